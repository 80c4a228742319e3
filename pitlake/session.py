"""Session settings and table access shared by the queries."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pitlake")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir, or, where that is unset in a local session, a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.pitlake.shared.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-pitlake-")
        spark.conf.set("spark.pitlake.shared.dir", root)
    return f"{root}/pitlake-{name}-{uuid.uuid4().hex}"


#: Tables that kept() has written in this process and release() has not deleted.
_KEPT: list[str] = []


def kept(df: DataFrame) -> DataFrame:
    """df written once as parquet to scratch() and read from there, column by column: lost executors cost no recomputation."""
    path = scratch(df.sparkSession, "kept")
    _KEPT.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete what kept() has written in this process, once what reads it is stored; returns the number of tables."""
    jvm, done = spark._jvm, 0
    while _KEPT:
        path = jvm.org.apache.hadoop.fs.Path(_KEPT.pop())
        done += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return done


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
