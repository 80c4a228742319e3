"""Helpers that several corpus operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitlake.session import table  # noqa: F401  (re-exported for the operators)

#: Words are maximal runs of other characters than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary folder; a cluster is refused, since each machine would
    write its part to its own disk."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.pitlake.shared.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-pitlake-")
        spark.conf.set("spark.pitlake.shared.dir", path)
    return path


#: Paths that cut() has written in this process and release() has not deleted.
_WRITTEN: list[str] = []


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df as a table in the shared folder and read it back, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pitlake-{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> list[str]:
    """Paths of the tables that release() would delete."""
    return list(_WRITTEN)


def release(spark: SparkSession, paths: list[str] | None = None) -> int:
    """Delete tables that cut() wrote in this process (all, or those of paths), once what reads them is stored; returns their number."""
    jvm, done = spark._jvm, 0
    for name in written() if paths is None else paths:
        _WRITTEN.remove(name)
        path = jvm.org.apache.hadoop.fs.Path(name)
        done += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return done


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores put before it until no column of df is called so in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def holdout(doc_id: Column) -> Column:
    """True for the documents that no model learns from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces whose texts sum to about most_bytes; one longer text is a piece of its own."""
    for batch in batches:
        n, start, held = batch.num_rows, 0, 0
        sizes = batch.column(column)
        lengths = pc.fill_null(pc.binary_length(sizes), 0).to_numpy(zero_copy_only=False)
        for i in range(n):
            if held and held + lengths[i] > most_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(lengths[i])
        if n > start:
            yield batch.slice(start)
