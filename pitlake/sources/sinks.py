"""Tables out: partitioned parquet, canonical observations, reports, ledgers."""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the canonical observation table.
OBSERVATION = ("series_id", "natural_key", "period_start", "period_end", "value", "unit", "published_at", "observed_at", "reconstructed_at", "generation", "capture_id", "json")


def write_table(df: DataFrame, path: str, by: list[str] = [], allow_empty: bool = False) -> None:
    """Zstd parquet by partition columns; an empty frame is refused before anything is written."""
    if not allow_empty and df.isEmpty():
        raise ValueError("an empty table is not written")
    writer = df.write.mode("append").option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_lake(df: DataFrame, root: str, layer: str, dataset: str) -> int:
    """Df (coin, date as YYYYMMDD and others) as one zstd file a coin and day, <root>/<layer>/<dataset>/<COIN>/<date>.parquet; returns their number.

    An empty frame is refused. Tasks write folders of partitions beside the lake; the driver then gives each file its place, a rename a partition, so
    readers see whole files only. A file that is there is replaced."""
    from pitlake.sources.lake import lake_path

    lake_path(root, layer, dataset)  # refuses an unknown layer or dataset
    if df.isEmpty():
        raise ValueError("an empty table is not written")
    spark = df.sparkSession
    coin = F.replace(F.upper(F.trim("coin")), F.lit("/"), F.lit("-"))
    staged = f"{root}/{layer}/.staged-{uuid.uuid4().hex}"
    dealt = df.withColumn("__coin", coin).withColumn("__date", F.col("date")).repartition("__coin", "__date")
    dealt.drop("date").write.option("compression", "zstd").partitionBy("__coin", "__date").parquet(staged)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(staged).getFileSystem(spark._jsc.hadoopConfiguration())
    done = 0
    for found in fs.globStatus(path(f"{staged}/__coin=*/__date=*/*.parquet")):
        parts = found.getPath().toString().split("/")
        names = [unquote(x.split("=", 1)[1]) for x in parts[-3:-1]]
        to = path(f"{root}/{layer}/{dataset}/{names[0]}/{names[1]}.parquet")
        fs.mkdirs(to.getParent())
        fs.delete(to, False)
        done += bool(fs.rename(found.getPath(), to))
    fs.delete(path(staged), True)
    return done


def write_observations(df: DataFrame, path: str) -> DataFrame:
    """Canonical observations sorted within files, so that row-group statistics can skip; returns the manifest by generation."""
    rows = df.select(*OBSERVATION)
    rows.repartition("generation").sortWithinPartitions("series_id", "period_end").write.mode("append").option("compression", "zstd").partitionBy("generation").parquet(path)
    return rows.groupBy("generation").agg(F.count("*").alias("rows"), F.min("period_end").alias("first"), F.max("period_end").alias("last"))


def star_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Decisions, scores and events of nested reports, each as a table with the run and trial that it is of."""
    schema = """run_id string, trials array<struct<variant:string,
      decisions:array<struct<at:long,prediction:double,position:double>>, scores:array<struct<at:long,squared_error:double>>,
      account:struct<events:array<struct<at:long,kind:string,amount_micros:long>>>>>"""
    runs = spark.read.schema(schema).option("multiLine", "true").json(path).select("run_id", F.explode("trials").alias("t"))
    base = ["run_id", F.col("t.variant").alias("variant")]
    return {n: runs.select(*base, F.inline(f"t.{c}")) for n, c in (("decisions", "decisions"), ("scores", "scores"), ("events", "account.events"))}


def leaderboard_rows(board: DataFrame) -> DataFrame:
    """Numbers as text of twelve significant digits; a null number has its status in a column of its own."""
    numbers = [f.name for f in board.schema.fields if f.dataType.typeName() == "double"]
    text = {c: F.format_string("%.11e", F.col(c)).try_cast("double").cast("string") for c in numbers}
    status = F.array_join(F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in numbers])), ",")
    return board.select(*[text[c].alias(c) if c in text else F.col(c) for c in board.columns], status.alias("undefined"))


def write_leaderboard(board: DataFrame, path: str) -> None:
    """A CSV with a header."""
    leaderboard_rows(board).coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def write_events(events: DataFrame, path: str) -> None:
    """One JSON line for each event."""
    events.write.mode("append").json(path)


def write_reports(reports: DataFrame, path: str) -> None:
    """Reports (folder, value as JSON) as one text file a folder of <path>, each read back as a whole."""
    reports.repartition("folder").write.mode("append").partitionBy("folder").text(path)


def report_ledger(spark: SparkSession, path: str) -> DataFrame:
    """One row for each report of schema 2 (report.json files, and those of write_reports()): its best audited row, counts by status, newest first."""
    schema = "schema_version int, run_id string, created_ms long, leaderboard array<struct<policy:string,rank:int,lift:double,status:string>>"
    r = spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "{report.json,part-*}").json(path).where("schema_version = 2")
    audited = F.filter("leaderboard", lambda x: x["status"] == "audited")
    best = F.array_min(F.transform(audited, lambda x: F.struct(x["rank"].alias("rank"), x["policy"].alias("policy"), x["lift"].alias("lift"))))
    blocked = F.size(F.filter("leaderboard", lambda x: x["status"] == "blocked"))
    return r.select("run_id", "created_ms", best["policy"].alias("policy"), best["lift"].alias("lift"), F.size(audited).alias("audited"), blocked.alias("blocked")).orderBy(F.desc("created_ms"), "run_id")


def receipts(captures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(objects, receipts) of captures (url, first_seen_at, permission, content): the same bytes are one object with several receipts."""
    rows = captures.select("url", "first_seen_at", "permission", F.sha2("content", 256).alias("sha256"), F.length("content").alias("bytes"))
    return rows.groupBy("sha256").agg(F.max("bytes").alias("bytes"), F.min("first_seen_at").alias("first_seen_at")), rows


def public_view(points: DataFrame, mode: str, hidden: tuple[str, ...] = ("observed_at", "capture_id"), keys: tuple[str, ...] = ("fetched_at", "url", "etag", "receipt")) -> DataFrame:
    """A reconstructed view without what was learned by acquiring: some columns, and some keys of extras."""
    if mode != "reconstructed":
        return points
    out = points.drop(*hidden)
    return out.withColumn("extras", F.map_filter("extras", lambda k, _: ~k.isin(*keys))) if "extras" in out.columns else out
