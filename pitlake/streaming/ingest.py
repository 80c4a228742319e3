"""Incremental ingestion of revisions with Structured Streaming.

The table is append-only and decides what is new: a batch is compared with it, not with a window of state, so
a correction that comes late is a row like any other. Offsets are the query's checkpoint. The batch number is the
generation, and a batch that is run again after a failure replaces what it had written. Stores are laid out by
a hash of the key, so a batch reads the folders of its own keys and not all history.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pitlake.functions.scalars import semantic_id


#: Folders of keys in a version store. A batch reads those that its keys hash to, of each generation.
BUCKETS = 64


def bucket_of(key: list[str], buckets: int = BUCKETS) -> Column:
    """The folder of a key: a hash of its columns as text, so that it does not depend on their types."""
    return F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in key]), F.lit(buckets)).cast("int").alias("bucket")


def stored_for(batch: DataFrame, path: str, like: DataFrame, before: int, key: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Stored rows, of earlier generations than `before`, that can share a key with the batch; an empty frame if there are none.

    A store is path/generation=<n>/bucket=<hash of key>/. The buckets of the batch, a bounded set of small numbers, are a condition on folders, so the scan
    opens no other; within one, rows are sorted by key, so that keys outside a row group's range are left out too."""
    from pyspark.errors import AnalysisException

    spark = batch.sparkSession
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema.fields) + ", generation long, bucket int"
    touched = sorted(r[0] for r in batch.select(bucket_of(key, buckets)).distinct().collect())
    try:
        found = spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    return found.where((F.col("generation") < before) & F.col("bucket").isin(touched))


def write_generation(df: DataFrame, path: str, generation: int, key: list[str], buckets: int = BUCKETS) -> None:
    """Write one generation's folder, by buckets of keys; running a batch again overwrites it."""
    dealt = df.withColumn("bucket", bucket_of(key, buckets)).repartition("bucket").sortWithinPartitions("bucket", *key)
    dealt.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/generation={generation}")


def compact(spark: SparkSession, path: str, to: str, like: DataFrame, key: list[str], buckets: int = BUCKETS) -> None:
    """Copy a store to another folder as one generation, the last of it, with one file a bucket; readers then take `to`.

    Rows keep the generation that brought them as first_generation."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema.fields) + ", generation long, bucket int"
    rows = spark.read.schema(schema).parquet(path)
    last = rows.agg(F.max("generation")).first()[0]
    if last is not None:
        write_generation(rows.withColumnRenamed("generation", "first_generation").drop("bucket"), to, last, key, buckets)


def new_versions(batch: DataFrame, stored: DataFrame, content: list[str], key: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose semantic id is new, and rows of keys that give one (key, order) two contents.

    A conflicting row is not stored; a repeat of stored or batch content is no new version."""
    ids = batch.withColumn("semantic_id", semantic_id([*key, order, *content])).dropDuplicates(["semantic_id"])
    fresh = ids.join(stored.select("semantic_id"), "semantic_id", "left_anti")
    both = fresh.select(*key, order, "semantic_id").unionByName(stored.select(*key, order, "semantic_id"))
    clash = both.where(F.col(order).isNotNull()).groupBy(*key, order).agg(F.count_distinct("semantic_id").alias("n")).where("n > 1").drop("n")
    return fresh.join(clash, [*key, order], "left_anti"), fresh.join(clash, [*key, order], "left_semi")


def version_sink(path: str, quarantine: str, content: list[str], key: list[str], order: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends new versions under the batch's generation and sets conflicts aside."""

    def write(batch: DataFrame, number: int) -> None:
        like = batch.withColumn("semantic_id", F.lit(""))
        good, bad = new_versions(batch, stored_for(batch, path, like, number, key, buckets), content, key, order)
        write_generation(good.select(*like.columns), path, number, key, buckets)
        write_generation(bad.select(*like.columns), quarantine, number, key, buckets)

    return write


def changed_metadata(batch: DataFrame, stored: DataFrame, key: str, content: list[str], time: str) -> DataFrame:
    """Rows whose content differs from the one before, in the batch or stored (slowly changing, type 2)."""
    rows = batch.withColumn("content_id", semantic_id(content))
    last = stored.groupBy(key).agg(F.max_by("content_id", time).alias("__last"))
    before = F.lag("content_id").over(Window.partitionBy(key).orderBy(time, "content_id"))
    seen = rows.withColumn("__before", before).join(last, key, "left")
    return seen.where(~F.coalesce("__before", "__last").eqNullSafe(F.col("content_id"))).drop("__before", "__last")


def metadata_sink(path: str, key: str, content: list[str], time: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends changed metadata only."""

    def write(batch: DataFrame, number: int) -> None:
        like = batch.withColumn("content_id", F.lit(""))
        out = changed_metadata(batch, stored_for(batch, path, like, number, [key], buckets), key, content, time)
        write_generation(out.select(*like.columns), path, number, [key], buckets)

    return write


def run_available(spark: SparkSession, source: str, schema: str, checkpoint: str, sink: Callable[[DataFrame, int], None], files_a_batch: int = 1, thin: tuple[str, str, list[str]] | None = None) -> None:
    """Take in the files that are there and stop; a later call goes on where the checkpoint says.

    thin: (arrival column, delay, content columns): repeats within the delay of arrival are dropped before the sink (R08). It bounds
    state only; the sink still decides."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(source)
    if thin:
        arrival, delay, content = thin
        stream = stream.withColumn("__id", semantic_id(content)).withWatermark(arrival, delay).dropDuplicatesWithinWatermark(["__id"]).drop("__id")
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()


def reconcile_totals(pages: DataFrame) -> DataFrame:
    """Runs (run, cursor, rows, total) in which a cursor comes twice or the rows differ from the advertised total."""
    g = pages.groupBy("run").agg(F.count("*").alias("pages"), F.count_distinct("cursor").alias("cursors"), F.sum("rows").alias("rows"), F.max("total").alias("total"))
    status = F.when(F.col("pages") != F.col("cursors"), "cursor_repeats").when(F.col("rows") != F.col("total"), "rows_differ").otherwise("ok")
    return g.withColumn("status", status)


def overlap(rows: DataFrame, time: str, last: int, days: int) -> DataFrame:
    """Rows of the trailing days before the last known time, to be taken in again; only changed versions then count."""
    return rows.where((F.col(time) > last - days * 86_400_000_000) & (F.col(time) <= last))


class _View(StatefulProcessor):
    """A symbol's clock and its quotes of the last `keep` units of time, with the one before them."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.clock = handle.getValueState("clock", "t long")
        self.quotes = handle.getValueState("quotes", "t array<long>, seq array<long>, mid array<double>")

    def handleInputRows(self, key, rows, timerValues):
        rows = pd.concat(list(rows))
        # a symbol's rows of one batch in order of time, quotes before the events of their time
        rows = rows.assign(is_event=rows["asked"].notna()).sort_values(["t", "is_event", "seq"], kind="stable")
        clock = self.clock.get()[0] if self.clock.exists() else None
        t, seq, mid = (list(x) for x in self.quotes.get()) if self.quotes.exists() else ([], [], [])
        forgot, out = clock is not None and bool(t) and t[0] < clock - self.keep, []
        began = clock
        for r in rows.itertuples(index=False):
            if began is not None and r.t < began:  # the clock does not go back
                if r.is_event:
                    out.append((key[0], r.seq, r.t, int(r.asked), None, None, "behind_clock"))
                continue
            clock = r.t
            if not r.is_event:
                t.append(r.t), seq.append(r.seq), mid.append(r.mid)
                continue
            asked = int(r.asked)
            if asked > clock:
                out.append((key[0], r.seq, r.t, asked, None, None, "future"))
                continue
            k = bisect_right(t, asked) - 1
            if asked < clock - self.keep and (k < 0 or forgot):
                out.append((key[0], r.seq, r.t, asked, None, None, "forgotten"))
            else:
                out.append((key[0], r.seq, r.t, asked, seq[k] if k >= 0 else None, mid[k] if k >= 0 else None, "quote" if k >= 0 else "no_quote"))
        if clock is not None:
            first = max(0, bisect_right(t, clock - self.keep) - 1)
            self.clock.update((int(clock),))
            self.quotes.update(([int(x) for x in t[first:]], [int(x) for x in seq[first:]], [float(x) for x in mid[first:]]))
        if out:
            found = pd.DataFrame(out, columns=["symbol", "seq", "t", "asked", "quote_seq", "mid", "status"])
            yield found.astype({"quote_seq": "Int64", "mid": "Float64"})

    def close(self) -> None:
        pass


def replay(events: DataFrame, quotes: DataFrame, keep: int) -> DataFrame:
    """Streams of events (symbol, seq, t) and quotes (symbol, seq, t, mid): one row an event with the last quote as of `asked`.

    events may have `asked`, the time that is looked at, else their own t. Each symbol has a clock, the latest time replayed; status says quote, no_quote,
    future (asked lies beyond the event's own time), behind_clock (the event comes in a later batch than events after it, as do late quotes, which are not
    taken in) or forgotten (asked is before what the state keeps: `keep` units before the clock and the quote at their start). Times are whole numbers.
    State is one row a symbol. Batches must come in order of time, as files of a replay do. Batch form: asof_join()."""
    asked = F.col("asked") if "asked" in events.columns else F.col("t")
    e = events.select(F.col("symbol").cast("string"), F.col("seq").cast("long"), F.col("t").cast("long"), asked.cast("long").alias("asked"), F.lit(None).cast("double").alias("mid"))
    q = quotes.select(F.col("symbol").cast("string"), F.col("seq").cast("long"), F.col("t").cast("long"), F.lit(None).cast("long").alias("asked"), F.col("mid").cast("double"))
    out = "symbol string, seq long, t long, asked long, quote_seq long, mid double, status string"
    return e.unionByName(q).groupBy("symbol").transformWithStateInPandas(_View(keep), out, "Append", "None")


#: What stateful processors need of a session.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def known_at(versions: DataFrame, t: int, keys: list[str], ready: str, order: list[str]) -> DataFrame:
    """Latest version of each key that was ready at t; what comes later cannot change it."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return versions.where(F.col(ready) <= t).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
