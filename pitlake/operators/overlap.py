"""Interval overlap as an equality join on time buckets, and the purge rule of walk-forward folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _buckets(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    return df.withColumn("__b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))


def overlapping(left: DataFrame, right: DataFrame, by: list[str], start: str, end: str, width: int) -> DataFrame:
    """The left rows whose closed interval meets any right one of the same key.

    Both sides are dealt to the buckets that they touch, so that the condition is tested within (key, bucket) only."""
    keys = [*by, "__b"]
    r = _buckets(right.select(*by, start, end), start, end, width).select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)], F.col(start).alias("__s"), F.col(end).alias("__e"))
    l = _buckets(left, start, end, width)
    on = (F.col(start) <= F.col("__e")) & (F.col("__s") <= F.col(end))
    for i, c in enumerate(keys):
        on &= F.col(c) == F.col(f"__k{i}")
    met = l.join(r, on, "left_semi")
    return met.drop("__b").dropDuplicates(left.columns)


def within(points: DataFrame, spans: DataFrame, by: list[str], time: str, start: str, end: str, width: int, closed: bool = True) -> DataFrame:
    """Point rows joined to the spans that hold them: start < time <= end (closed), or start <= time < end."""
    s = _buckets(spans, start, end, width).withColumnRenamed("__b", "__w").withColumnsRenamed({c: f"__k{i}" for i, c in enumerate(by)})
    p = points.withColumn("__b", F.floor(F.col(time) / width))
    inside = (F.col(time) > F.col(start)) & (F.col(time) <= F.col(end)) if closed else (F.col(time) >= F.col(start)) & (F.col(time) < F.col(end))
    on = (F.col("__b") == F.col("__w")) & inside
    for i, c in enumerate(by):
        on &= F.col(c) == F.col(f"__k{i}")
    return p.join(s, on).drop("__w", "__b", *[f"__k{i}" for i in range(len(by))])


def purged(start: Column, end: Column, test_start: Column, test_end: Column, purge: int, embargo: int) -> Column:
    """What a training sample must satisfy, both bounds strict."""
    return (end < test_start - purge) | (start > test_end + embargo)
