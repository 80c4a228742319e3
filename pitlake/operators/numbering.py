"""Global positions and running totals without one task for all rows.

A bucket expression that follows the order (say, the day of a time) splits the rows; each bucket is numbered
or summed by a window of its own, the totals of the buckets (one row each) are summed up in order, and every
row adds the total of the buckets before its own. Buckets are part of the key, so results do not depend
on how rows are partitioned.
"""

from __future__ import annotations

from math import ceil, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BEFORE = (Window.unboundedPreceding, -1)
_UPTO = (Window.unboundedPreceding, 0)


def _carried(df: DataFrame, by: list[str], bucket: Column, total, carry) -> DataFrame:
    """df with __b (its bucket) and __c (the totals of earlier buckets in its group)."""
    keyed = df.withColumn("__b", bucket)
    keys = [*by, "__b"]
    totals = keyed.groupBy(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)]).agg(total.alias("__t"))
    inner = [f"__k{i}" for i in range(len(by))]
    before = totals.withColumn("__c", carry("__t").over(Window.partitionBy(*inner).orderBy(f"__k{len(by)}").rowsBetween(*_BEFORE))).drop("__t")
    on = F.lit(True)
    for i, c in enumerate(keys):
        on &= F.col(c).eqNullSafe(F.col(f"__k{i}"))
    return keyed.join(before, on).drop(*[f"__k{i}" for i in range(len(keys))])


def even_buckets(df: DataFrame, column: str, buckets: int | None = None) -> Column:
    """A bucket number that does not fall along the column, with about as many rows in each: by approximate quantiles of it.

    Without a number there are as many as the root of the rows over 16, from 16 to 4,096: windows of buckets and the prefix over them grow alike.
    A row looks its bucket up among blocks of cuts, then in one block."""
    if buckets is None:
        buckets = min(4096, max(16, ceil(sqrt(df.count()) / 16)))
    cuts = [float(c) for c in sorted(set(df.approxQuantile(column, [k / buckets for k in range(1, buckets)], 1 / (4 * buckets))))]
    if not cuts:
        return F.lit(0)
    value, side = F.col(column).cast("double"), max(1, round(sqrt(len(cuts))))
    literal = lambda values: F.array(*[F.lit(v) for v in values])
    block = F.size(F.filter(literal(cuts[side - 1 :: side]), lambda c: c < value))
    inner = F.filter(F.slice(literal(cuts), block * side + 1, F.lit(side)), lambda c: c < value)
    return F.when(value.isNotNull(), block * side + F.size(inner)).otherwise(-1)


def number(df: DataFrame, order: list[Column], bucket: Column, name: str = "pos", by: list[str] = []) -> DataFrame:
    """Position from 0 in the whole order (within by). order must end with a unique column; bucket must not fall along it."""
    whole = _carried(df, by, bucket, F.count("*"), F.sum)
    local = F.row_number().over(Window.partitionBy(*by, "__b").orderBy(*order))
    return whole.withColumn(name, (F.coalesce("__c", F.lit(0)) + local - 1).cast("long")).drop("__b", "__c")


def running_sum(df: DataFrame, value: Column, order: list[Column], bucket: Column, name: str = "total", by: list[str] = []) -> DataFrame:
    """Running sum of value in the whole order (within by); decimals keep it exact."""
    whole = _carried(df.withColumn("__v", value), by, bucket, F.sum("__v"), F.sum)
    local = F.sum("__v").over(Window.partitionBy(*by, "__b").orderBy(*order).rowsBetween(*_UPTO))
    return whole.withColumn(name, F.coalesce("__c", F.lit(0)) + local).drop("__b", "__c", "__v")


def running_sums(df: DataFrame, values: dict[str, Column], order: list[Column], bucket: Column, by: list[str] = []) -> DataFrame:
    """running_sum() of several values in one pass, each under its name."""
    names = list(values)
    keyed = df.withColumns({f"__v{i}": values[n] for i, n in enumerate(names)})
    total = F.struct(*[F.sum(f"__v{i}").alias(f"s{i}") for i in range(len(names))])
    carry = lambda c: _Each({f"s{i}": F.sum(f"{c}.s{i}") for i in range(len(names))})
    whole = _carried(keyed, by, bucket, total, carry)
    window = Window.partitionBy(*by, "__b").orderBy(*order).rowsBetween(*_UPTO)
    sums = {n: F.coalesce(F.col(f"__c.s{i}"), F.lit(0)) + F.sum(f"__v{i}").over(window) for i, n in enumerate(names)}
    return whole.withColumns(sums).drop("__b", "__c", *[f"__v{i}" for i in range(len(names))])


class _Each:
    """Several aggregates that go over one window as a struct."""

    def __init__(self, parts: dict[str, Column]):
        self.parts = parts

    def over(self, window) -> Column:
        return F.struct(*[p.over(window).alias(n) for n, p in self.parts.items()])


def running_max(df: DataFrame, value: Column, order: list[Column], bucket: Column, name: str = "peak", by: list[str] = []) -> DataFrame:
    """Running maximum of value in the whole order (within by)."""
    whole = _carried(df.withColumn("__v", value), by, bucket, F.max("__v"), F.max)
    local = F.max("__v").over(Window.partitionBy(*by, "__b").orderBy(*order).rowsBetween(*_UPTO))
    return whole.withColumn(name, F.greatest("__c", local)).drop("__b", "__c", "__v")


def running_product(df: DataFrame, value: Column, order: list[Column], bucket: Column, name: str = "factor", by: list[str] = []) -> DataFrame:
    """Running product of value in the whole order (within by)."""
    whole = _carried(df.withColumn("__v", value), by, bucket, F.product("__v"), F.product)
    local = F.product("__v").over(Window.partitionBy(*by, "__b").orderBy(*order).rowsBetween(*_UPTO))
    return whole.withColumn(name, F.coalesce("__c", F.lit(1.0)) * local).drop("__b", "__c", "__v")


def sampled(pos: Column, n: Column, most: int) -> Column:
    """Whether a position of n is one of at most `most` even places round(i * (n - 1) / (most - 1)), halves to even; all of them up to `most`."""
    if most < 2:
        raise ValueError("two points at least")
    step = (n - 1) / F.lit(float(most - 1))
    near = F.rint(pos / F.when(step > 0, step))
    hit = F.lit(False)
    for k in (-1, 0, 1):
        i = near + k
        hit = hit | ((i >= 0) & (i < most) & (F.rint(i * step) == pos))
    return (n <= most) | hit
