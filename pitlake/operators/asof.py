"""As-of joins as one sorted pass: union, then the last right row seen in a window.

Both sides are put in one frame and sorted by (key, bucket, time); the last right row so far is carried to each
left row. A bucket of time bounds a window's rows for a busy key: the last right row of each earlier bucket comes from a
frame of one row per key and bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, take: list[str], *, forward: bool = False, strict: bool = False, ties: list[str] = [], width: int | None = None, prefix: str = "") -> DataFrame:
    """J01 (forward), J02/J03 (backward): each left row with the columns `take` of its right row; null where none.

    Times are long integers. Backward takes the last right row with time <= left time, forward the first with time >= left time;
    strict excludes equal times. Of right rows at one time, ties orders them: backward takes the last, forward the
    first. width: bucket in units of time. Left rows with a null time match nothing; right rows with one are not seen."""
    rows = left.select(*[F.col(c) for c in by], F.col(left_time).alias("__t"), F.struct(*[F.col(c) for c in left.columns]).alias("__l"), F.lit(None).alias("__r"))
    payload = F.struct(*[F.col(c).alias(f"__{i}") for i, c in enumerate(take)])
    tie = [F.col(c) for c in ties]
    seen = right.where(F.col(right_time).isNotNull()).select(*[F.col(c) for c in by], F.col(right_time).alias("__t"), F.lit(None).alias("__l"), payload.alias("__r"), F.struct(F.lit(0), *tie).alias("__k"))
    rows = rows.withColumn("__r", F.col("__r").cast(seen.schema["__r"].dataType)).withColumn("__k", F.lit(None).cast(seen.schema["__k"].dataType))
    seen = seen.withColumn("__l", F.lit(None).cast(rows.schema["__l"].dataType))
    # at equal times right rows come first, unless they are not to be seen
    both = rows.unionByName(seen).withColumn("__s", F.col("__r").isNull() if not strict else F.col("__r").isNotNull())
    both = both.withColumn("__b", F.coalesce(F.floor(F.col("__t") / width).cast("long"), F.lit(-(1 << 63))) if width else F.lit(0).cast("long"))
    up = (lambda c: F.col(c).desc_nulls_last()) if forward else (lambda c: F.col(c).asc_nulls_first())
    order = [up("__t"), F.col("__s").asc(), up("__k")]
    near = F.last("__r", ignorenulls=True).over(Window.partitionBy(*by, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("__n", near)
    if width:
        pick, keys = F.min_by if forward else F.max_by, [*by, "__b"]
        # one row for each key and bucket, with its own last right row, then with that of the buckets before
        ends = both.groupBy(*keys).agg(pick("__r", F.when(F.col("__r").isNotNull(), F.struct("__t", "__k"))).alias("__e"))
        step = F.col("__b").desc() if forward else F.col("__b").asc()
        carry = F.last("__e", ignorenulls=True).over(Window.partitionBy(*by).orderBy(step).rowsBetween(Window.unboundedPreceding, -1))
        carried = ends.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)], carry.alias("__c"))
        on = F.lit(True)
        for i, c in enumerate(keys):
            on &= F.col(c).eqNullSafe(F.col(f"__k{i}"))
        found = found.join(carried, on).withColumn("__n", F.coalesce("__n", "__c"))
    found = found.where(F.col("__l").isNotNull()).withColumn("__n", F.when(F.col("__t").isNotNull(), F.col("__n")))
    return found.select("__l.*", *[F.col(f"__n.__{i}").alias(prefix + c) for i, c in enumerate(take)])


def trailing_values(df: DataFrame, by: list[str], time: str, width: int, values: dict[str, Column], bucket: int | None = None) -> DataFrame:
    """Df with sums of the values, integers or decimals, over the rows of its key with time in [t - width, t], both ends inclusive; null where all are null.

    A row enters at its time and leaves just after width more, so a sum is the running one of what has entered and left: each row is added once and taken
    away once, however many share its span. Rows are dealt to buckets of time of at least `width`; a row that is still in at a bucket's end enters the
    next one too, so a busy key is many windows."""
    size, own = max(width, bucket or width), [f"__v{i}" for i in range(len(values))]
    at, leaves = F.col("__t"), F.col("__t") + width + 1
    b, last = F.floor(at / size), F.floor(leaves / size)
    event = lambda here, when, sign, row: F.struct(here.alias("b"), when.alias("at"), F.lit(sign).alias("sign"), row.alias("row"))
    none = F.lit(None).cast(df.schema)
    events = [event(b, at, 1, F.col("__row")), F.when(last > b, event(b + 1, at, 1, none)), F.when(last <= b + 1, event(last, leaves, -1, none))]
    rows = df.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], F.col(time).alias("__t"), F.struct(*df.columns).alias("__row"), *[c.alias(n) for n, c in zip(own, values.values(), strict=True)])
    keys = [f"__k{i}" for i in range(len(by))]
    moves = rows.select(*keys, *own, F.explode(F.array_compact(F.array(*events))).alias("__e"))
    window = Window.partitionBy(*keys, "__e.b").orderBy("__e.at").rangeBetween(Window.unboundedPreceding, 0)
    sums = [F.when(F.sum(F.when(F.col(v).isNotNull(), F.col("__e.sign"))).over(window) > 0, F.sum(F.col("__e.sign") * F.col(v)).over(window)).alias(n) for n, v in zip(values, own, strict=True)]
    return moves.select("__e.row", *sums).where("row is not null").select("row.*", *values)


def lookahead_violations(joined: DataFrame, taken: str) -> DataFrame:
    """Rows whose backward join found nothing, which a point-in-time feature must not be built from."""
    return joined.where(F.col(taken).isNull())


def expand(df: DataFrame, start: Column, end: Column, step: Column, name: str) -> DataFrame:
    """One row for each due time start, start + step, ... up to end."""
    return df.withColumn(name, F.explode(F.sequence(start, end, step)))
