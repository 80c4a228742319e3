"""Dependence statistics of aligned series, p-value families and scored predictions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitlake.operators.numbering import even_buckets, number, running_max, running_sum


def correlation(x: Column, y: Column, least: int = 3) -> Column:
    """Pearson over rows where both are set, clamped to [-1, 1]; null for fewer than three or a constant side."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    r = F.try_divide(F.covar_pop(a, b), F.when(spread > 0, spread))
    return F.when(F.count(a) >= least, clamped(r))


def clamped(r: Column) -> Column:
    """Within [-1, 1]; null stays null, which greatest() and least() alone would skip."""
    return F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def average_rank(value: str, by: list[str]) -> Column:
    """Rank within by, ties at their mean."""
    ties = F.count(value).over(Window.partitionBy(*by, value))
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (ties - 1) / 2


def duplicate_spans(points: DataFrame, span: list[str]) -> DataFrame:
    """Spans that a series has twice; they must stop an alignment."""
    return points.groupBy("series", *span).agg(F.count("*").alias("n")).where("n > 1")


def common_spans(points: DataFrame, series: list, span: list[str]) -> DataFrame:
    """Spans that all of the series have a value for; nothing is filled in."""
    some = points.where(F.col("series").isin(series) & F.col("value").isNotNull())
    return some.groupBy(*span).agg(F.count_distinct("series").alias("n")).where(F.col("n") == len(set(series))).drop("n")


def align(points: DataFrame, series: list, span: list[str]) -> DataFrame:
    """One row for each common span, one column s_<series> for each series."""
    some = points.where(F.col("series").isin(series) & F.col("value").isNotNull())
    columns = [F.max(F.when(F.col("series") == s, F.col("value"))).alias(f"s_{s}") for s in series]
    return some.groupBy(*span).agg(*columns).dropna()


def transform(points: DataFrame, how: str, order: list[str]) -> DataFrame:
    """Level, change or log_return between consecutive rows of a series; a null on either side breaks the chain, and
    a log needs both positive."""
    before = F.lag("value").over(Window.partitionBy("series").orderBy(*order))
    if how == "level":
        out = F.col("value")
    elif how == "change":
        out = F.col("value") - before
    elif how == "log_return":
        out = F.when((F.col("value") > 0) & (before > 0), F.log(F.col("value") / before))
    else:
        raise ValueError(f"no such transform: {how}")
    return points.withColumn("value", out)


def pairs(points: DataFrame, span: list[str]) -> DataFrame:
    """Every pair of series a < b on the spans that both have: a, b, span, x, y."""
    some = points.where(F.col("value").isNotNull())
    l = some.select(F.col("series").alias("a"), *span, F.col("value").alias("x"))
    r = some.select(F.col("series").alias("b"), *[F.col(c).alias(f"__{c}") for c in span], F.col("value").alias("y"))
    on = F.col("a") < F.col("b")
    for c in span:
        on &= F.col(c) == F.col(f"__{c}")
    return l.join(r, on).select("a", "b", *span, "x", "y")


def pair_table(paired: DataFrame) -> DataFrame:
    """N, Pearson and Spearman of every pair."""
    ranked = paired.withColumn("rx", average_rank("x", ["a", "b"])).withColumn("ry", average_rank("y", ["a", "b"]))
    return ranked.groupBy("a", "b").agg(F.count("*").alias("n"), correlation(F.col("x"), F.col("y")).alias("pearson"), correlation(F.col("rx"), F.col("ry")).alias("spearman"))


def lagged(paired: DataFrame, order: list[str], most: int, least: int = 6) -> DataFrame:
    """Pearson of x at i with y at i + lag, lags -most..most, null with fewer than `least` rows."""
    at = F.row_number().over(Window.partitionBy("a", "b").orderBy(*order))
    rows = paired.select("a", "b", "x", "y", at.alias("i"))
    l = rows.select("a", "b", "x", "i").withColumn("lag", F.explode(F.sequence(F.lit(-most), F.lit(most)))).withColumn("j", F.col("i") + F.col("lag"))
    r = rows.select(F.col("a").alias("__a"), F.col("b").alias("__b"), F.col("i").alias("__i"), "y")
    joined = l.join(r, (F.col("a") == F.col("__a")) & (F.col("b") == F.col("__b")) & (F.col("j") == F.col("__i")))
    return joined.groupBy("a", "b", "lag").agg(F.count("*").alias("n"), correlation(F.col("x"), F.col("y"), least).alias("pearson"))


def rolling(paired: DataFrame, order: list[str], width: int) -> DataFrame:
    """Pearson and Spearman over each window of `width` rows; null where undefined."""
    w = Window.partitionBy("a", "b").orderBy(*order)
    rows = paired.withColumn("i", F.row_number().over(w)).withColumn("near", F.collect_list(F.struct("i", "x", "y")).over(w.rowsBetween(1 - width, 0))).where(F.size("near") == width)
    flat = rows.select("a", "b", F.col("i").alias("end"), F.inline(F.col("near")))
    by = ["a", "b", "end"]
    ranked = flat.withColumn("rx", average_rank("x", by)).withColumn("ry", average_rank("y", by))
    return ranked.groupBy(*by).agg(correlation(F.col("x"), F.col("y")).alias("pearson"), correlation(F.col("rx"), F.col("ry")).alias("spearman"))


def exponential(paired: DataFrame, order: list[str], alpha: float) -> DataFrame:
    """Correlation with weights (1 - alpha)^(rows after); centred in a second pass over the same partitions."""
    back = F.row_number().over(Window.partitionBy("a", "b").orderBy(*[F.col(c).desc() for c in order])) - 1
    rows = paired.withColumn("w", F.pow(F.lit(1 - alpha), back))
    whole = Window.partitionBy("a", "b")
    for c in ("x", "y"):
        rows = rows.withColumn(f"m{c}", F.sum(F.col("w") * F.col(c)).over(whole) / F.sum("w").over(whole))
    dx, dy, w = F.col("x") - F.col("mx"), F.col("y") - F.col("my"), F.col("w")
    spread = F.sqrt(F.sum(w * dx * dx) * F.sum(w * dy * dy))
    r = F.try_divide(F.sum(w * dx * dy), F.when(spread > 0, spread))
    return rows.groupBy("a", "b").agg(F.when(F.count("*") >= 3, clamped(r)).alias("ew_correlation"))


def _below(rank: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each place, the sums of each row of weights over earlier places of smaller rank (ranks are all different).

    Runs are merged as in a merge sort: in each merged run the places of its second half take the running sums of its first half's, by rank."""
    n = len(rank)
    place, out, size = np.arange(n), np.zeros(weights.shape), 1
    while size < n:
        run, first = place // (2 * size), place // size % 2 == 0
        order = np.argsort(run * n + rank)
        own = np.where(first[order], weights[:, order], 0.0)
        upto = np.cumsum(own, axis=1)
        starts = run[order] * (2 * size)
        late = ~first[order]
        out[:, order[late]] += (upto - (upto - own)[:, starts])[:, late]
        size *= 2
    return out


def _distance(x: np.ndarray, y: np.ndarray) -> float | None:
    """A29 in n log^2 n time and linear memory; None for fewer than three rows or numbers that are not finite."""
    n = len(x)
    if n < 3 or not (np.isfinite(x).all() and np.isfinite(y).all()):
        return None
    sides = []
    for v in (x, y):
        v = v - v.mean()
        v = v / (np.abs(v).max() or 1.0)
        order = np.argsort(v, kind="stable")
        s, k = v[order], np.arange(n)
        row = np.empty(n)
        row[order] = s * (2 * k - n) + s.sum() - 2 * (np.cumsum(s) - s)  # distances of each row to all
        sides.append((v, row, 2 * n * (v * v).sum() - 2 * v.sum() ** 2))
    (x, a, aa), (y, b, bb) = sides
    order = np.lexsort((y, x))
    u, v = x[order], y[order]
    rank = np.empty(n, np.int64)
    rank[np.argsort(v, kind="stable")] = np.arange(n)
    parts = np.stack([np.ones(n), u, v, u * v])
    less, every = _below(rank, parts), np.cumsum(parts, axis=1) - parts
    m = 2 * less - every  # earlier rows, those with a smaller y less the others
    ab = 2 * (m[0] * u * v - u * m[2] - v * m[1] + m[3]).sum()
    centred = lambda whole, p, q: whole / n**2 - 2 * (p * q).sum() / n**3 + p.sum() * q.sum() / n**4
    vx, vy = centred(aa, a, a), centred(bb, b, b)
    return float(min(1.0, np.sqrt(max(0.0, centred(ab, a, b) / np.sqrt(vx * vy))))) if vx > 0 and vy > 0 else 0.0


def distance_correlation(paired: DataFrame) -> DataFrame:
    """(a, b, distance_correlation) of every pair, null with fewer than three rows or with a number that is not finite.

    Products of distances are summed over sorted ranks, never as a grid; a pair's two columns are one task's group."""
    import pyarrow as pa

    kinds = dict(paired.dtypes)

    def told(rows: pa.Table) -> pa.Table:
        x, y = (rows.column(c).to_numpy().astype(float) for c in ("x", "y"))
        return pa.table([rows.column("a").slice(0, 1), rows.column("b").slice(0, 1), pa.array([_distance(x, y)], pa.float64())], ["a", "b", "distance_correlation"])

    return paired.select("a", "b", "x", "y").groupBy("a", "b").applyInArrow(told, f"a {kinds['a']}, b {kinds['b']}, distance_correlation double")


def shift_null(paired: DataFrame, order: list[str], least: int = 20, most: int = 400) -> DataFrame:
    """|Pearson| against that of every rotation of y; p is the share of rotations, with the identity, as large.

    Every rotation meets every row, so a pair with more than `most` rows has no test, nor one with fewer than `least`: nulls, and the reason as state."""
    rows = paired.withColumn("n", F.count("*").over(Window.partitionBy("a", "b"))).where((F.col("n") >= least) & (F.col("n") <= most)).withColumn("i", F.row_number().over(Window.partitionBy("a", "b").orderBy(*order)) - 1)
    l = rows.withColumn("shift", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("j", (F.col("i") + F.col("shift")) % F.col("n"))
    r = rows.select(F.col("a").alias("__a"), F.col("b").alias("__b"), F.col("i").alias("__i"), F.col("y").alias("z"))
    turned = l.join(r, (F.col("a") == F.col("__a")) & (F.col("b") == F.col("__b")) & (F.col("j") == F.col("__i")))
    each = turned.groupBy("a", "b", "shift").agg(F.abs(correlation(F.col("x"), F.col("z"))).alias("r"))
    own = F.max(F.when(F.col("shift") == 0, F.col("r"))).over(Window.partitionBy("a", "b"))
    tested = each.withColumn("statistic", own)
    tested = tested.groupBy("a", "b").agg(F.max("statistic").alias("statistic"), F.count("*").alias("shifts"), (F.count_if(F.col("r") >= F.col("statistic") - 1e-14) / F.count("*")).alias("p_value"))
    every = paired.groupBy("a", "b").agg(F.count("*").alias("n"))
    state = F.when(F.col("n") < least, "too_few_rows").when(F.col("n") > most, "too_many_rows").otherwise("completed")
    return every.join(tested, ["a", "b"], "left").select("a", "b", "statistic", F.coalesce("shifts", F.lit(0)).alias("shifts"), "p_value", state.alias("state"))


def adjust(p_values: DataFrame, method: str, unique: str, buckets: int | None = None) -> DataFrame:
    """Benjamini-Hochberg or Benjamini-Yekutieli over the whole family, as adjusted. p outside [0, 1] raises.

    Ranks and the running minimum from the largest p down go by buckets of p with about as many rows each, so the family needs no single task."""
    if method not in ("BH", "BY"):
        raise ValueError(f"no such method: {method}")
    p = F.when((F.col("p") >= 0) & (F.col("p") <= 1), F.col("p")).otherwise(F.raise_error(F.lit("a p-value is outside 0 to 1")))
    rows = p_values.withColumn("p", p)
    bucket = even_buckets(p_values, "p", buckets)
    ranked = number(rows, [F.col("p"), F.col(unique)], bucket, "__k")
    n = rows.agg(F.count("*").alias("__n"))
    ranked = ranked.crossJoin(F.broadcast(n))
    # harmonic number: sum over 1..n, made by Spark for any n
    scale = F.lit(1.0)
    if method == "BY":
        spark = rows.sparkSession
        total = rows.count()
        scale = F.lit(spark.range(1, total + 1).agg(F.sum(1.0 / F.col("id"))).first()[0] if total else 1.0)
    raw = F.col("p") * F.col("__n") * scale / (F.col("__k") + 1)
    low = running_max(ranked.withColumn("__raw", raw), -F.col("__raw"), [F.col("p").desc(), F.col(unique).desc()], -bucket, "__m")
    return low.withColumn("adjusted", F.least(F.lit(1.0), -F.col("__m"))).drop("__k", "__n", "__raw", "__m")


def ledoit_wolf(matrix: DataFrame, columns: list[str]) -> DataFrame:
    """(i, j, covariance, partial, shrinkage) of at most 64 columns; rows with a null or non-finite value are left out.

    Two passes: means, then centred products and the mean of squared squared norms, summed in numpy within each task. The driver
    finishes the columns x columns matrix only."""
    p = len(columns)
    if not 0 < p <= 64:
        raise ValueError("1 to 64 columns")
    good = F.lit(True)
    for c in columns:
        good &= F.col(c).isNotNull() & ~F.isnan(F.col(c)) & (F.abs(F.col(c)) != float("inf"))
    rows = matrix.where(good).select(*[F.col(c).cast("double") for c in columns])
    first = rows.agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in columns]).first()
    n = first["n"]
    if n < 3:
        raise ValueError("three rows at least")
    mean = np.array([first[c] for c in columns])

    def summed(batches):
        import pyarrow as pa

        total = np.zeros(p * p + 1)
        for batch in batches:
            z = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns]) - mean
            total += np.append(z.T @ z, ((z * z).sum(1) ** 2).sum())
        yield pa.record_batch([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["k", "v"])

    # one matrix of sums a task; the products of thousands of pairs are beyond one generated aggregate
    sums = np.zeros(p * p + 1)
    for r in rows.mapInArrow(summed, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        sums[r.k] = r.v / n
    s, fourth = sums[:-1].reshape(p, p), sums[-1]
    mu = np.trace(s) / p
    if mu <= 0:
        raise ValueError("no variance")
    delta = ((s - mu * np.eye(p)) ** 2).sum() / p
    beta = min(max((fourth - (s**2).sum()) / (p * n), 0.0), delta)
    shrink = min(1.0, beta / delta) if delta > 0 else 0.0
    cov = (1 - shrink) * s + shrink * mu * np.eye(p)
    prec = np.linalg.inv(cov)
    partial = lambda i, j: None if s[i, i] <= 0 or s[j, j] <= 0 else 1.0 if i == j else float(np.clip(-prec[i, j] / np.sqrt(prec[i, i] * prec[j, j]), -1, 1))
    out = [(i, j, float(cov[i, j]), partial(i, j), float(shrink)) for i in range(p) for j in range(p)]
    return matrix.sparkSession.createDataFrame(out, "i int, j int, covariance double, partial double, shrinkage double")


_MASK = (1 << 64) - 1


def _xorshift(state: int) -> int:
    """The next state of the 64-bit xorshift generator with shifts 13, 7 and 17."""
    state ^= (state << 13) & _MASK
    state ^= state >> 7
    return state ^ (state << 17) & _MASK


def _jump(columns: list[int], state: int) -> int:
    """A linear map over bits, given by the images of the single bits, applied to a state."""
    out = 0
    while state:
        low = state & -state
        out ^= columns[low.bit_length() - 1]
        state ^= low
    return out


def xorshift_starts(spark: SparkSession, n: int, block: int, repeats: int, seed: int) -> DataFrame:
    """(rep, k, start): block starts of the moving-block bootstrap from one stream of a 64-bit xorshift generator.

    The generator is linear over bits, so the state with which each repeat begins is found by jumps on the driver (one
    number a repeat); the repeats' blocks are then drawn in tasks."""
    each = -(-n // block)
    jump, power, left = [1 << k for k in range(64)], [_xorshift(1 << k) for k in range(64)], each
    while left:  # jump = each steps at once, by squaring
        if left & 1:
            jump = [_jump(power, c) for c in jump]
        power, left = [_jump(power, c) for c in power], left >> 1
    states, state = [], max(1, seed)
    for rep in range(repeats):
        states.append((rep, state - (1 << 64) if state >> 63 else state))
        state = _jump(jump, state)

    def drawn(batches):
        import pyarrow as pa

        for b in batches:
            for rep, first in zip(b.column("rep").to_pylist(), b.column("state").to_pylist()):
                at, starts = first & _MASK, []
                for _ in range(each):
                    at = _xorshift(at)
                    starts.append(at % (n - block + 1))
                yield pa.record_batch([pa.array([rep] * each, pa.int32()), pa.array(range(each), pa.int32()), pa.array(starts, pa.int64())], ["rep", "k", "start"])

    return spark.createDataFrame(states, "rep int, state long").mapInArrow(drawn, "rep int, k int, start long")


def block_interval(gains: DataFrame, starts: DataFrame, n: int, block: int, repeats: int) -> DataFrame:
    """Mean and the 2.5 % and 97.5 % ranks of resampled means. gains: i from 0, gain. No row for fewer than two blocks or ten repeats.

    Every resample has exactly n values: the last block is cut off."""
    if n < 2 * block or repeats < 10:
        return gains.sparkSession.createDataFrame([], "mean double, low double, high double")
    drawn = starts.select("rep", "k", "start", F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("o")).where(F.col("k") * block + F.col("o") < n)
    joined = drawn.withColumn("i", F.col("start") + F.col("o")).join(gains.select("i", "gain"), "i")
    means = joined.groupBy("rep").agg(F.avg("gain").alias("m"))
    ranked = means.withColumn("r", F.row_number().over(Window.orderBy("m", "rep")) - 1)  # one row a resample
    low, high = repeats * 25 // 1000, min(repeats * 975 // 1000, repeats - 1)
    ends = ranked.agg(F.max(F.when(F.col("r") == low, F.col("m"))).alias("low"), F.max(F.when(F.col("r") == high, F.col("m"))).alias("high"))
    return gains.agg(F.avg("gain").alias("mean")).crossJoin(F.broadcast(ends))


def block_intervals(gains: DataFrame, by: list[str], order: list[str], block: int, repeats: int) -> DataFrame:
    """A35 for each group: low and high, the 2.5 % and 97.5 % ranks of resampled means of `gain` in order.

    Starts come from the MD5 of "repeat:block", so that every group draws in its own tasks; each resample has as many values as
    the group, its last block cut off. Groups of fewer than two blocks, and rows with a null gain, have no part in it."""
    if repeats < 10 or block < 1:
        raise ValueError("ten repeats and blocks of one row at least")
    w = Window.partitionBy(*by)
    rows = gains.where("gain is not null").select(*by, F.col("gain"), (F.row_number().over(w.orderBy(*order)) - 1).alias("__i"))
    sizes = rows.groupBy(*by).agg(F.count("*").alias("__n")).where(F.col("__n") >= 2 * block)
    reps = sizes.select(*by, "__n", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("__rep"))
    blocks = reps.withColumn("__k", F.explode(F.sequence(F.lit(0), F.ceil((F.col("__n") - block) / block).cast("int"))))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", "__rep", "__k")), 1, 15), 16, 10).cast("long")
    starts = blocks.withColumn("__start", draw % (F.col("__n") - block + 1))
    drawn = starts.withColumn("__o", F.explode(F.sequence(F.lit(0), F.lit(block - 1)))).where(F.col("__k") * block + F.col("__o") < F.col("__n"))
    means = drawn.withColumn("__i", F.col("__start") + F.col("__o")).join(rows, [*by, "__i"]).groupBy(*by, "__rep").agg(F.avg("gain").alias("__m"))
    rank = F.row_number().over(w.orderBy("__m", "__rep")) - 1  # one row a resample
    low, high = repeats * 25 // 1000, min(repeats * 975 // 1000, repeats - 1)
    at = lambda r: F.max(F.when(F.col("__r") == r, F.col("__m")))
    return means.withColumn("__r", rank).groupBy(*by).agg(at(low).alias("low"), at(high).alias("high"))


def average_precision(scored: DataFrame, by: list[str] = []) -> DataFrame:
    """Sum of recall gained x precision, from the highest score down, tied scores as one group; null without positives.

    Scores are grouped first; the running counts then go over distinct scores, by buckets of the score."""
    groups = scored.groupBy(*by, "p").agg(F.sum(F.col("label").cast("long")).alias("tp"), F.count("*").alias("n"))
    bucket, order = -even_buckets(scored, "p"), [F.col("p").desc()]
    run = running_sum(running_sum(groups, F.col("tp"), order, bucket, "ctp", by), F.col("n"), order, bucket, "cn", by)
    total = run.groupBy(*by).agg(F.sum("tp").alias("pos"), F.sum(F.col("tp") * F.col("ctp") / F.col("cn")).alias("s"), F.sum("n").alias("rows"))
    return total.select(*by, "rows", F.try_divide(F.col("s"), F.when(F.col("pos") > 0, F.col("pos"))).alias("pr_auc"))


def brier(label: Column, p: Column) -> Column:
    """Mean squared error of a probability."""
    return F.avg((label - p) * (label - p))


def calibration_error(scored: DataFrame, by: list[str] = []) -> DataFrame:
    """Over ten equal bins the share-weighted gap between the positive rate and the mean score."""
    bins = scored.groupBy(*by, F.least(F.lit(9), F.floor(F.col("p") * 10)).alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col("label").cast("double")).alias("rate"), F.avg("p").alias("mean_p"))
    return bins.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("rate") - F.col("mean_p"))) / F.sum("n")).alias("ece"))


def scorecard(scored: DataFrame, part: str, threshold: float, value: str = "value", time: str = "t") -> DataFrame:
    """Rows, time span, PR-AUC, Brier, ECE, positive and quote rate, the mean value of quoting always (baseline), of
    quoting below the threshold (policy, 0 where it does not quote) and the lift, for each partition and overall (a null partition).

    Every row counts in its partition and overall, so the grouped steps run once over both."""
    every = F.array(F.struct(F.col(part).alias("part"), F.lit(0).alias("overall")), F.struct(F.lit(None).cast("string").alias("part"), F.lit(1).alias("overall")))
    rest = ["p", "label", F.col(value).alias("value"), F.col(time).alias("t")]
    both = scored.select(F.explode(every).alias("g"), *rest).select("g.*", "p", "label", "value", "t")
    keys = ["overall", "part"]
    quoted = F.when(F.col("p") < threshold, F.col("value")).otherwise(0.0)
    base = both.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.min("t").alias("first"), F.max("t").alias("last"), brier(F.col("label"), F.col("p")).alias("brier"), F.avg(F.col("label").cast("double")).alias("positive_rate"),
        F.avg((F.col("p") < threshold).cast("double")).alias("quote_rate"), F.avg("value").alias("baseline"), F.avg(quoted).alias("policy"), F.avg(quoted - F.col("value")).alias("lift"),
    )
    out = base
    for extra in (average_precision(both, keys).drop("rows"), calibration_error(both, keys)):
        renamed = extra.withColumnsRenamed({k: f"__{k}" for k in keys})
        out = out.join(renamed, F.col("overall").eqNullSafe(F.col("__overall")) & F.col("part").eqNullSafe(F.col("__part"))).drop("__overall", "__part")
    return out


def nearest_rank(df: DataFrame, value: str, order: list[Column], bucket: Column) -> DataFrame:
    """Min, p50 (index n/2), p95 (index floor((n-1) 0.95)) and max by position; r50, r95 and r99 by the rounded index (n-1) q."""
    rows = number(df.where(F.col(value).isNotNull()), order, bucket, "__i").crossJoin(F.broadcast(df.agg(F.count(value).alias("__n"))))
    pick = lambda at: F.max(F.when(F.col("__i") == at, F.col(value)))
    n = F.col("__n")
    rounded = [pick(F.round((n - 1) * q).cast("long")).alias(f"r{round(100 * q)}") for q in (0.5, 0.95, 0.99)]
    return rows.agg(F.min(value).alias("min"), pick(F.floor(n / 2)).alias("p50"), pick(F.floor((n - 1) * 0.95)).alias("p95"), F.max(value).alias("max"), *rounded)


def isotonic(p: Column, knots: list[tuple[float, float]]) -> Column:
    """piecewise-linear calibration, constant beyond the end knots; null stays null."""
    out = F.when(p <= knots[0][0], knots[0][1])
    for (x0, y0), (x1, y1) in zip(knots, knots[1:]):
        out = out.when(p <= x1, y0 + (p - x0) * ((y1 - y0) / (x1 - x0)) if x1 > x0 else F.lit(y1))
    return F.when(p.isNotNull(), out.otherwise(knots[-1][1]))


def quote_below(p: Column, threshold: float | None) -> Column:
    """quote where the calibrated probability is below the threshold; no threshold gives null."""
    return p < F.lit(threshold).cast("double")


def batch_score(rows: DataFrame, features: list[str], load, name: str = "probability") -> DataFrame:
    """Probability of class 1 from a predictor: load() makes it once a worker, it maps a matrix to probabilities."""
    from collections.abc import Iterator

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict = load()
        for x in batches:
            yield pd.Series(np.asarray(predict(np.array(x.tolist(), float)), float))

    scored.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    udf = F.pandas_udf(scored, "double")
    return rows.withColumn(name, udf(F.array(*[F.col(c).cast("double") for c in features])))
