"""Labels, folds, policies and the policy leaderboard."""

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitlake.operators.numbering import number
from pitlake.operators.overlap import purged

BASELINE = "quote_all"
#: Names of the quote policies, in the order in which boards list them.
POLICIES = ("quote_all", "maker_side_filter", "maker_side_negative", "buy_only", "sell_only", "large_trade_filter", "small_trade_filter", "price_above_median")


def markout_bps(side: Column, mid: Column, price: Column) -> Column:
    """what a fill earned in basis points; null unless the price is positive and the side is 1 or -1."""
    return F.when((price > 0) & side.isin(1, -1), side * (mid - price) / price * 10_000)


def toxic(markout: Column, fee_bps: Column) -> Column:
    """the markout loses more than the fee."""
    return markout < -fee_bps


def horizon_seconds(label: Column) -> Column:
    """"10s", "250ms", "2m", "1h", "1d" in seconds; null for anything else, which sorts last."""
    n = F.regexp_extract(label, r"^(\d+(?:\.\d+)?)(ms|s|m|h|d)$", 1)
    unit = F.regexp_extract(label, r"^(\d+(?:\.\d+)?)(ms|s|m|h|d)$", 2)
    scale = F.when(unit == "ms", 0.001).when(unit == "s", 1.0).when(unit == "m", 60.0).when(unit == "h", 3600.0).when(unit == "d", 86400.0)
    return F.when(n != "", n.try_cast("double") * scale)


def exact_medians(df: DataFrame, columns: list[str], bins: int = 4096) -> dict[str, float | None]:
    """The exact median of each column of finite numbers; None without values.

    Each pass counts the values of a range in equal bins and narrows the range to the bins that hold the middle, so tasks
    return a row a bin and column, and no value but the middle ones is gathered or sorted. Nulls, NaN and infinities do not count."""
    known = {c: F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double")) for c in columns}
    first = df.agg(*[f(v).alias(f"{n}_{c}") for c, v in known.items() for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    out: dict[str, float | None] = {}
    # (column, place in the order) still sought: range of values and how many lie below it
    open_: dict[tuple[str, int], tuple[float, float, int]] = {}
    for c in columns:
        n = first[f"n_{c}"]
        for place in {(n - 1) // 2, n // 2} if n else ():
            open_[c, place] = first[f"lo_{c}"], first[f"hi_{c}"], 0
    found: dict[tuple[str, int], float] = {}
    while open_:
        for key in [k for k, (lo, hi, _) in open_.items() if lo == hi]:
            found[key] = open_.pop(key)[0]
        if not open_:
            break
        ranges = sorted({(c, lo, hi) for (c, _), (lo, hi, _) in open_.items()})
        parts = []
        for k, (c, lo, hi) in enumerate(ranges):
            half = hi / 2 - lo / 2  # halves, as the difference may be too large
            bin_ = F.floor((known[c] / 2 - F.lit(lo / 2)) / F.lit(half) * bins) if half > 0 else F.when(known[c] > lo, bins).otherwise(0)
            bin_ = F.least(F.lit(bins - 1), bin_).cast("int")
            parts.append(F.when(known[c].between(lo, hi), F.struct(F.lit(k).alias("k"), bin_.alias("bin"), known[c].alias("v"))))
        counted = df.select(F.explode(F.array_compact(F.array(*parts))).alias("x")).groupBy("x.k", "x.bin").agg(F.count("*").alias("n"), F.min("x.v").alias("lo"), F.max("x.v").alias("hi")).collect()
        for key, (lo, hi, below) in list(open_.items()):
            for r in sorted((r for r in counted if r.k == ranges.index((key[0], lo, hi))), key=lambda r: r.bin):
                if below + r.n > key[1]:
                    open_[key] = r.lo, r.hi, below
                    break
                below += r.n
    for c in columns:
        n = first[f"n_{c}"]
        out[c] = (found[c, (n - 1) // 2] + found[c, n // 2]) / 2 if n else None
    return out


def policy_masks(records: DataFrame) -> dict[str, Column]:
    """Each policy as a boolean column, by the exact medians of size and price over the records."""
    medians = {c: F.lit(v).cast("double") for c, v in exact_medians(records, ["qty", "px"]).items()}
    return {
        "quote_all": F.lit(True), "maker_side_filter": F.col("maker_side") > 0, "maker_side_negative": F.col("maker_side") < 0,
        "buy_only": F.col("side") == 1, "sell_only": F.col("side") == -1, "large_trade_filter": F.col("qty") >= medians["qty"],
        "small_trade_filter": F.col("qty") < medians["qty"], "price_above_median": F.col("px") >= medians["px"],
    }


def label_intervals(records: DataFrame, time: str, horizon: int, bucket: Column, unique: str) -> DataFrame:
    """Start, end and a dense position in the order (start, end, unique)."""
    spans = records.withColumn("start", F.col(time)).withColumn("end", F.col(time) + horizon)
    return number(spans, [F.col("start"), F.col("end"), F.col(unique)], bucket, "pos")


def fold_sizes(rows: int, folds: int, train_share: float = 0.4, test_share: float = 0.05) -> tuple[int, int]:
    """Training window and test block in rows."""
    train, test = int(rows * train_share), int(rows * test_share)
    if train < 1 or test < 1 or train + folds * test > rows:
        raise ValueError("not enough rows for the folds")
    return train, test


def test_blocks(intervals: DataFrame, folds: int, train: int, test: int) -> DataFrame:
    """The test rows of each fold, by position; boards need no more."""
    rows = intervals.where((F.col("pos") >= train) & (F.col("pos") < train + folds * test))
    return rows.withColumn("fold", F.floor((F.col("pos") - train) / test).cast("int")).withColumn("role", F.lit("test"))


def walk_forward(intervals: DataFrame, folds: int, train: int, test: int, purge: int, embargo: int) -> DataFrame:
    """(fold, role, pos, ...) in long form: test rows by position, and the last `train` eligible rows before them.

    A row is eligible if it ends before the test block by more than purge (or starts after it by more than embargo). Positions
    are dense, so the training rows lie in a range of positions that is longer than `train` by the rows purged in it: counts of
    one row a fold tell the range, and one pass over the intervals deals each row to its folds. intervals is read three times:
    pass what is stored. A fold without a training row has test rows only, for fold_errors() to report."""
    tests = test_blocks(intervals, folds, train, test)
    bounds = tests.groupBy("fold").agg(F.min("start").alias("ts"), F.max("end").alias("te"), F.min("pos").alias("tp")).collect()  # one row a fold
    if not bounds:
        return tests.select("fold", "role", *intervals.columns)

    def dealt(lowest: dict[int, int]) -> DataFrame:
        """Eligible rows before each fold from a position on."""
        each = [F.struct(F.lit(b.fold).alias("fold"), *[F.lit(v).cast("long").alias(n) for n, v in (("ts", b.ts), ("te", b.te), ("tp", b.tp), ("low", lowest.get(b.fold, 0)))]) for b in bounds]
        own = F.filter(F.array(*each), lambda b: (F.col("pos") < b["tp"]) & (F.col("pos") >= b["low"]) & purged(F.col("start"), F.col("end"), b["ts"], b["te"], purge, embargo))
        return intervals.withColumn("fold", F.explode(F.transform(own, lambda b: b["fold"])))

    # one count a fold in a single row
    fits = [F.count_if((F.col("pos") < b.tp) & purged(F.col("start"), F.col("end"), F.lit(b.ts), F.lit(b.te), purge, embargo)).alias(f"n{i}") for i, b in enumerate(bounds)]
    counted = intervals.agg(*fits).first()
    have = {b.fold: counted[f"n{i}"] for i, b in enumerate(bounds)}
    # positions before the block, less the rows to skip if all that is purged were in the range
    low = {b.fold: max(0, b.tp - (b.tp - have.get(b.fold, 0)) - train) for b in bounds}
    trains = dealt(low)
    more = {r.fold: r.n - train for r in trains.groupBy("fold").agg(F.count("*").alias("n")).where(F.col("n") > train).collect()}
    if more:  # some rows were purged below the range: rank what is left of it
        over = number(trains.where(F.col("fold").isin(list(more))), [F.col("pos").desc()], -F.floor(F.col("pos") / 65_536), "__r", ["fold"])
        trains = trains.where(~F.col("fold").isin(list(more))).unionByName(over.where(F.col("__r") < train).drop("__r"))
    cols = ["fold", "role", *intervals.columns]
    return tests.select(*cols).unionByName(trains.withColumn("role", F.lit("train")).select(*cols))


def fold_errors(folds: DataFrame) -> DataFrame:
    """Folds left without a training row."""
    return folds.groupBy("fold").agg(F.count_if(F.col("role") == "train").alias("n")).where("n = 0").select("fold")


def naive_folds(intervals: DataFrame, folds: int, test: int, seed: int, unique: str) -> DataFrame:
    """The control that ignores time: test blocks of the order of the MD5 of "seed:unique", every other row trains."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(unique).cast("string"))), 1, 15), 16, 10).cast("long")
    mixed = number(intervals.drop("pos").withColumn("__h", h), [F.col("__h"), F.col(unique)], F.shiftright("__h", 52), "pos")
    return mixed.withColumn("fold", F.floor(F.col("pos") / test).cast("int")).where(F.col("fold") < folds).withColumn("role", F.lit("test")).drop("__h")


def stacked(rows: DataFrame, masks: dict[str, Column], value: str) -> DataFrame:
    """Each row once for each policy, with quoted (its mask) and captured (the value if quoted, else 0)."""
    every = F.array(*[F.struct(F.lit(n).alias("policy"), m.alias("quoted")) for n, m in masks.items()])
    flat = rows.withColumn("__p", F.explode(every)).withColumn("policy", F.col("__p.policy")).withColumn("quoted", F.col("__p.quoted")).drop("__p")
    return flat.withColumn("captured", F.when(F.col("quoted"), F.col(value)).otherwise(0.0))


def mean_ci(value: Column, name: str) -> list[Column]:
    """Mean and its normal 95 % interval; one row has no width, none has zeros."""
    mean = F.coalesce(F.avg(value), F.lit(0.0))
    half = F.coalesce(1.96 * F.sqrt(F.var_samp(value) / F.count(value)), F.lit(0.0))
    return [mean.alias(name), (mean - half).alias(f"{name}_lower"), (mean + half).alias(f"{name}_upper")]


def leaderboard(folds: DataFrame, masks: dict[str, Column], value: str) -> DataFrame:
    """For each fold and policy over test rows: rows, quote_rate, policy and baseline means, lift and its interval.

    The paired baseline is quoting always, so strategy and baseline of a row need no join (J18)."""
    flat = stacked(folds.where(F.col("role") == "test"), masks, value)
    lift = F.col("captured") - F.col(value)
    return flat.groupBy("fold", "policy").agg(
        F.count("*").alias("rows"), F.avg(F.col("quoted").cast("double")).alias("quote_rate"), F.avg("captured").alias("policy_mean"), F.avg(value).alias("baseline_mean"), *mean_ci(lift, "lift")
    )


def sharpe(value: Column) -> Column:
    """Mean over sample deviation; null for fewer than two values or none of variance."""
    return F.try_divide(F.avg(value), F.when(F.stddev_samp(value) > 0, F.stddev_samp(value)))


def deflated_sharpe_z(board: DataFrame, score: str = "lift") -> DataFrame:
    """For each policy the z-score of its Sharpe ratio against the best of as many trials by chance; null where undefined."""
    trials = board.agg(F.count_distinct("policy").alias("trials"))
    per = board.groupBy("policy").agg(F.count(score).alias("n"), sharpe(F.col(score)).alias("sharpe"), F.skewness(score).alias("skew"), (F.kurtosis(score) + 3).alias("kurt"))
    both = per.crossJoin(F.broadcast(trials))
    expected = F.when(F.col("trials") > 1, F.sqrt(2 * F.log(F.col("trials").cast("double")) / F.col("n"))).otherwise(0.0)
    spread = 1 - F.col("skew") * F.col("sharpe") + (F.col("kurt") - 1) / 4 * F.col("sharpe") ** 2
    z = F.when((F.col("n") >= 3) & (spread > 0), (F.col("sharpe") - expected) * F.sqrt((F.col("n") - 1) / spread))
    return both.select("policy", "n", "trials", "sharpe", z.alias("z"))


def with_probability(z_rows: DataFrame) -> DataFrame:
    """dsr = the normal distribution function of z, by a pandas UDF as Spark has no erf; null stays null."""
    @F.pandas_udf("double")
    def phi(z: pd.Series) -> pd.Series:
        return z.map(lambda v: 0.5 * math.erfc(-v / math.sqrt(2)), na_action="ignore")

    return z_rows.withColumn("dsr", phi(F.col("z").cast("double")))


def overfit_probability(board: DataFrame, score: str = "lift") -> DataFrame:
    """Over all ways to take half of the folds as in-sample, the share in which the best policy there ranks in the
    lower half on the other folds: one row with splits, overfit and pbo; no row unless folds are even and four or more.

    The best is the first by name on ties. Split x fold x policy rows are numbers of the board, never of the records."""
    folds = board.select("fold").distinct()
    places = folds.select("fold", (F.row_number().over(Window.orderBy("fold")) - 1).alias("i"))  # one row a fold
    n = folds.count()
    if n > 40:
        raise ValueError("more halvings of the folds than can be gone through")
    ids = board.sparkSession.range(1 << n if n >= 4 and n % 2 == 0 else 0)  # in parts, not one row with all
    splits = ids.select(F.col("id").alias("split")).where(F.bit_count("id") == n // 2)
    cells = board.select("policy", "fold", F.col(score).alias("s")).join(F.broadcast(places), "fold")
    means = splits.crossJoin(F.broadcast(cells)).groupBy("split", "policy").agg(F.avg(F.expr("case when (shiftright(split, i) & 1) = 1 then s end")).alias("inside"), F.avg(F.expr("case when (shiftright(split, i) & 1) = 0 then s end")).alias("outside"))
    per = means.groupBy("split").agg(F.min_by("outside", F.struct(-F.col("inside"), "policy")).alias("best"), F.collect_list("outside").alias("all"))
    rank = 1 + F.size(F.filter("all", lambda x: x < F.col("best")))
    return per.agg(F.count("*").alias("splits"), F.count_if(rank / (F.size("all") + 1) < 0.5).alias("overfit")).where("splits > 0").withColumn("pbo", F.col("overfit") / F.col("splits"))


def policy_summary(board: DataFrame) -> DataFrame:
    """For each policy its folds, means, lifts in fold order and rank by (lift desc, name); top marks the best but the baseline."""
    s = board.groupBy("policy").agg(F.count("*").alias("folds"), F.avg("policy_mean").alias("policy_mean"), F.avg("lift").alias("avg_lift"), F.avg("quote_rate").alias("quote_rate"), F.array_sort(F.collect_list(F.struct("fold", "lift"))).alias("lifts"))
    ranked = s.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("avg_lift"), "policy")))  # one row a policy
    best = F.min(F.when(F.col("policy") != BASELINE, F.col("rank"))).over(Window.partitionBy())
    return ranked.withColumn("top", F.col("rank") == best)


def rank_shift(naive: DataFrame, audited: DataFrame) -> DataFrame:
    """Rank in two boards and the move between them; blocked where only the naive board has the policy."""
    a, b = naive.select("policy", F.col("rank").alias("naive_rank")), audited.select("policy", F.col("rank").alias("audited_rank"))
    both = a.join(b, "policy", "full")
    status = F.when(F.col("audited_rank").isNull(), "blocked").when(F.col("naive_rank").isNull(), "new").otherwise("ranked")
    return both.select("policy", "naive_rank", "audited_rank", (F.col("naive_rank") - F.col("audited_rank")).alias("delta"), status.alias("status"))


def markout_ladder(flat: DataFrame) -> DataFrame:
    """A10: mean captured markout and interval of each policy and horizon, horizons numbered by duration. flat has horizon, policy, captured."""
    g = flat.groupBy("policy", "horizon").agg(F.count("captured").alias("rows"), *mean_ci(F.col("captured"), "markout"))
    order = Window.partitionBy("policy").orderBy(horizon_seconds(F.col("horizon")).asc_nulls_last(), "horizon")
    return g.withColumn("rung", F.row_number().over(order))


def cost_waterfall(flat: DataFrame, value: str, maker_fee: float, slippage: float, funding: float) -> DataFrame:
    """For each policy the gross mean of quoted rows, then what fees, slippage and funding take, cumulatively."""
    gross = flat.groupBy("policy").agg(F.coalesce(F.avg(F.when(F.col("quoted"), F.col(value))), F.lit(0.0)).alias("gross"))
    steps, total = [], F.col("gross")
    for k, (name, cost) in enumerate((("fees", maker_fee), ("slippage", slippage), ("funding", funding))):
        total = total - F.lit(cost)
        steps.append(F.struct(F.lit(k).alias("step"), F.lit(name).alias("stage"), F.lit(-cost).alias("delta"), total.alias("cumulative")))
    return gross.select("policy", "gross", F.inline(F.array(*steps)))


def capacity_sweep(summary: DataFrame, caps: list[float]) -> DataFrame:
    """Lift that is left at each participation cap: lift x min(1, cap)."""
    every = F.explode(F.array(*[F.lit(float(c)) for c in caps]))
    return summary.select("policy", "avg_lift", every.alias("cap")).withColumn("fill", F.least(F.lit(1.0), F.col("cap"))).withColumn("realized_lift", F.col("avg_lift") * F.col("fill"))


def acceptance(board: DataFrame, dsr: DataFrame, pbo: DataFrame, policies: int = 8, folds: int = 8) -> DataFrame:
    """One row: counts, and the names of the requirements that fail."""
    a = board.agg(F.count_distinct("policy").alias("policies"), F.count_distinct("fold").alias("folds"), F.count("*").alias("cells"))
    b = dsr.agg(F.count("z").alias("numeric_dsr"))
    c = pbo.agg(F.count("pbo").alias("numeric_pbo"))
    rules = [("policies", F.col("policies") < policies), ("folds", F.col("folds") < folds), ("cells", F.col("cells") < policies * folds), ("pbo", F.col("numeric_pbo") < 1), ("dsr", F.col("numeric_dsr") < 1)]
    failures = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules]))
    return a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c)).withColumn("failures", F.array_join(failures, ",")).withColumn("accepted", F.size(failures) == 0)


def coverage_gate(partitions: DataFrame, least_symbols: int, least_dates: int) -> DataFrame:
    """One row over (symbol, date, rows): missing partitions, what is there, minimums, ready, failures."""
    g = partitions.agg(F.count_if(F.col("rows") == 0).alias("missing"), F.count_distinct(F.when(F.col("rows") > 0, F.col("symbol"))).alias("symbols"), F.count_distinct(F.when(F.col("rows") > 0, F.col("date"))).alias("dates"), F.sum("rows").alias("rows"))
    rules = [("missing_partitions", F.col("missing") > 0), ("too_few_symbols", F.col("symbols") < least_symbols), ("too_few_dates", F.col("dates") < least_dates)]
    failures = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules]))
    return g.withColumn("failures", F.array_join(failures, ",")).withColumn("ready", F.size(failures) == 0)
