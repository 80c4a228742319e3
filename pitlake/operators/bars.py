"""Bars: building, visibility, momentum, labels between bars, and typed dispatch of raw events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitlake.functions.scalars import quotient
from pitlake.operators.asof import asof_join
from pitlake.operators.ledger import action_maps, held_return
from pitlake.session import kept


def dispatch(events: DataFrame, schemas: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Events (event_type, payload as JSON) with one struct column for each kind, filled for its own rows; and the events of no
    known kind or whose payload does not parse."""
    columns = {k: F.when(F.col("event_type") == k, F.from_json("payload", s)) for k, s in schemas.items()}
    typed = events.withColumns({f"as_{k}": c for k, c in columns.items()})
    known = F.lit(False)
    for k in schemas:
        known = known | F.col(f"as_{k}").isNotNull()
    return typed.where(known), events.join(typed.where(known).select("event_id"), "event_id", "left_anti")


def canonical_order(time: str = "t", sequence: str = "seq", event_id: str | None = None) -> list[Column]:
    """(time, sequence, event id or empty)."""
    return [F.col(time), F.col(sequence), F.coalesce(F.col(event_id), F.lit(""))] if event_id else [F.col(time), F.col(sequence)]


def from_prints(prints: DataFrame, width: int, delay: Column) -> DataFrame:
    """Bars of a symbol: start, end, open, high, low, close, volume, available (end and a delay)."""
    order = F.struct("t", "seq")
    start = F.floor(F.col("t") / width) * width
    g = prints.groupBy("symbol", start.alias("start")).agg(F.min_by("px", order).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", order).alias("close"), F.sum("qty").alias("volume"))
    return g.withColumn("end", F.col("start") + width).withColumn("available", F.col("start") + width + delay)


def last_visible(decisions: DataFrame, bars: DataFrame, delay: int, width: int | None = None) -> DataFrame:
    """For each decision (symbol, t) the last bar with end <= t and available + delay <= t."""
    seen = bars.withColumn("seen", F.greatest(F.col("end"), F.col("available") + delay))
    return asof_join(decisions, seen, ["symbol"], "t", "seen", ["start", "close", "seen"], ties=["start"], width=width, prefix="bar_")


def momentum(bars: DataFrame, n: int = 31, longest: int | None = None, splits: DataFrame | None = None) -> DataFrame:
    """Over the last n bars of a symbol last/first - 1 and the population deviation of the n - 1 step returns.

    Withheld (null) with fewer bars, where the window spans more than `longest`, and where a split (symbol, effective) falls in it. A close of zero gives an infinite or undefined (NaN) step, as in IEEE 754."""
    w = Window.partitionBy("symbol").orderBy("start")
    rows = bars.withColumn("__r", quotient(F.col("close") - F.lag("close").over(w), F.lag("close").over(w)))
    near, steps = w.rowsBetween(1 - n, 0), w.rowsBetween(2 - n, 0)
    rows = rows.withColumn("__n", F.count("*").over(near)).withColumn("first_start", F.first("start").over(near))
    rows = rows.withColumn("momentum", quotient(F.col("close"), F.first("close").over(near)) - 1).withColumn("volatility", F.stddev_pop("__r").over(steps))
    whole = F.col("__n") == n
    if longest is not None:
        whole &= F.col("end") - F.col("first_start") <= longest
    if splits is not None:
        last = asof_join(rows.withColumn("__e", F.col("end")), splits, ["symbol"], "__e", "effective", ["effective"], prefix="split_")
        rows = last.drop("__e")
        whole &= F.col("split_effective").isNull() | (F.col("split_effective") <= F.col("first_start"))
    out = rows.withColumns({c: F.when(whole, F.col(c)) for c in ("momentum", "volatility")})
    return out.drop("__r", "__n", "first_start", "split_effective")


def relative_labels(decisions: DataFrame, bars: DataFrame, benchmark, latency: int, ahead: int, width: int, delay: int, actions: DataFrame, action_width: int) -> DataFrame:
    """From the bar at the first boundary after decision + latency to the one after the decision `ahead` sessions later: total return of
    the symbol less that of the benchmark, available when both last bars are, plus a delay.

    decisions: symbol, decision. actions: splits and dividends, as ledger.action_maps() takes them; their buckets are action_width. A missing bar on either side gives no label: no later bar stands in."""
    w = Window.partitionBy("symbol").orderBy("decision")
    boundary = lambda c: (F.floor((F.col(c) + latency) / width) + 1) * width
    rows = decisions.withColumn("__x", F.lead("decision", ahead).over(w)).where("__x is not null")
    rows = rows.withColumn("entry", boundary("decision")).withColumn("exit", boundary("__x")).drop("__x")
    for name, key, at in (("p0", F.col("symbol"), "entry"), ("p1", F.col("symbol"), "exit"), ("b0", F.lit(benchmark), "entry"), ("b1", F.lit(benchmark), "exit")):
        side = bars.select(F.col("symbol").alias("__s"), F.col("start").alias("__t"), F.col("open").alias(name), F.col("available").alias(f"__{name}"))
        rows = rows.join(side, (F.col("__s") == key) & (F.col("__t") == F.col(at))).drop("__s", "__t")
    maps = action_maps(actions, action_width)
    rows = kept(held_return(kept(rows), maps, action_width, "symbol", "p0", "p1", "__own"))
    rows = held_return(rows.withColumn("__bench", F.lit(benchmark)), maps, action_width, "__bench", "b0", "b1", "__base")
    label = F.col("__own") - F.col("__base")
    ready = F.greatest("__p1", "__b1") + delay
    return rows.select(*decisions.columns, "entry", "exit", label.alias("label"), ready.alias("label_ready"))


def dataset_listing(datasets: DataFrame, sources: DataFrame, distributions: DataFrame, text: str) -> DataFrame:
    """Datasets whose title has the text, with their source's name and count of distributions."""
    n = distributions.groupBy("dataset_id").agg(F.count("*").alias("distributions"))
    hits = datasets.where(F.contains(F.lower("title"), F.lit(text.lower())))
    return hits.join(sources, "source_id").join(n, "dataset_id", "left").withColumn("distributions", F.coalesce("distributions", F.lit(0)))


def distribution_detail(distributions: DataFrame, profiles: DataFrame, observations: DataFrame) -> DataFrame:
    """Each distribution with its latest profile, if any, and its count of observations."""
    last = profiles.groupBy("distribution_id").agg(F.max_by("rows", "profiled_at").alias("profile_rows"), F.max("profiled_at").alias("profiled_at"))
    n = observations.groupBy("distribution_id").agg(F.count("*").alias("observations"))
    return distributions.join(last, "distribution_id", "left").join(n, "distribution_id", "left").withColumn("observations", F.coalesce("observations", F.lit(0)))
