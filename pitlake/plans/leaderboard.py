"""Queries of the policy benchmark: labels, folds, leaderboard, overfit statistics, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitlake.functions.scalars import quotient, rounded
from pitlake.operators import evaluate as ev
from pitlake.operators.asof import asof_join, lookahead_violations, trailing_values
from pitlake.operators.numbering import even_buckets, number, running_max, running_sum, sampled
from pitlake.plans.registry import register
from pitlake.plans.views import DAY, HOUR, quotes, r6, trades, with_views
from pitlake.session import kept

HORIZON, FOLDS = HOUR, 8


def by_time(spark: SparkSession, sf: str):
    """Buckets of t with about as many trades each."""
    return even_buckets(trades(spark, sf), "t")


def records(spark: SparkSession, sf: str, horizon: int = HORIZON) -> DataFrame:
    """Trades with the mid a horizon later in their symbol and the markout; those without a later mid are left out."""
    t = trades(spark, sf).withColumn("due", F.col("t") + horizon)
    j = asof_join(t, quotes(spark, sf), ["symbol"], "due", "t", ["mid"], forward=True, ties=["seq"], width=DAY)
    return j.withColumn("markout", ev.markout_bps(F.col("side"), F.col("mid"), F.col("px"))).where("markout is not null")


def intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Records with their label interval and position, stored, as folds read them several times."""
    return kept(ev.label_intervals(records(spark, sf), "t", HORIZON, by_time(spark, sf), "seq"))


def folds(spark: SparkSession, sf: str) -> DataFrame:
    spans = intervals(spark, sf)
    train, test = ev.fold_sizes(spans.count(), FOLDS)
    return ev.walk_forward(spans, FOLDS, train, test, HORIZON, HORIZON)


def board(spark: SparkSession, sf: str) -> DataFrame:
    """The leaderboard of the walk-forward folds; it reads their test rows only."""
    spans = intervals(spark, sf)
    tests = ev.test_blocks(spans, FOLDS, *ev.fold_sizes(spans.count(), FOLDS))
    return ev.leaderboard(tests, ev.policy_masks(spans), "markout")


#: SQL of records() and, from there, of the stacked policies and the board.
REC = f"""WITH rec AS (SELECT t.*, q.mid, t.side * (q.mid - t.px) / t.px * 10000 AS markout FROM trades t ASOF JOIN quotes q ON t.symbol = q.symbol AND t.t + {HORIZON} <= q.t WHERE t.px > 0)"""
FOLD = (
    REC
    + f""", med AS (SELECT median(qty) AS qm, median(px) AS pm, CAST(floor(count(*) * 0.4) AS BIGINT) AS tr, CAST(floor(count(*) * 0.05) AS BIGINT) AS te FROM rec),
  num AS (SELECT rec.*, med.*, t AS s, t + {HORIZON} AS e, row_number() OVER (ORDER BY t, t + {HORIZON}, seq) - 1 AS pos FROM rec, med),
  test AS (SELECT *, CAST((pos - tr) // te AS INTEGER) AS fold FROM num WHERE pos >= tr AND pos < tr + {FOLDS} * te),
  bound AS (SELECT fold, min(s) AS ts, max(e) AS tend, min(pos) AS tp FROM test GROUP BY 1),
  train AS (SELECT * FROM (SELECT n.*, b.fold, row_number() OVER (PARTITION BY b.fold ORDER BY n.pos DESC) AS r FROM num n JOIN bound b ON n.pos < b.tp AND (n.e < b.ts -
    {HORIZON} OR n.s > b.tend + {HORIZON})) WHERE r <= tr)"""
)
STACK = """CROSS JOIN LATERAL (VALUES ('quote_all', true), ('maker_side_filter', maker_side > 0), ('maker_side_negative', maker_side < 0), ('buy_only', side = 1), ('sell_only', side = -1),
  ('large_trade_filter', qty >= qm), ('small_trade_filter', qty < qm), ('price_above_median', px >= pm)) AS p(policy, quoted)"""
BOARD = (
    FOLD
    + f""", flat AS (SELECT *, CASE WHEN quoted THEN markout ELSE 0 END AS captured FROM test {STACK}),
  board AS (SELECT fold, policy, count(*) AS rows, avg(CAST(quoted AS INTEGER)) AS quote_rate, avg(captured) AS policy_mean, avg(markout) AS baseline_mean, avg(captured -
    markout) AS lift,
    avg(captured - markout) - coalesce(1.96 * sqrt(var_samp(captured - markout) / count(*)), 0) AS lift_lower, avg(captured - markout) + coalesce(1.96 *
    sqrt(var_samp(captured - markout) / count(*)), 0) AS lift_upper FROM flat GROUP BY ALL)"""
)
V = "trades quotes"


def sql(head: str, body: str) -> str:
    return with_views(V, f"{head} {body}")


@register("asof_forward_markout", sql(REC, "SELECT seq, symbol, round(mid, 6) AS mid, round(markout, 6) + 0.0 AS markout, markout < -1.0 AS toxic FROM rec"))
def asof_forward_markout(spark, sf):
    """Markout of every trade against the first mid a horizon later."""
    return records(spark, sf).select("seq", "symbol", r6("mid").alias("mid"), r6("markout").alias("markout"), ev.toxic(F.col("markout"), F.lit(1.0)).alias("toxic"))


@register("asof_backward", sql("", f"SELECT t.seq, t.symbol, q.seq AS quote_seq, round(q.bid, 6) AS bid FROM trades t ASOF LEFT JOIN quotes q ON t.symbol = q.symbol AND t.t - {HOUR} >= q.t"))
def asof_backward(spark, sf):
    """The last quote at least an hour old; null where there is none."""
    t = trades(spark, sf).withColumn("lagged", F.col("t") - HOUR)
    j = asof_join(t, quotes(spark, sf), ["symbol"], "lagged", "t", ["seq", "bid"], ties=["seq"], width=DAY, prefix="quote_")
    return j.select("seq", "symbol", "quote_seq", r6("quote_bid").alias("bid"))


@register("lookahead_violations", sql("", f"SELECT t.seq FROM trades t ASOF LEFT JOIN quotes q ON t.symbol = q.symbol AND t.t - {6 * HOUR} > q.t WHERE q.seq IS NULL"))
def lookahead(spark, sf):
    """Trades without a feature row strictly older than the lag."""
    t = trades(spark, sf).withColumn("lagged", F.col("t") - 6 * HOUR)
    j = asof_join(t, quotes(spark, sf), ["symbol"], "lagged", "t", ["seq"], strict=True, ties=["seq"], width=DAY, prefix="quote_")
    return lookahead_violations(j, "quote_seq").select("seq")


@register("walk_forward_folds", sql(FOLD, "SELECT fold, 'test' AS role, seq, pos FROM test UNION ALL SELECT fold, 'train', seq, pos FROM train"))
def walk_forward_folds(spark, sf):
    """Rows of each fold by role."""
    return folds(spark, sf).select("fold", "role", "seq", "pos")


@register("policy_leaderboard", sql(BOARD, """SELECT fold, policy, rows, round(quote_rate, 6) AS quote_rate, round(policy_mean, 6) + 0.0 AS policy_mean,
    round(baseline_mean, 6) + 0.0 AS baseline_mean, round(lift, 6) + 0.0 AS lift, round(lift_lower, 6) + 0.0 AS lift_lower, round(lift_upper, 6) + 0.0 AS lift_upper FROM
    board"""))
def policy_leaderboard(spark, sf):
    """Lift of each policy over quoting always, by fold."""
    return board(spark, sf).select("fold", "policy", "rows", *[r6(c).alias(c) for c in ("quote_rate", "policy_mean", "baseline_mean", "lift", "lift_lower", "lift_upper")])


@register(
    "policy_dsr_terms",
    sql(BOARD, """, m AS (SELECT policy, count(*) AS n, avg(lift) AS mu, stddev_samp(lift) AS sd, (SELECT count(DISTINCT policy) FROM board) AS trials FROM board
    GROUP BY 1),
      c AS (SELECT b.policy, avg(pow(lift - mu, 2)) AS m2, avg(pow(lift - mu, 3)) AS m3, avg(pow(lift - mu, 4)) AS m4 FROM board b JOIN m USING (policy) GROUP BY 1),
      z AS (SELECT *, CASE WHEN sd > 0 THEN mu / sd END AS sr, CASE WHEN m2 > 0 THEN m3 / pow(m2, 1.5) END AS sk, CASE WHEN m2 > 0 THEN m4 / (m2 * m2) END AS ku FROM m
    JOIN c USING (policy))
      SELECT policy, n, trials, round(sr, 6) + 0.0 AS sharpe, CASE WHEN n >= 3 AND 1 - sk * sr + (ku - 1) / 4 * sr * sr > 0 THEN round((sr - sqrt(2 * ln(trials) / n)) *
    sqrt((n - 1) / (1 - sk * sr + (ku - 1) / 4 * sr * sr)), 6) + 0.0 END AS z FROM z"""),
)
def policy_dsr_terms(spark, sf):
    """Sharpe ratio and deflated z-score of each policy's fold lifts."""
    return ev.deflated_sharpe_z(board(spark, sf)).select("policy", "n", "trials", r6("sharpe").alias("sharpe"), r6("z").alias("z"))


@register("policy_dsr")
def policy_dsr(spark, sf):
    """Deflated Sharpe probability; a test holds it against published values, as DuckDB has no erf."""
    return ev.with_probability(ev.deflated_sharpe_z(board(spark, sf))).select("policy", r6("dsr").alias("dsr"))


PBO = """, splits AS (SELECT s FROM range(0, 256) AS r(s) WHERE bit_count(s) = 4),
  means AS (SELECT s, policy, avg(CASE WHEN (s >> fold) & 1 = 1 THEN lift END) AS i, avg(CASE WHEN (s >> fold) & 1 = 0 THEN lift END) AS o FROM board, splits GROUP BY ALL),
  top AS (SELECT s, first(o ORDER BY i DESC, policy) AS b FROM means GROUP BY 1),
  ranks AS (SELECT s, 1 + count(*) FILTER (WHERE o < b) AS r, count(*) AS n FROM means JOIN top USING (s) GROUP BY 1)"""


@register("cscv_pbo", sql(BOARD, PBO + " SELECT count(*) AS splits, count(*) FILTER (WHERE r / (n + 1) < 0.5) AS overfit, round(count(*) FILTER (WHERE r / (n + 1) < 0.5) / count(*), 6) AS pbo FROM ranks"))
def cscv_pbo(spark, sf):
    """Probability of backtest overfit over the 70 halvings of eight folds."""
    return ev.overfit_probability(board(spark, sf)).select("splits", "overfit", r6("pbo").alias("pbo"))


SUMMARY = """, summ AS (SELECT policy, count(*) AS folds, avg(policy_mean) AS policy_mean, avg(lift) AS avg_lift, avg(quote_rate) AS quote_rate FROM board GROUP BY
    1), ranked AS (SELECT *, row_number() OVER (ORDER BY avg_lift DESC, policy) AS rank FROM summ)"""


@register("policy_summary", sql(BOARD, SUMMARY + """ SELECT policy, folds, round(policy_mean, 6) + 0.0 AS policy_mean, round(avg_lift, 6) + 0.0 AS avg_lift,
    round(quote_rate, 6) AS quote_rate, CAST(rank AS INTEGER) AS rank, rank = (SELECT min(rank) FROM ranked WHERE policy <> 'quote_all') AS top FROM ranked"""))
def policy_summary(spark, sf):
    """Mean lift and rank of each policy; the best but the baseline is marked."""
    return ev.policy_summary(board(spark, sf)).select("policy", "folds", r6("policy_mean").alias("policy_mean"), r6("avg_lift").alias("avg_lift"), r6("quote_rate").alias("quote_rate"), "rank", "top")


@register("fold_heatmap", sql(BOARD, "SELECT fold, policy, round(lift, 6) + 0.0 AS lift, round(min(lift) OVER (), 6) + 0.0 AS min_lift, round(max(lift) OVER (), 6) + 0.0 AS max_lift FROM board"))
def fold_heatmap(spark, sf):
    """Cells of fold x policy with the range of all."""
    from pyspark.sql import Window

    b = board(spark, sf)
    whole = Window.partitionBy()  # one row a cell of the board
    return b.select("fold", "policy", r6("lift").alias("lift"), r6(F.min("lift").over(whole)).alias("min_lift"), r6(F.max("lift").over(whole)).alias("max_lift"))


#: As the query: of quotes at one time the first by seq; no markout without a positive price (F01), and none without a mid.
LADDER = ", firsts AS (SELECT symbol, t, arg_min_null(mid, seq) AS mid FROM quotes GROUP BY ALL)" + "".join(
    f", r{k} AS (SELECT '{h}' AS horizon, {k} AS rung, t.*, t.side * (q.mid - t.px) / t.px * 10000 AS markout FROM trades t ASOF JOIN firsts q ON t.symbol = q.symbol AND t.t + {us} <= q.t WHERE t.px > 0 AND q.mid IS NOT NULL)"
    for k, (h, us) in enumerate((("10m", HOUR // 6), ("1h", HOUR), ("1d", DAY)), 1)
)


@register(
    "markout_ladder",
    with_views(V, "WITH med AS (SELECT median(qty) AS qm, median(px) AS pm FROM trades)" + LADDER + f""", long AS (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION
    ALL SELECT * FROM r3),
      flat AS (SELECT *, CASE WHEN quoted THEN markout ELSE 0 END AS c FROM long, med {STACK})
      SELECT policy, horizon, CAST(rung AS INTEGER) AS rung, count(*) AS rows, round(avg(c), 6) + 0.0 AS markout, round(avg(c) - coalesce(1.96 * sqrt(var_samp(c) /
    count(*)), 0), 6) + 0.0 AS markout_lower, round(avg(c) + coalesce(1.96 * sqrt(var_samp(c) / count(*)), 0), 6) + 0.0 AS markout_upper FROM flat GROUP BY ALL"""),
)
def markout_ladder(spark, sf):
    """Captured markout of each policy at three horizons."""
    wide = trades(spark, sf)
    masks = ev.policy_masks(wide)
    q = quotes(spark, sf)
    names = {"10m": HOUR // 6, "1h": HOUR, "1d": DAY}
    for h, us in names.items():
        wide = asof_join(wide.withColumn("due", F.col("t") + us), q, ["symbol"], "due", "t", ["mid"], forward=True, ties=["seq"], width=DAY, prefix=f"{h}_").withColumn(f"markout_bps_{h}", ev.markout_bps(F.col("side"), F.col(f"{h}_mid"), F.col("px")))
    from pitlake.sources.lake import markout_long

    flat = ev.stacked(markout_long(wide), masks, "bps")
    return ev.markout_ladder(flat).select("policy", "horizon", "rung", "rows", *[r6(c).alias(c) for c in ("markout", "markout_lower", "markout_upper")])


MED = REC + ", med AS (SELECT median(qty) AS qm, median(px) AS pm FROM rec)"


@register(
    "cost_waterfall",
    sql(MED, f""", flat AS (SELECT * FROM rec, med {STACK}), g AS (SELECT policy, coalesce(avg(CASE WHEN quoted THEN markout END), 0) AS gross FROM flat GROUP BY 1)
      SELECT policy, round(gross, 6) + 0.0 AS gross, CAST(step AS INTEGER) AS step, stage, delta, round(gross + cum, 6) + 0.0 AS cumulative FROM g, (VALUES (0, 'fees',
    -1.5, -1.5), (1, 'slippage', -0.5, -2.0), (2, 'funding', -0.125, -2.125)) AS t(step, stage, delta, cum)"""),
)
def cost_waterfall(spark, sf):
    """Gross edge of quoted rows less fees, slippage and funding over the horizon."""
    rec = kept(records(spark, sf))
    masks = ev.policy_masks(rec)
    out = ev.cost_waterfall(ev.stacked(rec, masks, "markout"), "markout", 1.5, 0.5, 1.0 * 3600 / (8 * 3600))
    return out.select("policy", r6("gross").alias("gross"), "step", "stage", "delta", r6("cumulative").alias("cumulative"))


@register("capacity_sweep", sql(BOARD, SUMMARY + " SELECT policy, cap, least(1.0, cap) AS fill, round(avg_lift * least(1.0, cap), 6) + 0.0 AS realized_lift FROM ranked, (VALUES (0.05), (0.1), (0.25), (0.5), (1.0), (2.0)) AS t(cap)"))
def capacity_sweep(spark, sf):
    """Lift at six participation caps."""
    out = ev.capacity_sweep(ev.policy_summary(board(spark, sf)), [0.05, 0.1, 0.25, 0.5, 1.0, 2.0])
    return out.select("policy", "cap", "fill", r6("realized_lift").alias("realized_lift"))


@register(
    "acceptance_gate",
    sql(BOARD, PBO + """, pbo AS (SELECT count(*) AS k FROM ranks HAVING count(*) > 0), c AS (SELECT count(DISTINCT policy) AS policies, count(DISTINCT fold) AS
    folds, count(*) AS cells, (SELECT count(k) FROM pbo) AS numeric_pbo,
      (SELECT count(*) FROM (SELECT policy FROM board GROUP BY policy HAVING count(*) >= 3 AND stddev_samp(lift) > 0)) AS numeric_dsr FROM board),
      f AS (SELECT *, list_filter([CASE WHEN policies < 8 THEN 'policies' END, CASE WHEN folds < 8 THEN 'folds' END, CASE WHEN cells < 64 THEN 'cells' END, CASE WHEN
    numeric_pbo < 1 THEN 'pbo' END, CASE WHEN numeric_dsr < 1 THEN 'dsr' END], lambda x: x IS NOT NULL) AS l FROM c)
      SELECT policies, folds, cells, CAST(numeric_pbo AS INTEGER) AS numeric_pbo, array_to_string(l, ',') AS failures, len(l) = 0 AS accepted FROM f"""),
)
def acceptance_gate(spark, sf):
    """Whether the board is large enough and its statistics are numbers."""
    b = kept(board(spark, sf))
    out = ev.acceptance(b, ev.deflated_sharpe_z(b), ev.overfit_probability(b))
    return out.select("policies", "folds", "cells", F.col("numeric_pbo").cast("int").alias("numeric_pbo"), "failures", "accepted")


@register("opportunity_counts", sql("", """SELECT symbol, count(*) AS n, count(*) FILTER (WHERE side = 1) AS buys, count(*) FILTER (WHERE side = -1) AS sells,
    count(*) FILTER (WHERE maker_side > 0) AS maker_plus, count(*) FILTER (WHERE maker_side < 0) AS maker_minus FROM trades GROUP BY 1"""))
def opportunity_counts(spark, sf):
    """Prints by side and maker side."""
    return trades(spark, sf).groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(F.col("side") == 1).alias("buys"), F.count_if(F.col("side") == -1).alias("sells"), F.count_if(F.col("maker_side") > 0).alias("maker_plus"), F.count_if(F.col("maker_side") < 0).alias("maker_minus"))


@register("event_histogram", "SELECT event_type, count(*) AS n, epoch_us(min(ts)) AS first_t, epoch_us(max(ts)) AS last_t FROM events GROUP BY 1")
def event_histogram(spark, sf):
    """Events by kind with the first and last time."""
    from pitlake.plans.views import micros
    from pitlake.session import table

    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.min(micros("ts")).alias("first_t"), F.max(micros("ts")).alias("last_t"))


CUM = """, flat AS (SELECT seq, t, CASE WHEN maker_side > 0 THEN CAST(round(markout, 4) AS DECIMAL(24, 4)) ELSE 0 END AS c FROM rec), cum AS (SELECT *, sum(c) OVER
    (ORDER BY t, seq) AS total, row_number() OVER (ORDER BY t, seq) - 1 AS pos, count(*) OVER () AS n FROM flat), peak AS (SELECT *, max(total) OVER (ORDER BY t, seq) AS
    peak FROM cum)"""


@register("global_drawdown", sql(REC, CUM + """ SELECT seq, pos, CAST(total AS DOUBLE) AS total, CAST(peak - total AS DOUBLE) AS drawdown FROM peak WHERE n <= 200 OR
    pos IN (SELECT round_even(i * ((SELECT count(*) FROM flat) - 1) / 199.0, 0) FROM range(200) r(i))"""))
def global_drawdown(spark, sf):
    """Cumulative captured markout in one order over all records, its drawdown, at 200 even places at most."""
    rec = records(spark, sf)
    value = F.when(F.col("maker_side") > 0, F.round("markout", 4).cast("decimal(24,4)")).otherwise(F.lit(0).cast("decimal(24,4)"))
    order = [F.col("t"), F.col("seq")]
    bucket = by_time(spark, sf)
    flat = kept(number(rec.select("seq", "t", value.alias("c")), order, bucket, "pos"))
    run = running_max(running_sum(flat, F.col("c"), order, bucket, "total"), F.col("total"), order, bucket, "peak")
    n = F.broadcast(flat.agg(F.count("*").alias("n")))
    few = run.crossJoin(n).where(sampled(F.col("pos"), F.col("n"), 200))
    return few.select("seq", "pos", F.col("total").cast("double").alias("total"), (F.col("peak") - F.col("total")).cast("double").alias("drawdown"))


@register("trailing_window", sql("", f"SELECT seq, symbol, count(*) OVER w AS n, round(sum(qty) OVER w, 6) AS qty FROM trades WINDOW w AS (PARTITION BY symbol ORDER BY t RANGE BETWEEN {HOUR} PRECEDING AND CURRENT ROW)"))
def trailing_window(spark, sf):
    """Trades of the symbol in the last hour, both ends inclusive."""
    out = trailing_values(trades(spark, sf), ["symbol"], "t", HOUR, {"n": F.lit(1).cast("long"), "sum_qty": F.col("qty")}, DAY)
    return out.select("seq", "symbol", "n", r6(F.col("sum_qty").cast("double")).alias("qty"))


@register("breakout_signal", sql("", """WITH s AS (SELECT seq, symbol, (px - lag(px, 5) OVER w) / lag(px, 5) OVER w * 10000 AS m FROM trades WINDOW w AS (PARTITION BY
    symbol ORDER BY t, seq)) SELECT seq, symbol, round(m, 6) + 0.0 AS momentum, CASE WHEN m > 500 THEN 'buy' WHEN m < -500 THEN 'sell' ELSE 'none' END AS signal FROM s"""))
def breakout_signal(spark, sf):
    """Momentum over five prints in bps against a threshold; from a price of zero infinite, or NaN if both are."""
    from pyspark.sql import Window

    w = Window.partitionBy("symbol").orderBy("t", "seq")
    before = F.lag("px", 5).over(w)
    m = quotient(F.col("px") - before, before) * 10_000
    return trades(spark, sf).withColumn("m", m).select("seq", "symbol", (rounded("m", 6) + F.lit(0.0)).alias("momentum"), F.when(F.col("m") > 500, "buy").when(F.col("m") < -500, "sell").otherwise("none").alias("signal"))


@register("flow_imbalance", sql("", """WITH f AS (SELECT symbol, t // 3600000000 AS hour, sum(CASE WHEN side = 1 THEN qty ELSE 0 END) AS b, sum(CASE WHEN side = -1
    THEN qty ELSE 0 END) AS a FROM trades GROUP BY ALL) SELECT symbol, hour, round((b - a) / (b + a), 6) + 0.0 AS imbalance, CASE WHEN (b - a) / (b + a) > 0.2 THEN 'buy'
    WHEN (b - a) / (b + a) < -0.2 THEN 'sell' ELSE 'none' END AS signal FROM f"""))
def flow_imbalance(spark, sf):
    """Imbalance of bought and sold size by hour, and the side it asks for."""
    f = trades(spark, sf).groupBy("symbol", F.floor(F.col("t") / HOUR).alias("hour")).agg(F.sum(F.when(F.col("side") == 1, F.col("qty")).otherwise(0)).alias("b"), F.sum(F.when(F.col("side") == -1, F.col("qty")).otherwise(0)).alias("a"))
    i = (F.col("b") - F.col("a")) / (F.col("b") + F.col("a"))
    return f.select("symbol", "hour", r6(i).alias("imbalance"), F.when(i > 0.2, "buy").when(i < -0.2, "sell").otherwise("none").alias("signal"))
