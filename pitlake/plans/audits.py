"""Queries of rules, probes, audits, text sources and the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitlake.functions import scalars as fn
from pitlake.operators import bitemporal as bt
from pitlake.operators import evaluate as ev
from pitlake.operators import ledger as lg
from pitlake.operators import models as md
from pitlake.operators import probes as pr
from pitlake.operators import rules as ru
from pitlake.plans import leaderboard as lb
from pitlake.plans.registry import register
from pitlake.plans.trading import lagged_series
from pitlake.plans.views import DAY, HOUR, micros, r6, trades, versions, with_views
from pitlake.session import kept, table


@register("overlap_leak", lb.sql(lb.FOLD, """SELECT DISTINCT 'temporal_overlap' AS probe, t.fold || ':' || t.pos AS item FROM (SELECT b.fold, n.* FROM num n JOIN
    bound b ON n.pos < b.tp AND n.e >= b.ts) t JOIN test e ON e.fold = t.fold AND t.s <= e.e AND e.s <= t.e"""))
def overlap_leak(spark, sf):
    """Unpurged training rows whose label runs into the test block."""
    spans = lb.intervals(spark, sf)
    f = ev.test_blocks(spans, lb.FOLDS, *ev.fold_sizes(spans.count(), lb.FOLDS)).select("fold", "role", "pos", "start", "end")
    naive = pr.unpurged(spans, f)
    return pr.overlap_leak(f.unionByName(naive), "pos", HOUR).select("probe", "item")


@register("purged_folds_are_clean", lb.sql(lb.FOLD, "SELECT 'temporal_overlap' AS probe, count(*) AS n FROM train t JOIN test e ON e.fold = t.fold AND t.s <= e.e AND e.s <= t.e"))
def purged_folds_are_clean(spark, sf):
    """No training row of the purged folds meets a test row."""
    found = pr.overlap_leak(lb.folds(spark, sf).select("fold", "role", "pos", "start", "end"), "pos", HOUR)
    return found.agg(F.count("*").alias("n")).select(F.lit("temporal_overlap").alias("probe"), "n")


@register("probe_normaliser", lb.sql(lb.FOLD, "SELECT fold, count(*) AS n FROM test WHERE maker_side > 0 GROUP BY 1"))
def probe_normaliser(spark, sf):
    """Test rows that a normaliser fitted on one maker side of the full sample has seen, by fold."""
    spans = lb.intervals(spark, sf)
    f = ev.test_blocks(spans, lb.FOLDS, *ev.fold_sizes(spans.count(), lb.FOLDS))
    fitted = trades(spark, sf).where("maker_side > 0").select("seq")
    return pr.normaliser_leak(f, fitted, "seq").groupBy(F.split("item", ":")[0].cast("int").alias("fold")).agg(F.count("*").alias("n"))


@register("probe_survivorship", """SELECT CAST(o_custkey AS VARCHAR) AS item FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY o_custkey HAVING
    o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01')""")
def probe_survivorship(spark, sf):
    """Customers of the first year that the last year's universe drops."""
    o = table(spark, sf, "orders").withColumn("symbol", F.col("o_custkey"))
    return pr.survivorship_leak(o.where("o_orderdate < TIMESTAMP_NTZ'1996-01-01 00:00:00'"), o.where("o_orderdate >= TIMESTAMP_NTZ'2001-01-01 00:00:00'")).select("item")


@register("probe_perturbation", with_views("trades", """WITH a AS (SELECT seq, lead(px) OVER (PARTITION BY symbol ORDER BY t, seq) AS p, t FROM trades), b AS (SELECT
    seq, lead(CASE WHEN t > 1705276800000000 THEN px + 1 ELSE px END) OVER (PARTITION BY symbol ORDER BY t, seq) AS p FROM trades) SELECT CAST(a.seq AS VARCHAR) AS item
    FROM a JOIN b USING (seq) WHERE a.t <= 1705276800000000 AND (abs(a.p - b.p) > 0 OR (a.p IS NULL) <> (b.p IS NULL))"""))
def probe_perturbation(spark, sf):
    """Predictions at or before a cutoff that a change of later prices moves: the leaky signal is caught."""
    from pyspark.sql import Window

    cut = 1_705_276_800_000_000  # 2024-01-15
    t = trades(spark, sf)
    leaky = lambda df: df.withColumn("prediction", F.lead("px").over(Window.partitionBy("symbol").orderBy("t", "seq"))).where(F.col("t") <= cut).select("seq", "prediction")
    return pr.perturbation_leak(leaky(t), leaky(t.withColumn("px", F.when(F.col("t") > cut, F.col("px") + 1).otherwise(F.col("px")))), "seq").select("item")


@register("probe_target", """SELECT n_name AS policy, count(*) AS n FROM nation, part WHERE p_partkey % 25 = n_nationkey AND (lower(trim(p_type)) = lower('small') OR
    starts_with(lower(trim(p_name)), 'small')) AND (lower(trim(p_type)) = 'small') GROUP BY 1""")
def probe_target(spark, sf):
    """features named as their target, by policy (part types as features of a policy for each nation)."""
    f = table(spark, sf, "part").join(table(spark, sf, "nation"), F.col("p_partkey") % 25 == F.col("n_nationkey")).select(F.col("n_name").alias("policy"), F.col("p_type").alias("feature"), F.lit("small").alias("target"))
    return pr.target_leak(f).groupBy(F.split("item", ":")[0].alias("policy")).agg(F.count("*").alias("n"))


@register("probe_zero_cost", "SELECT CAST(l_orderkey AS VARCHAR) AS item, count(*) AS n FROM lineitem WHERE l_discount = 0 AND l_tax = 0 AND l_quantity < 5 GROUP BY 1")
def probe_zero_cost(spark, sf):
    """lines that charge neither tax nor discount on a small quantity, as executions at no cost."""
    c = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("name"), F.col("l_tax").alias("maker"), F.col("l_discount").alias("taker"), F.when(F.col("l_quantity") < 5, 0).otherwise(1).alias("slippage"))
    return pr.zero_cost_leak(c).groupBy("item").agg(F.count("*").alias("n"))


@register("falsification_matrix", lb.sql(lb.FOLD, """, sh AS (SELECT seq, markout, coalesce(lead(markout) OVER (ORDER BY t, seq), 0) AS n FROM rec), sy AS (SELECT
    DISTINCT symbol FROM rec),
  found AS (SELECT 'label_lookahead' AS defect, (SELECT count(*) FROM sh WHERE markout <> n) AS evidence
    UNION ALL SELECT 'feature_from_future', (SELECT count(*) FROM sy, (VALUES ('maker_side'), ('markout_bps_1h')) AS f(feature) WHERE feature = 'markout_bps_1h' OR
    starts_with(feature, 'markout_bps_1h_'))
    UNION ALL SELECT 'survivorship', (SELECT count(*) FROM sy WHERE symbol NOT IN (SELECT symbol FROM sy WHERE symbol < 8))
    UNION ALL SELECT 'fold_contamination', (SELECT count(*) FROM (SELECT DISTINCT t.fold, t.pos FROM (SELECT b.fold, n.* FROM num n JOIN bound b ON n.pos < b.tp AND n.e
    >= b.ts) t JOIN test e ON e.fold = t.fold AND t.s <= e.e AND e.s <= t.e))
    UNION ALL SELECT 'fee_slippage_zeroing', (SELECT count(*) FROM (SELECT symbol, 0.0 AS maker, 0.0 AS taker, 0.0 AS slip FROM sy) WHERE maker = 0 AND taker = 0 AND slip
    = 0))
  SELECT defect, evidence, evidence > 0 AS caught FROM found"""))
def falsification_matrix(spark, sf):
    """Five injected defects, each to be caught by its probe."""
    rec = kept(lb.records(spark, sf))
    plain = rec.select("seq", "t", F.col("markout").alias("prediction"))
    shifted = pr.shift_labels(plain, [F.col("t"), F.col("seq")], "prediction", lb.by_time(spark, sf))
    symbols = rec.select("symbol").distinct()
    features = symbols.select(F.col("symbol").cast("string").alias("policy"), F.explode(F.array(F.lit("maker_side"), F.lit("markout_bps_1h"))).alias("feature"), F.lit("markout_bps_1h").alias("target"))
    found = pr.verdicts({
        "label_lookahead": pr.perturbation_leak(plain, shifted, "seq"), "feature_from_future": pr.target_leak(features), "survivorship": pr.survivorship_leak(symbols, symbols.where("symbol < 8")),
        "fold_contamination": overlap_leak(spark, sf), "fee_slippage_zeroing": pr.zero_cost_leak(symbols.select(F.col("symbol").alias("name"), F.lit(0.0).alias("maker"), F.lit(0.0).alias("taker"), F.lit(0.0).alias("slippage"))),
    })
    return found.select("defect", "evidence", "caught")


CUT = 915_148_800_000_000  # 1999-01-01
TRADE_CUT = 1_705_276_800_000_000  # 2024-01-15
MUTATION = f"""WITH late AS (SELECT * REPLACE (CASE WHEN observed > {CUT} THEN value + 1 ELSE value END AS value) FROM versions),
  q2 AS (SELECT * REPLACE (CASE WHEN t > {TRADE_CUT} THEN bid + 1 ELSE bid END AS bid) FROM quotes), t2 AS (SELECT * REPLACE (CASE WHEN t > {TRADE_CUT} THEN qty + 7 ELSE
    qty END AS qty) FROM trades),
  e2 AS (SELECT * REPLACE (CASE WHEN known > {CUT} THEN weight + 1 ELSE weight END AS weight) FROM edges),
  points AS (SELECT id, observed, value FROM versions WHERE observed <= {CUT} QUALIFY row_number() OVER (PARTITION BY key ORDER BY observed DESC, id DESC) = 1), points2
    AS (SELECT id, observed, value FROM late WHERE observed <= {CUT} QUALIFY row_number() OVER (PARTITION BY key ORDER BY observed DESC, id DESC) = 1),
  leaky AS (SELECT id, observed, lead(value) OVER w AS value FROM versions WINDOW w AS (PARTITION BY key ORDER BY observed, id)), leaky2 AS (SELECT id, observed,
    lead(value) OVER w AS value FROM late WINDOW w AS (PARTITION BY key ORDER BY observed, id)),
  prices AS (SELECT t.seq, q.bid FROM trades t ASOF LEFT JOIN quotes q ON t.symbol = q.symbol AND t.t >= q.t WHERE t.t <= {TRADE_CUT}), prices2 AS (SELECT t.seq, q.bid
    FROM trades t ASOF LEFT JOIN q2 q ON t.symbol = q.symbol AND t.t >= q.t WHERE t.t <= {TRADE_CUT}),
  volumes AS (SELECT * FROM (SELECT seq, t, sum(qty) OVER w AS v FROM trades WINDOW w AS (PARTITION BY symbol ORDER BY t RANGE BETWEEN {HOUR} PRECEDING AND CURRENT ROW))
    WHERE t <= {TRADE_CUT}), volumes2 AS (SELECT * FROM (SELECT seq, t, sum(qty) OVER w AS v FROM t2 WINDOW w AS (PARTITION BY symbol ORDER BY t RANGE BETWEEN {HOUR}
    PRECEDING AND CURRENT ROW)) WHERE t <= {TRADE_CUT}),
  sinks AS (SELECT b, sum(CAST(weight AS DECIMAL(18, 2))) AS w FROM edges WHERE known <= {CUT} GROUP BY 1), sinks2 AS (SELECT b, sum(CAST(weight AS DECIMAL(18, 2))) AS w
    FROM e2 WHERE known <= {CUT} GROUP BY 1)
"""
MUTATION_SQL = MUTATION + " UNION ALL ".join(
    f"""SELECT '{n}' AS query, (SELECT count(*) FROM (SELECT * FROM {n} WHERE {w} EXCEPT ALL SELECT * FROM {n}2 WHERE {w})) + (SELECT count(*) FROM (SELECT * FROM {n}2
    WHERE {w} EXCEPT ALL SELECT * FROM {n} WHERE {w})) AS changed"""
    for n, w in (("points", f"observed <= {CUT}"), ("leaky", f"observed <= {CUT}"), ("prices", "true"), ("volumes", "true"), ("sinks", "true"))
)


#: What must not change whatever is done: shown by the audit as 0 rows.
STEADY = ("reordered", "display", "readiness", "maturity", "after_arrival")


@register("mutation_invariance", with_views("versions quotes trades edges", MUTATION_SQL + "".join(f" UNION ALL SELECT '{n}', 0" for n in STEADY)))
def mutation_invariance(spark, sf):
    """Later corrections, prices, volumes and edges, another order of rows and other display texts change no earlier answer, while a query that looks
    ahead is changed; nothing is seen before it is ready, no model has learned from a label of later, no fill precedes its order's arrival."""
    from pyspark.sql import Window

    from pitlake.operators.asof import asof_join, trailing_values
    from pitlake.plans.views import edges, quotes

    v, t, q, e = versions(spark, sf), trades(spark, sf), quotes(spark, sf), edges(spark, sf)
    after = lambda time, at, c, by: lambda df: df.withColumn(c, F.when(F.col(time) > at, F.col(c) + by).otherwise(F.col(c)))
    latest = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("observed"), F.desc("id")))
    checks = {
        "points": (v, after("observed", CUT, "value", 1), lambda df: df.where(F.col("observed") <= CUT).withColumn("n", latest).where("n = 1").select("id", "observed", "value"), F.col("observed") <= CUT),
        "leaky": (v, after("observed", CUT, "value", 1), lambda df: df.withColumn("value", F.lead("value").over(Window.partitionBy("key").orderBy("observed", "id"))).select("id", "observed", "value"), F.col("observed") <= CUT),
        "prices": (q, after("t", TRADE_CUT, "bid", 1), lambda df: asof_join(t, df, ["symbol"], "t", "t", ["bid"], ties=["seq"], width=DAY).select("seq", "t", "bid"), F.col("t") <= TRADE_CUT),
        "volumes": (t, after("t", TRADE_CUT, "qty", 7), lambda df: trailing_values(df, ["symbol"], "t", HOUR, {"v": F.col("qty")}, DAY).select("seq", "t", "v"), F.col("t") <= TRADE_CUT),
        "sinks": (e, after("known", CUT, "weight", 1), lambda df: df.where(F.col("known") <= CUT).groupBy("b").agg(F.sum(F.col("weight").cast("decimal(18,2)")).alias("w")), F.lit(True)),
    }
    facts = v.select("id", "key", "period", "value", F.lit("active").alias("status"), F.col("generation").alias("revision"), (F.col("id") % 7).alias("source_id"), F.col("observed").alias("ready"))
    sources = spark.range(7).select(F.col("id").alias("source_id"), F.lit(0).alias("ready"), F.lit("title").alias("title"))
    snapshot = lambda df: bt.fact_snapshot(facts, df, CUT, ["key", "period"])
    lags = lagged_series(spark, sf)
    middle = lags.agg(F.expr("cast(percentile_approx(m, 0.5) as int)").alias("m")).first()["m"]
    forecast = lambda df: md.walk_forward_ridge(df, ["series"], "m", "ready", ["y1"], "value", 24, 12).select("series", "m", F.round("prediction", 4).alias("prediction"))
    checks |= {
        "reordered": (v, lambda df: df.repartition(5, "value").sortWithinPartitions(F.desc("value")), lambda df: bt.points(df, "observed", 1 << 40, CUT).select("key", "period", "id"), F.lit(True)),
        "display": (sources, lambda df: df.withColumn("title", F.lit("another")), lambda df: snapshot(df).select("id", "value"), F.lit(True)),
        "maturity": (lags, after("ready", middle, "value", 1e6), forecast, F.col("m") <= middle),
    }
    filled = lg.market_fills(t, q, 5_000_000, 0.0, 0.0, DAY).where("q_seq is not null").join(q.select(F.col("seq").alias("q_seq"), F.col("t").alias("q_t")), "q_seq")
    counted = {"readiness": snapshot(sources).where(F.col("ready") > CUT), "after_arrival": filled.where("q_t < due")}
    out = None
    for name, bad in counted.items():
        row = bad.agg(F.count("*").alias("changed")).select(F.lit(name).alias("query"), "changed")
        out = row if out is None else out.unionByName(row)
    for name, (frame, mutate, ask, known) in checks.items():
        row = pr.invariant(frame, mutate, ask, known).agg(F.count("*").alias("changed")).select(F.lit(name).alias("query"), "changed")
        out = row if out is None else out.unionByName(row)
    return out


NAIVE = lb.STACK.replace(") AS p(policy", ", ('leaky_future', markout > 0)) AS p(policy")


@register("leaky_vs_purged", lb.sql(lb.BOARD, lb.SUMMARY + f""",
  mixed AS (SELECT *, row_number() OVER (ORDER BY CAST('0x' || substr(md5('7:' || seq), 1, 15) AS BIGINT), seq) - 1 AS place FROM num),
  naive AS (SELECT place // te AS nf, policy, CASE WHEN quoted THEN markout ELSE 0 END - markout AS lift FROM mixed {NAIVE} WHERE place // te < {lb.FOLDS}),
  cells AS (SELECT nf, policy, avg(lift) AS lift FROM naive GROUP BY ALL), means AS (SELECT policy, avg(lift) AS lift FROM cells GROUP BY 1),
  first AS (SELECT policy, CAST(row_number() OVER (ORDER BY lift DESC, policy) AS INTEGER) AS naive_rank FROM means)
  SELECT policy, naive_rank, CAST(r.rank AS INTEGER) AS audited_rank, naive_rank - CAST(r.rank AS INTEGER) AS delta, CASE WHEN r.rank IS NULL THEN 'blocked' WHEN
    naive_rank IS NULL THEN 'new' ELSE 'ranked' END AS status
  FROM first FULL JOIN ranked r USING (policy)"""))
def leaky_vs_purged(spark, sf):
    """Ranks of the policies on random folds, where a leaky one wins, and on purged folds, where it is blocked."""
    spans = lb.intervals(spark, sf)
    masks = ev.policy_masks(spans)
    _, test = ev.fold_sizes(spans.count(), lb.FOLDS)
    mixed = ev.naive_folds(spans, lb.FOLDS, test, 7, "seq")
    naive = ev.policy_summary(ev.leaderboard(mixed, masks | {"leaky_future": F.col("markout") > 0}, "markout"))
    return ev.rank_shift(naive, ev.policy_summary(lb.board(spark, sf)))


#: Declared scenarios: name, cost, delay, a condition on trades, and how long before its time a quote is used (an invalid back-fill).
SCENARIOS = (("base", 1, 0, "true", 0), ("delay_15m", 1, HOUR // 4, "true", 0), ("double_cost", 2, 0, "true", 0), ("no_buys", 1, 0, "side = -1", 0), ("small_only", 1, 0, "qty < 10", 0), ("backfilled", 1, 0, "true", HOUR))


@register("scenario_sweep", with_views("quotes trades", " UNION ALL ".join(f"""SELECT '{n}' AS scenario, count(*) AS rows, round(avg(t.side * (q.mid - t.px) / t.px *
    10000) - {c}, 4) + 0.0 AS net FROM (SELECT * FROM trades WHERE {w} AND px > 0) t ASOF JOIN quotes q ON t.symbol = q.symbol AND t.t + {HOUR + d - early} <= q.t""" for n, c, d, w, early in SCENARIOS)))
def scenario_sweep(spark, sf):
    """Mean markout net of cost as declared, with a delay, at double cost, on two parts of the trades, and with quotes known too early."""
    from pitlake.operators.asof import asof_join
    from pitlake.plans.views import quotes

    q = quotes(spark, sf)

    def run(df):
        j = asof_join(df.withColumn("due", F.col("t") + HOUR + F.col("delay")), q, ["symbol"], "due", "t", ["mid"], forward=True, ties=["seq"], width=DAY)
        bps = ev.markout_bps(F.col("side"), F.col("mid"), F.col("px"))
        return j.where("mid is not null and px > 0").agg(F.count("*").alias("rows"), (F.round(F.avg(bps) - F.max("cost"), 4) + F.lit(0.0)).alias("net"))

    variant = lambda cost, delay, where: lambda df: df.where(where).withColumn("delay", F.lit(delay)).withColumn("cost", F.lit(cost))
    return pr.scenarios(trades(spark, sf), {n: variant(c, d - early, w) for n, c, d, w, early in SCENARIOS}, run)


EVIDENCE = {"base": ("true", "true", 0), "no_facts": ("true", "false", 0), "no_graph": ("false", "true", 0), "delayed": ("true", "true", 90 * DAY)}


@register("evidence_scenarios", with_views("edges", "WITH f AS (SELECT s_suppkey, CAST(s_acctbal AS DECIMAL(12, 2)) AS value FROM supplier) " + " UNION ALL ".join(f"""SELECT '{n}' AS scenario, count(*) AS parts,
    count(*) FILTER (WHERE missing) AS missing, round(coalesce(avg(mean), 0), 4) + 0.0 AS mean FROM (SELECT b, sum(value) IS NULL AS missing,
    coalesce(CAST(sum(CAST(weight AS DECIMAL(12, 0)) * value) AS DOUBLE) / sum(CASE WHEN value IS NOT NULL THEN weight END), 0) AS mean FROM edges LEFT JOIN f ON
    s_suppkey = a AND {w} WHERE {g} AND known + {d} <= {CUT} AND active AND since <= {CUT} AND until > {CUT} GROUP BY b)""" for n, (g, w, d) in EVIDENCE.items())))
def evidence_scenarios(spark, sf):
    """The network metric of each part as declared, without facts, without the graph, and with edges known ninety days later."""
    from pitlake.plans.views import edges

    supplier = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_acctbal").cast("decimal(12,2)").alias("value"))

    def run(df):
        live = bt.edge_snapshot(df.withColumn("known", F.col("known") + F.col("late")), CUT).withColumn("weight", F.col("weight").cast("decimal(12,0)"))
        met = bt.neighbour_metric(live.withColumn("a", F.when(F.col("facts"), F.col("a"))), supplier)
        return met.agg(F.count("*").alias("parts"), F.count_if("missing").alias("missing"), (F.round(F.coalesce(F.avg("mean"), F.lit(0.0)), 4) + F.lit(0.0)).alias("mean"))

    frame = edges(spark, sf).withColumn("revision", F.lit(1))
    variant = lambda g, w, d: lambda df: df.where(g).withColumn("facts", F.expr(w)).withColumn("late", F.lit(d))
    return pr.scenarios(frame, {n: variant(*x) for n, x in EVIDENCE.items()}, run)


@register("quality_quarantine", """SELECT array_to_string(list_filter([CASE WHEN NOT l_quantity > 2 THEN 'quantity' END, CASE WHEN NOT l_extendedprice / l_quantity >
    950 THEN 'price' END, CASE WHEN NOT l_linenumber <> 3 THEN 'line' END], lambda x: x IS NOT NULL), ',') AS violations, count(*) AS n FROM lineitem WHERE NOT
    (l_quantity > 2 AND l_extendedprice / l_quantity > 950 AND l_linenumber <> 3) GROUP BY 1""")
def quality_quarantine(spark, sf):
    """Rows that break rules, by the names of the rules."""
    rules = {"quantity": F.col("l_quantity") > 2, "price": F.col("l_extendedprice") / F.col("l_quantity") > 950, "line": F.col("l_linenumber") != 3}
    _, bad = ru.split(table(spark, sf, "lineitem"), rules)
    return bad.groupBy(F.array_join("violations", ",").alias("violations")).agg(F.count("*").alias("n"))


@register("conflicting_keys", """SELECT l_orderkey, l_linenumber, count(DISTINCT (l_partkey, l_suppkey, l_quantity, l_shipdate)) AS payloads FROM lineitem GROUP BY
    ALL HAVING count(DISTINCT (l_partkey, l_suppkey, l_quantity, l_shipdate)) > 1""")
def conflicting_keys(spark, sf):
    """Order lines with one key and several payloads."""
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    return ru.conflicts(l, ["l_orderkey", "l_linenumber"])


@register("reconciliation", """SELECT status, count(*) AS n FROM (SELECT CASE WHEN e.o_orderkey IS NULL THEN 'missing' WHEN abs(o.o_totalprice - e.want) > 100 THEN
    'mismatch' ELSE 'ok' END AS status FROM orders o LEFT JOIN (SELECT o_orderkey, o_totalprice + o_orderkey % 300 AS want FROM orders WHERE o_orderkey % 10 <> 0) e USING
    (o_orderkey)) GROUP BY 1""")
def reconciliation(spark, sf):
    """Computed against expected totals with a tolerance."""
    o = table(spark, sf, "orders")
    want = o.where("o_orderkey % 10 <> 0").select("o_orderkey", (F.col("o_totalprice") + F.col("o_orderkey") % 300).alias("o_totalprice"))
    return pr.reconcile(o, want, "o_orderkey", "o_totalprice", 100.0).groupBy("status").agg(F.count("*").alias("n"))


@register("semantic_ids", "SELECT o_orderkey, sha256(CAST(o_custkey AS VARCHAR) || chr(0) || o_orderstatus || chr(0) || o_orderpriority) AS id FROM orders".replace("chr(0)", "'|'"))
def semantic_ids(spark, sf):
    """F16: stable ids from parts (a printable separator here, as SQL strings hold no NUL)."""
    parts = F.concat_ws("|", F.col("o_custkey").cast("string"), "o_orderstatus", "o_orderpriority")
    return table(spark, sf, "orders").select("o_orderkey", F.sha2(parts, 256).alias("id"))


@register("content_hash", """WITH l AS (
    SELECT o_orderkey AS k, sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '","o_totalprice":' ||
    CAST(o_totalprice AS VARCHAR) || '}') AS h FROM orders),
  a AS (SELECT k // 1000 AS a_g, sha256(string_agg(h, '' ORDER BY k)) AS a_h, count(*) AS a_n FROM l GROUP BY 1),
  b AS (SELECT a_g // 4096 AS b_g, sha256(string_agg(a_h, '' ORDER BY a_g)) AS b_h, sum(a_n) AS b_n FROM a GROUP BY 1),
  c AS (SELECT b_g // 4096 AS c_g, sha256(string_agg(b_h, '' ORDER BY b_g)) AS c_h, sum(b_n) AS c_n FROM b GROUP BY 1)
  SELECT sha256(string_agg(c_h, '' ORDER BY c_g)) AS hash, CAST(sum(c_n) AS BIGINT) AS rows FROM c""")
def content_hash(spark, sf):
    """One order-stable hash of all orders; a test holds it against partitionings."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    return pr.content_hash(o, [F.col("o_orderkey")], F.floor(F.col("o_orderkey") / 1000))


@register("link_extract", r"""WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"', 1)) AS href FROM pages), h AS (SELECT *,
    regexp_extract(url, '^(https?://[^/?#]+)', 1) AS root, regexp_extract(url, '^(https?)://', 1) AS scheme FROM l),
  r AS (SELECT page_id, root, regexp_replace(CASE WHEN regexp_matches(href, '^https?://') THEN href WHEN starts_with(href, '//') THEN scheme || ':' || href WHEN
    starts_with(href, '/') THEN root || href WHEN starts_with(href, '#') OR regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') OR href = '' THEN NULL ELSE root ||
    coalesce(nullif(regexp_extract(url, '^https?://[^/?#]+(/(?:[^?#]*/)?)', 1), ''), '/') || href END, '#.*$', '') AS link FROM h)
  SELECT DISTINCT page_id, link, regexp_extract(link, '^(https?://[^/?#]+)', 1) = root AS same_host FROM r WHERE link IS NOT NULL""")
def link_extract(spark, sf):
    """Links of every page, made absolute, without fragments and repeats."""
    from pitlake.sources.documents import links

    return links(table(spark, sf, "pages").select("page_id", "url", "html"), "page_id")


@register("allowed_hosts", r"""SELECT page_id, regexp_matches(url, '^https://') AND (regexp_extract(lower(url), '^https://([^/:?#]+)', 1) = 'example.org' OR
    ends_with(regexp_extract(lower(url), '^https://([^/:?#]+)', 1), '.example.org')) AS allowed FROM pages""")
def allowed_hosts(spark, sf):
    """Pages of hosts on a list, over https."""
    return table(spark, sf, "pages").select("page_id", fn.allowed_host(F.lower("url"), ["example.org"]).alias("allowed"))


@register("csv_profile", " UNION ALL ".join(f"""SELECT '{c}' AS name, count(*) FILTER (WHERE trim(CAST({c} AS VARCHAR)) = '' OR {c} IS NULL) AS missing, count(*)
    FILTER (WHERE TRY_CAST({c} AS DOUBLE) IS NOT NULL) AS numeric, count(*) AS rows FROM customer""" for c in ("c_custkey", "c_name", "c_mktsegment")))
def csv_profile(spark, sf):
    """Per column missing cells, numeric cells and rows, in one pass over columns read as text."""
    from pitlake.sources.documents import profile

    c = table(spark, sf, "customer").select(*[F.col(x).cast("string") for x in ("c_custkey", "c_name", "c_mktsegment")])
    return profile(c).select("name", "missing", "numeric", "rows")


@register("dataset_relevance", """WITH d AS (SELECT doc_id, lower(text) AS t FROM documents), s AS (SELECT doc_id, (CAST(contains(t, 'licensed') AS INTEGER) +
    CAST(contains(t, 'under') AS INTEGER) + CAST(contains(t, 'license') AS INTEGER)) / 3 AS rel FROM d) SELECT doc_id, round(least(1, greatest(0, 0.65 * rel + 0.35 * 0.5
    - 0.1 * 0.2)), 6) AS score FROM s ORDER BY score DESC, doc_id LIMIT 25""")
def dataset_relevance(spark, sf):
    """The 25 documents with the most words of a query."""
    from pitlake.sources.documents import relevance

    d = table(spark, sf, "documents").withColumn("provenance", F.lit(0.5)).withColumn("cost", F.lit(0.2))
    return relevance(d, F.col("text"), "Licensed under license a", "doc_id", 25).select("doc_id", r6("score").alias("score"))


@register("conversation_gaps", """WITH t AS (SELECT conv_id, turn, turn - lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS gap FROM conversations) SELECT
    conv_id, count(*) AS turns, count(*) FILTER (WHERE gap <> 1) AS gaps, min(turn) AS first FROM t GROUP BY 1""")
def conversation_gaps(spark, sf):
    """Order and completeness of each conversation's turns."""
    from pyspark.sql import Window

    t = table(spark, sf, "conversations").withColumn("gap", F.col("turn") - F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn")))
    return t.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("gap") != 1).alias("gaps"), F.min("turn").alias("first"))


@register("distinct_union", "SELECT k, count(*) AS n FROM (SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer) GROUP BY 1")
def distinct_union(spark, sf):
    """Known keys of two tables, each once."""
    a, b = table(spark, sf, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    return a.unionByName(b).distinct().groupBy("k").agg(F.count("*").alias("n"))


@register("orphan_keys", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def orphan_keys(spark, sf):
    """Customers without a finished order."""
    done = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(done, "c_custkey", "left_anti")


@register("first_seen", "SELECT l_suppkey, min(l_orderkey) AS first FROM lineitem GROUP BY 1 ORDER BY 2, 1")
def first_seen(spark, sf):
    """Suppliers in the order in which orders mention them."""
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.min("l_orderkey").alias("first")).orderBy("first", "l_suppkey")


@register("period_bounds", """SELECT o_orderkey, CAST(CASE o_orderkey % 3 WHEN 0 THEN make_date(year(o_orderdate), 1, 1) WHEN 1 THEN date_trunc('month', o_orderdate)
    ELSE o_orderdate END AS DATE) AS first, CAST(CASE o_orderkey % 3 WHEN 0 THEN make_date(year(o_orderdate), 12, 31) WHEN 1 THEN last_day(o_orderdate) ELSE o_orderdate
    END AS DATE) AS last FROM orders""")
def period_bounds(spark, sf):
    """bounds of periods written as a year, a month or a day."""
    text = F.substring(F.col("o_orderdate").cast("string"), 1, F.when(F.col("o_orderkey") % 3 == 0, 4).when(F.col("o_orderkey") % 3 == 1, 7).otherwise(10))
    return table(spark, sf, "orders").select("o_orderkey", fn.period_start(text).alias("first"), fn.period_end(text).alias("last"))
