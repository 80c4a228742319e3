"""Queries of tables that are written and read back: the lake, sinks, ledgers and the audit over several probes."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitlake.operators import probes as pr
from pitlake.plans.registry import register
from pitlake.plans.views import trades, versions, with_views
from pitlake.session import scratch, table
from pitlake.sources import lake, sinks

FILLS = """SELECT CASE symbol % 3 WHEN 0 THEN 'a/' ELSE 's' END || symbol AS coin, t // 1000 AS ms, px, qty, seq FROM trades"""


@register("lake_round_trip", with_views("trades", f"""WITH f AS ({FILLS})
  SELECT upper(replace(coin, '/', '-')) AS coin, strftime(epoch_ms(ms), '%Y%m%d') AS date, count(*) AS rows, round(sum(px), 4) AS total, max(seq) AS last FROM f GROUP BY ALL"""))
def lake_round_trip(spark, sf):
    """Trades written as one file a coin and day, found again by their paths and read with an explicit schema."""
    t = trades(spark, sf)
    ms = F.floor(F.col("t") / 1000)
    coin = F.concat(F.when(F.col("symbol") % 3 == 0, "a/").otherwise("s"), F.col("symbol").cast("string"))
    raw = t.select(coin.alias("coin"), F.date_format(F.timestamp_millis(ms), "yyyyMMdd").alias("date"), ms.alias("ts_ms"), "px", F.col("qty").cast("double").alias("sz"), F.col("seq").alias("tid"))
    root = scratch(spark, "lake")
    sinks.write_lake(raw, root, "silver", "fills")
    found = lake.from_path(lake.scan(spark, lake.lake_path(root, "silver", "fills"), lake.FILLS))
    return found.groupBy(F.col("coin_part").alias("coin"), F.col("date_part").alias("date")).agg(F.count("*").alias("rows"), F.round(F.sum("px"), 4).alias("total"), F.max("tid").alias("last"))


@register("observation_sink", with_views("versions", "SELECT generation, count(*) AS rows, min(period) AS first, max(period) AS last, count(DISTINCT key) AS series FROM versions GROUP BY 1"))
def observation_sink(spark, sf):
    """Canonical observations by generation, and what is read back of each."""
    v = versions(spark, sf)
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    rows = v.select(
        F.col("key").cast("string").alias("series_id"), F.concat_ws(":", "key", "period").alias("natural_key"), F.col("period").alias("period_start"), F.col("period").alias("period_end"), "value", F.lit("USD").alias("unit"), F.col("published").alias("published_at"),
        F.col("observed").alias("observed_at"), F.col("reconstructed").alias("reconstructed_at"), "generation", none("string", "capture_id"), none("string", "json"),
    )
    path = scratch(spark, "observations")
    manifest = sinks.write_observations(rows, path)
    back = spark.read.schema(rows.schema).parquet(path).groupBy("generation").agg(F.count("*").alias("n"), F.count_distinct("series_id").alias("series"))
    return manifest.join(back, "generation").where("rows = n").select("generation", "rows", "first", "last", "series")


RUNS = """SELECT 'run' || o_custkey % 50 AS run_id, 'v' || o_orderkey % 3 AS variant, o_orderkey AS "at", o_totalprice AS prediction, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN -1 ELSE 0 END AS position FROM orders"""


@register("report_star", f"""WITH r AS ({RUNS})
  SELECT 'decisions' AS what, run_id, variant, count(*) AS rows, round(sum(prediction), 2) AS total FROM r GROUP BY run_id, variant
  UNION ALL SELECT 'scores', run_id, variant, count(*), round(sum(prediction * 2), 2) FROM r WHERE "at" % 2 = 0 GROUP BY run_id, variant
  UNION ALL SELECT 'events', run_id, variant, count(*), round(CAST(sum("at") AS DOUBLE), 2) FROM r WHERE position <> 0 GROUP BY run_id, variant""")
def report_star(spark, sf):
    """Nested reports as JSON to decisions, scores and events with the run and variant that they are of."""
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    position = F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "O", -1.0).otherwise(0.0)
    by = [F.concat(F.lit("run"), F.col("o_custkey") % 50).alias("run_id"), F.concat(F.lit("v"), k % 3).alias("variant")]
    decision = F.struct(k.alias("at"), F.col("o_totalprice").alias("prediction"), position.alias("position"))
    score = F.when(k % 2 == 0, F.struct(k.alias("at"), (F.col("o_totalprice") * 2).alias("squared_error")))
    event = F.when(position != 0, F.struct(k.alias("at"), F.lit("fill").alias("kind"), k.alias("amount_micros")))
    trial = F.struct("variant", "decisions", "scores", F.struct("events").alias("account"))
    g = o.groupBy(*by).agg(F.collect_list(decision).alias("decisions"), F.collect_list(score).alias("scores"), F.collect_list(event).alias("events"))
    path = scratch(spark, "reports")
    runs = g.groupBy("run_id").agg(F.collect_list(trial).alias("trials"))
    sinks.write_reports(runs.select(F.col("run_id").alias("folder"), F.to_json(F.struct("run_id", "trials")).alias("value")), path)
    out = None
    for name, value in (("decisions", "prediction"), ("scores", "squared_error"), ("events", "amount_micros")):
        part = sinks.star_tables(spark, path)[name].groupBy("run_id", "variant").agg(F.count("*").alias("rows"), F.round(F.sum(value).cast("double"), 2).alias("total")).select(F.lit(name).alias("what"), "run_id", "variant", "rows", "total")
        out = part if out is None else out.unionByName(part)
    return out


@register("leaderboard_csv", "SELECT c_nationkey AS policy, count(*) AS n, round(avg(CASE WHEN c_nationkey % 5 > 0 THEN c_acctbal END), 6) AS lift, CASE WHEN c_nationkey % 5 = 0 THEN 'lift' ELSE '' END AS undefined FROM customer GROUP BY 1")
def leaderboard_csv(spark, sf):
    """A board written as CSV with twelve digits; a number that is not defined is named."""
    c = table(spark, sf, "customer")
    board = c.groupBy(F.col("c_nationkey").alias("policy")).agg(F.count("*").alias("n"), F.avg(F.when(F.col("c_nationkey") % 5 > 0, F.col("c_acctbal"))).alias("lift"))
    path = scratch(spark, "board")
    sinks.write_leaderboard(board, path)
    back = spark.read.schema("policy int, n long, lift double, undefined string").option("header", "true").csv(path)
    return back.select("policy", "n", F.round("lift", 6).alias("lift"), F.coalesce("undefined", F.lit("")).alias("undefined"))


@register("event_lines", with_views("trades", "SELECT symbol, count(*) AS n, sum(qty) AS qty, round(max(px), 6) AS top FROM trades GROUP BY 1"))
def event_lines(spark, sf):
    """Events as JSON lines and back."""
    path = scratch(spark, "events")
    sinks.write_events(trades(spark, sf).select("seq", "symbol", "t", "px", "qty"), path)
    back = spark.read.schema("seq long, symbol long, t long, px double, qty long").json(path)
    return back.groupBy("symbol").agg(F.count("*").alias("n"), F.sum("qty").alias("qty"), F.round(F.max("px"), 6).alias("top"))


@register("ledger_of_reports", """WITH p AS (SELECT c_custkey % 40 AS run, c_custkey AS rank, 'p' || c_custkey AS policy, c_acctbal AS lift, CASE c_custkey % 3 WHEN 0 THEN 'blocked' ELSE 'audited' END AS status FROM customer)
  SELECT 'r' || run AS run_id, 1000 + run AS created_ms, arg_min(policy, rank) FILTER (WHERE status = 'audited') AS policy, arg_min(lift, rank) FILTER (WHERE status = 'audited') AS lift,
    CAST(count(*) FILTER (WHERE status = 'audited') AS INTEGER) AS audited, CAST(count(*) FILTER (WHERE status = 'blocked') AS INTEGER) AS blocked FROM p WHERE run % 4 > 0 GROUP BY run""")
def ledger_of_reports(spark, sf):
    """The best audited policy of each report of the schema; older schemas are passed over."""
    k = F.col("c_custkey")
    row = F.struct(F.concat(F.lit("p"), k).alias("policy"), k.cast("int").alias("rank"), F.col("c_acctbal").alias("lift"), F.when(k % 3 == 0, "blocked").otherwise("audited").alias("status"))
    g = table(spark, sf, "customer").groupBy((k % 40).alias("run")).agg(F.collect_list(row).alias("leaderboard"))
    reports = g.select(F.when(F.col("run") % 4 > 0, 2).otherwise(1).alias("schema_version"), F.concat(F.lit("r"), "run").alias("run_id"), (F.col("run") + 1000).alias("created_ms"), "leaderboard")
    path = scratch(spark, "ledger")
    # one report a file, as report.json in a folder of its own
    files = reports.select(F.col("run_id").alias("folder"), F.to_json(F.struct(*reports.columns)).alias("value"))
    sinks.write_reports(files, path)
    return sinks.report_ledger(spark, path)


@register("leak_audit", with_views("trades", f"""WITH s AS (SELECT DISTINCT symbol FROM trades), kept AS (SELECT DISTINCT symbol FROM trades WHERE px > 5 AND symbol <> 4)
  SELECT 'survivorship' AS probe, 'hard' AS severity, CAST(symbol AS VARCHAR) AS item FROM s WHERE symbol NOT IN (SELECT symbol FROM kept)
  UNION ALL SELECT 'zero_cost_execution', 'hard', 'n' || n_nationkey FROM nation WHERE n_nationkey % 4 = 0 AND n_regionkey % 2 = 0
  UNION ALL SELECT 'lookahead_perturbation', 'hard', CAST(seq AS VARCHAR) FROM trades WHERE seq % 97 = 0"""))
def leak_audit(spark, sf):
    """The violations of three probes in one table."""
    t, n = trades(spark, sf), table(spark, sf, "nation")
    configs = n.select(F.concat(F.lit("n"), "n_nationkey").alias("name"), (F.col("n_nationkey") % 4).cast("double").alias("maker"), (F.col("n_regionkey") % 2).cast("double").alias("taker"), F.lit(0.0).alias("slippage"))
    before = t.select("seq", F.col("px").alias("prediction"))
    after = before.withColumn("prediction", F.when(F.col("seq") % 97 == 0, F.col("prediction") + 1).otherwise(F.col("prediction")))
    return pr.audit(pr.survivorship_leak(t, t.where("px > 5 and symbol <> 4")), pr.zero_cost_leak(configs), pr.perturbation_leak(before, after, "seq")).select("probe", "severity", "item")
