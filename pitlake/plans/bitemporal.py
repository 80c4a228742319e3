"""Queries of the bitemporal store, the catalogue and the graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitlake.operators import bitemporal as bt
from pitlake.plans.registry import register
from pitlake.plans.views import DAY, edges, micros, r6, versions, with_views
from pitlake.session import table

T0 = 915_148_800_000_000  # 1999-01-01
SNAP = 10_000_000
OBS = f"generation <= {SNAP} AND observed <= {{t}} AND (published IS NULL OR published <= {{t}})"
RECON = f"generation <= {SNAP} AND reconstructed IS NOT NULL AND reconstructed <= {{t}}"
PICK = "row_number() OVER (PARTITION BY key, period ORDER BY coalesce(source_order, observed) DESC, observed DESC, id DESC)"


@register("points_asof_observed", with_views("versions", f"SELECT id, key, period, value FROM (SELECT *, {PICK} AS n FROM versions WHERE {OBS.format(t=T0)}) WHERE n = 1"))
def points_asof_observed(spark, sf):
    """The version of each key and period known at a time by the observed clock."""
    return bt.points(versions(spark, sf), "observed", SNAP, T0).select("id", "key", "period", "value")


@register("points_asof_reconstructed", with_views("versions", f"SELECT id, key, period, value FROM (SELECT *, {PICK} AS n FROM versions WHERE {RECON.format(t=T0)}) WHERE n = 1"))
def points_asof_reconstructed(spark, sf):
    """The same by the reconstructed clock."""
    return bt.points(versions(spark, sf), "reconstructed", SNAP, T0).select("id", "key", "period", "value")


FACTS = """, facts AS (SELECT id, key, period, id AS revision, CASE WHEN status = 'F' THEN 'retracted' ELSE 'active' END AS status, key % 25 AS source_id, value, CASE
    WHEN published IS NOT NULL AND observed IS NOT NULL THEN greatest(published, observed) END AS ready FROM versions)"""


def facts(spark, sf):
    v = versions(spark, sf)
    return v.select("id", "key", "period", F.col("id").alias("revision"), F.when(F.col("status") == "F", "retracted").otherwise("active").alias("status"), (F.col("key") % 25).alias("source_id"), "value", bt.ready_observed(F.col("published"), F.col("observed")).alias("ready"))


def sources(spark, sf):
    n = table(spark, sf, "nation")
    return n.select(F.col("n_nationkey").cast("long").alias("source_id"), (F.lit(T0) + (F.col("n_nationkey") - 20) * 30 * DAY).alias("ready"))


SOURCES = f", sources AS (SELECT CAST(n_nationkey AS BIGINT) AS source_id, {T0} + (n_nationkey - 20) * CAST({30 * DAY} AS BIGINT) AS ready FROM nation)"


@register("fact_snapshot", with_views("versions", "WITH z AS (SELECT 1)" + FACTS + SOURCES + f""" SELECT id, key, period, value FROM (SELECT f.*, row_number() OVER
    (PARTITION BY key, period ORDER BY revision DESC) AS n FROM facts f WHERE ready <= {T0} AND source_id IN (SELECT source_id FROM sources WHERE ready <= {T0})) WHERE n
    = 1 AND status = 'active'"""))
def fact_snapshot(spark, sf):
    """Facts and sources ready at a time; a retraction hides what it replaces."""
    return bt.fact_snapshot(facts(spark, sf), sources(spark, sf), T0, ["key", "period"]).select("id", "key", "period", "value")


@register("revision_conflicts", with_views("versions", "SELECT key, source_order AS revision, count(DISTINCT (value, status)) AS contents FROM versions WHERE source_order IS NOT NULL GROUP BY ALL HAVING count(DISTINCT (value, status)) > 1"))
def revision_conflicts(spark, sf):
    """One revision number of a key with different contents."""
    v = versions(spark, sf).where("source_order is not null").withColumn("revision", F.col("source_order"))
    return bt.revision_conflicts(v, ["key"], ["value", "status"])


@register("edge_snapshot", with_views("edges", f"SELECT id, a, b, weight FROM edges WHERE known <= {T0} AND active AND since <= {T0} AND until > {T0}"))
def edge_snapshot(spark, sf):
    """The graph as known and valid at a time."""
    return bt.edge_snapshot(edges(spark, sf).withColumn("revision", F.lit(1)), T0).select("id", "a", "b", "weight")


@register("neighbour_metric", with_views("edges", f"""SELECT b, count(*) AS n_edges, coalesce(CAST(sum(CAST(weight * s_acctbal AS DECIMAL(28, 2))) AS DOUBLE) /
    nullif(sum(weight), 0), 0) AS mean, sum(weight) IS NULL AS missing FROM edges JOIN supplier ON a = s_suppkey WHERE known <= {T0} AND active AND since <= {T0} AND
    until > {T0} GROUP BY b"""))
def neighbour_metric(spark, sf):
    """Mean balance of a part's suppliers, weighted by quantity."""
    live = bt.edge_snapshot(edges(spark, sf).withColumn("revision", F.lit(1)), T0).withColumn("weight", F.col("weight").cast("decimal(12,0)"))
    metric = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_acctbal").cast("decimal(12,2)").alias("value"))
    return bt.neighbour_metric(live, metric).select("b", "n_edges", "mean", "missing")


@register("latest_metric", with_views("versions", """SELECT entity, metric, period, count(DISTINCT id) AS keys, min(value) AS value, count(DISTINCT id) > 1 AS
    ambiguous FROM (SELECT key % 100 AS entity, status AS metric, period, id, value, rank() OVER (PARTITION BY key % 100, status ORDER BY period DESC) AS r FROM versions
    WHERE id % 3 <> 0) WHERE r = 1 GROUP BY ALL"""))
def latest_metric(spark, sf):
    """The last period's fact of each entity and metric, and whether it is ambiguous; every third fact is a part by region and does not count."""
    parts = F.when(F.col("id") % 3 == 0, F.create_map(F.lit("region"), F.lit("EU"))).otherwise(F.create_map().cast("map<string,string>"))
    v = versions(spark, sf).select((F.col("key") % 100).alias("entity"), F.col("status").alias("metric"), F.col("period").alias("period_end"), F.col("period").alias("period_start"), F.col("id").alias("fact_key"), "value", parts.alias("dimensions"))
    return bt.latest_metric(v).select("entity", "metric", F.col("period_end").alias("period"), "keys", "value", "ambiguous")


NODES = f"""nodes AS (SELECT 's' || s_suppkey AS id, 'supplier' AS kind, s_name AS name, {T0} + (s_suppkey % 40 - 20) * {30 * DAY} AS known_from FROM supplier
    UNION ALL SELECT 'p' || p_partkey, 'part', p_name, {T0} + (p_partkey % 40 - 20) * {30 * DAY} FROM part),
  layered AS (SELECT id, ['source', 'knowledge', 'statistical', 'predictive'][n % 4 + 1] AS layer, 's' || a AS a, 'p' || b AS b, known AS known_from, CASE WHEN n % 3 = 0
    THEN known + {400 * DAY} END AS known_to FROM edges)"""


def graph_of(spark, sf):
    """Suppliers and parts as nodes, what is supplied as edges of four layers, some of them withdrawn after 400 days."""
    at = lambda k: F.lit(T0) + (F.col(k) % 40 - 20) * 30 * DAY
    s = table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.lit("supplier").alias("kind"), F.col("s_name").alias("name"), at("s_suppkey").alias("known_from"))
    p = table(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.lit("part").alias("kind"), F.col("p_name").alias("name"), at("p_partkey").alias("known_from"))
    layer = F.element_at(F.array(*map(F.lit, ("source", "knowledge", "statistical", "predictive"))), (F.col("n") % 4 + 1).cast("int"))
    e = edges(spark, sf).select("id", layer.alias("layer"), F.concat(F.lit("s"), "a").alias("a"), F.concat(F.lit("p"), "b").alias("b"), F.col("known").alias("known_from"), F.when(F.col("n") % 3 == 0, F.col("known") + 400 * DAY).alias("known_to"))
    return s.unionByName(p), e


@register("layered_graph", with_views("edges", f"""WITH {NODES}, live AS (SELECT * FROM nodes WHERE known_from <= {T0} AND contains(lower(name || ' ' || kind), '5'))
  SELECT 'node' AS what, id, kind AS layer FROM live
  UNION ALL SELECT 'edge', id, layer FROM layered WHERE known_from <= {T0} AND (known_to IS NULL OR known_to > {T0}) AND (a IN (SELECT id FROM live) OR b IN (SELECT id FROM live))"""))
def layered_graph(spark, sf):
    """Nodes known at a time by a part of their name, and the edges of all layers known then that touch them."""
    nodes, linked = bt.layered_graph(*graph_of(spark, sf), T0, "5")
    return nodes.select(F.lit("node").alias("what"), "id", F.col("kind").alias("layer")).unionByName(linked.select(F.lit("edge").alias("what"), "id", "layer"))


@register("network_of", with_views("edges", f"SELECT id, a, b FROM edges WHERE known <= {T0} AND active AND since <= {T0} AND until > {T0} AND b % 50 < 25 AND b % 7 > 0 AND (SELECT min(a) FROM edges WHERE a % 10 = 3) IN (a, b)"))
def network_of(spark, sf):
    """The edges of one number, supplier or part, as of a time whose source document and its capture are there."""
    e = edges(spark, sf).withColumn("revision", F.lit(1)).withColumn("document_id", F.col("b"))
    d = table(spark, sf, "part").select(F.col("p_partkey").alias("document_id"), (F.col("p_partkey") % 50).alias("capture_id")).where("document_id % 7 > 0")
    c = d.select("capture_id").where("capture_id < 25")
    first = e.where("a % 10 = 3").agg(F.min("a")).first()[0]
    return bt.edge_snapshot(e, T0, first, d, c).select("id", "a", "b")


@register("evidence_rows", with_views("versions", f"""WITH meta AS (SELECT c_custkey AS key, c_name AS name, c_nationkey % 4 AS p FROM customer WHERE c_custkey // 100
    <= {SNAP})
  SELECT 'observed' AS mode, v.id, m.name, v.value, 'u' || v.id % 90 AS url, 'r' || v.id % 90 AS receipt FROM versions v JOIN meta m USING (key) WHERE {OBS.format(t=T0)}
    AND v.id % 90 >= 10 AND p > 0
  UNION ALL SELECT 'reconstructed', v.id, m.name, v.value, 'u' || v.id % 90, NULL FROM versions v JOIN meta m USING (key) WHERE v.generation <= {SNAP} AND v.reconstructed
    <= {T0} AND v.id % 90 >= 10 AND p > 0"""))
def evidence_rows(spark, sf):
    """Each visible version with its series and receipt where the provider's policy allows it; rebuilt views withhold the receipt."""
    v = versions(spark, sf).withColumn("capture_id", F.col("id") % 90)
    captures = spark.range(10, 90).select(F.col("id").alias("capture_id"), F.concat(F.lit("u"), "id").alias("url"), F.concat(F.lit("r"), "id").alias("receipt"))
    series = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.floor(F.col("c_custkey") / 100).alias("generation"), F.lit(0).alias("known"), (F.col("c_nationkey") % 4).cast("string").alias("provider"))
    policies = spark.range(4).select(F.col("id").cast("string").alias("provider"), F.lit(True).alias("enabled"), F.lit(2 * T0).alias("review_due"), F.create_map(F.lit("research"), F.col("id") > 0).alias("purposes"))
    out = None
    for mode in ("observed", "reconstructed"):
        found = bt.evidence(v.select("id"), v, captures, series, policies, "research", mode, SNAP, T0).select(F.lit(mode).alias("mode"), "id", "name", "value", "url", "receipt")
        out = found if out is None else out.unionByName(found)
    return out


@register("snapshot_many_times", with_views("versions", f"""WITH d AS (SELECT {T0} + i * {120 * DAY} AS decision FROM range(0, 6) AS r(i)) SELECT key, decision,
    arg_max(id, id) AS id, arg_max(value, id) AS value FROM d JOIN versions v ON v.observed <= d.decision GROUP BY ALL"""))
def snapshot_many_times(spark, sf):
    """The newest version of each key at six decision times."""
    d = spark.range(6).select((F.lit(T0) + F.col("id") * 120 * DAY).alias("decision"))
    v = versions(spark, sf).withColumn("ready", F.col("observed"))
    return bt.snapshot_many(d, v, ["key"], F.col("id"))


@register("series_catalog", with_views("versions", f"""SELECT c_custkey AS key, c_name AS name, coalesce(n, 0) AS versions FROM customer LEFT JOIN (SELECT key,
    count(*) AS n FROM versions WHERE {OBS.format(t=T0)} GROUP BY 1) ON key = c_custkey WHERE c_custkey // 100 <= {SNAP} AND contains(lower(c_name), '7') AND c_nationkey
    % 3 <> 1"""))
def series_catalog(spark, sf):
    """Series with the count of their visible versions, by a part of the name, of providers whose policy allows research."""
    meta = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.floor(F.col("c_custkey") / 100).alias("generation"), F.lit(0).alias("known"), (F.col("c_nationkey") % 3).cast("string").alias("provider"))
    policies = spark.range(3).select(F.col("id").cast("string").alias("provider"), F.lit(True).alias("enabled"), F.lit(2 * T0).alias("review_due"), F.create_map(F.lit("research"), F.col("id") != 1).alias("purposes"))
    return bt.series_catalog(meta, versions(spark, sf), "observed", SNAP, T0, "7", policies=policies, purpose="research").select("key", "name", "versions")


@register("revision_history", with_views("versions", f"SELECT id, observed, value FROM versions WHERE key = (SELECT min(key) FROM versions) AND {OBS.format(t=T0 + 3000 * DAY)} ORDER BY observed DESC, id DESC LIMIT 200"))
def revision_history(spark, sf):
    """Versions of one series, newest first."""
    v = versions(spark, sf)
    return bt.revision_history(v, v.agg(F.min("key")).first()[0], SNAP, T0 + 3000 * DAY).select("id", "observed", "value")


@register("reveal_outcome", with_views("versions", f"""WITH past AS (SELECT key, period, value, id FROM (SELECT *, {PICK} AS n FROM versions WHERE {OBS.format(t=T0)})
    WHERE n = 1), cur AS (SELECT key, period, value, id FROM (SELECT *, {PICK} AS n FROM versions WHERE {OBS.format(t=T0 + 3000 * DAY)}) WHERE n = 1),
  base AS (SELECT key, arg_max(period, (period, id)) AS base_period, arg_max(value, (period, id)) AS base_value FROM past GROUP BY 1)
  SELECT b.key, base_period, base_value, arg_min(c.period, (c.period, c.id)) AS period, arg_min(c.value, (c.period, c.id)) AS value FROM base b LEFT JOIN cur c ON c.key =
    b.key AND c.period > b.base_period GROUP BY ALL"""))
def reveal_outcome(spark, sf):
    """The baseline of a past scope and the first later value of the current one."""
    v = versions(spark, sf)
    return bt.revealed(bt.points(v, "observed", SNAP, T0), bt.points(v, "observed", SNAP, T0 + 3000 * DAY))


@register("rights_filter", "SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL AND CAST(substr(source, 4) AS INTEGER) % 3 <> 0 GROUP BY 1")
def rights_filter(spark, sf):
    """Documents of providers whose policy allows research; the others, and unknown ones, are denied."""
    d = table(spark, sf, "documents").withColumn("provider", F.col("source"))
    n = F.substring("provider", 4, 9).cast("int")
    policies = d.where("provider is not null").select("provider").distinct().select("provider", F.lit(True).alias("enabled"), F.lit(2 * T0).alias("review_due"), F.create_map(F.lit("research"), n % 3 != 0).alias("purposes"))
    return bt.allowed(d, policies, "research", T0).groupBy("source").agg(F.count("*").alias("n"))


@register("keyset_page", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 100")
def keyset_page(spark, sf):
    """The next page after a key."""
    return table(spark, sf, "orders").where("o_orderkey > 1000").orderBy("o_orderkey").limit(100).select("o_orderkey", "o_totalprice")


@register("latest_changes", with_views("versions", f"""SELECT id, key, greatest(published, observed) AS ready, period FROM versions WHERE published IS NOT NULL AND
    greatest(published, observed) <= {T0} ORDER BY ready DESC, period DESC, id DESC LIMIT 32"""))
def latest_changes(spark, sf):
    """The 32 newest changes known at a time."""
    ready = bt.ready_observed(F.col("published"), F.col("observed"))
    return versions(spark, sf).withColumn("ready", ready).where(F.col("ready") <= T0).orderBy(F.desc("ready"), F.desc("period"), F.desc("id")).limit(32).select("id", "key", "ready", "period")


@register("publication_days", with_views("versions", f"SELECT key, count(*) AS n, count(value) AS n_values, count(DISTINCT published // {DAY}) AS days FROM versions GROUP BY 1"))
def publication_days(spark, sf):
    """Versions, values and distinct publication days of each series."""
    return versions(spark, sf).groupBy("key").agg(F.count("*").alias("n"), F.count("value").alias("n_values"), F.count_distinct(F.floor(F.col("published") / DAY)).alias("days"))


@register("catalogue_status", "SELECT o_orderstatus AS state, count(*) AS n, round(sum(o_totalprice), 2) AS total, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY 1")
def catalogue_status(spark, sf):
    """Counts and sums by state."""
    o = table(spark, sf, "orders")
    return o.groupBy(F.col("o_orderstatus").alias("state")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))


@register("data_coverage", """WITH b AS (SELECT user_id % 10 AS symbol, epoch_us(ts) // 3600000000 AS h FROM events) SELECT symbol, count(DISTINCT h) AS bars,
    greatest(0, (SELECT max(h) - min(h) + 1 FROM b) - count(DISTINCT h)) AS missing FROM b GROUP BY 1""")
def data_coverage(spark, sf):
    """Hours with an event for each symbol, and hours of the whole span without."""
    b = table(spark, sf, "events").select((F.col("user_id") % 10).alias("symbol"), F.floor(micros("ts") / 3_600_000_000).alias("h"))
    span = F.broadcast(b.agg((F.max("h") - F.min("h") + 1).alias("w")))
    g = b.groupBy("symbol").agg(F.count_distinct("h").alias("bars")).crossJoin(span)
    return g.select("symbol", "bars", F.greatest(F.lit(0), F.col("w") - F.col("bars")).alias("missing"))


@register("fact_coverage", with_views("versions", f"""SELECT status AS precision, count(*) AS facts, count(*) FILTER (WHERE published IS NOT NULL AND observed IS NOT NULL) AS ready_observed,
  count(*) FILTER (WHERE published IS NOT NULL AND reconstructed IS NOT NULL) AS ready_reconstructed, count(DISTINCT published // {DAY}) AS release_days FROM versions GROUP BY 1"""))
def fact_coverage(spark, sf):
    """Facts by precision (here the order's status), those ready in each mode, and release days."""
    return bt.fact_coverage(versions(spark, sf), "status", DAY)


PARTITIONS = f"""p AS (SELECT user_id AS symbol, epoch_us(ts) // {DAY} AS date, count(*) AS rows FROM events GROUP BY ALL), s AS (SELECT DISTINCT symbol FROM p), d AS
    (SELECT DISTINCT date FROM p), g AS (SELECT symbol, date, coalesce(rows, 0) AS rows FROM s CROSS JOIN d LEFT JOIN p USING (symbol, date))"""


def user_days(spark, sf):
    """Each event with its user as symbol and its day."""
    return table(spark, sf, "events").select(F.col("user_id").alias("symbol"), F.floor(micros("ts") / DAY).alias("date"))


@register("lake_inventory", f"WITH {PARTITIONS} SELECT symbol, date, rows, least(rows, 2) AS evaluated FROM g")
def lake_inventory(spark, sf):
    """Rows of each requested user and date, and those that a cap leaves."""
    from pitlake.sources.lake import inventory

    e = user_days(spark, sf)
    return inventory(e, e, e, 2)


@register("partition_cap", f"SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id % 10, epoch_us(ts) // {DAY} ORDER BY ts, event_id) AS n FROM events) WHERE n <= 5")
def partition_cap(spark, sf):
    """The first five rows of each symbol and date in order of time."""
    from pitlake.sources.lake import cap_partitions

    e = table(spark, sf, "events").withColumn("symbol", F.col("user_id") % 10).withColumn("date", F.floor(micros("ts") / DAY))
    return cap_partitions(e, ["symbol", "date"], [F.col("ts"), F.col("event_id")], 5).select("event_id")


@register("coverage_gate", f"""WITH {PARTITIONS}
  SELECT count(*) FILTER (WHERE rows = 0) AS missing, count(DISTINCT symbol) FILTER (WHERE rows > 0) AS symbols, count(DISTINCT date) FILTER (WHERE rows > 0) AS dates,
    CAST(sum(rows) AS BIGINT) AS rows,
    CASE WHEN count(*) FILTER (WHERE rows = 0) > 0 THEN 'missing_partitions' ELSE '' END AS failures, count(*) FILTER (WHERE rows = 0) = 0 AS ready FROM g""")
def coverage_gate(spark, sf):
    """Whether the partitions asked for are there."""
    from pitlake.operators.evaluate import coverage_gate as gate
    from pitlake.sources.lake import inventory

    e = user_days(spark, sf)
    return gate(inventory(e, e, e, 1 << 30), 3, 5)
