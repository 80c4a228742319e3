"""Inputs of the operators, derived from the star tables: each as a DataFrame and as SQL of the same columns.

Times are microseconds since the epoch as long integers, so that nothing depends on a session's zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitlake.session import table

DAY = 86_400_000_000
HOUR = 3_600_000_000


def micros(name: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {name})")


def r6(c: Column | str) -> Column:
    """Rounded to six digits, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def trades(spark: SparkSession, sf: str) -> DataFrame:
    """Prints of ten symbols: seq (unique), symbol, t, px, qty, side (1 buy, -1 sell), maker_side."""
    k = F.get_json_object("props", "$.k").cast("long") + 1
    return table(spark, sf, "events").select(
        F.col("event_id").alias("seq"), (F.col("user_id") % 10).alias("symbol"), micros("ts").alias("t"), F.col("value").alias("px"), k.alias("qty"),
        F.when(F.col("event_type").isin("purchase", "signup"), 1).otherwise(-1).alias("side"), (F.col("event_id") % 2 * 2 - 1).cast("int").alias("maker_side"),
    )


def quotes(spark: SparkSession, sf: str) -> DataFrame:
    """Top of book from views and clicks: seq, symbol, t, bid, ask, mid."""
    e = table(spark, sf, "events").where(F.col("event_type").isin("view", "click"))
    return e.select(F.col("event_id").alias("seq"), (F.col("user_id") % 10).alias("symbol"), micros("ts").alias("t"), (F.col("value") * 0.999).alias("bid"), (F.col("value") * 1.001).alias("ask"), F.col("value").alias("mid"))


def versions(spark: SparkSession, sf: str) -> DataFrame:
    """Bitemporal observations: id, key, source_order, published, observed, reconstructed (null for some), generation, value, status, period."""
    o = table(spark, sf, "orders")
    p = micros("o_orderdate")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("key"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 50).alias("source_order"),
        F.when(F.col("o_orderkey") % 11 != 0, p).alias("published"), (p + F.col("o_orderkey") % 30 * DAY).alias("observed"),
        F.when(F.col("o_orderkey") % 7 != 0, p + 60_000_000).alias("reconstructed"), F.floor(F.col("o_orderkey") / 1000).alias("generation"),
        F.col("o_totalprice").alias("value"), F.col("o_orderstatus").alias("status"), F.floor(p / (90 * DAY)).alias("period"),
    )


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Fills: account, symbol, t, px, qty (signed), fee, and r, which orders fills of one time: line items repeat, so by all that differs."""
    l = table(spark, sf, "lineitem")
    qty = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    return l.select(
        F.col("l_suppkey").alias("account"), (F.col("l_partkey") % 20).alias("symbol"), micros("l_shipdate").alias("t"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("ln"), F.col("l_partkey").alias("part"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"), qty.alias("qty"), (F.col("l_extendedprice") * F.col("l_tax")).alias("fee"),
    )


#: The columns that put one account's fills of a symbol in order.
LEDGER_ORDER = ("t", "o", "ln", "part", "qty", "px", "fee")


def monthly(spark: SparkSession, sf: str) -> DataFrame:
    """A monthly series for each nation: series, m (months since 1970), value."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    joined = o.join(c, o["o_custkey"] == c["c_custkey"])
    m = (F.year("o_orderdate") - 1970) * 12 + F.month("o_orderdate") - 1
    return joined.groupBy(F.col("c_nationkey").alias("series"), m.alias("m")).agg(F.sum(F.col("o_totalprice").cast("decimal(20,2)")).cast("double").alias("value"))


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scored rows: id, part (language), p in [0, 1], label."""
    d, l = table(spark, sf, "documents"), table(spark, sf, "labels")
    p = F.round((F.col("n_chars") * 7919 % 1000) / 1000, 3)
    return d.join(l, "doc_id").select(F.col("doc_id").alias("id"), F.col("lang").alias("part"), p.alias("p"), F.col("quality").alias("label"))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Supplies edges supplier -> part: id, a, b, weight, since, until (half open), known (first ship time of the edge), revision, active."""
    l = table(spark, sf, "lineitem")
    t = micros("l_shipdate")
    g = l.groupBy(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")).agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("weight"), F.min(t).alias("since"), F.max(t).alias("until"), F.count("*").alias("n"))
    return g.select(F.concat_ws("-", "a", "b").alias("id"), "a", "b", "weight", "since", (F.col("until") + 400 * DAY).alias("until"), (F.col("since") + (F.col("a") + F.col("b")) % 90 * DAY).alias("known"), "n", ((F.col("a") + F.col("b")) % 13 != 0).alias("active"))


#: SQL of the same views; with_views() puts them before a query.
SQL = {
    "trades": "SELECT event_id AS seq, user_id % 10 AS symbol, epoch_us(ts) AS t, value AS px, CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS qty, CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE -1 END AS side, CAST(event_id % 2 * 2 - 1 AS INTEGER) AS maker_side FROM events",
    "quotes": "SELECT event_id AS seq, user_id % 10 AS symbol, epoch_us(ts) AS t, value * 0.999 AS bid, value * 1.001 AS ask, value AS mid FROM events WHERE event_type IN ('view', 'click')",
    "versions": f"""SELECT o_orderkey AS id, o_custkey AS key, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 50 END AS source_order,
      CASE WHEN o_orderkey % 11 <> 0 THEN epoch_us(o_orderdate) END AS published, epoch_us(o_orderdate) + o_orderkey % 30 * {DAY} AS observed,
      CASE WHEN o_orderkey % 7 <> 0 THEN epoch_us(o_orderdate) + 60000000 END AS reconstructed, o_orderkey // 1000 AS generation,
      o_totalprice AS value, o_orderstatus AS status, epoch_us(o_orderdate) // {90 * DAY} AS period FROM orders""",
    "ledger": """SELECT l_suppkey AS account, l_partkey % 20 AS symbol, epoch_us(l_shipdate) AS t, l_orderkey AS o, l_linenumber AS ln, l_partkey AS part, l_extendedprice / l_quantity AS px,
      CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS qty, l_extendedprice * l_tax AS fee FROM lineitem""",
    "monthly": "SELECT c_nationkey AS series, CAST((year(o_orderdate) - 1970) * 12 + month(o_orderdate) - 1 AS INTEGER) AS m, CAST(sum(CAST(o_totalprice AS DECIMAL(20, 2))) AS DOUBLE) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL",
    "scores": "SELECT doc_id AS id, lang AS part, round((n_chars * 7919 % 1000) / 1000, 3) AS p, quality AS label FROM documents JOIN labels USING (doc_id)",
    "edges": f"""SELECT a || '-' || b AS id, a, b, weight, since, until + {400 * DAY} AS until, since + (a + b) % 90 * {DAY} AS known, n, (a + b) % 13 <> 0 AS active FROM (
      SELECT l_suppkey AS a, l_partkey AS b, CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS weight, min(epoch_us(l_shipdate)) AS since, max(epoch_us(l_shipdate)) AS until, count(*) AS n FROM lineitem GROUP BY ALL)""",
}


def with_views(names: str, sql: str) -> str:
    """The SQL with the named views before it; its own WITH clause goes on with them."""
    body = sql.strip()
    own = body[:5].upper() == "WITH "
    views = ", ".join(f"{n} AS ({SQL[n]})" for n in names.split())
    return f"WITH {views}{', ' + body[5:] if own else ' ' + body}"
