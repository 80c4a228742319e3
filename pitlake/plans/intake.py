"""Queries of rules, scalar columns, scans, payload parsers and ingestion steps.

Payloads are written as JSON from the star tables by Spark and parsed again; the SQL goes from the tables straight to the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlake.functions import scalars as fn
from pitlake.operators import bars as br
from pitlake.operators import bitemporal as bt
from pitlake.operators import ledger as lg
from pitlake.operators import probes as pr
from pitlake.operators import rules as ru
from pitlake.operators.numbering import even_buckets
from pitlake.plans.registry import register
from pitlake.plans.views import DAY, HOUR, edges, micros, quotes, r6, trades, versions, with_views
from pitlake.session import table
from pitlake.sources import documents as doc
from pitlake.sources import lake, sinks
from pitlake.streaming import ingest as ing


def broken(df: DataFrame, rules: ru.Rules) -> DataFrame:
    """How many rows break which rules; rows that break none are not listed."""
    _, bad = ru.split(df, rules)
    return bad.groupBy(F.array_join("violations", ",").alias("violations")).agg(F.count("*").alias("n"))


def broken_sql(view: str, rules: dict[str, str]) -> str:
    """SQL of broken(): the names of the conditions that are not true, in order."""
    names = ", ".join(f"CASE WHEN ({c}) IS NOT TRUE THEN '{n}' END" for n, c in rules.items())
    return f"SELECT v AS violations, count(*) AS n FROM (SELECT array_to_string(list_filter([{names}], lambda x: x IS NOT NULL), ',') AS v FROM ({view})) WHERE v <> '' GROUP BY 1"


# --- rules ---------------------------------------------------------------------------------------------


TRADE = """SELECT CASE WHEN seq % 19 = 0 THEN 's' ELSE 'S' END || symbol AS symbol, px - 5 AS price, qty - 3 AS quantity, maker_side * (1 + seq % 23 // 22) AS
    maker_side, seq AS first_id, CASE WHEN seq % 5 > 0 THEN seq + seq % 11 - 2 END AS last_id, t FROM trades"""


@register("trade_rules", with_views("trades", broken_sql(TRADE, {"symbol": "symbol = upper(symbol)", "price": "price > 0", "quantity": "quantity > 0", "maker_side": "abs(maker_side) = 1", "ids": "last_id IS NULL OR last_id >= first_id", "time": "t IS NOT NULL"})))
def trade_rules(spark, sf):
    """Prints, some with a low price, no size, ids out of order, a symbol in small letters or another maker side."""
    t, k = trades(spark, sf), F.col("seq")
    given = t.select(
        F.concat(F.when(k % 19 == 0, "s").otherwise("S"), F.col("symbol").cast("string")).alias("symbol"), (F.col("px") - 5).alias("price"), (F.col("qty") - 3).alias("quantity"),
        (F.col("maker_side") * F.when(k % 23 == 22, 2).otherwise(1)).alias("maker_side"), k.alias("first_id"), F.when(k % 5 > 0, k + k % 11 - 2).alias("last_id"), F.timestamp_micros("t").alias("timestamp"),
    )
    return broken(given, ru.trade_rules())


@register("quote_rules", with_views("quotes", broken_sql("SELECT CASE WHEN seq % 17 = 0 THEN ask ELSE bid END - 8 AS bid, ask - 8 AS ask, CASE WHEN seq % 29 > 0 THEN t END AS t FROM quotes", {"bid": "bid > 0", "ask": "ask > 0", "spread": "ask > bid", "time": "t IS NOT NULL"})))
def quote_rules(spark, sf):
    """Quotes, some crossed, negative or without time."""
    k = F.col("seq")
    given = quotes(spark, sf).select((F.when(k % 17 == 0, F.col("ask")).otherwise(F.col("bid")) - 8).alias("bid"), (F.col("ask") - 8).alias("ask"), F.when(k % 29 > 0, F.timestamp_micros("t")).alias("timestamp"))
    return broken(given, ru.quote_rules())


BAR = f"""SELECT start + CASE WHEN symbol = 3 THEN 1 ELSE 0 END AS s, start + CASE WHEN symbol = 4 THEN 2 ELSE 1 END * {HOUR} + CASE WHEN symbol = 3 THEN 1 ELSE 0 END
    AS e, start + {HOUR} + CASE WHEN symbol = 5 THEN -1 ELSE 0 END AS a,
  open, high - CASE WHEN symbol = 6 THEN 1 ELSE 0 END AS high, low, close, volume FROM (SELECT symbol, t // {HOUR} * {HOUR} AS start, arg_min(px, (t, seq)) AS open,
    max(px) AS high, min(px) AS low, arg_max(px, (t, seq)) AS close, sum(qty) AS volume FROM trades GROUP BY ALL)"""


@register("bar_rules", with_views("trades", broken_sql(BAR, {"width": f"e - s = {HOUR}", "aligned": f"s % {HOUR} = 0", "available": "a >= e", "contained": "low <= open AND low <= close AND high >= open AND high >= close", "positive": "low > 0", "volume": "volume >= 0"})))
def bar_rules(spark, sf):
    """Hourly bars, shifted, too wide, known too early or with too low a high for some symbols."""
    b, s = br.from_prints(trades(spark, sf), HOUR, F.lit(0)), F.col("symbol")
    moved = F.when(s == 3, 1).otherwise(0)
    given = b.select(
        (F.col("start") + moved).alias("start"), (F.col("start") + F.when(s == 4, 2).otherwise(1) * HOUR + moved).alias("end"), (F.col("end") - F.when(s == 5, 1).otherwise(0)).alias("available_at"),
        "open", (F.col("high") - F.when(s == 6, 1).otherwise(0)).alias("high"), "low", "close", "volume",
    )
    return broken(given, ru.bar_rules(HOUR))


FACT = """SELECT CASE WHEN o_orderkey % 7 > 0 THEN o_orderstatus ELSE '' END AS locator, o_orderkey % 30 AS a, 12 + o_orderkey % 9 AS b, o_orderkey % 29 - 14 AS
    scale, CASE o_orderstatus WHEN 'F' THEN 'active' WHEN 'O' THEN 'retracted' ELSE 'lost' END AS status FROM orders"""


@register("fact_rules", broken_sql(FACT, {"locator": "locator <> ''", "period": "a <= b", "scale": "scale BETWEEN -12 AND 12", "status": "status <> 'lost'"}))
def fact_rules(spark, sf):
    """Orders as facts with an empty locator, a period in reverse, a scale out of bounds or an unknown status."""
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "active").when(F.col("o_orderstatus") == "O", "retracted").otherwise("lost")
    given = table(spark, sf, "orders").select(F.when(k % 7 > 0, F.col("o_orderstatus")).otherwise("").alias("locator"), (k % 30).alias("start"), (12 + k % 9).alias("end"), (k % 29 - 14).alias("scale"), status.alias("status"))
    return broken(given, ru.fact_rules())


@register("orphan_facts", "SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_acctbal >= 0)")
def orphan_facts(spark, sf):
    """Orders whose source, a customer in credit, is not there."""
    sources = table(spark, sf, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("o_custkey"))
    return ru.orphans(table(spark, sf, "orders"), sources, "o_custkey").select("o_orderkey")


KINDS = ("supplies", "exposed_to", "rents")


@register("relationship_rules", with_views("edges", broken_sql("""SELECT CAST(weight * 20000 AS BIGINT) AS w, since AS f, CASE WHEN a % 6 = 0 THEN NULL WHEN a % 11 =
    0 THEN since ELSE until END AS u, CASE a % 3 WHEN 0 THEN 'supplies' WHEN 1 THEN 'exposed_to' ELSE 'rents' END AS r FROM edges""", {"weight": "w >= 0 AND w <= 1000000", "valid": "u IS NULL OR u > f", "relation": "r IN ('supplies', 'purchases', 'competes', 'manufactures', 'exposed_to')"})))
def relationship_rules(spark, sf):
    """Edges with too large a weight, no span of validity or another kind."""
    a = F.col("a")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (a % 3 + 1).cast("int"))
    given = edges(spark, sf).select((F.col("weight") * 20_000).cast("long").alias("weight_ppm"), F.col("since").alias("valid_from"), F.when(a % 6 != 0, F.when(a % 11 == 0, F.col("since")).otherwise(F.col("until"))).alias("valid_to"), kind.alias("relation"))
    return broken(given, ru.relationship_rules())


@register("source_rules", broken_sql("SELECT CASE WHEN doc_id % 8 > 0 THEN source ELSE '' END AS id, CASE doc_id % 5 WHEN 0 THEN upper(sha256(text)) WHEN 1 THEN substr(sha256(text), 2) ELSE sha256(text) END AS h FROM documents", {"id": "id <> ''", "sha256": "len(h) = 64 AND regexp_full_match(h, '[0-9a-fA-F]*')"}))
def source_rules(spark, sf):
    """Documents as sources without id or with a malformed hash; upper-case hex is a hash too."""
    k, h = F.col("doc_id"), F.sha2("text", 256)
    given = table(spark, sf, "documents").select(F.when(k % 8 > 0, F.col("source")).otherwise("").alias("id"), F.when(k % 5 == 0, F.upper(h)).when(k % 5 == 1, F.substring(h, 2, 63)).otherwise(h).alias("content_sha256"))
    return broken(given, ru.source_rules())


@register("duplicate_sources", "SELECT any_value(sha256(text)) AS sha256, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_sources(spark, sf):
    """Contents that are there more than once."""
    return ru.duplicates(table(spark, sf, "documents").select(F.sha2("text", 256).alias("sha256")), ["sha256"])


SEEN = """SELECT CASE doc_id % 6 WHEN 0 THEN 'instant' WHEN 1 THEN 'day' ELSE 'date_end_conservative' END AS precision, CASE doc_id % 5 WHEN 0 THEN 'Mars/Base' WHEN 1
    THEN 'UTC' ELSE 'America/New_York' END AS zone,
  CASE WHEN doc_id % 31 > 0 THEN n_chars END AS published, CASE WHEN doc_id % 4 > 0 THEN n_chars END AS first_seen, CASE WHEN doc_id % 7 > 0 THEN n_chars + doc_id % 9 - 2
    END AS extracted, CASE WHEN doc_id % 8 > 0 THEN n_chars + doc_id % 10 - 3 END AS modelled FROM documents"""


@register("availability_rules", broken_sql(SEEN, {"precision": "precision IN ('instant', 'date_end_conservative')", "zone": "zone <> 'Mars/Base'", "published": "published IS NOT NULL", "extracted": "first_seen IS NULL OR extracted IS NULL OR extracted >= first_seen", "modelled": "modelled IS NULL OR published IS NULL OR modelled >= published"}))
def availability_rules(spark, sf):
    """Clocks of documents with an unknown precision or zone, extracted before they were received or modelled before they were published."""
    k, n = F.col("doc_id"), F.col("n_chars")
    given = table(spark, sf, "documents").select(
        F.when(k % 6 == 0, "instant").when(k % 6 == 1, "day").otherwise("date_end_conservative").alias("precision"), F.when(k % 5 == 0, "Mars/Base").when(k % 5 == 1, "UTC").otherwise("America/New_York").alias("zone"),
        F.when(k % 31 > 0, n).alias("published"), F.when(k % 4 > 0, n).alias("first_seen"), F.when(k % 7 > 0, n + k % 9 - 2).alias("extracted"), F.when(k % 8 > 0, n + k % 10 - 3).alias("modelled"),
    )
    return broken(given, ru.availability_rules())


@register("order_rules", broken_sql("""SELECT CASE WHEN o_orderkey % 13 > 0 THEN 'x' ELSE '' END AS s, ['new', 'cancel', 'replace', 'fill', 'amend'][o_orderkey % 5 +
    1] AS action, CASE o_orderstatus WHEN 'F' THEN 'buy' WHEN 'O' THEN 'sell' ELSE 'hold' END AS side, o_totalprice - 2000 AS price, o_orderkey % 40 - 1 AS q, o_orderkey
    % 43 - 2 AS r FROM orders""", {"named": "s <> ''", "action": "action <> 'amend'", "side": "side <> 'hold'", "price": "price > 0", "quantity": "q > 0", "remaining": "r >= 0 AND r <= q"}))
def order_rules(spark, sf):
    """Orders as agents' orders without a name, with another action or side, no price or quantity, or more left than there was."""
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    given = table(spark, sf, "orders").select(
        F.when(k % 13 > 0, "x").otherwise("").alias("scenario_id"), F.lit("a").alias("agent_id"), k.cast("string").alias("order_id"), F.element_at(F.array(*map(F.lit, ("new", "cancel", "replace", "fill", "amend"))), (k % 5 + 1).cast("int")).alias("action"),
        F.when(status == "F", "buy").when(status == "O", "sell").otherwise("hold").alias("side"), (F.col("o_totalprice") - 2000).alias("price"), (k % 40 - 1).alias("quantity"), (k % 43 - 2).alias("remaining"),
    )
    return broken(given, ru.order_rules())


@register("depth_rules", with_views("trades", broken_sql("SELECT CASE WHEN seq % 21 > 0 THEN seq % 5 - 2.0 END AS p, px - 6 AS d, px * qty - 50 AS n FROM trades", {"percentage": "p IS NOT NULL", "depth": "d >= 0", "notional": "n >= 0"})))
def depth_rules(spark, sf):
    """Prints as depth levels without percentage, or with a negative depth or notional."""
    k = F.col("seq")
    given = trades(spark, sf).select(F.when(k % 21 > 0, k % 5 - 2.0).alias("percentage"), (F.col("px") - 6).alias("depth"), (F.col("px") * F.col("qty") - 50).alias("notional"))
    return broken(given, ru.depth_rules())


KLINE = f"""SELECT CASE symbol WHEN 3 THEN '' ELSE '1h' END AS interval, start AS o_t, start + CASE WHEN symbol = 4 THEN -1 ELSE 1 END * {HOUR} AS c_t, open, high -
    CASE WHEN symbol = 6 THEN 1 ELSE 0 END AS high, low - CASE WHEN symbol = 7 THEN 20 ELSE 0 END AS low, close,
  volume - CASE WHEN symbol = 8 THEN 30 ELSE 0 END AS volume, symbol % 10 - 1 AS trades FROM (SELECT symbol, t // {HOUR} * {HOUR} AS start, arg_min(px, (t, seq)) AS open,
    max(px) AS high, min(px) AS low, arg_max(px, (t, seq)) AS close, sum(qty) AS volume FROM trades GROUP BY ALL)"""


@register("kline_rules", with_views("trades", broken_sql(KLINE, {"interval": "interval <> ''", "span": "c_t >= o_t", "positive": "low > 0 AND open > 0 AND close > 0", "contained": "low <= open AND low <= close AND high >= open AND high >= close", "volume": "volume >= 0", "trades": "trades >= 0"})))
def kline_rules(spark, sf):
    """Hourly bars as klines without interval, in reverse, with too low a low, too low a high, a negative volume or count."""
    b, s = br.from_prints(trades(spark, sf), HOUR, F.lit(0)), F.col("symbol")
    given = b.select(
        F.when(s == 3, "").otherwise("1h").alias("interval"), F.col("start").alias("open_time"), (F.col("start") + F.when(s == 4, -1).otherwise(1) * HOUR).alias("close_time"), "open", (F.col("high") - F.when(s == 6, 1).otherwise(0)).alias("high"),
        (F.col("low") - F.when(s == 7, 20).otherwise(0)).alias("low"), "close", (F.col("volume") - F.when(s == 8, 30).otherwise(0)).alias("volume"), (s % 10 - 1).alias("trade_count"),
    )
    return broken(given, ru.kline_rules())


#: Sessions of the days with trades: nine to four, to one on every fifth day.
SESSIONS = f"sessions AS (SELECT DISTINCT t // {DAY} * {DAY} + {9 * HOUR} AS open, t // {DAY} * {DAY} + CASE WHEN t // {DAY} % 5 = 0 THEN 13 ELSE 16 END * {HOUR} AS close FROM trades)"


def sessions_of(spark, sf):
    day = F.floor(F.col("t") / DAY)
    return trades(spark, sf).select((day * DAY + 9 * HOUR).alias("open"), (day * DAY + F.when(day % 5 == 0, 13).otherwise(16) * HOUR).alias("close")).distinct()


@register("bars_in_sessions", with_views("trades", f"""WITH {SESSIONS}, b AS (SELECT DISTINCT symbol, t // {HOUR} * {HOUR} AS start FROM trades) SELECT symbol, start,
    EXISTS (SELECT 1 FROM sessions s WHERE s.open <= start AND start + {HOUR} <= s.close) AS in_session FROM b"""))
def bars_in_sessions(spark, sf):
    """Which hourly bars lie within a session."""
    b = br.from_prints(trades(spark, sf), HOUR, F.lit(0)).select("symbol", "start", "end")
    return ru.within_sessions(b, sessions_of(spark, sf), 7 * DAY).select("symbol", "start", "in_session")


@register("actions_at_open", with_views("trades", f"""WITH {SESSIONS}, a AS (SELECT p_partkey AS id, p_partkey % 10 AS symbol, 1704067200000000 + p_partkey % 40 *
    {DAY} + CASE WHEN p_partkey % 3 = 0 THEN 10 ELSE 9 END * {HOUR} AS effective FROM part) SELECT id, effective IN (SELECT open FROM sessions) AS at_open, count(*) OVER
    (PARTITION BY symbol, effective) = 1 AS alone FROM a"""))
def actions_at_open(spark, sf):
    """Which corporate actions take effect at the open of a session, and which are their symbol's only one then."""
    k = F.col("p_partkey")
    a = table(spark, sf, "part").select(k.alias("id"), (k % 10).alias("symbol"), (F.lit(1_704_067_200_000_000) + k % 40 * DAY + F.when(k % 3 == 0, 10).otherwise(9) * HOUR).alias("effective"))
    return ru.at_session_open(a, sessions_of(spark, sf)).select("id", "at_open", "alone")


@register("action_rules", broken_sql("SELECT p_partkey % 5 AS n, p_partkey % 7 AS d, p_size - 3 AS dividend, p_partkey AS effective, p_partkey + p_size % 4 - 1 AS pay FROM part", {"split": "n > 0 AND d > 0", "dividend": "dividend >= 0", "pay_date": "dividend = 0 OR pay >= effective"}))
def action_rules(spark, sf):
    """Parts as corporate actions with split terms of 0, negative dividends or a payment before its time."""
    k, size = F.col("p_partkey"), F.col("p_size")
    given = table(spark, sf, "part").select((k % 5).alias("split_num"), (k % 7).alias("split_den"), (size - 3).alias("dividend"), k.alias("effective"), (k + size % 4 - 1).alias("pay_at"))
    return broken(given, ru.action_rules())


LOCAL = """SELECT CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS DATE) + CASE WHEN o_orderkey % 13 = 0 THEN INTERVAL '9 hours 31 minutes' ELSE INTERVAL
    '9 hours 30 minutes' END AS o, CAST(o_orderdate AS DATE) + INTERVAL '10 hours' AS c0, CAST(o_orderdate AS DATE) + CASE o_orderkey % 3 WHEN 0 THEN INTERVAL '13 hours'
    WHEN 1 THEN INTERVAL '16 hours' ELSE INTERVAL '40 hours' END AS c FROM orders"""


@register("session_rules", broken_sql(LOCAL, {"weekday": "isodow(d) <= 5", "open": "strftime(o, '%H:%M') = '09:30'", "decision": "strftime(c0, '%H:%M') = '10:00'", "close": "strftime(c, '%H:%M') IN ('13:00', '16:00')", "same_date": "CAST(o AS DATE) = d AND CAST(c AS DATE) = d"}))
def session_rules(spark, sf):
    """Order dates as sessions in New York: some at weekends, opening late or closing a day after."""
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    at = lambda minutes: F.unix_millis(F.to_utc_timestamp(F.timestamp_seconds(F.unix_date(day) * 86_400 + minutes * 60), "America/New_York"))
    given = table(spark, sf, "orders").select(day.alias("date"), at(F.when(k % 13 == 0, 571).otherwise(570)).alias("open"), at(F.lit(600)).alias("decision"), at(F.when(k % 3 == 0, 780).when(k % 3 == 1, 960).otherwise(2400)).alias("close"))
    return broken(given, ru.session_rules())


@register("observation_rules", with_views("versions", broken_sql("""SELECT CASE WHEN id % 9 > 0 THEN 'k' ELSE '' END AS s, period AS a, period + id % 6 - 1 AS b, CASE
    id % 10 WHEN 0 THEN NULL WHEN 1 THEN 'inf'::DOUBLE WHEN 2 THEN 'nan'::DOUBLE ELSE value END AS v, published AS p, CASE WHEN id % 4 = 0 THEN published - 1 ELSE
    reconstructed END AS r FROM versions""", {"identity": "s <> ''", "period": "a <= b", "value": "v IS NULL OR isfinite(v)", "reconstructed": "r IS NULL OR r >= p"})))
def observation_rules(spark, sf):
    """Observations without identity, with a period in reverse, a value that is no number, or rebuilt before publication."""
    k = F.col("id")
    value = F.when(k % 10 == 0, None).when(k % 10 == 1, float("inf")).when(k % 10 == 2, float("nan")).otherwise(F.col("value"))
    given = versions(spark, sf).select(F.when(k % 9 > 0, "k").otherwise("").alias("series_id"), F.col("period").alias("period_start"), (F.col("period") + k % 6 - 1).alias("period_end"), value.alias("value"), "published", F.when(k % 4 == 0, F.col("published") - 1).otherwise(F.col("reconstructed")).alias("reconstructed"))
    return broken(given, ru.observation_rules())


@register("reconstructed_ready", with_views("versions", "SELECT id, CASE WHEN published IS NOT NULL AND reconstructed IS NOT NULL THEN greatest(published, reconstructed - id % 3 * 120000000) END AS ready FROM versions"))
def reconstructed_ready(spark, sf):
    """When a rebuilt observation could be used; null where either instant is missing."""
    return versions(spark, sf).select("id", bt.ready_reconstructed(F.col("published"), F.col("reconstructed") - F.col("id") % 3 * 120_000_000).alias("ready"))


# --- scalar columns ------------------------------------------------------------------------------------


@register("scalar_columns", """WITH l AS (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) * 10000 AS m, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN -1 END
    AS s FROM lineitem)
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, s * l_quantity AS signed, (m * 7 + 9999) // 10000 AS fee, m + coalesce(s, 0) * ((m * 7 + 19999) // 20000) AS
    price, m AS micros, round(m / 1e6 * pow(10.0, l_linenumber % 3), 3) AS scaled FROM l""")
def scalar_columns(spark, sf):
    """signed size, whole fees, a price after spread and impact, micros of a text, scaled micros."""
    text = F.round("l_extendedprice", 2).cast("decimal(18,2)").cast("string")
    rows = table(spark, sf, "lineitem").withColumn("m", fn.micros_of(text))
    side = F.when(F.col("l_returnflag") == "A", "buy").when(F.col("l_returnflag") == "R", "sell").otherwise("none")
    sign = F.when(side == "buy", 1).when(side == "sell", -1).otherwise(0)
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", fn.signed(side, F.col("l_quantity")).alias("signed"), fn.ceiling_fee(F.col("m"), F.lit(7)).alias("fee"),
        fn.impact_price(F.col("m"), sign, F.lit(3), F.lit(2)).alias("price"), F.col("m").alias("micros"), F.round(fn.scaled(F.col("m"), F.col("l_linenumber") % 3), 3).alias("scaled"),
    )




@register("publication_instants", f"""WITH p AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) + 1 AS d FROM orders), s AS (SELECT *, make_date(year(d), 4, 1) + CAST(7
    - isodow(make_date(year(d), 4, 1)) AS INTEGER) AS spring, make_date(year(d), 10, 31) - CAST(isodow(make_date(year(d), 10, 31)) % 7 AS INTEGER) AS autumn FROM p)
  SELECT o_orderkey, epoch_us(CAST(d AS TIMESTAMP)) + CASE WHEN d > spring AND d <= autumn THEN 4 ELSE 5 END * {HOUR} + 900000000 AS published FROM s""")
def publication_instants(spark, sf):
    """a quarter of an hour after the order day's end in New York. The SQL has the daylight saving of 1987 to 2006, which holds all orders."""
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", F.unix_micros(fn.publication_instant(F.to_date("o_orderdate"), "America/New_York", "interval 15 minutes")).alias("published"))


@register("coerced_cells", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN epoch_us(o_orderdate) WHEN 1 THEN epoch_us(o_orderdate) WHEN 2 THEN
    epoch_us(o_orderdate) END AS at, CASE o_orderkey % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false END AS flag,
  CASE o_orderkey % 6 WHEN 0 THEN round(o_totalprice, 2) WHEN 5 THEN -o_orderkey END AS number, o_orderkey % 6 = 4 AS bad FROM orders""")
def coerced_cells(spark, sf):
    """Times and flags in several notations, numbers with separators and suppression tokens."""
    k, at = F.col("o_orderkey"), micros("o_orderdate")
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    when = F.when(k % 4 == 0, F.concat(iso, F.lit("Z"))).when(k % 4 == 1, (at / 1000).cast("long").cast("string")).when(k % 4 == 2, F.concat((at / 1000).cast("long").cast("string"), F.lit(".0"))).otherwise("soon")
    flag = F.element_at(F.array(*map(F.lit, ("TRUE", "0", " 1", "False", "maybe"))), (k % 5 + 1).cast("int"))
    cell = F.when(k % 6 == 0, F.format_number("o_totalprice", 2)).when(k % 6 == 1, "(NA)").when(k % 6 == 2, " - ").when(k % 6 == 3, "").when(k % 6 == 4, "n/a").otherwise((-k).cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", F.unix_micros(fn.to_timestamp_any(when)).alias("at"), fn.to_boolean(flag).alias("flag"), fn.clean_number(cell).alias("number"), fn.bad_number(cell).alias("bad"))


@register("redacted_urls", "SELECT page_id, url || '?q=' || page_id || '&Token=[REDACTED]&page=2&apikey=[REDACTED]#top' AS url, page_id AS q FROM pages")
def redacted_urls(spark, sf):
    """Secrets in query parameters and in maps, whatever their case."""
    p = table(spark, sf, "pages")
    url = F.concat("url", F.lit("?q="), "page_id", F.lit("&Token=s3"), "page_id", F.lit("&page=2&apikey=x"), F.lit("#top"))
    kept = fn.redact_map(F.create_map(F.lit("q"), F.col("page_id").cast("string"), F.lit("API_KEY"), F.lit("x")))
    return p.select("page_id", fn.redact_url(url).alias("url"), F.when(kept["API_KEY"] == "[REDACTED]", kept["q"].cast("long")).alias("q"))


@register("requested_lists", """WITH s AS (SELECT s_suppkey, DATE '2024-02-26' + CAST(s_suppkey % 5 AS INTEGER) AS d FROM supplier) SELECT s_suppkey,
    array_to_string([strftime(d + CAST(k AS INTEGER), '%Y%m%d') FOR k IN range(0, 4)] || ['20240101'], ',') AS days, 'C' || s_suppkey || '-PERP,BTC-USD' AS symbols FROM s""")
def requested_lists(spark, sf):
    """Ranges of days and lists of coins, with repeats."""
    first = F.date_add(F.lit("2024-02-26").cast("date"), (F.col("s_suppkey") % 5).cast("int"))
    text = lambda n: F.date_format(F.date_add(first, n), "yyyyMMdd")
    days = F.concat(text(0), F.lit(".."), text(3), F.lit(", "), text(1), F.lit(",20240101,"))
    coins = F.concat(F.lit("c"), "s_suppkey", F.lit(", btc/usd,C"), "s_suppkey")
    return table(spark, sf, "supplier").select("s_suppkey", F.array_join(lake.requested_dates(days), ",").alias("days"), F.array_join(lake.requested_symbols(coins), ",").alias("symbols"))


# --- scans ---------------------------------------------------------------------------------------------


@register("fill_scan", with_views("trades", f"""SELECT 'C' || symbol AS symbol, CAST(row_number() OVER (PARTITION BY symbol, t // {DAY} ORDER BY t // 1000, CASE WHEN
    seq % 5 > 0 THEN seq END NULLS FIRST, seq) AS INTEGER) AS sequence, t // 1000 AS ms, px AS price, CASE side WHEN 1 THEN 'buy' ELSE 'sell' END AS side, CASE WHEN seq %
    5 > 0 THEN seq END AS trade_id FROM trades"""))
def fill_scan(spark, sf):
    """Raw fills to events with their sequence in the coin's day."""
    t = trades(spark, sf)
    raw = t.select(F.concat(F.lit("c"), F.col("symbol").cast("string")).alias("coin"), F.floor(F.col("t") / 1000).alias("ts_ms"), "px", F.col("qty").cast("double").alias("sz"), F.when(F.col("side") == 1, "B").otherwise("A").alias("side"), F.lit(True).alias("crossed"), "maker_side", F.lit(0.0).alias("fee"), F.lit("USDC").alias("fee_token"), F.col("seq").alias("oid"), F.when(F.col("seq") % 5 > 0, F.col("seq")).alias("tid"))
    return lake.fills(raw).select("symbol", "sequence", F.unix_millis("timestamp").alias("ms"), "price", "side", "trade_id")


@register("depth_scan", """SELECT l_suppkey AS symbol, epoch_us(l_shipdate) AS at, count(*) AS levels, min(l_discount) AS nearest, max_by(l_quantity, (l_discount,
    l_quantity, l_extendedprice)) AS last_depth FROM lineitem GROUP BY ALL""")
def depth_scan(spark, sf):
    """Levels of one time in one row, in order of their distance."""
    l = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("symbol"), micros("l_shipdate").alias("timestamp"), F.col("l_discount").alias("percentage"), F.col("l_quantity").alias("depth"), F.col("l_extendedprice").alias("notional"))
    out = lake.depth_snapshots(l)
    return out.select("symbol", F.col("timestamp").alias("at"), F.size("levels").cast("long").alias("levels"), F.col("levels")[0]["percentage"].alias("nearest"), F.element_at("levels", -1)["depth"].alias("last_depth"))


@register("tick_scan", with_views("trades quotes", "SELECT t.seq AS id, t.t // 1000 AS ms, t.px AS price, t.maker_side > 0 AS maker, q.bid AS bid FROM trades t LEFT JOIN quotes q USING (seq)"))
def tick_scan(spark, sf):
    """Aggregate trades with flags as text, and the top of book of the same events with times in milliseconds."""
    t, ms = trades(spark, sf), F.floor(F.col("t") / 1000)
    raw = t.select(F.col("seq").alias("event_id"), ms.cast("string").alias("timestamp"), F.col("seq").cast("string").alias("aggregate_trade_id"), F.col("px").cast("string").alias("price"), F.col("qty").cast("string").alias("quantity"), F.col("seq").alias("first_trade_id"), F.col("seq").alias("last_trade_id"), F.when(F.col("maker_side") > 0, "True").otherwise("0").alias("is_buyer_maker"))
    book = quotes(spark, sf).select(F.col("seq").alias("event_id"), F.floor(F.col("t") / 1000).alias("timestamp"), F.col("seq").alias("update_id"), F.col("bid").alias("bid_price"), F.lit(1).alias("bid_quantity"), F.col("ask").alias("ask_price"), F.lit(1).alias("ask_quantity"))
    a, b = lake.agg_trades(raw), lake.top_of_book(book).select("event_id", F.col("bid_price").alias("bid"))
    return a.join(b, "event_id", "left").select(F.col("event_id").alias("id"), F.unix_millis("timestamp").alias("ms"), "price", F.col("is_buyer_maker").alias("maker"), "bid")


@register("hash_check", "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'missing' WHEN doc_id % 10 = 1 THEN 'orphan' WHEN doc_id % 10 = 2 THEN 'changed' ELSE 'ok' END AS status FROM documents")
def hash_check(spark, sf):
    """Contents against a manifest that misses some, has others and knows some by another hash."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("sha256"))
    manifest = d.where("path % 10 <> 1").withColumn("sha256", F.when(F.col("path") % 10 == 2, F.sha2("sha256", 256)).otherwise(F.col("sha256")))
    return lake.verify_hashes(d.where("path % 10 <> 0"), manifest).select(F.col("path").alias("doc_id"), "status")


@register("capture_receipts", "SELECT sha256(text) AS sha256, max(strlen(text)) AS bytes, min(doc_id) AS first_seen_at, count(*) AS receipts FROM documents GROUP BY 1")
def capture_receipts(spark, sf):
    """Equal bytes are one object with several receipts."""
    d = table(spark, sf, "documents").select(F.concat_ws("/", "source", "doc_id").alias("url"), F.col("doc_id").alias("first_seen_at"), F.lit("public").alias("permission"), F.encode("text", "UTF-8").alias("content"))
    objects, receipts = sinks.receipts(d)
    n = receipts.groupBy("sha256").agg(F.count("*").alias("receipts"))
    return objects.join(n, "sha256").select("sha256", F.col("bytes").cast("long").alias("bytes"), "first_seen_at", "receipts")


# --- payloads ------------------------------------------------------------------------------------------


def bodies(df: DataFrame, by: list[str], row: Column, wrap) -> DataFrame:
    """One JSON body for each group: wrap(list of rows)."""
    return df.groupBy(*by).agg(F.collect_list(row).alias("rows")).select(*by, F.to_json(wrap(F.col("rows"))).alias("body"))


@register("bar_pages", with_views("trades", f"SELECT 'S' || symbol AS symbol, t // 60000000 * 60000 AS start, t // 60000000 * 60000 + 60000 AS available_at, max(px) AS high, CAST(sum(qty) AS DOUBLE) AS volume FROM trades GROUP BY ALL"))
def bar_pages(spark, sf):
    """Pages of minute bars by symbol and hour."""
    b = trades(spark, sf).groupBy("symbol", F.floor(F.col("t") / 60_000_000).alias("m")).agg(F.max("px").alias("h"), F.sum("qty").alias("v"), F.min("px").alias("l"))
    at = F.date_format(F.timestamp_seconds(F.col("m") * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    row = F.struct(at.alias("t"), F.col("l").alias("o"), "h", "l", F.col("h").alias("c"), "v")
    pages = b.groupBy("symbol", F.floor(F.col("m") / 60)).agg(F.collect_list(row).alias("rows")).select(F.to_json(F.struct(F.create_map(F.concat(F.lit("S"), F.col("symbol").cast("string")), "rows").alias("bars"))).alias("body"))
    return doc.bars(pages).select("symbol", "start", "available_at", "high", "volume")


@register("asset_pages", "SELECT CAST(p_partkey AS VARCHAR) AS id, p_brand AS symbol, p_size > 20 AS active FROM part")
def asset_pages(spark, sf):
    """Pages of assets by brand."""
    row = F.struct(F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("symbol"), F.col("p_name").alias("name"), F.lit("X").alias("exchange"), F.when(F.col("p_size") > 20, "active").otherwise("inactive").alias("status"))
    return doc.assets(bodies(table(spark, sf, "part"), ["p_brand", "p_type"], row, lambda r: r)).select("id", "symbol", "active")


FACTS = """WITH o AS (SELECT o_custkey, o_orderpriority AS tag, CAST(date_trunc('month', o_orderdate) AS DATE) AS e, o_orderkey % 2 AS instant,
    CAST(round(o_totalprice * 100) AS BIGINT) * 10000 AS v, CAST('A' || o_orderkey AS VARCHAR) AS accn, CAST(o_orderdate AS DATE) AS filed FROM orders)
  SELECT CAST(o_custkey AS VARCHAR) AS entity, tag, CASE WHEN instant = 1 THEN e ELSE CAST(e - INTERVAL 1 MONTH AS DATE) END AS period_start, e AS period_end, CASE
    instant WHEN 1 THEN 'instant' ELSE 'duration' END AS kind, v AS value_micros, accn AS source_id,
    CAST(row_number() OVER (PARTITION BY o_custkey, tag, CASE WHEN instant = 1 THEN e ELSE CAST(e - INTERVAL 1 MONTH AS DATE) END, e ORDER BY filed, accn, v) AS INTEGER)
    AS revision FROM o WHERE filed <= DATE '2000-06-30'"""


@register("company_facts", FACTS)
def company_facts(spark, sf):
    """One body a customer, each priority a tag, with revisions in order of filing up to a cutoff."""
    o, end = table(spark, sf, "orders"), F.trunc(F.to_date("o_orderdate"), "month")
    fact = F.struct(
        F.when(F.col("o_orderkey") % 2 == 0, F.add_months(end, -1).cast("string")).alias("start"), end.cast("string").alias("end"), F.round("o_totalprice", 2).cast("decimal(18,2)").cast("string").alias("val"),
        F.concat(F.lit("A"), "o_orderkey").alias("accn"), F.lit("10-Q").alias("form"), F.to_date("o_orderdate").cast("string").alias("filed"),
    )
    tags = o.groupBy("o_custkey", "o_orderpriority").agg(F.collect_list(fact).alias("rows"))
    tags = tags.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", F.struct(F.create_map(F.lit("USD"), "rows").alias("units"))))).alias("t"))
    pages = tags.select(F.to_json(F.struct(F.col("o_custkey").cast("string").alias("cik"), F.create_map(F.lit("x"), "t").alias("facts"))).alias("body"))
    return doc.company_facts(pages, "2000-06-30").select("entity", "tag", "period_start", "period_end", F.col("period_kind").alias("kind"), "value_micros", "source_id", "revision")


@register("filing_pages", """SELECT CAST(o_custkey AS VARCHAR) AS cik, o_orderkey || '-' || o_orderstatus AS accession, strftime(o_orderdate, '%Y-%m-%d') AS filed,
    epoch_us(o_orderdate) AS published, 'data/' || o_custkey || '/' || o_orderkey || o_orderstatus || '/d.htm' AS path FROM orders""")
def filing_pages(spark, sf):
    """An index of parallel arrays for each customer."""
    at = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    row = F.struct(F.concat_ws("-", "o_orderkey", "o_orderstatus").alias("a"), F.lit("d.htm").alias("p"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("f"), at.alias("t"))
    g = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_list(row).alias("r"))
    recent = F.struct(*[F.col(f"r.{k}").alias(n) for k, n in (("a", "accessionNumber"), ("p", "primaryDocument"), ("f", "filingDate"), ("t", "acceptanceDateTime"))])
    pages = g.select(F.to_json(F.struct(F.col("o_custkey").cast("string").alias("cik"), F.struct(recent.alias("recent")).alias("filings"))).alias("body"))
    return doc.filing_index(pages).select("cik", F.col("accessionNumber").alias("accession"), F.col("filingDate").alias("filed"), F.unix_micros("published").alias("published"), "path")


YEARLY = "SELECT c_nationkey AS n, year(o_orderdate) AS y, CAST(sum(CAST(o_totalprice AS DECIMAL(20, 2))) AS DOUBLE) AS v FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL"


def yearly(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy(F.col("c_nationkey").alias("n"), F.year("o_orderdate").alias("y")).agg(F.sum(F.col("o_totalprice").cast("decimal(20,2)")).cast("double").alias("v"))


@register("indicator_pages", f"SELECT 'WB:T:' || n AS series_id, make_date(y, 1, 1) AS period_start, make_date(y, 12, 31) AS period_end, CASE WHEN y % 3 > 0 THEN v END AS value FROM ({YEARLY})")
def indicator_pages(spark, sf):
    """A page of [header, rows] for each country; a null stays a row."""
    row = F.struct(F.struct(F.lit("T").alias("id")).alias("indicator"), F.struct(F.col("n").cast("string").alias("id")).alias("country"), F.col("y").cast("string").alias("date"), F.when(F.col("y") % 3 > 0, F.col("v")).alias("value"))
    g = yearly(spark, sf).groupBy("n").agg(F.collect_list(row).alias("r"))
    pages = g.select(F.concat(F.lit('[{"page":1,"pages":1,"total":'), F.size("r"), F.lit("},"), F.to_json("r", {"ignoreNullFields": "false"}), F.lit("]")).alias("body"))
    return doc.indicators(pages)[0]


@register("indicator_faults", "SELECT CASE doc_id % 4 WHEN 0 THEN 'no_value_field' WHEN 1 THEN 'not_a_number' ELSE 'no_identity' END AS fault, count(*) AS n FROM documents WHERE doc_id % 4 < 3 GROUP BY 1")
def indicator_faults(spark, sf):
    """Rows without a value field, with a value that is no number or without a country; a null value is no fault."""
    k = F.col("doc_id") % 4
    value = F.when(k == 0, "").when(k == 1, ',"value":"n/a"').when(k == 2, ',"value":1').otherwise(',"value":null')
    country = F.when(k == 2, "").otherwise(',"country":{"id":"US"}')
    row = F.concat(F.lit('{"indicator":{"id":"T"},"date":"2024"'), country, value, F.lit("}"))
    g = table(spark, sf, "documents").groupBy(F.floor(F.col("doc_id") / 50)).agg(F.array_join(F.collect_list(row), ",").alias("r"))
    _, bad = doc.indicators(g.select(F.concat(F.lit('[{"page":1},['), "r", F.lit("]]")).alias("body")))
    return bad.groupBy("fault").agg(F.count("*").alias("n"))


@register("page_gaps", """SELECT c_nationkey AS source, count(*) AS seen, CAST(max(c_nationkey % 4) + 5 AS BIGINT) AS pages FROM (SELECT DISTINCT c_nationkey,
    c_custkey % 6 AS p FROM customer) GROUP BY 1 HAVING count(*) <> max(c_nationkey % 4) + 5""")
def page_gaps(spark, sf):
    """Sources whose pages are not as many as their headers say."""
    g = table(spark, sf, "customer").select(F.col("c_nationkey").alias("source"), (F.col("c_custkey") % 6).alias("p")).distinct()
    n = F.col("source") % 4 + 5
    body = F.concat(F.lit('[{"page":'), "p", F.lit(',"pages":'), n, F.lit(',"total":'), n, F.lit('},[{"a":1}]]'))
    return doc.page_gaps(g.select("source", body.alias("body"))).select("source", "seen", F.col("pages").cast("long").alias("pages"))


@register("statistics_file", """SELECT 'SR' || o_custkey || CASE o_orderkey % 14 WHEN 13 THEN ':annual' ELSE '' END AS series_id, CASE o_orderkey % 14 WHEN 13 THEN
    make_date(year(o_orderdate), 1, 1) ELSE make_date(year(o_orderdate), o_orderkey % 14, 1) END AS period_start, CASE WHEN o_orderkey % 5 > 0 THEN round(o_totalprice, 2)
    END AS value FROM orders WHERE o_orderkey % 14 > 0""")
def statistics_file(spark, sf):
    """Months and annual averages of a tab-separated file, with suppressed cells."""
    k = F.col("o_orderkey")
    raw = table(spark, sf, "orders").select(F.concat(F.lit("SR"), "o_custkey", F.lit("  ")).alias("series_id"), F.year("o_orderdate").cast("string").alias("year"), F.concat(F.lit("M"), F.lpad((k % 14).cast("string"), 2, "0")).alias("period"), F.when(k % 5 > 0, F.format_number("o_totalprice", 2)).otherwise("-").alias("value"))
    return doc.statistics_rows(raw).select("series_id", "period_start", "value")


def paged(c: DataFrame, row: Column, by: Column) -> DataFrame:
    """Rows in pages of a hundred keys."""
    return c.groupBy(F.floor(by / 100).alias("page")).agg(F.collect_list(row).alias("r"))


@register("header_tables", """SELECT CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS segment, '' AS fault FROM customer WHERE c_custkey % 9 > 0 UNION ALL SELECT
    'short', NULL, 'width' FROM customer WHERE c_custkey % 9 = 0""")
def header_tables(spark, sf):
    """Arrays under a header row; rows of another width are set aside."""
    row = F.when(F.col("c_custkey") % 9 > 0, F.array(F.col("c_custkey").cast("string"), "c_name", "c_mktsegment")).otherwise(F.array(F.lit("short")))
    pages = paged(table(spark, sf, "customer"), row, F.col("c_custkey")).select(F.to_json(F.concat(F.array(F.array(F.lit("id"), F.lit("name"), F.lit("segment"))), "r")).alias("body"))
    good, bad = doc.header_table(pages, ["id", "segment"])
    return good.withColumn("fault", F.lit("")).unionByName(bad.select(F.col("row")[0].alias("id"), F.lit(None).cast("string").alias("segment"), "fault"))


@register("trade_tables", """SELECT 'CENSUS:exports:' || o_custkey || ':' || o_orderkey % 97 || ':ALL_VAL_MO' AS series_id, CAST(date_trunc('month', o_orderdate) AS
    DATE) AS period_start, last_day(o_orderdate) AS period_end,
    CASE WHEN o_orderkey % 8 > 0 THEN o_totalprice END AS value, CAST(o_custkey AS VARCHAR) AS partner, '' AS fault FROM orders WHERE o_orderkey % 21 > 1
  UNION ALL SELECT NULL, CAST(date_trunc('month', o_orderdate) AS DATE), NULL, NULL, NULL, CASE o_orderkey % 21 WHEN 0 THEN 'width' ELSE 'not_a_number' END FROM orders
    WHERE o_orderkey % 21 < 2""")
def trade_tables(spark, sf):
    """Monthly trade by commodity and partner, suppressed values as nulls, rows of another width or without a number set aside."""
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    value = F.when(k % 21 == 1, "many").when(k % 8 == 0, "(S)").otherwise(F.col("o_totalprice").cast("string"))
    row = F.when(k % 21 == 0, F.array(F.lit("0"))).otherwise(F.array((k % 97).cast("string"), F.lit("goods"), F.col("o_custkey").cast("string"), F.lit("land"), value))
    head = F.array(*map(F.lit, ("E_COMMODITY", "E_COMMODITY_LDESC", "CTY_CODE", "CTY_NAME", "ALL_VAL_MO")))
    g = o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.floor(k / 1000).alias("page")).agg(F.collect_list(row).alias("r"))
    good, bad = doc.trade_values(g.select("month", F.to_json(F.concat(F.array(head), "r")).alias("body")), "exports", "E_COMMODITY", "E_COMMODITY_LDESC", "ALL_VAL_MO")
    told = good.select("series_id", "period_start", "period_end", "value", F.col("dimensions")["partner"].alias("partner"), F.lit("").alias("fault"))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    return told.unionByName(bad.select(none("string", "series_id"), F.col("row")[0].cast("date").alias("period_start"), none("date", "period_end"), none("double", "value"), none("string", "partner"), "fault"))


@register("facet_rows", f"""SELECT f AS field, make_date(y, 1, 1) AS period_start, count(*) AS series, sum(CASE f WHEN 'sales' THEN v ELSE y END) AS total, max(CASE f
    WHEN 'sales' THEN 'USD' ELSE 'a' END) AS unit FROM ({YEARLY}), (VALUES ('sales'), ('age')) AS t(f) GROUP BY ALL""")
def facet_rows(spark, sf):
    """Wide rows of facets to one observation a field."""
    row = F.create_map(F.lit("period"), F.col("y").cast("string"), F.lit("nation"), F.col("n").cast("string"), F.lit("sales"), F.col("v").cast("decimal(24,2)").cast("string"), F.lit("sales-units"), F.lit("USD"), F.lit("age"), F.col("y").cast("string"), F.lit("age-units"), F.lit("a"))
    pages = bodies(yearly(spark, sf), ["n"], row, lambda r: F.struct(F.struct(r.alias("data")).alias("response")))
    out = doc.facets(pages, "route", ["sales", "age"], ["nation"])
    field = F.split("series_id", ":")[1]
    return out.groupBy(field.alias("field"), "period_start").agg(F.count_distinct("series_id").alias("series"), F.sum(F.col("value").cast("decimal(24,2)")).cast("double").alias("total"), F.max("unit").alias("unit"))


@register("route_listing", """SELECT 'r' || r_regionkey AS route, 'child' AS kind, n_name AS name, NULL::DATE AS first, NULL::DATE AS last FROM region JOIN nation ON
    n_regionkey = r_regionkey UNION ALL SELECT 'r' || r_regionkey, 'frequency', f, make_date(2000 + r_regionkey, 1, 1), make_date(2010, 6, 30) FROM region, (VALUES
    ('monthly'), ('annual')) AS t(f)""")
def route_listing(spark, sf):
    """Regions as routes with their nations below and two frequencies."""
    n = table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.collect_list(F.struct(F.col("n_name").alias("id"))).alias("routes"))
    found = table(spark, sf, "region").join(n, "r_regionkey")
    response = F.struct(F.concat(F.lit("r"), "r_regionkey").alias("id"), "routes", F.array(F.struct(F.lit("monthly").alias("id")), F.struct(F.lit("annual").alias("id"))).alias("frequency"), (2000 + F.col("r_regionkey")).cast("string").alias("startPeriod"), F.lit("2010-06").alias("endPeriod"))
    return doc.route_catalogue(found.select(F.to_json(F.struct(response.alias("response"))).alias("body")))


@register("input_output_cells", """SELECT 'T:' || s_nationkey || ':' || p_size AS series_id, CAST(p_size AS VARCHAR) AS col, make_date(1998, 1, 1) AS period_start,
    CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS value FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey GROUP BY
    s_nationkey, p_size""")
def input_output_cells(spark, sf):
    """Cells of nation by part size from a table body for each nation."""
    l, s, p = table(spark, sf, "lineitem"), table(spark, sf, "supplier"), table(spark, sf, "part")
    cells = l.join(s, l["l_suppkey"] == s["s_suppkey"]).join(p, l["l_partkey"] == p["p_partkey"]).groupBy("s_nationkey", "p_size").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("v"))
    row = F.struct(F.lit("1998").alias("Year"), F.col("s_nationkey").cast("string").alias("RowCode"), F.col("p_size").cast("string").alias("ColCode"), F.format_number("v", 2).alias("DataValue"))
    pages = bodies(cells, ["s_nationkey"], row, lambda r: F.struct(r.alias("Data")))
    return doc.input_output(pages, "T").select("series_id", F.col("dimensions")["column"].alias("col"), "period_start", "value")


@register("release_pages", """SELECT page_id, make_date(CAST(2000 + page_id % 20 AS BIGINT), 1 + page_id % 12, 1) AS period_start, (1000 + page_id) * 1e6 AS value,
    epoch_us(CAST(make_date(CAST(2000 + page_id % 20 AS BIGINT), 1 + page_id % 12, 1) + INTERVAL 11 DAY AS TIMESTAMP)) - 28800000000 AS published FROM pages WHERE page_id
    % 7 > 0""")
def release_pages(spark, sf):
    """A figure, its month and its day from pages that announce it; other pages have none."""
    k = F.col("page_id")
    first = F.make_date((2000 + k % 20).cast("int"), (1 + k % 12).cast("int"), F.lit(1))
    name = F.element_at(F.array(*map(F.lit, doc.MONTHS)), (1 + k % 12).cast("int"))
    said = F.concat(name, F.lit(" "), F.year(first), F.lit(" Revenue Report: NT$ "), F.format_number(1000 + k, 0), F.lit(" Million"))
    html = F.concat(F.lit('<meta name="description" content="'), F.when(k % 7 > 0, said).otherwise("News"), F.lit('">'), F.date_format(F.date_add(first, -40), "yyyy/MM/dd"), F.lit(" "), F.date_format(F.date_add(first, 10), "yyyy/MM/dd"), "html")
    pages = table(spark, sf, "pages").select(k.cast("string").alias("url"), html.alias("html"))
    return doc.release_figure(pages).select(F.col("url").cast("long").alias("page_id"), "period_start", "value", F.unix_micros("published").alias("published"))


KINDS_OF = ("ckan", "stac", "jsonld", "ogc", "openapi", "sdmx")

#: Entries of customers by their number's hundred: what each protocol holds of an entry.
ENTRIES = """c AS (SELECT *, c_custkey // 100 AS page, CAST(c_custkey AS VARCHAR) AS id, ['ckan', 'stac', 'jsonld', 'ogc', 'openapi', 'sdmx'][c_custkey // 100 % 6 + 1] AS protocol FROM customer)"""


def catalogue_documents(spark, sf):
    """Customers as catalogue entries, a hundred a document, in six protocols; sdmx is XML with namespaces."""
    k = F.col("c_custkey")
    c = table(spark, sf, "customer").withColumn("page", F.floor(k / 100)).withColumn("id", k.cast("string")).withColumn("name", F.col("c_name"))
    protocol = F.element_at(F.array(*map(F.lit, KINDS_OF)), (F.col("page") % 6 + 1).cast("int"))
    title = F.when(k % 4 > 0, F.col("c_name")).alias("title")
    extent = F.struct(F.struct(F.array(F.array(k % 7, k % 5)).alias("bbox")).alias("spatial"), F.struct(F.array(F.array(F.lit("2000-01-01"), F.lit(None).cast("string"))).alias("interval")).alias("temporal"))
    part = F.struct(F.concat(F.lit("files/"), "id", F.lit(".csv")).alias("url"), F.lit("text/csv").alias("mimetype"), F.lit("CSV").alias("format"))
    rows = {
        "ckan": F.struct("id", title, F.lit("n").alias("notes"), F.lit("Open").alias("license_title"), F.array(F.struct(F.col("c_mktsegment").alias("name"))).alias("tags"), F.array(part, F.struct(F.lit(None).cast("string").alias("url"), F.lit("x").alias("mimetype"), F.lit("y").alias("format"))).alias("resources")),
        "stac": F.struct("id", title, F.lit("proprietary").alias("license"), extent.alias("extent"), F.array(F.col("c_mktsegment")).alias("keywords"), F.create_map(F.lit("data"), F.struct(F.concat(F.lit("/a/"), "id").alias("href"), F.lit("t").alias("type"))).alias("assets"), F.array(F.struct(F.lit("self").alias("rel"), F.concat(F.lit("../c/"), "id").alias("href"))).alias("links")),
        "jsonld": F.struct(F.col("id").alias("@id"), F.when(k % 2 == 0, "schema:Dataset").otherwise("Person").alias("@type"), "name", F.array(F.struct(F.concat(F.lit("/"), "id").alias("contentUrl"), F.lit("e").alias("encodingFormat"))).alias("distribution")),
        "ogc": F.struct("id", title, extent.alias("extent")),
    }
    packed = F.coalesce(*[F.when(protocol == p, F.to_json(r)) for p, r in rows.items()])
    path = F.concat(F.lit('"/d/'), "id", F.lit('":{'), F.when(k % 3 > 0, '"get":{"summary":"s","tags":["g"]}').otherwise('"post":{}'), F.lit("}"))
    flow = F.concat(F.lit("<s:Dataflow id='"), "id", F.lit("' agencyID='A'><c:Name xml:lang='en'>"), F.replace(F.col("c_name"), F.lit("#"), F.lit("-")), F.lit("</c:Name></s:Dataflow>"))
    each = F.when(protocol == "openapi", path).when(protocol == "sdmx", flow).otherwise(packed)
    g = c.select("page", protocol.alias("protocol"), each.alias("e")).groupBy("page", "protocol").agg(F.collect_list("e").alias("e"))
    said = F.array_join("e", ",")
    body = (
        F.when(F.col("protocol") == "ckan", F.concat(F.lit('{"success":true,"result":{"count":7,"results":['), said, F.lit("]}}"))).when(F.col("protocol").isin("stac", "ogc"), F.concat(F.lit('{"links":[{"rel":"child","href":"next"}],"collections":['), said, F.lit("]}")))
        .when(F.col("protocol") == "jsonld", F.concat(F.lit('{"@graph":['), said, F.lit("]}"))).when(F.col("protocol") == "openapi", F.concat(F.lit('{"openapi":"3","info":{"license":{"name":"L"}},"paths":{'), said, F.lit("}}")))
        .otherwise(F.concat(F.lit("<m:Structure xmlns:m='a' xmlns:s='b' xmlns:c='d'><m:Structures><s:Dataflows>"), F.array_join("e", ""), F.lit("</s:Dataflows></m:Structures></m:Structure>")))
    )
    return g.select(F.concat(F.lit("https://x.org/k/"), "page").alias("url"), "protocol", body.alias("body"))


@register("catalogue_entries", f"""WITH {ENTRIES}
  SELECT 'https://x.org/k/' || page AS url, protocol, CASE protocol WHEN 'openapi' THEN 'GET /d/' || id ELSE id END AS external_id,
    CASE WHEN protocol = 'openapi' THEN 's' WHEN protocol = 'sdmx' THEN replace(c_name, '#', '-') WHEN protocol = 'jsonld' OR c_custkey % 4 > 0 THEN c_name ELSE id END AS
    title,
    CASE protocol WHEN 'ckan' THEN 'n' ELSE '' END AS description,
    CASE protocol WHEN 'stac' THEN 'https://x.org/c/' || id WHEN 'openapi' THEN 'https://x.org/d/' || id WHEN 'sdmx' THEN 'https://x.org/k/' || page END AS landing,
    CASE protocol WHEN 'ckan' THEN 'Open' WHEN 'stac' THEN 'proprietary' WHEN 'openapi' THEN 'L' END AS license,
    CASE WHEN protocol IN ('stac', 'ogc') THEN '{{"bbox":[[' || c_custkey % 7 || ',' || c_custkey % 5 || ']]}}' END AS spatial,
    CASE WHEN protocol = 'ckan' THEN '{{"metadata_created":null,"metadata_modified":null}}' WHEN protocol IN ('stac', 'ogc') THEN '{{"interval":[["2000-01-01",null]]}}'
    END AS temporal,
    CASE WHEN protocol IN ('ckan', 'stac') THEN c_mktsegment WHEN protocol = 'openapi' THEN 'g' ELSE '' END AS keywords,
    CASE protocol WHEN 'ckan' THEN 'https://x.org/k/files/' || id || '.csv|text/csv|CSV' WHEN 'stac' THEN 'https://x.org/a/' || id || '|t|' WHEN 'jsonld' THEN
    'https://x.org/' || id || '|e|' ELSE '' END AS parts
  FROM c WHERE (protocol <> 'jsonld' OR c_custkey % 2 = 0) AND (protocol <> 'openapi' OR c_custkey % 3 > 0)""")
def catalogue_entries(spark, sf):
    """Catalogue documents of six protocols to datasets with extents, keywords and distributions."""
    found, _ = doc.catalog_entries(catalogue_documents(spark, sf))
    parts = F.array_join(F.transform("distributions", lambda p: F.concat(p["url"], F.lit("|"), F.coalesce(p["media_type"], F.lit("")), F.lit("|"), F.coalesce(p["format"], F.lit("")))), ",")
    return found.select(*[c for c in found.columns if c not in ("keywords", "distributions")], F.array_join("keywords", ",").alias("keywords"), parts.alias("parts"))


@register("catalogue_follow", f"""WITH {ENTRIES} SELECT 'https://x.org/k/' || page AS url, 'https://x.org/k/next' AS follow, CAST(NULL AS BIGINT) AS total FROM c WHERE
    protocol = 'stac' GROUP BY page UNION ALL SELECT 'https://x.org/k/' || page, NULL, CASE protocol WHEN 'ckan' THEN 7 WHEN 'ogc' THEN count(*) END FROM c GROUP BY page,
    protocol""")
def catalogue_follow(spark, sf):
    """The links of catalogue documents that lead on, and the totals that they state."""
    d = catalogue_documents(spark, sf)
    links = doc.catalog_links(d).withColumn("total", F.lit(None).cast("long"))
    return links.unionByName(doc.catalog_totals(d).select("url", F.lit(None).cast("string").alias("follow"), "total"))


@register("csv_observations", """SELECT make_date(year(o_orderdate), month(o_orderdate), 1) AS period_start, o_orderstatus AS status, CASE WHEN o_orderkey % 6 > 0
    THEN round(o_totalprice, 2) END AS value, 'USD' AS unit FROM orders""")
def csv_observations(spark, sf):
    """Rows of text to observations with the rest as dimensions."""
    o = table(spark, sf, "orders")
    cells = o.select(F.date_format("o_orderdate", "yyyy-MM").alias("REF_DATE"), F.when(F.col("o_orderkey") % 6 > 0, F.format_number("o_totalprice", 2)).otherwise("(S)").alias("VALUE"), F.lit("USD").alias("UOM"), F.col("o_orderstatus").alias("STATUS"))
    return doc.csv_observations(cells, "d", "REF_DATE", "VALUE", "UOM").select("period_start", F.col("dimensions")["STATUS"].alias("status"), "value", "unit")


# --- ingestion, replayed as batches --------------------------------------------------------------------


@register("new_versions", "SELECT o_orderkey AS id, o_custkey AS key, CASE WHEN o_orderkey % 10 IN (1, 3) THEN 'conflict' ELSE 'stored' END AS status FROM orders WHERE o_orderkey % 2 = 1")
def new_versions(spark, sf):
    """A second capture repeats all orders and contradicts some: only new ones are stored, contradictions are set aside."""
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("revision"), F.col("o_totalprice").alias("value"))
    stored = rows.where("id % 2 = 0").withColumn("semantic_id", fn.semantic_id(["id", "key", "revision", "value"]))
    other = rows.where("id % 10 in (1, 3)").withColumn("value", F.col("value") + 1)
    good, bad = ing.new_versions(rows.unionByName(rows).unionByName(other), stored, ["id", "value"], ["key"], "revision")
    each = lambda df, name: df.select("id", "key", F.lit(name).alias("status")).distinct()
    return each(good, "stored").unionByName(each(bad, "conflict"))


@register("changed_metadata", """WITH v AS (SELECT o_custkey AS key, o_orderkey AS t, o_orderstatus AS s, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY
    o_orderkey) AS b FROM orders) SELECT key, t, s AS status FROM v WHERE t > 7000 AND b IS DISTINCT FROM s""")
def changed_metadata(spark, sf):
    """A version is kept only where its content differs from the one before, stored or new."""
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("t"), F.col("o_orderstatus").alias("status"))
    stored = rows.where("t <= 7000").withColumn("content_id", fn.semantic_id(["status"]))
    return ing.changed_metadata(rows.where("t > 7000"), stored, "key", ["status"], "t").select("key", "t", "status")


@register("late_corrections", with_views("versions", f"SELECT key, period, arg_max(id, (observed, id)) AS id FROM versions WHERE observed <= {915_148_800_000_000} GROUP BY ALL"))
def late_corrections(spark, sf):
    """What was known at a time, from a table to which corrections were added later."""
    cut = 915_148_800_000_000
    v = versions(spark, sf)
    late = v.where(F.col("observed") <= cut).withColumn("observed", F.lit(cut + DAY)).withColumn("value", F.col("value") * 2)
    return ing.known_at(v.unionByName(late), cut, ["key", "period"], "observed", ["observed", "id"]).select("key", "period", "id")


@register("overlap_refresh", with_views("trades", f"SELECT symbol, count(*) AS n FROM trades WHERE t > (SELECT max(t) FROM trades) - {7 * DAY} GROUP BY 1"))
def overlap_refresh(spark, sf):
    """The rows of the last seven days, which are taken in again."""
    t = trades(spark, sf)
    last = t.agg(F.max("t")).first()[0]
    return ing.overlap(t, "t", last, 7).groupBy("symbol").agg(F.count("*").alias("n"))


@register("run_totals", """WITH p AS (SELECT c_nationkey AS run, CASE WHEN c_nationkey % 5 = 0 AND c_custkey % 7 = 0 THEN 0 ELSE c_custkey END AS cursor, 10 AS n FROM
    customer) SELECT run, CASE WHEN count(*) <> count(DISTINCT cursor) THEN 'cursor_repeats' WHEN run % 4 = 1 THEN 'rows_differ' ELSE 'ok' END AS status FROM p GROUP BY
    run""")
def run_totals(spark, sf):
    """Runs whose cursor comes back or whose rows are not what was advertised."""
    c = table(spark, sf, "customer")
    k = F.when((F.col("c_nationkey") % 5 == 0) & (F.col("c_custkey") % 7 == 0), 0).otherwise(F.col("c_custkey"))
    total = c.groupBy(F.col("c_nationkey").alias("run")).agg((10 * F.count("*") + F.when(F.max("c_nationkey") % 4 == 1, 1).otherwise(0)).alias("total"))
    pages = c.select(F.col("c_nationkey").alias("run"), k.alias("cursor"), F.lit(10).alias("rows")).join(total, "run")
    return ing.reconcile_totals(pages).select("run", "status")


# --- lookups and order ---------------------------------------------------------------------------------


@register("current_vintage", with_views("versions", "SELECT id, key FROM versions WHERE observed <= 946684800000000"))
def current_vintage(spark, sf):
    """Observations seen by a time; the reconstructed view of a current vintage is empty."""
    at = 946_684_800_000_000
    v = versions(spark, sf).withColumn("observed_at", F.col("observed"))
    both = bt.current_vintage(v, "observed", at).unionByName(bt.current_vintage(v, "reconstructed", at))
    return both.select("id", "key")


@register("funding_average", with_views("trades", f"""WITH a AS (SELECT symbol, t // {DAY} AS d, avg(CASE WHEN seq % 4 = 0 THEN px END) AS r FROM trades WHERE symbol <
    6 GROUP BY ALL), b AS (SELECT symbol, t // {DAY} AS d, max(px) AS r FROM trades GROUP BY ALL), u AS (SELECT * FROM a UNION ALL SELECT * FROM b WHERE (symbol, d) NOT
    IN (SELECT (symbol, d) FROM a)) SELECT symbol, round(coalesce(avg(r) * 10000, 0), 4) AS funding_bps FROM u GROUP BY 1"""))
def funding_average(spark, sf):
    """Mean rate of each symbol from a first source, on days without it from a second under another name."""
    day = F.floor(F.col("t") / DAY).alias("date")
    t = trades(spark, sf)
    first = t.where("symbol < 6").groupBy("symbol", day).agg(F.avg(F.when(F.col("seq") % 4 == 0, F.col("px"))).alias("funding"))
    second = t.groupBy("symbol", day).agg(F.max("px").alias("rate"))
    return lg.funding_average([first, second], ["funding", "rate"]).select("symbol", F.round("funding_bps", 4).alias("funding_bps"))


@register("canonical_order", with_views("trades", """SELECT symbol, seq, CAST(row_number() OVER (PARTITION BY symbol ORDER BY t // 60000000, seq % 3, coalesce(CASE
    WHEN seq % 2 = 0 THEN CAST(seq AS VARCHAR) END, ''), seq) AS INTEGER) AS place FROM trades"""))
def canonical_order(spark, sf):
    """Events of a symbol by time, sequence and id, a missing id first."""
    from pyspark.sql import Window

    t = trades(spark, sf).select("symbol", "seq", F.floor(F.col("t") / 60_000_000).alias("minute"), (F.col("seq") % 3).alias("k"), F.when(F.col("seq") % 2 == 0, F.col("seq").cast("string")).alias("name"))
    order = br.canonical_order("minute", "k", "name")
    return t.select("symbol", "seq", F.row_number().over(Window.partitionBy("symbol").orderBy(*order, "seq")).alias("place"))


@register("shifted_labels", with_views("trades", "SELECT seq, coalesce(lead(px) OVER (ORDER BY t, seq), 0) AS px FROM trades"))
def shifted_labels(spark, sf):
    """Each price replaced by the next in the whole order."""
    return pr.shift_labels(trades(spark, sf).select("seq", "t", "px"), [F.col("t"), F.col("seq")], "px", even_buckets(trades(spark, sf), "t")).select("seq", "px")
