"""Rules as named columns: rows that break one go to quarantine with the names of what they break."""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlake.operators.asof import asof_join

Rules = dict[str, Column]


def violations(rules: Rules) -> Column:
    """Names of the rules that do not hold; a rule that is null does not hold."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))


def split(df: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the others with the column violations."""
    checked = df.withColumn("violations", violations(rules))
    return checked.where(F.size("violations") == 0).drop("violations"), checked.where(F.size("violations") > 0)


def _set(*names: str) -> Column:
    out = F.lit(True)
    for n in names:
        out &= F.col(n).isNotNull()
    return out


def trade_rules() -> Rules:
    """P01, trades."""
    return {"symbol": F.col("symbol") == F.upper("symbol"), "price": F.col("price") > 0, "quantity": F.col("quantity") > 0, "maker_side": F.col("maker_side").isin(-1, 1), "ids": F.coalesce(F.col("last_id") >= F.col("first_id"), F.lit(True)), "time": _set("timestamp")}


def quote_rules() -> Rules:
    """P01, quotes: a positive uncrossed book."""
    return {"bid": F.col("bid") > 0, "ask": F.col("ask") > 0, "spread": F.col("bid") < F.col("ask"), "time": _set("timestamp")}


def order_rules(actions: tuple[str, ...] = ("new", "cancel", "replace", "fill")) -> Rules:
    """P01, orders of agents: named, a known action and side, something left of a positive quantity."""
    named = (F.length("scenario_id") > 0) & (F.length("agent_id") > 0) & (F.length("order_id") > 0)
    return {"named": named, "action": F.col("action").isin(*actions), "side": F.col("side").isin("buy", "sell"), "price": F.col("price") > 0, "quantity": F.col("quantity") > 0, "remaining": F.col("remaining").between(0, F.col("quantity"))}


def depth_rules() -> Rules:
    """P01, depth levels."""
    return {"percentage": _set("percentage"), "depth": F.col("depth") >= 0, "notional": F.col("notional") >= 0}


def kline_rules() -> Rules:
    """P01, klines: a named interval that does not end before it begins; low and high contain open and close."""
    prices = (F.col("low") > 0) & (F.col("open") > 0) & (F.col("close") > 0)
    inside = (F.col("low") <= F.least("open", "close")) & (F.col("high") >= F.greatest("open", "close"))
    return {"interval": F.length("interval") > 0, "span": F.col("close_time") >= F.col("open_time"), "positive": prices, "contained": inside, "volume": F.col("volume") >= 0, "trades": F.col("trade_count") >= 0}


def bar_rules(minute: int = 60_000) -> Rules:
    """One aligned minute, available at its end or later, low and high contain open and close."""
    inside = (F.col("low") <= F.least("open", "close")) & (F.col("high") >= F.greatest("open", "close"))
    return {"width": F.col("end") - F.col("start") == minute, "aligned": F.col("start") % minute == 0, "available": F.col("available_at") >= F.col("end"), "contained": inside, "positive": F.col("low") > 0, "volume": F.col("volume") >= 0}


def fact_rules() -> Rules:
    """Locator, dates in order, scale within 12."""
    return {"locator": F.length("locator") > 0, "period": F.col("start") <= F.col("end"), "scale": F.abs("scale") <= 12, "status": F.col("status").isin("active", "retracted", "unresolved")}


def relationship_rules(kinds: tuple[str, ...] = ("supplies", "purchases", "competes", "manufactures", "exposed_to")) -> Rules:
    """Weight in parts per million, a span of validity, an allowed kind."""
    return {"weight": F.col("weight_ppm").between(0, 1_000_000), "valid": F.coalesce(F.col("valid_to") > F.col("valid_from"), F.col("valid_to").isNull()), "relation": F.col("relation").isin(*kinds)}


def source_rules() -> Rules:
    """Id and a SHA-256 in hex of either case."""
    return {"id": F.length("id") > 0, "sha256": F.col("content_sha256").rlike("^[0-9a-fA-F]{64}$")}


def availability_rules() -> Rules:
    """A known precision and zone, extraction not before receipt, modelled availability not before publication."""
    ordered = lambda first, then: F.coalesce(F.col(then) >= F.col(first), F.lit(True))
    return {
        "precision": F.col("precision").isin("instant", "date_end_conservative"), "zone": F.col("zone").isin(*sorted(available_timezones())), "published": _set("published"),
        "extracted": ordered("first_seen", "extracted"), "modelled": ordered("published", "modelled"),
    }


def action_rules() -> Rules:
    """Split terms positive; a dividend is paid at its effective time or later."""
    paid = (F.col("dividend") == 0) | (F.col("pay_at") >= F.col("effective"))
    return {"split": (F.col("split_num") > 0) & (F.col("split_den") > 0), "dividend": F.col("dividend") >= 0, "pay_date": paid}


def within_sessions(bars: DataFrame, sessions: DataFrame, width: int) -> DataFrame:
    """Bars (start, end) with in_session: whether the last session (open, close) that opens by the bar's start closes at its end or later."""
    found = asof_join(bars.withColumn("__s", F.col("start")), sessions, [], "__s", "open", ["close"], width=width, prefix="session_").drop("__s")
    return found.withColumn("in_session", F.coalesce(F.col("session_close") >= F.col("end"), F.lit(False))).drop("session_close")


def at_session_open(actions: DataFrame, sessions: DataFrame) -> DataFrame:
    """Actions (symbol, effective) with at_open, whether a session opens at that very time, and alone, whether it is the symbol's only action then."""
    opens = sessions.select(F.col("open").alias("__o")).distinct()
    counts = actions.groupBy(F.col("symbol").alias("__y"), F.col("effective").alias("__e")).agg(F.count("*").alias("__n"))
    met = actions.join(opens, F.col("effective") == F.col("__o"), "left").join(counts, (F.col("symbol") == F.col("__y")) & (F.col("effective") == F.col("__e")), "left")
    return met.select(*actions.columns, F.col("__o").isNotNull().alias("at_open"), (F.col("__n") == 1).alias("alone"))


def session_rules() -> Rules:
    """A weekday, 09:30 to 13:00 or 16:00 in New York with the decision at 10:00, all on the session's date. Times in ms."""
    local = {c: F.from_utc_timestamp(F.timestamp_millis(c), "America/New_York") for c in ("open", "decision", "close")}
    clock = {c: F.date_format(t, "HH:mm:ss") for c, t in local.items()}
    return {
        "weekday": F.weekday(F.col("date")) < 5, "open": clock["open"] == "09:30:00", "decision": clock["decision"] == "10:00:00", "close": clock["close"].isin("13:00:00", "16:00:00"),
        "same_date": (F.to_date(local["open"]) == F.col("date")) & (F.to_date(local["close"]) == F.col("date")),
    }


def observation_rules() -> Rules:
    """Identity, period in order, a finite value if any, reconstruction not before publication."""
    finite = F.col("value").isNull() | (~F.isnan("value") & (F.abs("value") != float("inf")))
    rebuilt = F.col("reconstructed").isNull() | (F.col("reconstructed") >= F.col("published"))
    return {"identity": F.length("series_id") > 0, "period": F.col("period_start") <= F.col("period_end"), "value": finite, "reconstructed": rebuilt}


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are there more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def conflicts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with more than one payload; exact repeats are no conflict."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.count_distinct(F.xxhash64(*rest)).alias("payloads")).where("payloads > 1")


def merged(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows without exact repeats and conflicting keys, and the rows of conflicting keys."""
    once = df.dropDuplicates()
    bad = conflicts(once, keys).select(*[F.col(k).alias(f"__{k}") for k in keys])
    on = F.lit(True)
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    return once.join(bad, on, "left_anti"), once.join(bad, on, "left_semi")


def orphans(df: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose parent is not there."""
    return df.join(parents.select(key).distinct(), key, "left_anti")
