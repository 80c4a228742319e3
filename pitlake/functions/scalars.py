"""Scalar columns: periods, instants, money, coercions, identifiers, text rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cells that stand for a suppressed or missing value.
SUPPRESSED = ("-", "(S)", "(NA)", "N", "S", "")
#: Names of query parameters and keys whose values must not be kept.
SECRET_NAMES = ("key", "api_key", "apikey", "token", "secret", "password", "userid", "registrationkey")


def quotient(a: Column, b: Column) -> Column:
    """a / b of doubles by IEEE 754, without an error: over zero an infinity of a's sign, of zero NaN."""
    a, b = a.cast("double"), b.cast("double")
    over = F.when(F.isnan(a) | (a == 0), float("nan")).when(a > 0, float("inf")).when(a < 0, float("-inf"))
    return F.when(b == 0, over).otherwise(F.try_divide(a, b))


def round8(c: Column | str) -> Column:
    """F.round(c, 8) of doubles, by a product and a quotient instead of decimals where these surely give the same.

    Below 2e6 the product and the printed digits that F.round() goes by are within 0.03 of the true 1e8 x c, so 0.04 from a half they round alike, and
    a whole number below 2 ** 53 over 1e8 is the double nearest to that decimal. From 1e9 a double prints no ninth decimal."""
    x = F.col(c) if isinstance(c, str) else c
    y = x * 1e8
    exact = F.round(x, 8)
    return F.when(F.abs(x) >= 1e9, x).when((F.abs(x) < 2e6) & (F.abs(y - F.rint(y)) < 0.46), F.rint(y) / F.lit(1e8)).otherwise(exact)


def rounded(c: Column | str, digits: int) -> Column:
    """Doubles rounded by their product with 10 ** digits, a half away from zero, as the SQL of the queries rounds.

    F.round() goes by printed digits, which next to a half can fall on its other side."""
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    y = x * F.lit(10.0**digits)
    whole = F.rint(y)
    away = F.when((y > 0) & (y - whole == 0.5), whole + 1).when((y < 0) & (y - whole == -0.5), whole - 1).otherwise(whole)
    return F.when(F.abs(y) < float("inf"), away / F.lit(10.0**digits)).otherwise(x)


def mid(bid: Column, ask: Column) -> Column:
    """middle of the book."""
    return (bid + ask) / 2


def imbalance(bid_qty: Column, ask_qty: Column) -> Column:
    """(bid - ask) / (bid + ask) of sizes; null for an empty book."""
    return F.try_divide(bid_qty - ask_qty, bid_qty + ask_qty)


def microprice(bid: Column, ask: Column, bid_qty: Column, ask_qty: Column) -> Column:
    """each side weighted by the other side's size."""
    return F.try_divide(bid * ask_qty + ask * bid_qty, bid_qty + ask_qty)


def signed(side: Column, qty: Column) -> Column:
    """quantity with the side's sign; null for another side."""
    return F.when(side.isin("buy", "B"), qty).when(side.isin("sell", "A"), -qty)


def fee(price: Column, qty: Column, bps: Column) -> Column:
    """|price x quantity| in basis points."""
    return F.abs(price * qty) * bps / 10_000


def ceiling_fee(notional_micros: Column, bps: Column) -> Column:
    """whole micros, rounded up."""
    return F.ceil(notional_micros.cast("decimal(38,0)") * bps / 10_000).cast("long")


def impact_price(open_micros: Column, side: Column, spread_bps: Column, impact_bps: Column) -> Column:
    """open plus (buy) or minus (sell) half the spread and the impact, rounded up to micros."""
    move = F.ceil(open_micros.cast("decimal(38,0)") * (spread_bps + 2 * impact_bps) / 20_000).cast("long")
    return open_micros + side * move


def period_start(text: Column) -> Column:
    """first day of YYYY, YYYY-MM or YYYY-MM-DD; null for anything else."""
    return F.when(text.rlike(r"^\d{4}$"), F.concat(text, F.lit("-01-01"))).when(text.rlike(r"^\d{4}-\d{2}$"), F.concat(text, F.lit("-01"))).when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text).try_cast("date")


def period_end(text: Column) -> Column:
    """last day of the period."""
    start = period_start(text)
    return F.when(text.rlike(r"^\d{4}$"), F.make_date(F.year(start), F.lit(12), F.lit(31))).when(text.rlike(r"^\d{4}-\d{2}$"), F.last_day(start)).otherwise(start)


def publication_instant(date: Column, zone: str, allowance: str = "interval 0 seconds") -> Column:
    """midnight after the local date in the publisher's zone, as UTC, plus an allowance."""
    return F.to_utc_timestamp(F.date_add(date, 1).cast("timestamp"), zone) + F.expr(allowance)


def micros_of(text: Column) -> Column:
    """decimal text with at most six fraction digits as whole micros; null for another form. Overflow raises."""
    good = text.rlike(r"^-?\d+(\.\d{1,6})?$")
    return F.when(good, (F.when(good, text).cast("decimal(38,6)") * 1_000_000).cast("decimal(38,0)").cast("long"))


def to_timestamp_any(value: Column) -> Column:
    """ISO text, or epoch milliseconds as text or a number; null for anything else."""
    text = value.cast("string")
    ms = F.when(text.rlike(r"^-?\d+(\.\d+)?$"), text).try_cast("double").cast("long")
    return F.coalesce(F.timestamp_millis(ms), F.when(ms.isNull(), F.try_to_timestamp(text)))


def to_boolean(value: Column) -> Column:
    """true, false, 1 or 0 in any case; null for anything else."""
    text = F.lower(F.trim(value.cast("string")))
    return F.when(text.isin("true", "1"), True).when(text.isin("false", "0"), False)


def scaled(micros: Column, scale: Column) -> Column:
    """micros / 1e6 x 10^scale."""
    return micros / 1e6 * F.pow(F.lit(10.0), scale)


def stable_id(prefix: str, *parts: Column) -> Column:
    """F16: prefix and the SHA-256 of the parts joined by NUL; a null part counts as empty."""
    return F.concat(F.lit(prefix), F.sha2(F.concat_ws("\0", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256))


def sorted_map(entries: Column) -> Column:
    """A map with its keys in order, so that its JSON is the same however it was made."""
    return F.map_from_entries(F.array_sort(F.map_entries(entries)))


def semantic_id(columns: list[str], maps: list[str] = []) -> Column:
    """SHA-256 of the record's JSON with columns in order of name and map keys sorted."""
    return F.sha2(F.to_json(F.struct(*[(sorted_map(F.col(c)) if c in maps else F.col(c)).alias(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def allowed_host(url: Column, hosts: list[str]) -> Column:
    """Https, and the host is one of the allowed ones or below it."""
    name = F.lower(F.regexp_extract(url, r"^https://([^/:?#]+)", 1))
    ok = F.lit(False)
    for h in hosts:
        ok |= (name == h) | name.endswith("." + h)
    return ok


def redact_url(url: Column) -> Column:
    """Values of secret query parameters as [REDACTED]."""
    return F.regexp_replace(url, r"(?i)([?&](?:" + "|".join(SECRET_NAMES) + r")=)[^&#]*", "$1[REDACTED]")


def redact_map(entries: Column) -> Column:
    """Values of secret keys as [REDACTED]."""
    return F.transform_values(entries, lambda k, v: F.when(F.lower(k).isin(*SECRET_NAMES), F.lit("[REDACTED]")).otherwise(v))


def clean_number(text: Column) -> Column:
    """Number of a cell with thousands commas; null for a suppression token. Other text is null too: see bad_number()."""
    t = F.trim(text)
    return F.when(~t.isin(*SUPPRESSED), F.replace(t, F.lit(","), F.lit("")).try_cast("double"))


def bad_number(text: Column) -> Column:
    """A cell that is neither a number nor a suppression token; such cells fail a file."""
    t = F.trim(text)
    return t.isNotNull() & ~t.isin(*SUPPRESSED) & F.replace(t, F.lit(","), F.lit("")).try_cast("double").isNull()


def leaks_target(feature: Column, target: Column) -> Column:
    """a feature's normalised name is the target's, or starts with it and an underscore."""
    f, t = F.lower(F.trim(feature)), F.lower(F.trim(target))
    return (f == t) | F.startswith(f, F.concat(t, F.lit("_")))


def zero_cost(maker: Column, taker: Column, slip: Column) -> Column:
    """an execution that charges nothing at all."""
    return (maker == 0) & (taker == 0) & (slip == 0)


def matches(text: Column, part: str) -> Column:
    """contains, without regard to case."""
    return F.contains(F.lower(text), F.lit(part.lower()))
