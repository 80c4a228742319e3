"""The medallion lake: layout, typed scans, partition discovery, caps and inventory."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LAYERS = ("bronze", "silver", "gold")
DATASETS = ("fills", "l2_book", "funding", "asset_ctxs", "candles", "markout", "training")
FILLS = "coin string, ts_ms long, px double, sz double, notional double, side string, crossed boolean, maker_side int, fee double, fee_bps double, fee_token string, oid long, tid long, hash string, direction string"


def symbol(raw: str) -> str:
    """A coin's name in the lake: upper case, "/" as "-"."""
    return raw.strip().upper().replace("/", "-")


def lake_path(root: str, layer: str, dataset: str, coin: str = "*", date: str = "*") -> str:
    """Path (or glob) of one dataset's partition files."""
    if layer not in LAYERS or dataset not in DATASETS:
        raise ValueError(f"no such dataset: {layer}/{dataset}")
    return f"{root}/{layer}/{dataset}/{coin if coin == '*' else symbol(coin)}/{date}.parquet"


def from_path(df: DataFrame) -> DataFrame:
    """Coin and date (YYYYMMDD) of the file that each row is read from."""
    path = F.col("_metadata.file_path")
    return df.select("*", F.regexp_extract(path, r"/([^/]+)/\d{8}\.parquet", 1).alias("coin_part"), F.regexp_extract(path, r"/(\d{8})\.parquet", 1).alias("date_part"))


def scan(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Partition files with an explicit schema; no file is an empty frame."""
    try:
        return spark.read.schema(schema).option("ignoreMissingFiles", "true").parquet(path)
    except Exception as e:  # a glob that meets nothing
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def fills(raw: DataFrame) -> DataFrame:
    """Fill events: time from milliseconds, B/A as buy/sell, sequence by (ts_ms, tid) within the coin's day."""
    t = F.timestamp_millis("ts_ms")
    day = F.floor(F.col("ts_ms") / 86_400_000)
    seq = F.row_number().over(Window.partitionBy("coin", day).orderBy("ts_ms", F.col("tid").asc_nulls_first(), "oid"))
    return raw.select(
        F.upper("coin").alias("symbol"), t.alias("timestamp"), seq.alias("sequence"), F.col("px").alias("price"), F.col("sz").alias("quantity"),
        F.when(F.col("side") == "B", "buy").when(F.col("side") == "A", "sell").alias("side"), "maker_side", "crossed", "fee", "fee_token", F.col("tid").alias("trade_id"),
    )


def markout_columns(df: DataFrame) -> dict[str, str]:
    """Horizon -> column of each markout_bps_<horizon> column."""
    return {m[1]: c for c in df.columns if (m := re.fullmatch(r"markout_bps_(\w+)", c))}


def markout_map(df: DataFrame) -> DataFrame:
    """Df with markouts, a map of the horizons that have a value; df needs one markout column at least."""
    found = markout_columns(df)
    if not found:
        raise ValueError("no markout column")
    pairs = F.map_from_arrays(F.array(*[F.lit(h) for h in found]), F.array(*[F.col(c).cast("double") for c in found.values()]))
    return df.withColumn("markouts", F.map_filter(pairs, lambda _, v: v.isNotNull()))


def with_horizon(df: DataFrame, horizon: str) -> DataFrame:
    """The records of markout_map() that have a value for the horizon; none left is an error."""
    out = df.where(F.map_contains_key("markouts", F.lit(horizon)))
    if out.isEmpty():
        raise ValueError(f"no record has a markout at {horizon}")
    return out


def markout_long(df: DataFrame) -> DataFrame:
    """One row for each record and horizon with a value: columns horizon and bps instead of the wide ones."""
    found = markout_columns(df)
    every = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(c).cast("double").alias("bps")) for h, c in found.items()])
    rest = [c for c in df.columns if c not in found.values()]
    return df.select(*rest, F.inline(every)).where(F.col("bps").isNotNull())


def klines(raw: DataFrame) -> DataFrame:
    """One-minute bars by timestamp."""
    names = {"open_price": "open", "high_price": "high", "low_price": "low", "close_price": "close", "volume": "volume", "trade_count": "trades"}
    return raw.select("event_id", "symbol", F.col("timestamp").cast("timestamp"), *[F.col(a).cast("long" if b == "trades" else "double").alias(b) for a, b in names.items()])


def depth_snapshots(levels: DataFrame, by: list[str] = ["symbol", "timestamp"]) -> DataFrame:
    """One row for each snapshot with its levels in order of percentage."""
    return levels.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("percentage", "depth", "notional"))).alias("levels"))


def agg_trades(raw: DataFrame) -> DataFrame:
    """Aggregate trades; the maker flag may be a boolean or text."""
    from pitlake.functions.scalars import to_boolean, to_timestamp_any

    return raw.select("event_id", to_timestamp_any(F.col("timestamp")).alias("timestamp"), F.col("aggregate_trade_id").cast("long"), F.col("price").cast("double"), F.col("quantity").cast("double"), F.col("first_trade_id").cast("long"), F.col("last_trade_id").cast("long"), to_boolean(F.col("is_buyer_maker")).alias("is_buyer_maker"))


def top_of_book(raw: DataFrame) -> DataFrame:
    """Best bid and ask."""
    from pitlake.functions.scalars import to_timestamp_any

    return raw.select("event_id", to_timestamp_any(F.col("timestamp")).alias("timestamp"), F.col("update_id").cast("long"), *[F.col(c).cast("double") for c in ("bid_price", "bid_quantity", "ask_price", "ask_quantity")])


def cap_partitions(df: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """The first rows of each partition in an explicit order, which the reading order of files is not."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__n") <= most).drop("__n")


def inventory(symbols: DataFrame, dates: DataFrame, present: DataFrame, cap: int) -> DataFrame:
    """Every requested (symbol, date) with its rows (0 where absent) and the rows that a cap leaves."""
    grid = symbols.select("symbol").distinct().crossJoin(dates.select("date").distinct())
    counts = present.groupBy("symbol", "date").agg(F.count("*").alias("rows"))
    out = grid.join(counts, ["symbol", "date"], "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    return out.withColumn("evaluated", F.least(F.col("rows"), F.lit(cap)))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """Path, length and SHA-256 of each file."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def verify_hashes(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Status of each file or manifest row: ok, changed, missing (no file) or orphan (not in the manifest)."""
    m = manifest.select("path", F.col("sha256").alias("want"))
    status = F.when(F.col("want").isNull(), "orphan").when(F.col("sha256").isNull(), "missing").when(F.col("sha256") == F.col("want"), "ok").otherwise("changed")
    return files.join(m, "path", "full").select("path", status.alias("status"))


def requested_dates(spec: Column) -> Column:
    """Dates (YYYYMMDD) of a list of days and inclusive ranges a..b, as an array without repeats."""
    one = lambda s: F.sequence(F.to_date(F.split(s, r"\.\.")[0], "yyyyMMdd"), F.to_date(F.element_at(F.split(s, r"\.\."), -1), "yyyyMMdd"))
    days = F.flatten(F.transform(F.filter(F.transform(F.split(spec, ","), lambda s: F.trim(s)), lambda s: s != ""), one))
    return F.array_distinct(F.transform(days, lambda d: F.date_format(d, "yyyyMMdd")))


def requested_symbols(spec: Column) -> Column:
    """Markets of a list of coins: upper case, -PERP added where no market is named, first mention kept."""
    names = F.transform(F.filter(F.transform(F.split(spec, ","), lambda s: F.trim(s)), lambda s: s != ""), lambda s: F.replace(F.upper(s), F.lit("/"), F.lit("-")))
    return F.array_distinct(F.transform(names, lambda s: F.when(s.contains("-"), s).otherwise(F.concat(s, F.lit("-PERP")))))


SCHEMA_DEPTH = T.ArrayType(T.StructType([T.StructField(n, T.DoubleType()) for n in ("percentage", "depth", "notional")]))
