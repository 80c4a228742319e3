"""URL filter by a temporal list join; DataFrame functions only.

Dated list entries become validity intervals: an entry holds from its date until the next entry of the same
pattern, or for good. A capture is judged by the entries active when it was fetched. Patterns are hosts
with all below them ("example.org") or host and path prefix up to a slash ("example.org/blog/"); the most
specific active entry decides. A capture has one row for each suffix of its host and each prefix of its path, as
deep as any entry of the list goes; one as-of join takes them all: an equality on (pattern, month) with the
interval as its condition. Intervals of a pattern do not overlap, so a capture meets at most one on each
level, and no list is collected. Spark broadcasts the entries where their measured size allows it and else
joins by shuffle, splitting a hot host's captures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitlake.llm.common import cut


def host(url: Column) -> Column:
    """Lower-case host of an http(s) URL without user, port and final dot; null for anything else."""
    found = F.regexp_extract(url, r"^(?i:https?)://(?:[^/?#@]*@)?([^/:?#@]+)", 1)
    name = F.regexp_replace(F.lower(found), r"\.$", "")
    return F.when(name != "", name)


def path(url: Column) -> Column:
    """The path of a URL from its first slash, without query and fragment; "/" where it has none."""
    found = F.regexp_extract(url, r"^(?i:https?)://[^/?#]+(/[^?#]*)", 1)
    return F.when(found == "", "/").otherwise(found)


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals (pattern, verdict, since, until) of dated entries (pattern, verdict, listed_at).

    until is the date of the pattern's next entry, exclusive, or null. Of entries of one pattern and date the
    verdict "block" wins over others, then the smallest. Entries with a null pattern, date or verdict do not count.
    Case does not matter in the host of a pattern; it does in its path."""
    some = entries.where(F.col("pattern").isNotNull() & F.col("listed_at").isNotNull() & F.col("verdict").isNotNull())
    name = F.concat(F.lower(F.substring_index("pattern", "/", 1)), F.regexp_replace("pattern", "^[^/]*", ""))  # paths keep their case
    best = some.groupBy(name.alias("pattern"), F.col("listed_at").cast("date").alias("since")).agg(F.min(F.struct((F.col("verdict") != "block").alias("k"), "verdict")).alias("v"))
    after = F.lead("since").over(Window.partitionBy("pattern").orderBy("since"))
    return best.select("pattern", F.col("v.verdict").alias("verdict"), "since", after.alias("until"))


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures with verdict, pattern and since of the most specific entry active at fetched_at (a date).

    verdict is null where no entry applies, also for a null or odd URL and for a null date. Longer paths go
    before shorter ones, paths before hosts, longer hosts before their parents. Every capture stays once, repeated ones
    too. Columns of captures named verdict, pattern or since are replaced."""
    kept = captures.drop("verdict", "pattern", "since")
    fetched = F.trunc(F.col("fetched_at"), "month")
    # the months in which something was fetched: twelve a year at most, whatever the number of captures
    months = sorted(r[0].isoformat() for r in kept.where("fetched_at is not null").select(fetched).distinct().collect())
    every = F.transform(F.split(F.lit(",".join(months)), ","), lambda m: m.cast("date"))
    valid = lambda m: (m >= F.trunc("since", "month")) & (F.col("until").isNull() | (m < F.col("until")))
    listed = intervals(entries).withColumn("__m", F.explode(F.filter(every, valid) if months else F.array().cast("array<date>")))
    listed = cut(listed, "intervals")
    most = listed.agg(F.max(F.size(F.split(F.substring_index("pattern", "/", 1), r"\."))).alias("labels"), F.max(F.regexp_count("pattern", F.lit("/"))).alias("slashes")).first()
    most_labels, most_parts = most["labels"] or 1, max(0, (most["slashes"] or 0) - 1)
    # what is judged: each URL and date once; captures take the answer back
    judged = kept.select("url", "fetched_at", host(F.col("url")).alias("__host")).where("__host is not null and fetched_at is not null").distinct()
    labels = F.split("__host", r"\.")
    parts = F.filter(F.split(path(F.col("url")), "/"), lambda x: x != "")
    deep = F.regexp_count(path(F.col("url")), F.lit("/[^/]+(?=/)"))
    # the host and all its parents, then paths, each above all that is shorter
    hosts = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most_labels))), lambda n: F.struct(n.alias("level"), F.array_join(F.slice(labels, -n, n), ".").alias("key")))
    paths = F.sequence(F.lit(0), F.least(deep, F.lit(most_parts)))
    paths = F.transform(paths, lambda n: F.struct((n + most_labels + 1).alias("level"), F.concat(F.col("__host"), F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/"), F.when(n > 0, "/").otherwise("")).alias("key")))
    keyed = judged.select("url", "fetched_at", fetched.alias("__month"), F.explode(F.concat(hosts, paths)).alias("__k"))
    on = (F.col("__k.key") == F.col("pattern")) & (F.col("__month") == F.col("__m")) & (F.col("fetched_at") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetched_at") < F.col("until")))
    found = keyed.join(listed, on).groupBy("url", "fetched_at").agg(F.max_by(F.struct("verdict", "pattern", "since"), "__k.level").alias("__f"))
    return kept.join(found, ["url", "fetched_at"], "left").select(*kept.columns, "__f.verdict", "__f.pattern", "__f.since")
