"""Mixing sources to target weights by a low-discrepancy schedule.

The schedule is a row of slots, each worth a block of `block` words. Slot i has the point i * golden ratio modulo one, as an exact
integer of 40 bits; cumulative target shares map the point to a source, so every stretch of slots holds each source close to its share. Slots
are ranked per source. The documents of a source stand in a shuffled order on a line of words, which repeats up to `most` times; the line is
cut into blocks of equal words, and the k-th slot of a source takes its k-th block. A document may be in many blocks, a block in many documents.

Positions on a line and ranks of slots go by buckets (pitlake.operators.numbering), so a source with a third of all rows is many
small windows. Sources are a table; nothing of them but one-row aggregates and some splitters reaches the driver.

Defined results: a null text has no words; a null source is a source of its own and comes last; a null doc_id is kept; repeated rows are
rows of their own, told apart by a number among equals, so that reruns agree; of an empty table, or without any word, targets
and takings are 0; columns besides doc_id, text and source are not looked at.
"""

from __future__ import annotations

from math import ceil, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlake.llm.common import WORD, cut
from pitlake.operators.asof import asof_join
from pitlake.operators.numbering import number, running_sum

#: Words of a block. Slots are few bytes beside the words they stand for; small blocks keep sources of few words near their targets.
BLOCK = 64
#: Points are integers below 2 ** BITS; GOLDEN is the golden ratio's fraction on that scale, odd so that no point repeats.
BITS = 40
GOLDEN = int((sqrt(5) - 1) / 2 * 2**BITS) | 1  # 679535556991


def words(text: Column) -> Column:
    """Number of words of a text, 0 of a null one; holds two strings of the text's length at most."""
    marks = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), WORD + "+", "w")
    return F.length(F.translate(marks, " \t\n\x0b\x0c\r", "")).cast("long")


def point(slot: Column) -> Column:
    """slot * GOLDEN modulo 2 ** BITS, in longs that do not overflow for slots below 2 ** BITS."""
    half = BITS // 2
    high, low = F.shiftright(slot, half), slot.bitwiseAND(F.lit((1 << half) - 1))
    return (high * F.lit((GOLDEN << half) % (1 << BITS)) + low * F.lit(GOLDEN)) % F.lit(1 << BITS)


def targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """sources (source, source_size) with rank (by code point, null last) and target.

    Weights repeat along the ranks; they share the sum of all sizes. A target stops at most * source_size, and the excess is shared
    again by weight until none is above. Each round is one aggregate of one row."""
    # splitters of bounded number, in order: ranks do not depend on them
    cuts = sorted(r[0] for r in sources.where("source is not null").orderBy(F.xxhash64("source")).limit(255).select("source").collect())
    known = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<string>")
    bucket = F.when(F.col("source").isNull(), len(cuts) + 1).otherwise(F.size(F.filter(known, lambda c: c <= F.col("source"))))
    ranked = number(sources, [F.col("source").asc_nulls_last()], bucket, "rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = cut(ranked.select("source", "source_size", "rank", weight.cast("long").alias("weight"), (F.col("source_size") * most).alias("cap")), "sources")
    share, full = 0.0, -1
    while True:
        above = F.col("cap") < F.col("weight") * share
        r = ranked.agg(F.sum("source_size").alias("all"), F.sum(F.when(above, F.col("cap")).otherwise(0)).alias("capped"), F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("open"), F.count_if(above).alias("full")).first()
        if r["full"] == full or not r["open"]:
            break
        share, full = (r["all"] - r["capped"]) / r["open"], r["full"]
    target = F.when(F.col("cap") < F.col("weight") * share, F.col("cap").cast("double")).otherwise(F.col("weight") * F.lit(float(share)))
    return ranked.select("source", "source_size", "rank", target.alias("target"))


def schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, rank, turn): the source of every slot by its rank, and which of this source's slots it is, from 0.

    sources: as targets() returns it. A slot whose point rounding leaves beyond all shares goes to the last source."""
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    slots = sources.sparkSession.range(ceil(total / block)).select(F.col("id").alias("slot"), point(F.col("id")).alias("at"))
    width = F.round(F.col("target") / F.lit(float(max(total, 1))) * F.lit(float(1 << BITS))).cast("long")
    ends = running_sum(sources.select("rank", width.alias("width")), F.col("width"), [F.col("rank")], F.floor(F.col("rank") / 4096), "end")
    starts = ends.where("width > 0").select((F.col("end") - F.col("width")).alias("start"), "rank")
    dealt = asof_join(slots, starts, [], "at", "start", ["rank"], width=(1 << BITS) // max(16, ceil(sqrt(total / block))))
    # about as many buckets of slots as slots in one
    return number(dealt.select("slot", "rank"), [F.col("slot")], F.floor(F.col("slot") / max(64, ceil(sqrt(total / block)))), "turn", by=["rank"])


def lines(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """docs (row, doc_id, source, size, copy) with rank, source_size, target and start: where the row begins on its source's line."""
    digest = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size"), F.col("copy")))
    key = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    named = docs.withColumn("key", key).join(sources.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    # about as many buckets as rows in one: neither a window nor the prefix over buckets holds more than the root of the rows
    buckets = max(16, ceil(sqrt(docs.count())))
    upto = running_sum(named, F.col("size"), [F.col("key"), F.col("doc_id"), F.col("copy"), F.col("row")], F.floor(F.col("key") / F.lit((1 << 60) // buckets + 1)), "upto", by=["rank"])
    return upto.withColumn("start", F.col("upto") - F.col("size")).drop("upto", "key")


def placed(docs: DataFrame, weights: tuple[int, ...], most: int) -> tuple[DataFrame, DataFrame]:
    """(documents on their lines, sources with targets), both written once."""
    named = docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"), F.monotonically_increasing_id().alias("row"))
    named = cut(named, "sizes")
    # equal rows are numbered, partition by partition, so that a row repeated many times is many places on the line
    copies = number(named, [F.col("row")], F.shiftright("row", 33), "copy", by=["doc_id", "source", "size"])
    sources = cut(targets(named.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "targets")
    return cut(lines(copies, sources), "lines"), sources


def pieces(docs: DataFrame, sources: DataFrame, block: int = BLOCK, most: int = 3) -> DataFrame:
    """(slot, row, doc_id, source, repeat, first, words): what each slot takes, as ranges of words of documents; repeat counts from 0.

    docs, sources: as placed() returns them."""
    turns = cut(schedule(sources, block), "slots")
    got = turns.groupBy("rank").agg((F.count("*") * block).alias("got"))
    at = F.col("start") + F.col("source_size") * F.col("repeat")
    spans = docs.where("size > 0").join(got, "rank").withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).withColumn("at", at).where("at < got")
    end = F.least(F.col("at") + F.col("size"), F.col("got"))
    cutting = spans.withColumn("end", end).withColumn("turn", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("end") - 1) / block))))
    low, high = F.greatest(F.col("at"), F.col("turn") * block), F.least(F.col("end"), (F.col("turn") + 1) * block)
    part = cutting.select("rank", "turn", "row", "doc_id", "source", "repeat", (low - F.col("at")).alias("first"), (high - low).alias("words"))
    return part.join(turns, ["rank", "turn"]).select("slot", "row", "doc_id", "source", "repeat", "first", "words")


def mix(docs: DataFrame, block: int = BLOCK, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """The mix of docs (doc_id, text, source), as pieces() states it: read in order of slot it holds every source at its share."""
    rows, sources = placed(docs, weights, most)
    return pieces(rows, sources, block, most)


def taken(docs: DataFrame, block: int = BLOCK, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """doc_id, size, source_size, target and taken (the words that the mix takes of it, repeats counted) of every row of docs."""
    rows, sources = placed(docs, weights, most)
    sums = pieces(rows, sources, block, most).groupBy("row").agg(F.sum("words").alias("taken"))
    return rows.join(sums, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))
