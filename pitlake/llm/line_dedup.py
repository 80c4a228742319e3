"""Line deduplication by prefix doubling over line-ID sequences; DataFrame functions only.

A document is its sequence of non-blank lines; each distinct line is one symbol, named by a 128-bit hash. The suffixes
of all sequences are ranked in the order of their symbols, by their first 1, 2, 4 ... lines: a rank is the place in
the suffix array where the suffixes with that prefix begin. The rank by 2d lines is the rank by d lines plus the number of
suffixes of the same rank whose next d lines rank lower; such sums go by buckets of the next rank, so that no hot
line is one task. Suffixes with one rank at depth d are an interval of the suffix array whose longest common
prefix reaches d lines; one alone in its interval is settled and leaves the rounds.

A run that repeats with `words` words or more is covered exactly by its minimal windows: from each line
the fewest lines on that reach `words`, and from each line back. (Each line of such a run lies in a window inside it, and
each window with an earlier copy lies in a maximal run with one.) So the array is ordered to the depth of the longest
minimal window only (at most `words` lines, since every line has a word), which bounds the rounds by
log2(words) whatever the documents. The interval of a window of m lines is told by two overlapping ranks at a power of two.
The first copy of a window, in order of (doc_id, line), stays; later copies that overlap make up the maximal
repeated runs, whose lines are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitlake.llm.common import WORD, cut, free
from pitlake.operators.numbering import running_sum

#: A line occurrence: the document's id, a hash of its text (rows may share an id), the line's place among the non-blank.
PLACE = ("d", "t", "i")
#: Ranks of one bucket when the suffixes of one rank are put in order.
BUCKET = 1 << 14


def _place() -> Column:
    return F.struct(*PLACE)


def _classes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The first place of each interval that has two places, by partial aggregates; a hot interval is one row."""
    found = rows.groupBy(*keys).agg(F.min(_place()).alias("first"), F.max(_place()).alias("last"))
    # written, so that the join to the rows has an exchange on both sides and Spark can split a hot interval
    return cut(found.where(F.col("first") < F.col("last")).drop("last"), "intervals")


def _sequences(docs: DataFrame) -> DataFrame:
    """One row for each non-blank line: its place, position in the text, word count and symbol (x, y)."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x, p: F.struct(p.alias("p"), x.alias("line"))), lambda s: s["line"].rlike(WORD))
    flat = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"), F.posexplode(lines).alias("i", "s"))
    line = F.col("s.line")
    return flat.select("d", "t", "i", F.col("s.p").alias("p"), F.regexp_count(line, F.lit(WORD)).alias("w"), F.xxhash64(line).alias("x"), F.xxhash64(F.lit(1), line).alias("y"))


def _symbols(lines: DataFrame) -> DataFrame:
    """x, y and r0 (rank) of the lines that stand in two places."""
    counted = lines.groupBy("x", "y").agg(F.count("*").alias("n"), F.min(_place()).alias("first"), F.max(_place()).alias("last"))
    repeated = counted.where(F.col("first") < F.col("last")).select("x", "y", "n")
    ranked = running_sum(repeated, F.col("n"), [F.col("x"), F.col("y")], F.shiftright("x", 48), "upto")
    return cut(ranked.select("x", "y", (F.col("upto") - F.col("n")).alias("r0")), "symbols")


def _refined(named: DataFrame, rank: str, to: str) -> DataFrame:
    """The rank, next and the rank by both of suffixes that share it with others."""
    pairs = named.where(F.col("next").isNotNull()).groupBy(rank, "next").agg(F.count("*").alias("n"))
    ranked = running_sum(pairs, F.col("n"), [F.col("next")], F.floor(F.col("next") / BUCKET), "upto", [rank])
    return cut(ranked.where("n > 1").select(F.col(rank).alias("__r"), F.col("next").alias("__n"), (F.col(rank) + F.col("upto") - F.col("n")).alias(to)), "ranks")


def later_copies(docs: DataFrame, words: int = 50) -> DataFrame:
    """d, t and cut (positions of the lines to delete) of each text that has lines in a later copy of a run.

    d is the id (null: the smallest), t the hash of the text."""
    lines = cut(_sequences(docs), "lines")
    active = lines.join(_symbols(lines), ["x", "y"]).select(*PLACE, "p", "w", "r0").repartition("d", "t")
    # exact repeated rows put one place there twice: they are one text
    active = active.groupBy("d", "t", "i").agg(F.first("p").alias("p"), F.first("w").cast("long").alias("w"), F.first("r0").alias("r0"))
    # a stretch: repeated lines without a gap; only one with enough words can hold a window
    stretch, run = Window.partitionBy("d", "t", "g"), Window.partitionBy("d", "t", "g").orderBy("i")
    active = active.withColumn("g", F.col("i") - F.row_number().over(Window.partitionBy("d", "t").orderBy("i")))
    long = active.withColumn("all", F.sum("w").over(stretch)).withColumn("upto", F.sum("w").over(run)).where(F.col("all") >= words)
    sized = long.withColumn("ends", F.collect_list("upto").over(run.rowsBetween(0, words))).withColumn("starts", F.collect_list(F.col("upto") - F.col("w")).over(run.rowsBetween(-words, 0)))
    # the fewest lines from here on, and back to here, with enough words; null where the stretch has not so many
    ahead = F.size(F.filter("ends", lambda e: e - F.col("upto") + F.col("w") < words)) + 1
    back = F.size(F.filter("starts", lambda s: F.col("upto") - s < words)) + 1
    rows = cut(sized.select(
        *PLACE, "p", "g", "r0",
        F.when(F.element_at("ends", -1) - F.col("upto") + F.col("w") >= words, ahead).alias("ahead"),
        F.when(F.col("upto") - F.element_at("starts", 1) >= words, back).alias("back"),
    ), "rank0")
    deepest = int(rows.agg(F.max(F.greatest("ahead", "back"))).first()[0] or 1)
    for k in range(1, deepest.bit_length()):
        before, rank = f"r{k - 1}", f"r{k}"
        named = rows.withColumn("next", F.when(F.col(before).isNotNull(), F.lead(before, 1 << (k - 1)).over(run)))
        shared = _refined(named, before, rank)
        rows = cut(named.join(shared, (F.col(before) == F.col("__r")) & (F.col("next") == F.col("__n")), "left").drop("next", "__r", "__n"), rank)
    ranks = rows.select(*PLACE, F.array(*[f"r{k}" for k in range(deepest.bit_length())]).alias("r"))
    both = F.array(F.struct(F.col("i").alias("s"), F.col("ahead").alias("m")), F.struct((F.col("i") - F.col("back") + 1).alias("s"), F.col("back").alias("m")))
    spans = rows.select("d", "t", F.explode(F.filter(both, lambda v: v["m"].isNotNull())).alias("v")).select("d", "t", F.col("v.s").alias("i"), F.col("v.m").alias("m")).distinct()
    spans = spans.withColumn("k", F.floor(F.log2(F.col("m").cast("double")) + 1e-9).cast("int")).withColumn("j", F.col("i") + F.col("m") - F.expr("shiftleft(1, k)"))
    spans = spans.join(ranks, ["d", "t", "i"]).withColumn("a", F.element_at("r", F.col("k") + 1)).drop("r")
    spans = spans.join(ranks.withColumnRenamed("i", "j"), ["d", "t", "j"]).withColumn("b", F.element_at("r", F.col("k") + 1)).drop("r")
    windows = cut(spans.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select(*PLACE, "m", "a", "b"), "windows")
    firsts = _classes(windows, ["m", "a", "b"])
    copies = windows.join(firsts, ["m", "a", "b"]).where(_place() > F.col("first"))
    reach = copies.groupBy("d", "t", "i").agg(F.max(F.col("i") + F.col("m") - 1).alias("e"))
    covered = rows.select("d", "t", "i", "p").join(reach, ["d", "t", "i"], "left")
    upto = F.max("e").over(Window.partitionBy("d", "t").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    gone = covered.withColumn("upto", upto).where(F.col("upto") >= F.col("i"))
    return gone.groupBy("d", "t").agg(F.sort_array(F.collect_list("p")).alias("cut"))


def dedup_lines(docs: DataFrame, words: int = 50, names: tuple[str, str] = ("n_lines", "cut")) -> DataFrame:
    """docs with the lines of later copies deleted from text, plus n_lines (before) and cut (deleted positions), or the given names.

    A run of whole lines repeats if the same non-blank lines stand in the same order elsewhere, in another
    document or further on in the same; runs of fewer than `words` words stay. The first copy in order of
    (doc_id, position) stays. Ids may be null (before all others). Rows with equal id and text are one text:
    all of them keep or lose the same lines; rows with equal id and other texts come in order of a hash of the
    text. Null and empty texts stay as they are, with n_lines 0 and 1. Other columns pass through; columns
    named like the two added are replaced."""
    kept = docs.drop(*names)
    d, t, gone = free(kept, "d", "t", "gone")
    id_of = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    found = later_copies(docs.select(id_of.alias("doc_id"), F.col("text").cast("string").alias("text")), words)
    found = cut(found.select(F.col("d").alias(d), F.col("t").alias(t), F.col("cut").alias(gone)), "cut")
    keyed = kept.withColumn(d, id_of).withColumn(t, F.xxhash64("text"))
    # by merge at every size: a small table of deletions would be broadcast, and the plan and its disk then jump as it grows
    both = keyed.join(found.hint("merge"), [d, t], "left")
    lines = F.split("text", "\n")
    left = F.array_join(F.filter(lines, lambda x, p: ~F.array_contains(gone, p)), "\n")
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(left).alias("text")
    others = [text if c.lower() == "text" else F.col(c) for c in kept.columns]
    return both.select(*others, F.coalesce(F.size(lines), F.lit(0)).alias(names[0]), F.coalesce(gone, F.array().cast("array<int>")).alias(names[1]))
