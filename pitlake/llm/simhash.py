"""SimHash near-duplicates by a byte-position inverted index.

A fingerprint of 64 bits is eight positional bytes. Two fingerprints that differ in at most d bits share at
least 8 - d of them. The index has a posting for each choice of k positions and the bytes there, so a pair that shares
s positional bytes meets in C(s, k) postings. How often each pair meets is tallied; a pair below the guaranteed minimum of
C(8 - d, k) is dropped, and the rest is verified bit by bit. k is 1 for small inputs and grows with the logarithm of
the number of fingerprints, so that postings stay short: with k = 1 each would hold 1/256 of the corpus at any size.

A posting with more than `dense` fingerprints emits no pairs, since those would grow with its square: its members are linked
through centres instead. Each emits itself and its 64 neighbours at one bit; two that meet in a centre are at most two
bits apart, and all at most two bits apart meet in one, so linking each centre's members to their smallest
loses no component. A pair's tally is short only where some of its postings are dense, and then both have
centres. All of this works on distinct fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitlake.llm.common import cut, free, slices

BITS = 2


def hashes(text: str | None, words: int = 3) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of a text, A-Z lower-cased, as unsigned 64-bit numbers."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined, h = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([h(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = [0, *ends[: len(found) - words].tolist()]
    return np.array([h(joined[a:b], 42) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())], np.uint64)


def fingerprint(h: np.ndarray) -> int:
    """Bits set in over half of h; 0 without any."""
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h)).view(">u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row; a null text has fingerprint 0."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            fps = np.array([fingerprint(hashes(t, words)) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.record_batch([b.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(marked, "doc_id long, fp long")


def posting_bytes(n: int, dense: int, bits: int = BITS) -> int:
    """Positional bytes of a posting: the fewest with which n evenly spread fingerprints fill a posting to half of dense at most."""
    return next((k for k in range(1, 8 - bits) if n <= dense // 2 << 8 * k), 8 - bits)


def links(fps: DataFrame, dense: int = 32, k: int | None = None) -> DataFrame:
    """Pairs (a, b), a > b, of the distinct fingerprints in column fp that connect all at most BITS bits apart.

    k: positional bytes of a posting (posting_bytes() of their number by default)."""
    k = posting_bytes(fps.count(), dense) if k is None else k
    masks = [sum(255 << 8 * p for p in chosen) for chosen in combinations(range(8), k)]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]  # as signed longs
    keys = F.array(*[F.struct(F.lit(i).alias("n"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(masks)])
    postings = fps.select("fp", F.explode(keys).alias("k")).select("fp", F.col("k.n").alias("n"), F.col("k.v").alias("v"))
    sizes = postings.groupBy("n", "v").agg(F.count("*").alias("m")).where(F.col("m") > 1)
    met = cut(postings.join(sizes, ["n", "v"]), "postings")
    few = met.where(F.col("m") <= dense)
    left, right = few.select("n", "v", F.col("fp").alias("a")), few.select("n", "v", F.col("fp").alias("b"))
    tally = left.join(right, ["n", "v"]).where(F.col("a") > F.col("b")).groupBy("a", "b").agg(F.count("*").alias("m"))
    pairs = tally.where((F.col("m") >= comb(8 - BITS, k)) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS)).select("a", "b")
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    balls = met.where(F.col("m") > dense).select("fp").distinct().select("fp", F.explode(F.concat(F.array("fp"), flips)).alias("centre"))
    centres = balls.groupBy("centre").agg(F.min("fp").alias("b"), F.max("fp").alias("most")).where(F.col("most") > F.col("b"))
    stars = balls.join(centres, "centre").where(F.col("fp") > F.col("b")).select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (a, b) reaches.

    Alternates large-star and small-star rounds; every round is a written table, so that a lost executor
    repeats one round at most. Raises where the rounds do not settle it (each at least halves the depth)."""
    edges = cut(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        after = cut(small.where(F.col("a") != F.col("b")).distinct(), "edges")
        if _sign(after) == _sign(edges):
            return after.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(after.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        edges = after
    raise RuntimeError("the components did not settle")


def _sign(edges: DataFrame) -> tuple:
    """One row for any number of edges: their count and an order-free hash."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def grouped(fps: DataFrame) -> DataFrame:
    """fp, first (its smallest doc_id) and component (the smallest fingerprint it reaches) of the distinct fingerprints of (doc_id, fp)."""
    classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = cut(components(links(classes.select("fp"))), "roots").select(F.col("node").alias("fp"), F.col("root").alias("component"))
    return cut(classes.join(roots, "fp", "left").withColumn("component", F.coalesce("component", "fp")), "components")


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id of every row of docs.

    Fingerprints link at BITS or fewer differing bits; component_id is the smallest doc_id reachable. Null and
    empty texts share fingerprint 0 and are linked like any other. A row without an id gets the component of
    its fingerprint; a component of such rows alone has a null component_id. Repeated rows stay repeated."""
    marked = cut(fingerprints(docs, words), "fingerprints")
    member = grouped(marked)
    lowest = member.groupBy("component").agg(F.min("first").alias("component_id"))
    named = member.join(lowest, "component").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = 3) -> DataFrame:
    """docs with one row of each component of near_duplicates(), all columns as they are.

    The row with the smallest id stays (rows without an id come last), of several such the one with the smallest hash of its
    text, then of all its columns but maps; of rows equal in all of these, one. Rows without an id are grouped like others."""
    row, fp, h, g = free(docs, "row", "fp", "h", "g")
    names = docs.columns

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            fps = np.array([fingerprint(hashes(t, words)) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.record_batch([*b.columns, pa.array(fps.view(np.int64))], [*names, fp])

    found = docs.mapInArrow(marked, T.StructType([*docs.schema.fields, T.StructField(fp, T.LongType())]))
    # numbered and written: the numbers don't change when a task runs again
    every = cut(found.withColumn(row, F.monotonically_increasing_id()).withColumn(h, F.xxhash64("text")).withColumn(g, F.xxhash64(*[f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])), "numbered")
    ids = every.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(fp).alias("fp"), F.col(row).alias("row"), F.col(h).alias("h"), F.col(g).alias("g"))
    member = grouped(ids.select("doc_id", "fp")).select("fp", "component")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "g", "row")
    # once by fingerprint with partial sums, so that a large group of equal texts is one row before the join
    best = ids.groupBy("fp").agg(F.min(order).alias("o")).join(member, "fp").groupBy("component").agg(F.min("o").alias("o"))
    chosen = best.select(F.col("o.row").alias(row))
    return every.join(chosen, row, "left_semi").select(*names)
