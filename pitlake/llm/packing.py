"""Conflict-constrained best-fit packing of documents into training sequences.

Documents are dealt by a hash of their id and text into chunks of bounded expected size, so that neither a hot
source nor a large group of copies meets in one chunk (rows that repeat an id and its text are dealt by their
number too); each chunk is packed by itself. Within a chunk,
open bins stand in order of what is left in them. Each bin carries a bitmap of the sources and one of the
duplicate clusters in it. A piece goes to the tightest bin that holds it and shares no bit with it: the
search starts at the successor of its length and goes on to larger bins until one is compatible.

Only documents of one chunk can meet in a bin, so near copies are looked for within each chunk. A pair is near
if its sets of five-word shingles have a Jaccard index of 0.8 or more; such pairs share one of their rarest
shingles (prefix filtering), and each pair so met is verified, so that none is missed.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlake.llm.common import WORD, cut

#: Near copies: words of a shingle.
SHINGLE = 5

_SPACE = re.compile(rb"[\x20\x09-\x0D]")

_ARROW = pa.schema([("bin_id", pa.int64()), ("slot", pa.int32()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32())])
SCHEMA = "bin_id long, slot int, doc_id long, piece int, start long, length int"


def best_fit(items: list[tuple], capacity: int) -> list[tuple[int, int]]:
    """(bin, slot) of each item (length, source, cluster), taken longest first, ties in the order given.

    Two items of one source or of one cluster never share a bin; None conflicts with nothing. Every length
    is 1 to capacity. Of equally tight bins the oldest is tried first."""
    bit_of: tuple[dict, dict] = ({}, {})
    for k in (0, 1):  # a bit only for what can conflict here at all
        for value, n in Counter(x[1 + k] for x in items).items():
            if n > 1 and value is not None:
                bit_of[k][value] = 1 << len(bit_of[k])
    order = sorted(range(len(items)), key=lambda i: -items[i][0])
    open_bins: list[tuple[int, int]] = []  # (residual, bin), sorted
    sources: list[int] = []
    clusters: list[int] = []
    filled: list[int] = []
    out: list[tuple[int, int]] = [(0, 0)] * len(items)
    for i in order:
        length, source, cluster = items[i]
        s, c = bit_of[0].get(source, 0), bit_of[1].get(cluster, 0)
        at = bisect_left(open_bins, (length, -1))
        while at < len(open_bins) and (sources[b := open_bins[at][1]] & s or clusters[b] & c):
            at += 1
        if at < len(open_bins):
            left, b = open_bins.pop(at)
        else:
            left, b = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
            filled.append(0)
        out[i] = b, filled[b]
        sources[b] |= s
        clusters[b] |= c
        filled[b] += 1
        if left > length:
            insort(open_bins, (left - length, b))
    return out


class Shingles:
    """Sets of 64-bit numbers for the shingles of texts, equal for equal words.

    A word (A-Z lower-cased) is told by a 64-bit hash, and the hashes of a shingle's words are mixed. Words are hashed `step` bytes of a text at a time,
    so that a very long text takes few times its own size."""

    def __init__(self, words: int = SHINGLE, step: int = 1 << 20):
        self.words, self.step = words, step

    def hashes(self, text: str) -> np.ndarray:
        """The hash of each word of a text, in order."""
        raw = text.encode("utf-8", "surrogatepass").lower()

        def parts() -> Iterator[np.ndarray]:
            start = 0
            while start < len(raw):
                space = _SPACE.search(raw, start + self.step)
                end = space.start() if space else len(raw)
                found = raw[start:end].split()
                yield np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
                start = end

        return np.concatenate([np.zeros(0, np.uint64), *parts()])

    @staticmethod
    def mix(x: np.ndarray) -> np.ndarray:
        """A one-to-one map of 64-bit numbers that spreads each bit over all."""
        x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(29))

    def of(self, text: str) -> np.ndarray:
        """The sorted distinct shingles of a text; of fewer words, the whole sequence."""
        n = self.hashes(text)
        if not len(n):
            return n
        size = min(self.words, len(n))
        h = np.full(len(n) - size + 1, size, np.uint64)
        for k in range(size):
            h = self.mix(h ^ n[k : len(n) - size + 1 + k])
        return np.unique(h)


def near_groups(sets: list[np.ndarray]) -> list[int]:
    """For each set of shingle hashes the first index of its group: sets of a Jaccard index of 0.8 or more, and all linked by such."""
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    lengths = [len(x) for x in sets]
    if not sum(lengths):
        return root
    # a number for each distinct shingle, the rarest first
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    every = every[order]
    numbers = np.concatenate([[0], np.cumsum(every[1:] != every[:-1], dtype=np.int32)]).astype(np.int32)
    counts = np.bincount(numbers)
    rank = np.empty(len(counts), np.int32)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts), dtype=np.int32)
    at = np.empty(len(order), np.int32)
    at[order] = rank[numbers]
    del every, order, numbers, rank
    alone = int((counts == 1).sum())  # ranks below are of one set each and meet nothing: only their number is kept
    shared, start = [], 0
    for n in lengths:
        own = at[start : start + n]
        shared.append(np.sort(own[own >= alone]))
        start += n
    del at, counts
    postings: dict[int, list[int]] = {}
    for i in sorted(range(len(sets)), key=lengths.__getitem__):
        n, met = lengths[i], set()
        prefix = shared[i][: max(0, n - (4 * n + 4) // 5 + 1 - (n - len(shared[i])))].tolist()
        for r in prefix:
            met.update(postings.get(r, ()))
        for j in met:
            m = lengths[j]
            if 5 * m >= 4 * n and find(i) != find(j):
                both = len(np.intersect1d(shared[i], shared[j], assume_unique=True))
                if 9 * both >= 4 * (n + m):
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
        for r in prefix:
            postings.setdefault(r, []).append(i)
    return [find(i) for i in range(len(sets))]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def exact_cluster(text: Column) -> Column:
    """The same value for the same text without regard to case and white space; null for a text without words."""
    return F.when(text.rlike(WORD), F.md5(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " ")))


def pack(docs: DataFrame, capacity: int = 2048, length: Column | None = None, source: Column | None = None, cluster: Column | None = None, chunk: int = 4096, chunk_bytes: int = 64 << 20) -> DataFrame:
    """Pack every document of docs; returns one row for each piece: bin_id, slot, doc_id, piece, start, length.

    length: units of a document (words by default); source and cluster: what must not meet in a bin (the source
    column, and exact and near copies of the text, by default). A document longer than capacity is cut into pieces of capacity and a
    rest; start is a piece's first unit. chunk, chunk_bytes: documents and bytes of text packed together on average, whichever are reached first; they bound a
    task's memory but for a longer text, which is whole in its chunk.
    A document of length 0 or null fills nothing: it has a row with null bin_id. Repeated rows and rows without
    an id are packed each by itself; null sources and clusters conflict with nothing. Columns of docs beyond
    doc_id and those read by the three expressions are ignored."""
    length = word_count(F.col("text")) if length is None else length
    source = F.col("source") if source is None else source
    takes_texts = cluster is None
    near = F.col("text") if takes_texts else F.lit(None)
    cluster = exact_cluster(F.col("text")) if cluster is None else cluster
    # only near copies take the texts to the tasks
    size = F.octet_length(F.col("text").cast("string")) if takes_texts else F.lit(0)
    whole = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(size.cast("long")), F.lit(0)).alias("bytes")).first()
    chunks = max(1, -(-whole["n"] // chunk), -(-whole["bytes"] // chunk_bytes))
    # bit for bit equal rows of an id and its text would all be dealt alike: many of them are told apart by number
    deal = F.xxhash64("doc_id", F.col("text").cast("string")) if "text" in docs.columns else F.xxhash64("doc_id")
    rows = docs.select(
        F.col("doc_id").cast("long"), F.coalesce(length.cast("long"), F.lit(0)).alias("n"), source.cast("string").alias("s"), cluster.cast("string").alias("c"),
        near.cast("string").alias("t"), deal.alias("h"), F.lit(0).cast("long").alias("copy"),
    )
    heavy = cut(docs.groupBy(deal.alias("h")).agg(F.count("*").alias("m")).where(F.col("m") > max(1, chunk // 64)).select("h"), "repeated")
    if not heavy.isEmpty():
        same = [c for c in rows.columns if c != "copy"]
        counted = rows.join(heavy, "h", "left_semi").groupBy(*same).agg(F.count("*").alias("m"))
        copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "m"))).select(*rows.columns)
        rows = rows.join(heavy, "h", "left_anti").select(*rows.columns).unionByName(copies)
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("h", "n", "s", "copy"), F.lit(chunks))).drop("h", "copy")

    def packed(table: pa.Table) -> pa.Table:
        texts, first_of = table.column("t"), {}
        for i, c in enumerate(table.column("c").to_pylist()):
            if c is not None and texts[i].is_valid:
                first_of.setdefault(c, i)
        shingles = Shingles()
        groups = near_groups([shingles.of(texts[i].as_py()) for i in first_of.values()])
        names = list(first_of)
        group = {c: names[g] for c, g in zip(names, groups)}
        docs = zip(*[table.column(c).to_pylist() for c in ("doc_id", "n", "c", "s", "chunk")])
        docs = sorted(docs, key=lambda r: tuple((x is not None, x) for x in r))
        items, rows = [], []
        for doc, n, c, s, _ in docs:
            for piece, start in enumerate(range(0, n, capacity)):
                m = min(capacity, n - start)
                items.append((m, s, group.get(c, c)))
                rows.append((doc, piece, start, m))
            if n <= 0:
                items.append(None)
                rows.append((doc, 0, 0, 0))
        first = docs[0][4] << 32
        full = [i for i, x in enumerate(items) if x]
        placed = dict(zip(full, best_fit([items[i] for i in full], capacity)))
        out = [(first + placed[i][0], placed[i][1], *r) if i in placed else (None, None, *r) for i, r in enumerate(rows)]
        return pa.table([pa.array(list(c), f.type) for c, f in zip(zip(*out), _ARROW)], schema=_ARROW)

    return rows.groupBy("chunk").applyInArrow(packed, SCHEMA)
