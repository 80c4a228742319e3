"""Spelling variant grouping by k-d trees over letter counts.

Words are counted in built-in functions. A word is a point: how often it has each letter. One inserted, deleted or replaced letter changes one
count up by one, one count down by one, or both, so the words near a word of length n have length n (one up and one down), n + 1
(one up) or n - 1. For each length there is a k-d tree over its words, and for each pair of lengths (n, n) and (n, n + 1) the words
of length n search the tree of the second: a branch is left out as soon as its box needs more ups or downs than one edit
has. Words of the leaves that remain are compared letter by letter.

The top of a length's tree is built from a bounded sample of its words (`SAMPLE` in all) and only deals the work: its leaves are
cells, each word is a point in one cell and a query to each cell it can reach, and a task searches one cell with a
k-d tree of its own. The sample changes the sizes of cells, never which pairs are found. Cells that hold many
words all the same (anagrams share one point) are cut into blocks that every query of the cell visits.

Defined results: a null text has no words; a null doc_id counts as empty text; an empty table gives no rows; very long texts are read in
pieces that end between words; very long words are compared in chunks; a word without near words has n_near 0 and itself as
root; ties of the largest n go to the smallest word in code-point order. Columns but doc_id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlake.llm.common import cut

LETTER = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters are counted by code point modulo DIMS, which keeps those of LETTER apart and others within the same bounds.
DIMS = 191
#: Words that the tops of all trees are built from, at most, and words of a cell aimed at.
SAMPLE, CELL = 65_536, 2_048
#: Code points that a comparison or a cell holds at once, about.
CHUNK = 1 << 22


def counted_words(docs: DataFrame, length: int = 6, often: int = 5, every: int = 199) -> DataFrame:
    """(word, n): the words of docs (doc_id, text) with at least `length` code points that occur at least `often` times.

    A word is a maximal run of letters with A-Z lower-cased. A run whose unsigned crc32 of "<doc_id>:<run>" is divisible by
    `every` loses the code point at that number modulo its length."""
    text = F.translate(F.col("text").cast("string"), UPPER, LOWER)
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    # pieces end where a run ends, so that no row holds all runs of a very long text
    piece = docs.select(name.alias("d"), F.explode(F.regexp_extract_all(text, F.lit(f"(?s).{{1,65536}}+{LETTER}*+"), F.lit(0))).alias("t"))
    runs = piece.select("d", F.explode(F.regexp_extract_all("t", F.lit(f"{LETTER}++"), F.lit(0))).alias("w"))
    h = F.crc32(F.concat("d", F.lit(":"), "w"))
    k = (F.col("h") % F.length("w")).cast("int")
    less = F.concat(F.col("w").substr(F.lit(1), k), F.col("w").substr(k + 2, F.length("w")))
    found = runs.withColumn("h", h).select(F.when(F.col("h") % every == 0, less).otherwise(F.col("w")).alias("word"))
    return found.where(F.length("word") >= length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= often)


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all words, and where each word begins in them (and the last ends)."""
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])


def vectors(words: list[str]) -> np.ndarray:
    """Letter counts, one row a word."""
    flat, ends = codes(words)
    row = np.repeat(np.arange(len(words), dtype=np.int64), np.diff(ends))
    return np.bincount(row * DIMS + flat % DIMS, minlength=len(words) * DIMS).reshape(-1, DIMS).astype(np.int32)


class Tree:
    """A k-d tree: node i has a letter dim[i] (-1: a leaf, numbered by left[i]), a cut and two children; counts up to the cut go left."""

    def __init__(self, points: np.ndarray, capacity: int):
        self.dim, self.cut, self.left, self.right, self.leaves = [], [], [], [], []
        if len(points):
            self._grow(points, capacity)

    def _node(self) -> int:
        for a in (self.dim, self.cut, self.left, self.right):
            a.append(-1)
        return len(self.dim) - 1

    def _grow(self, points: np.ndarray, capacity: int) -> None:
        stack = [(self._node(), np.arange(len(points)))]
        while stack:
            node, rows = stack.pop()
            best = None
            if len(rows) > capacity:
                held = points[rows]
                low, high = held.min(0), held.max(0)
                for d in np.flatnonzero(high > low):  # the most even cut of any letter
                    tally = np.cumsum(np.bincount(held[:, d] - low[d]))[:-1]
                    k = int(np.abs(2 * tally - len(rows)).argmin())
                    odd = abs(2 * int(tally[k]) - len(rows))
                    if best is None or odd < best[0]:
                        best = (odd, int(d), int(low[d]) + k)
            if best is None:
                self.left[node] = len(self.leaves)
                self.leaves.append(rows)
                continue
            _, self.dim[node], self.cut[node] = best
            below = points[rows, best[1]] <= best[2]
            self.left[node], self.right[node] = self._node(), self._node()
            stack += [(self.right[node], rows[~below]), (self.left[node], rows[below])]

    def reach(self, queries: np.ndarray, up: int, down: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows of queries) of all leaves whose box a query gets into by at most `up` more and `down` fewer letters."""
        if not self.dim or not len(queries):
            return
        zero = np.zeros(len(queries), np.int64)
        stack = [(0, np.arange(len(queries)), zero, zero, {}, {})]
        while stack:
            node, rows, more, fewer, low, high = stack.pop()
            d, c = self.dim[node], self.cut[node]
            if d < 0:
                yield self.left[node], rows
                continue
            q = queries[rows, d]
            # what this letter asks for already is replaced, as the box narrows
            fall = fewer + np.maximum(q - c, 0) - (np.maximum(q - high[d], 0) if d in high else 0)
            rise = more + np.maximum(c + 1 - q, 0) - (np.maximum(low[d] - q, 0) if d in low else 0)
            if (keep := rise <= up).any():
                stack.append((self.right[node], rows[keep], rise[keep], fewer[keep], low | {d: c + 1}, high))
            if (keep := fall <= down).any():
                stack.append((self.left[node], rows[keep], more[keep], fall[keep], low, high | {d: c}))


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the rows of a turn into those of b by replacing one code point (equal widths) or inserting one (b is one wider)."""
    n = a.shape[1]
    if b.shape[1] == n:
        return (a != b).sum(1) == 1
    same = lambda x, y: np.logical_and.accumulate(x == y, axis=1).sum(1)
    return same(a, b[:, :n]) + same(a[:, ::-1], b[:, :0:-1]) >= n


def search(points: list[str], queries: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of queries, rows of points) of all pairs at one edit; queries are as long as points, or shorter by one."""
    if not points or not queries:
        return
    wide, narrow = len(points[0]), len(queries[0])
    p, q = (codes(x)[0].reshape(len(x), -1) for x in (points, queries))
    tree, most = Tree(vectors(points), max(1, min(16, CHUNK // wide))), max(1, CHUNK // wide)
    step = max(1, CHUNK // DIMS)
    for start in range(0, len(queries), step):
        for leaf, rows in tree.reach(vectors(queries[start : start + step]), 1, int(wide == narrow)):
            held = tree.leaves[leaf]
            i, j = np.repeat(rows + start, len(held)), np.tile(held, len(rows))
            for k in range(0, len(i), most):
                good = one_edit(q[i[k : k + most]], p[j[k : k + most]])
                if good.any():
                    yield i[k : k + most][good], j[k : k + most][good]


def tops(words: DataFrame, sample: int = SAMPLE, cell: int = CELL) -> dict[int, Tree]:
    """The top of the tree of each length with more words than fit into a cell, from at most `sample` words of all lengths."""
    size = F.greatest(F.lit(1), F.least(F.lit(cell), F.floor(F.lit(CHUNK) / F.col("l"))))
    large = {r["l"]: (r["m"], r["size"]) for r in words.groupBy(F.length("word").alias("l")).agg(F.count("*").alias("m")).withColumn("size", size).where("m > size").collect()}
    if not large:
        return {}
    drawn = words.where(F.length("word").isin([*large])).orderBy(F.xxhash64("word"), "word").limit(sample)
    by: dict[int, list[str]] = {}
    for r in drawn.select("word").toLocalIterator():
        by.setdefault(len(r[0]), []).append(r[0])
    out = {}
    for n, (m, size) in large.items():
        got = by.get(n, [])
        # at least 16 sampled words a leaf
        out[n] = Tree(vectors(got), max(16, ceil(len(got) * size / m))) if got else Tree(np.zeros((0, DIMS), np.int32), 1)
        out[n].leaves = [None] * len(out[n].leaves)
    return out


def deal(words: DataFrame, trees: dict[int, Tree], cell: int = CELL) -> DataFrame:
    """(length, cell, block, query, word, n): each word as a point of its cell, and as a query to the cells that it can reach."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array(batch.column("word").to_pylist(), object)
            lengths = np.fromiter(map(len, names), np.int64, len(names))
            for n in np.unique(lengths):
                rows = np.flatnonzero(lengths == n)
                step = max(1, min(4096, CHUNK // int(n)))
                for part in (rows[k : k + step] for k in range(0, len(rows), step)):
                    yield from sent(batch, part, int(n), vectors(list(names[part])))

    def sent(batch: pa.RecordBatch, part: np.ndarray, n: int, v: np.ndarray) -> Iterator[pa.RecordBatch]:
        for to, up, down, query in ((n, 0, 0, False), (n, 1, 1, True), (n + 1, 1, 0, True)):
            tree = trees.get(to)
            for leaf, rows in tree.reach(v, up, down) if tree and tree.dim else [(0, np.arange(len(part)))]:
                own = batch.take(pa.array(part[rows]))
                same = lambda x, kind: pa.array(np.full(len(rows), x), kind)
                yield pa.record_batch([same(to, pa.int32()), same(leaf, pa.int32()), same(query, pa.bool_()), own.column("word"), own.column("n")], ["length", "cell", "query", "word", "n"])

    rows = words.select("word", "n").mapInArrow(dealt, "length int, cell int, query boolean, word string, n long")
    rows = cut(rows, "dealt")
    size = F.greatest(F.lit(1), F.least(F.lit(cell), F.floor(F.lit(CHUNK) / F.col("length"))))
    full = rows.where("not query").groupBy("length", "cell").agg(F.count("*").alias("m")).withColumn("blocks", F.ceil(F.col("m") / size).cast("int")).where("blocks > 4").drop("m")
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    block = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).when(F.col("query"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))
    return rows.join(full, ["length", "cell"], "left").select("length", "cell", F.explode(block).alias("block"), "query", "word", "n")


def near_words(words: DataFrame, sample: int = SAMPLE, cell: int = CELL) -> DataFrame:
    """(word, near, n): each word of words (word, n), all different, with each word that differs by one edit, and its n."""

    def searched(rows: pa.Table) -> pa.Table:
        query = rows.column("query").to_numpy(zero_copy_only=False)
        names, n = np.array(rows.column("word").to_pylist(), object), rows.column("n").to_numpy()
        points, length = np.flatnonzero(~query), rows.column("length")[0].as_py()
        out: list[list] = [[], [], []]
        asked = np.flatnonzero(query)
        wide = np.fromiter(map(len, names[asked]), np.int64, len(asked)) == length
        for same in (True, False):
            q = asked[wide == same]
            for i, j in search(list(names[points]), list(names[q])):
                for a, b in ((q[i], points[j]),) if same else ((q[i], points[j]), (points[j], q[i])):
                    for kept, x in zip(out, (names[a], names[b], n[b]), strict=True):
                        kept.extend(x.tolist())
        return pa.table([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], ["word", "near", "n"])

    rows = deal(words, tops(words, sample, cell), cell)
    return rows.groupBy("length", "cell", "block").applyInArrow(searched, "word string, near string, n long")


def roots(forms: DataFrame, steps: int) -> DataFrame:
    """(word, root) of forms (word, form), whose chains have at most `steps` steps; each round doubles the steps that are done."""
    done = cut(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(ceil(log2(max(1, steps)))):
        after = done.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        done = cut(done.join(after, "root", "left").select("word", F.coalesce("__next", "root").alias("root")), "roots")
    return done


def variants(words: DataFrame, ratio: int = 5, sample: int = SAMPLE, cell: int = CELL) -> DataFrame:
    """word, form, root, n, n_near and form_n of every row of words (word, n), whose words are all different.

    form: the near word of largest n (ties: the smallest), if that n is at least ratio times the word's own."""
    words = cut(words, "words")
    first = F.min(F.struct((-F.col("n")).alias("n"), F.col("near").alias("near")))
    found = near_words(words, sample, cell).groupBy("word").agg(F.count("*").alias("n_near"), first.alias("f"))
    best = F.when(-F.col("f.n") >= ratio * F.col("n"), F.struct(F.col("f.near").alias("form"), (-F.col("f.n")).alias("n")))
    formed = cut(words.join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), best.alias("b")), "forms")
    # every step multiplies n by ratio at least
    top = formed.agg(F.max("n")).first()[0] or 1
    last = roots(formed.where("b is not null").select("word", F.col("b.form").alias("form")), ceil(log(max(2, top), ratio)) + 1)
    return formed.join(last, "word", "left").select("word", F.col("b.form").alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near", F.col("b.n").alias("form_n"))
