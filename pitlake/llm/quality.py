"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are grown in numpy on a bounded sample of labelled documents, flattened into arrays of one
complete binary layout (children of i at 2i+1 and 2i+2), sent to the tasks with the closure (a few kB)
and traversed for a whole batch at once, one array step for each level of each tree.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitlake.llm.common import holdout, slices

#: Names of the statistics, in the order of statistics().
FEATURES = (
    "log_bytes", "log_words", "mean_word", "sd_word", "upper_share", "digit_share", "stop_share", "symbol_share",
    "space_share", "high_share", "unique_words", "top_word", "repeat_next", "capital_words", "edge_symbols",
    "lines_per_word", "unique_lines", "entropy",
)
_KIND = np.zeros(256, np.int64)  # 0 control, 1 lower, 2 upper, 3 digit, 4 sentence mark, 5 symbol, 6 space, 7 beyond ASCII
_KIND[[*range(97, 123)]] = 1
_KIND[[*range(65, 91)]] = 2
_KIND[[*range(48, 58)]] = 3
_KIND[[*b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]] = 5
_KIND[[*b".,;:?'\"-"]] = 4
_KIND[[*b" \t\n\r\v\f"]] = 6
_KIND[128:] = 7
_SYMBOLS = frozenset(np.flatnonzero(_KIND == 5).tolist())


def statistics(text: str | None) -> list[float]:
    """The statistics of one whole text; null counts as empty, and an empty text has zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [float(np.log1p(len(raw))), *[0.0] * (len(FEATURES) - 1)]
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kinds = np.bincount(_KIND, weights=counts, minlength=8)
    letters, n, size = max(1.0, kinds[1] + kinds[2] + kinds[7]), len(words), len(raw)
    lengths = np.fromiter(map(len, words), np.int64, n)
    seen = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    p = counts[counts > 0] / size
    return [
        float(np.log1p(size)), float(np.log1p(n)), float(lengths.mean()), float(lengths.std()), kinds[2] / letters, kinds[3] / size,
        kinds[4] / size, kinds[5] / size, kinds[6] / size, kinds[7] / size, len(seen) / n, seen.most_common(1)[0][1] / n,
        sum(map(bytes.__eq__, words, words[1:])) / n, sum(map(bytes.isupper, words)) / n,
        sum(w[-1] in _SYMBOLS or w[0] in _SYMBOLS for w in words) / n,
        len(lines) / n, len(set(lines)) / len(lines), float(-(p * np.log2(p)).sum()),
    ]


@dataclass
class Trees:
    """A boosted ensemble as arrays of shape (trees, nodes); a leaf's way on is to itself."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of x."""
        rows, total = np.arange(len(x)), np.full(len(x), self.base)
        for f, t, v in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            total += v[at]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, least: float = 2.0, l2: float = 1.0) -> Trees:
    """Boost depth-wise trees on binned columns; each level sums gradients into one histogram of all its nodes.

    Without rows the score is 0.5 everywhere; with one class it is that class's smoothed share."""
    n, width = x.shape if x.ndim == 2 else (0, len(FEATURES))
    nodes, leaves = 2**depth - 1, 2**depth
    feature = np.zeros((trees, nodes + leaves), np.int64)
    threshold = np.full((trees, nodes + leaves), np.inf)
    value = np.zeros((trees, nodes + leaves))
    share = (y.sum() + 1) / (n + 2)
    base = float(np.log(share / (1 - share)))
    if not n or y.min() == y.max():
        return Trees(base, feature, threshold, value, depth)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    raw = np.full(n, base)
    for k in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, m = 2**level - 1, 2**level
            slot = (((at - first)[:, None] * width + np.arange(width)) * bins + binned).ravel()
            grid = [np.bincount(slot, np.repeat(w, width), m * width * bins).reshape(m, width, bins) for w in (g, h)]
            gl, hl = (a.cumsum(2)[:, :, :-1] for a in grid)
            gt, ht = (a.sum(2, keepdims=True) for a in grid)
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            gain[(hl < least) | (ht - hl < least)] = -1
            best = gain.reshape(m, -1).argmax(1)
            for node in range(m):
                j, b = divmod(int(best[node]), bins - 1)
                if gain[node, j, b] > 1e-6 and b < len(cuts[j]):
                    feature[k, first + node], threshold[k, first + node] = j, cuts[j][b]
            at = 2 * at + 1 + (x[np.arange(n), feature[k, at]] > threshold[k, at])
        sums = [np.bincount(at - nodes, w, leaves) for w in (g, h)]
        value[k, nodes:] = -rate * sums[0] / (sums[1] + l2)
        raw += value[k, at]
    return Trees(base, feature, threshold, value, depth)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        x = [statistics(t) for t in b.column("text").to_pylist()]
        yield pa.record_batch([b.column("doc_id"), b.column("y"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "y", "x"])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, **how) -> Trees:
    """Learn labels.quality on documents outside the hold-out.

    max_rows bounds the sample: the labelled ids with the smallest hash. Rows without an id or a label are not
    learned from; of several labels of one id the largest counts, and of several texts of one id the one with the
    smallest statistics, so that the driver gets max_rows rows at most."""
    chosen = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~holdout(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("id")).agg((F.max("quality") > 0).cast("int").alias("y"))
        .orderBy(F.xxhash64("id"), "id").limit(max_rows)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("doc_id", "text", "y")
    measured = rows.mapInArrow(_measured, "doc_id long, y int, x array<double>")
    found = sorted(tuple(r) for r in measured.groupBy("doc_id").agg(F.min("x").alias("x"), F.max("y").alias("y")).collect())
    return grow(np.array([r[1] for r in found]), np.array([r[2] for r in found], float), **how)


def score(docs: DataFrame, model: Trees, cut_at: float = 0.3, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Add score (0 to 1, higher: likelier good) and predicted (score >= cut_at), or the given names, to every row of docs.

    Columns of docs named alike are replaced. A null text counts as empty; every row stays, repeated ones too."""
    kept = docs.drop(*names)
    schema = T.StructType([*kept.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            s = model.score(np.array([statistics(t) for t in b.column("text").to_pylist()]))
            yield pa.record_batch([*b.columns, pa.array(s), pa.array((s >= cut_at).astype(np.int32))], [*b.schema.names, *names])

    return kept.mapInArrow(scored, schema)


def classify(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """fit() and score() together; held_out marks the documents that the fit left out."""
    model = fit(docs, labels, **how)
    return score(docs, model).withColumn("held_out", holdout(F.col("doc_id")))
