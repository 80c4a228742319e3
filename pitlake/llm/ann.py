"""Approximate nearest neighbours by learned partitions.

A bounded sample is joined into a neighbour graph (its rows in tasks, against the whole sample), which is split into
partitions of equal size that cut few edges; there are more partitions the more rows there are. A small network learns, from a
vector, the share of its neighbours in each partition. Every row is
indexed in its likeliest partition; a query goes to its several likeliest ones, as many as reach the wanted
recall on sampled vectors kept back, and is scored there against every vector in double precision. A query that
finds too few there is asked of all partitions. Partitions are worked on in blocks of bounded size, vectors by
queries, so a partition that holds a third of all rows is many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitlake.llm.common import cut

#: Scores of one block that differ by less are scored anew, summing each pair in one fixed order.
SLACK = 1e-9


def usable(vector: Column) -> Column:
    """A vector with components, all of them finite numbers and not all zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def graph(x: np.ndarray, k: int, rows: slice = slice(None)) -> np.ndarray:
    """Numbers of the k nearest rows of each of some rows of unit vectors."""
    own = np.arange(len(x))[rows]
    out = np.empty((len(own), k), np.int64)
    for a in range(0, len(own), 512):
        s = x[own[a : a + 512]] @ x.T
        s[np.arange(len(s)), own[a : a + 512]] = -np.inf
        out[a : a + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def sample_graph(spark: SparkSession, x: np.ndarray, k: int, block: int = 1024) -> np.ndarray:
    """graph() of all rows, a block of them a task; the sample is broadcast (bounded, as it is)."""
    if len(x) <= 4 * block:
        return graph(x, k)
    shared = spark.sparkContext.broadcast(x)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first in b.column("id").to_pylist():
                found = graph(shared.value, k, slice(first, first + block))
                yield pa.record_batch([pa.array(np.arange(first, first + len(found))), pa.array(list(found), pa.list_(pa.int64()))], ["row", "near"])

    starts = spark.range(0, len(x), block, numPartitions=-(-len(x) // block))
    got = starts.mapInArrow(near, "row long, near array<long>").toArrow()
    out = np.empty((len(x), k), np.int64)
    out[got.column("row").to_numpy()] = np.array(got.column("near").to_pylist(), np.int64)
    shared.destroy()
    return out


def default_parts(rows: int) -> int:
    """A power of two near the square root of the rows over 16, from 16 to 1024."""
    return 1 << int(np.clip(np.rint(np.log2(max(rows, 1)) / 2 - 4), 4, 10))


def partition(near: np.ndarray, parts: int, rounds: int = 30) -> np.ndarray:
    """Split the graph into parts (a power of two) of sizes that differ by one at most, halving again and again.

    A half is first cut at the median of a smooth vector over the graph (power iteration of its averaging,
    without the constant), then pairs of vertices are swapped across while fewer edges are cut by it."""
    n = len(near)
    label = np.zeros(n, np.int64)
    a, b = np.repeat(np.arange(n), near.shape[1]), near.reshape(-1)
    heads, tails = np.concatenate([a, b]), np.concatenate([b, a])
    step = 1
    while step < parts:
        inner = label[heads] == label[tails]
        u, v = heads[inner], tails[inner]
        degree = np.maximum(np.bincount(u, minlength=n), 1)
        f = np.random.default_rng(step).standard_normal(n)
        sizes = np.bincount(label, minlength=step)
        for _ in range(200):
            f -= (np.bincount(label, f, step) / sizes)[label]
            f = 0.5 * f + 0.5 * np.bincount(u, f[v], n) / degree
            f /= np.sqrt(np.bincount(label, f * f, step))[label] + 1e-300
        order = np.lexsort((f, label))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        side = (place >= (sizes[label] + 1) // 2).astype(np.int64)
        for _ in range(rounds):
            other = np.bincount(u, side[u] != side[v], n) - np.bincount(u, side[u] == side[v], n)
            moved = 0
            for k in range(step):
                here = np.flatnonzero(label == k)
                left, right = here[side[here] == 0], here[side[here] == 1]
                left, right = left[np.argsort(-other[left], kind="stable")], right[np.argsort(-other[right], kind="stable")]
                m = min(len(left), len(right))
                # a swapped pair may share an edge, so only clear gains count, and half of them at a time
                gain = int(np.sum(other[left[:m]] + other[right[:m]] > 2))
                take = (gain + 1) // 2
                side[left[:take]], side[right[:take]] = 1, 0
                moved += take
            if not moved:
                break
        label = 2 * label + side
        step *= 2
    return label


@dataclass
class Router:
    """A network of one hidden layer from a unit vector to shares of partitions, and how many of them a query needs."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1

    @property
    def dim(self) -> int:
        return len(self.w1)

    def order(self, x: np.ndarray) -> np.ndarray:
        """Partitions by falling share, for each row of unit vectors."""
        h = np.maximum(x.astype(np.float64) @ self.w1 + self.b1, 0)
        return np.argsort(-(h @ self.w2 + self.b2), axis=1, kind="stable")


def train(x: np.ndarray, share: np.ndarray, hidden: int = 128, epochs: int = 40, batch: int = 256, rate: float = 3e-3) -> Router:
    """Fit the shares by cross entropy with Adam, in a fixed order of batches."""
    rng = np.random.default_rng(7)
    p = [rng.standard_normal((x.shape[1], hidden)) * np.sqrt(2 / x.shape[1]), np.zeros(hidden), rng.standard_normal((hidden, share.shape[1])) * np.sqrt(1 / hidden), np.zeros(share.shape[1])]
    m, v, t = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), batch):
            i = order[a : a + batch]
            h = np.maximum(x[i] @ p[0] + p[1], 0)
            z = h @ p[2] + p[3]
            e = np.exp(z - z.max(1, keepdims=True))
            d = (e / e.sum(1, keepdims=True) - share[i]) / len(i)
            back = (d @ p[2].T) * (h > 0)
            t += 1
            for k, g in enumerate((x[i].T @ back, back.sum(0), h.T @ d, d.sum(0))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return Router(*p)


def fit(spark: SparkSession, x: np.ndarray, parts: int = 16, k: int = 10, wanted: float = 0.95, top: int = 5) -> Router:
    """Learn a router from sampled vectors; probes reach the wanted recall on a fifth (4,096 at most) that is kept back from the fit.

    A sample too small for parts of 64 vectors gets fewer parts, one in the end."""
    x = even(np.unique(x, axis=0).astype(np.float64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = x[np.random.default_rng(5).permutation(len(x))]
    while parts > 1 and len(x) < parts * 64:
        parts //= 2
    if parts <= 1:
        return Router(np.zeros((x.shape[1] if x.ndim == 2 else 0, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    kept = min(len(x) // 5, 4096)
    own = x[kept:]
    near = sample_graph(spark, own, min(k, len(own) - 1))
    label = partition(near, parts)
    share = np.eye(parts)[label]
    for column in near.T:
        share[np.arange(len(own)), label[column]] += 1 / near.shape[1]
    router = train(own, share / 2)
    ranks = router.order(x)
    home = ranks[:, 0]
    truth = graph(x, top, slice(0, kept))
    place = np.argsort(ranks[:kept], axis=1)  # at which probe each partition comes
    needed = place[np.arange(kept)[:, None], home[truth]]
    for probes in range(1, parts + 1):
        if (needed < probes).mean() >= wanted:
            break
    router.probes = probes
    return router


def even(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that the largest component is from 1/2 to 1: same cosines, and no square overflows or vanishes."""
    _, power = np.frexp(np.abs(x).max(1, initial=0, keepdims=True))
    return np.ldexp(x, -power)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return even(np.array(column.to_pylist(), np.float64).reshape(-1, dim))


def best(ids: np.ndarray, x: np.ndarray, asked: np.ndarray, q: np.ndarray, top: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: its number, and ids and scores of the top ids by cosine, ties to the smaller id; without its own id.

    An id with several rows has the best of their scores."""
    nx, nq = np.sqrt((x * x).sum(1)), np.sqrt((q * q).sum(1))
    unit = x / nx[:, None]
    repeats = len(ids) - len(np.unique(ids))
    for a in range(0, len(q), 64):
        rough = (q[a : a + 64] / nq[a : a + 64, None]) @ unit.T
        for i, s in enumerate(rough, a):
            s[ids == asked[i]] = -np.inf
            m = min(top, len(s))
            while True:  # rows of one id may take several of the m best places
                bar = np.partition(s, len(s) - m)[len(s) - m] - SLACK
                at = np.flatnonzero((s >= bar) & (s > -np.inf))
                if not repeats or m == len(s) or len(np.unique(ids[at])) >= top:
                    break
                m = min(4 * m, len(s))
            exact = (x[at] * q[i]).sum(1) / (nx[at] * nq[i])
            order = np.lexsort((ids[at], -exact))
            if repeats:
                _, first = np.unique(ids[at][order], return_index=True)
                order = order[np.sort(first)]
            yield int(asked[i]), ids[at][order[:top]], exact[order[:top]]


def search(vectors: DataFrame, is_query: Column, top: int = 5, parts: int | None = None, sample: int | None = None, wanted: float = 0.95, rows_a_block: int = 16_384, queries_a_block: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest rows of each query by cosine, nearest first, ties to the smaller vec_id.

    vectors has vec_id and embedding; other columns are ignored. Queries are the rows where is_query holds. Rows
    without an id, or whose vector is not usable() or has another length than most sampled ones, take no part.
    Rows repeated exactly count once; of other rows with one id the best score counts, whichever of them asks or is found.
    A query never finds its own id; with fewer than top candidates it gets them all. parts: partitions, default_parts() of
    the rows if not given. sample bounds the rows that the router is learned from (those with the smallest hash of their
    id); 256 a partition if not given, 4,096 to 65,536. Every row is indexed."""
    spark = vectors.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("ask"))
    parts = default_parts(vectors.count()) if parts is None else parts
    sample = min(max(256 * parts, 4096), 65_536) if sample is None else sample
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample).select("v").toArrow().column("v")
    if not len(some):
        return spark.createDataFrame([], out)
    dims = pc.list_value_length(some).to_numpy()
    sizes, counts = np.unique(dims, return_counts=True)
    dim = int(sizes[np.lexsort((sizes, counts))[-1]])
    router = fit(spark, np.array([v for v in some.to_pylist() if len(v) == dim]), parts, wanted=wanted, top=top)
    parts = router.w2.shape[1]

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("v"), dim)
            order = router.order(x / np.sqrt((x * x).sum(1, keepdims=True)))[:, : router.probes].astype(np.int32)
            yield pa.record_batch([b.column("vec_id"), b.column("v"), b.column("ask"), pa.array(list(order), pa.list_(pa.int32()))], ["vec_id", "v", "ask", "p"])

    placed = rows.where(F.size("v") == dim).mapInArrow(routed, "vec_id long, v array<double>, ask boolean, p array<int>")
    placed = cut(placed, "routed")
    index = placed.select("vec_id", "v", F.element_at("p", 1).alias("p"))
    queries = placed.where("ask").select(F.col("vec_id").alias("q"), F.col("v").alias("w"), "p")
    held = {r["p"]: r["n"] for r in index.groupBy("p").agg(F.count("*").alias("n")).collect()}  # at most `parts` rows

    def scored(here: pa.Table, asked: pa.Table) -> pa.Table:
        found = []
        if here.num_rows and asked.num_rows:
            found = list(best(here.column("vec_id").to_numpy(), _matrix(here.column("v"), dim), asked.column("q").to_numpy(), _matrix(asked.column("w"), dim), top))
        return pa.table({
            "query_id": pa.array([q for q, i, _ in found for _ in i], pa.int64()),
            "vec_id": pa.array(np.concatenate([i for _, i, _ in found]) if found else [], pa.int64()),
            "score": pa.array(np.concatenate([s for _, _, s in found]) if found else [], pa.float64()),
        })

    def met(asks: DataFrame) -> DataFrame:
        """Best candidates of each (query, partition) in asks, from each block of the partition."""
        wants = {r["r"]: r["m"] for r in asks.groupBy("r").agg(F.count("*").alias("m")).collect()}  # at most `parts` rows
        blocks = [(p, -(-n // rows_a_block), -(-wants[p] // queries_a_block)) for p, n in held.items() if p in wants]
        sizes = F.broadcast(spark.createDataFrame(blocks, "p int, vs int, qs int"))
        left = index.join(sizes, "p").select("p", F.pmod(F.xxhash64("vec_id", "v"), "vs").cast("int").alias("vb"), F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("qb"), "vec_id", "v")
        right = asks.join(sizes, F.col("r") == F.col("p")).select("r", F.explode(F.sequence(F.lit(0), F.col("vs") - 1)).alias("rv"), F.pmod(F.xxhash64("q", "w"), "qs").cast("int").alias("rq"), "q", "w")
        near = left.groupBy("p", "vb", "qb").cogroup(right.groupBy("r", "rv", "rq")).applyInArrow(scored, "query_id long, vec_id long, score double")
        return near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))

    def ranked(near: DataFrame) -> DataFrame:
        order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return near.withColumn("rank", order).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")

    found = cut(ranked(met(queries.select("q", "w", F.explode("p").alias("r")))), "found")
    full = found.where(F.col("rank") == top).select(F.col("query_id").alias("q"))
    short = cut(queries.select("q", "w").join(full, "q", "left_anti"), "short") if router.probes < parts else None
    if short is None or short.isEmpty():
        return found
    # too few candidates in the partitions of these: all partitions
    every = short.select("q", "w", F.explode(F.array(*[F.lit(p).cast("int") for p in held])).alias("r"))
    return found.join(full, F.col("query_id") == F.col("q"), "left_semi").unionByName(ranked(met(every)))
