import numpy as np
from pyspark.sql import functions as F

from pitlake.llm import ann
from pitlake.llm.queries import op9_nearest


def truth(ids, x, q, top=5):
    """Ids and scores of each query's nearest rows, by comparing all."""
    out = {}
    for i in np.flatnonzero(q):
        s = (x * x[i]).sum(1) / np.sqrt((x * x).sum(1)) / np.sqrt((x[i] * x[i]).sum())
        at = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:top]
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in at]
    return out


def test_partition_is_balanced_and_cuts_few_edges():
    rng = np.random.default_rng(2)
    x = np.repeat(np.eye(8), 50, axis=0) + 0.1 * rng.standard_normal((400, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = ann.graph(x, 6)
    label = ann.partition(near, 8)
    assert np.bincount(label).tolist() == [50] * 8
    assert (label[near] == label[:, None]).mean() > 0.9


def test_recall_and_scores(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    local = rows.toPandas()
    ids, x = local.vec_id.to_numpy(), np.array(local.embedding.tolist(), float)
    want = truth(ids, x, ids % 50 == 0)
    got = {}
    for r in op9_nearest(spark, "/root/testdata/sf0.1").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    assert np.mean([len({i for i, _ in got[k]} & {i for i, _ in want[k]}) / 5 for k in want]) >= 0.9
    place = {i: k for k, i in enumerate(ids)}
    for k, found in got.items():
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
        for i, s in found:
            a, b = x[place[k]], x[place[i]]
            assert abs(s - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12


def test_odd_vectors_ties_and_blocks(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0] if i < 40 else [0.5, float(i)]) for i in range(60)]
    rows += [(60, None), (61, []), (62, [0.0, 0.0]), (63, [1.0, None]), (64, [nan, 1.0]), (65, [inf, 1.0]), (66, [1.0]), (None, [1.0, 1.0]), (3, [1.0, 0.0]), (100, [2.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.search(v.withColumn("score", F.lit(1)), F.col("vec_id") % 50 == 0, rows_a_block=7, queries_a_block=1).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in got if r.query_id in (0, 100)] == [(0, i) for i in (1, 2, 3, 4, 5)] + [(100, i) for i in (0, 1, 2, 3, 4)]
    assert [r["rank"] for r in got if r.query_id == 50] == [1, 2, 3, 4, 5]
    few = ann.search(v.where("vec_id in (50, 51, 1)"), F.col("vec_id") % 50 == 0).collect()
    assert [(r["rank"], r.vec_id) for r in sorted(few, key=lambda r: r["rank"])] == [(1, 51), (2, 1)]
    assert ann.search(v.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert ann.search(v, F.lit(False)).count() == 0


def test_very_large_and_very_small_components(spark):
    rows = [(50, [1e200, 0.0]), (1, [1e-200, 1e-200]), (2, [-1e300, 1e300]), (3, [5e-324, 0.0]), (4, [3.0, 4.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 50).orderBy("rank").collect()
    assert [(r.vec_id, round(r.score, 9)) for r in got] == [(3, 1.0), (1, round(0.5**0.5, 9)), (4, 0.6), (2, round(-(0.5**0.5), 9))]


def test_best_row_of_an_id_counts(spark):
    rows = [(7, [0.0, 1.0]), (7, [1.0, 0.01]), (8, [1.0, 0.2]), (9, [1.0, 0.5]), (50, [1.0, 0.0]), (50, [0.0, 1.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 50, top=3).orderBy("rank").collect()
    assert [(r.vec_id, round(r.score, 5)) for r in got] == [(7, 1.0), (8, 0.98058), (9, 0.89443)]
    ids, x = np.array([1] * 50 + [2, 3]), np.array([[1.0, k / 1e6] for k in range(50)] + [[1.0, 1.0], [1.0, 2.0]])
    (_, found, _), = ann.best(ids, x, np.array([9]), np.array([[1.0, 0.0]]), 3)
    assert found.tolist() == [1, 2, 3]


def test_queries_with_too_few_candidates_ask_all_partitions(spark):
    rng = np.random.default_rng(6)
    x = np.repeat(np.eye(8), 60, axis=0) + 0.05 * rng.standard_normal((480, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, [-1.0] * 8), (1001, [-1.0, -1.1] * 4)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id").isin(1000, 3), top=100, parts=4, wanted=0.01).collect()
    assert sorted(r["rank"] for r in got if r.query_id == 1000) == list(range(1, 101))


def test_parts_grow_and_the_graph_is_the_same_in_tasks(spark):
    assert [ann.default_parts(n) for n in (0, 10_000, 1_000_000, 10**9, 10**13)] == [16, 16, 64, 1024, 1024]
    x = np.random.default_rng(1).standard_normal((300, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert (ann.sample_graph(spark, x, 5, block=50) == ann.graph(x, 5)).all()
