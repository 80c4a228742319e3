"""Dependence statistics, fits and filters against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitlake.operators import ledger as lg
from pitlake.operators import models as md
from pitlake.operators import stats as st
from pitlake.plans.statistics import partial_correlations

RNG = np.random.default_rng(8)


@pytest.fixture(scope="module")
def paired(spark):
    x = np.round(RNG.standard_normal(30), 1)
    y = np.round(x + RNG.standard_normal(30), 1)
    return x, y, spark.createDataFrame([(0, 1, i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "a int, b int, m int, x double, y double")


def ranks(v):
    return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])


def test_pair_statistics(paired):
    x, y, df = paired
    r = st.pair_table(df).first()
    assert abs(r.pearson - np.corrcoef(x, y)[0, 1]) < 1e-12 and abs(r.spearman - np.corrcoef(ranks(x), ranks(y))[0, 1]) < 1e-12
    a, b = (np.abs(v[:, None] - v) for v in (x, y))
    a, b = (m - m.mean(0) - m.mean(1)[:, None] + m.mean() for m in (a, b))
    assert abs(st.distance_correlation(df).first()[2] - np.sqrt((a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum()))) < 1e-12
    w = 0.8 ** np.arange(29, -1, -1)
    dx, dy = x - (w * x).sum() / w.sum(), y - (w * y).sum() / w.sum()
    assert abs(st.exponential(df, ["m"], 0.2).first()[2] - (w * dx * dy).sum() / np.sqrt((w * dx**2).sum() * (w * dy**2).sum())) < 1e-12
    turned = [abs(np.corrcoef(x, np.roll(y, -k))[0, 1]) for k in range(30)]
    s = st.shift_null(df, ["m"]).first()
    assert abs(s.statistic - turned[0]) < 1e-12 and abs(s.p_value - np.mean(np.array(turned) >= turned[0] - 1e-14)) < 1e-12


def test_constant_side_is_undefined(spark):
    df = spark.createDataFrame([(0, 1, i, 1.0, float(i)) for i in range(5)], "a int, b int, m int, x double, y double")
    r = st.pair_table(df).first()
    assert r.pearson is None and r.spearman is None and st.distance_correlation(df).first()[2] == 0.0


@pytest.mark.parametrize("method", ["BH", "BY"])
def test_adjust(spark, method):
    p = np.round(RNG.random(100) ** 2, 2)
    n, order = len(p), np.argsort(p, kind="stable")
    c = (1 / np.arange(1, n + 1)).sum() if method == "BY" else 1.0
    want = np.empty(n)
    want[order] = np.minimum(1, np.minimum.accumulate((p[order] * n * c / np.arange(1, n + 1))[::-1])[::-1])
    got = st.adjust(spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)], "id int, p double"), method, "id").orderBy("id").collect()
    assert np.allclose([r.adjusted for r in got], want)


def test_partial_correlations(spark):
    x = RNG.standard_normal((60, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.3], [0, 0, 1]])
    got = st.ledoit_wolf(spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double"), ["a", "b", "c"]).collect()
    cov = np.zeros((3, 3))
    for r in got:
        cov[r.i, r.j] = r.covariance
    s = np.cov(x.T, bias=True)
    h = got[0].shrinkage
    assert np.allclose(cov, (1 - h) * s + h * np.trace(s) / 3 * np.eye(3)) and 0 <= h <= 1
    prec = np.linalg.inv(cov)
    assert all(abs(r.partial - (1 if r.i == r.j else -prec[r.i, r.j] / np.sqrt(prec[r.i, r.i] * prec[r.j, r.j]))) < 1e-9 for r in got)


def test_distance_correlation_of_many_rows(spark):
    for n in (3, 4, 17, 300):
        for x, y in ((RNG.standard_normal(n), RNG.standard_normal(n)), (RNG.integers(0, 4, n) + 0.0, RNG.integers(0, 3, n) + 1e6), (np.arange(n) * 1e9, np.arange(n) ** 2.0)):
            a, b = np.abs(np.subtract.outer(x, x)), np.abs(np.subtract.outer(y, y))
            a, b = (m - m.mean(0) - m.mean(1)[:, None] + m.mean() for m in (a, b))
            want = np.sqrt(max(0, (a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum()))) if (a * a).sum() * (b * b).sum() > 1e-9 else 0.0
            assert abs(st._distance(x, y) - want) < 1e-7
    assert st._distance(np.ones(5), np.arange(5.0)) == 0.0 and st._distance(np.arange(2.0), np.arange(2.0)) is None
    n = 60_000
    df = spark.range(n).selectExpr("'a' as a", "'b' as b", "cast(id as double) as x", f"2.0 * id + 1 as y").unionByName(spark.createDataFrame([("c", "d", 1.0, 2.0)], "a string, b string, x double, y double"))
    got = {r.a: r.distance_correlation for r in st.distance_correlation(df).collect()}
    assert abs(got["a"] - 1) < 1e-9 and got["c"] is None
    assert {(r.a, r.state, r.shifts) for r in st.shift_null(df, ["x"]).collect()} == {("a", "too_many_rows", 0), ("c", "too_few_rows", 0)}


def test_bootstrap(spark):
    gains = RNG.standard_normal(25)
    df = spark.createDataFrame([(i, float(g)) for i, g in enumerate(gains)], "i int, gain double")
    starts = st.xorshift_starts(spark, 25, 4, 40, 11)
    means = []
    draws = {}
    for r in starts.collect():
        draws.setdefault(r.rep, {})[r.k] = r.start
    for rep in draws:
        v = np.concatenate([gains[s : s + 4] for _, s in sorted(draws[rep].items())])[:25]
        means.append(v.mean())
    means.sort()
    r = st.block_interval(df, starts, 25, 4, 40).first()
    assert np.allclose([r["mean"], r.low, r.high], [gains.mean(), means[1], means[39]])
    assert st.block_interval(df, starts, 25, 13, 40).count() == 0


def test_block_intervals_of_groups(spark):
    gains = {"a": RNG.standard_normal(25), "b": RNG.standard_normal(8), "short": RNG.standard_normal(5), "none": [None] * 9}
    df = spark.createDataFrame([(g, i, None if v is None else float(v)) for g, x in gains.items() for i, v in enumerate(x)], "g string, t int, gain double")
    got = {r.g: (r.low, r.high) for r in st.block_intervals(df, ["g"], ["t"], 3, 40).collect()}
    assert set(got) == {"a", "b"}
    for g in got:
        n = len(gains[g])
        grid = spark.range(40).selectExpr("cast(id as int) as r", f"explode(sequence(0, {-(-n // 3) - 1})) as k")
        starts = {(r.r, r.k): r.s for r in grid.selectExpr("r", "k", f"cast(conv(substr(md5(concat(r, ':', k)), 1, 15), 16, 10) as bigint) % {n - 2} as s").collect()}
        means = sorted(np.concatenate([gains[g][starts[r, k] : starts[r, k] + 3] for k in range(-(-n // 3))])[:n].mean() for r in range(40))
        assert np.allclose(got[g], (means[1], means[39]))
    assert st.block_intervals(df.where("false"), ["g"], ["t"], 3, 40).count() == 0


def direct(x, y, penalty=1.0):
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-12)
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    return mean, scale, np.linalg.solve(z.T @ z + penalty * np.diag([0, *[1] * x.shape[1]]), z.T @ y)


def test_ridge(spark):
    x = RNG.standard_normal((80, 3)) * [1, 50, 0.01] - [3, 0, 7]
    y = x @ [2, 0.1, -40] + RNG.standard_normal(80)
    df = spark.createDataFrame([(int(i % 2), *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "g int, a double, b double, c double, y double")
    for r in md.ridge_fit(df, ["g"], ["a", "b", "c"], "y").collect():
        mean, scale, w = direct(x[r.g :: 2], y[r.g :: 2])
        assert np.allclose(r.means, mean) and np.allclose(r.scales, scale) and np.allclose(r.weights, w)


def test_walk_forward_ridge_is_a_direct_fit(spark):
    n = 40
    x, y = RNG.standard_normal((n, 2)), RNG.standard_normal(n)
    df = spark.createDataFrame([(0, i, i + 3, *map(float, x[i]), float(y[i])) for i in range(n)], "s int, t int, ready int, a double, b double, y double")
    for r in md.walk_forward_ridge(df, ["s"], "t", "ready", ["a", "b"], "y", 12, 6).collect():
        train = [j for j in range(r.t) if j + 3 <= r.t][-12:]
        if len(train) < 6:
            assert r.prediction is None
            continue
        mean, scale, w = direct(x[train], y[train])
        want = w[0] + ((x[r.t] - mean) / scale) @ w[1:]
        assert abs(r.prediction - want) < 1e-9 and r.n_train == len(train) and abs(r.squared_error - (want - y[r.t]) ** 2) < 1e-9


def test_ridge_with_large_means(spark):
    """A feature like an epoch time keeps its slope."""
    x = 1e9 + RNG.standard_normal((400, 2))
    y = 2 * (x[:, 0] - 1e9) - 3 * (x[:, 1] - 1e9) + 0.1 * RNG.standard_normal(400) + 1e9
    df = spark.createDataFrame([(int(i % 3), i, i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "g int, t int, ready int, a double, b double, y double").repartition(5)
    for r in md.ridge_fit(df, ["g"], ["a", "b"], "y").collect():
        mean, scale, w = direct(x[r.g :: 3], y[r.g :: 3])
        assert np.allclose(r.weights[1:], w[1:], rtol=1e-6) and np.allclose(r.scales, scale, rtol=1e-6)
    got = {r.t: r.prediction for r in md.walk_forward_ridge(df, ["g"], "t", "ready", ["a", "b"], "y", 50, 20).collect()}
    for t in (200, 301, 399):
        train = [j for j in range(t) if j % 3 == t % 3][-50:]
        mean, scale, w = direct(x[train], y[train])
        assert abs(got[t] - (w[0] + ((x[t] - mean) / scale) @ w[1:])) < 1e-4


def test_walk_forward_windows_of_any_length(spark):
    """Windows that cross blocks, ties of readiness, labels that leave late, and labels ready at the decision."""
    n = 70
    x, y = RNG.standard_normal(n), RNG.standard_normal(n)
    ready, left = [int(t + RNG.integers(0, 9)) for t in range(n)], [int(t + RNG.integers(0, 6)) for t in range(n)]
    df = spark.createDataFrame([(k % 2, t, ready[t], left[t], float(x[t] + k), float(y[t])) for k in range(2) for t in range(n)], "s int, t int, ready int, left int, a double, y double")
    for window in (2, 7, 16, 1 << 30):
        for width in (None, 10):
            got = {(r.s, r.t): (r.n_train, r.prediction) for r in md.walk_forward_ridge(df, ["s"], "t", "ready", ["a"], "y", window, 2, left="left", width=width).collect()}
            for t in range(n):
                use = lambda j: max(ready[j], left[j] + 1, j + 1)
                train = sorted((j for j in range(n) if use(j) <= t), key=lambda j: (use(j), j))[-window:]
                if len(train) < 2:
                    assert got[0, t] == (None, None)
                    continue
                mean, scale, w = direct(x[train][:, None], y[train])
                assert got[0, t][0] == len(train) and abs(got[0, t][1] - (w[0] + (x[t] - mean[0]) / scale[0] * w[1])) < 1e-8
                assert abs(got[1, t][1] - got[0, t][1]) < 1e-8


def test_calibration_sees_no_later_value(spark):
    rng = np.random.default_rng(11)
    rows = [(p, s, t + 1 + s, t, t, float(rng.normal(5 * s, 1 + s)), "mean", 0.5) for p in (1, 2) for s in (0, 1) for t in range(40) if (p, s) != (2, 1) or t < 11]
    schema = "panel int, series int, released int, first int, last int, value double, how string, noise double"

    def run(rows):
        releases, panels = md.calibrate(spark.createDataFrame(rows, schema))
        told = {r.panel: (r.cutoff, r.state) for r in panels.collect()}
        steps = releases.groupBy("panel").agg((F.max("released") + 1).alias("steps"))
        return told, {(r.panel, r.step): (r["mean"], r.variance) for r in md.factor_filter(releases, steps, 0.8, 0.36, 1.0, 4).collect()}, releases.collect()

    told, before, releases = run(rows)
    assert told == {1: (13, "completed"), 2: (12, "insufficient_data")}
    assert {r.panel for r in releases} == {1} and min(r.released for r in releases) == 14
    head = np.array([r[5] for r in rows if r[:2] == (1, 1)][:12])
    assert all(abs(r.value - (next(x[5] for x in rows if x[:4] == (1, r.series, r.released, r["first"])) - head.mean()) / head.std()) < 1e-9 for r in releases if r.series == 1)
    changed = [r if r[2] <= 25 else (*r[:5], r[5] * -7 + 3, *r[6:]) for r in rows]
    _, after, _ = run(changed)
    assert all(before[k] == after[k] for k in before if k[1] <= 25) and any(before[k] != after[k] for k in before if k[1] > 25)


def test_filter_is_conditioning(spark):
    """The filtered state is the conditional mean of a joint normal given the releases so far."""
    phi, q, steps, noise = 0.7, 0.51, 8, 0.3
    rel = [(1, 0, 1, 0.9, "mean"), (4, 2, 4, -0.5, "sum"), (4, 3, 3, 0.2, "last"), (6, 6, 6, 1.1, "last")]
    df = spark.createDataFrame([(5, *r, noise) for r in rel], "panel int, released int, first int, last int, value double, how string, noise double")
    got = md.factor_filter(df, spark.createDataFrame([(5, steps)], "panel int, steps int"), phi, q, 1.0, 5).orderBy("step").collect()
    i = np.arange(steps)
    cov = phi ** np.abs(i[:, None] - i) * 1.0  # stationary as q = 1 - phi^2
    for r in got:
        seen = [x for x in rel if x[0] <= r.step]
        h = np.zeros((len(seen), steps))
        for k, (_, a, b, _, how) in enumerate(seen):
            h[k, b if how == "last" else slice(a, b + 1)] = 1 / (b - a + 1) if how == "mean" else 1
        v = h @ cov @ h.T + noise * np.eye(len(seen))
        gain = cov[r.step] @ h.T @ np.linalg.inv(v) if seen else np.zeros(0)
        assert abs(r["mean"] - (gain @ [x[3] for x in seen] if seen else 0)) < 1e-9
        assert abs(r.variance - (1 - (gain @ h @ cov[:, r.step] if seen else 0))) < 1e-9


def test_average_cost(spark):
    fills = [(1, 10.0, 2.0), (2, 12.0, 2.0), (3, 13.0, -1.0), (4, 9.0, -5.0), (5, 8.0, 2.0), (6, 8.5, 3.0)]
    df = spark.createDataFrame([("a", "s", t, p, q, 0.0) for t, p, q in fills], "account string, symbol string, t int, px double, qty double, fee double")
    # average 11; sell 1 at 13: +2; sell 5 at 9 closes 3: -6 and opens -2 at 9; buy 2 at 8: +2; buy 3 at 8.5
    for r in (lg.realised_pnl(df, ["t"]).first(), *(lg.average_cost(df, ["t"], width).first() for width in (1, 2, 100))):
        assert (r.fills, r.position, r.average_price, r.realised) == (6, 3.0, 8.5, -2.0)


def test_isotonic_and_batches(spark):
    df = spark.createDataFrame([(0.0,), (0.3,), (0.5,), (1.0,), (None,)], "p double")
    knots = [(0.1, 0.2), (0.5, 0.6), (0.5, 0.7), (0.9, 0.9)]
    got = [r[0] for r in df.select(st.isotonic(F.col("p"), knots)).collect()]
    assert np.allclose(got[:4], [0.2, 0.4, 0.6, 0.9]) and got[4] is None
    assert [r.probability for r in st.batch_score(df.dropna(), ["p"], lambda: lambda x: x[:, 0] / 2).collect()] == [0.0, 0.15, 0.25, 0.5]


def test_partial_correlations_take_all_components(spark, tmp_path):
    rng = np.random.default_rng(8)
    x = (rng.normal(size=(300, 64)) @ rng.normal(size=(64, 64))).astype(np.float32)
    spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.i, r.j): r.partial for r in partial_correlations(spark, str(tmp_path)).collect()}
    z = x.astype(float) - x.astype(float).mean(0)
    s, n, p = z.T @ z / len(z), len(z), 64
    mu = np.trace(s) / p
    delta = ((s - mu * np.eye(p)) ** 2).sum() / p
    beta = min(max((((z**2).sum(1) ** 2).mean() - (s**2).sum()) / (p * n), 0), delta)
    prec = np.linalg.inv((1 - beta / delta) * s + beta / delta * mu * np.eye(p))
    d = np.sqrt(np.diag(prec))
    want = -prec / np.outer(d, d) + 2 * np.eye(p)
    assert len(got) == 64 * 64 and all(abs(v - want[k]) < 2e-6 for k, v in got.items())


def test_a_variant_without_data_is_skipped(spark):
    rows = [(0, t, t + 1, float(t % 5), None, float(t)) for t in range(30)]
    df = spark.createDataFrame(rows, "s int, t int, ready int, a double, edge double, y double")
    got = {r.variant: r for r in md.nested_comparison(df, ["s"], "t", "ready", {"A": ["a"], "D": ["a", "edge"]}, "y", 10, 5).collect()}
    assert got["A"].rows > 0 and got["A"].gain == 0 and (got["D"].rows, got["D"].mse) == (0, None)


def test_releases_that_do_not_fit_are_refused(spark):
    rel = [(1, 1, 0, 0, 1.0, "mean", 0.5), (1, 0, 1, 1, 1.0, "mean", 0.5), (1, 2, 0, 2, 1.0, "median", 0.5), (1, 3, 3, 3, float("nan"), "sum", 0.5), (1, 9, 9, 9, 1.0, "sum", 0.5), (1, 3, 3, 3, 1.0, "sum", 0.0)]
    df = spark.createDataFrame(rel, "panel int, released int, first int, last int, value double, how string, noise double")
    got = md.factor_filter(df, spark.createDataFrame([(1, 4), (2, 2)], "panel int, steps int"), 0.5, 0.75, 1.0, 3).orderBy("panel", "step").collect()
    assert [(r.panel, r.step, r.used, r.refused) for r in got] == [(1, 0, 0, 5), (1, 1, 1, 5), (1, 2, 0, 5), (1, 3, 0, 5), (2, 0, 0, 0), (2, 1, 0, 0)]
    assert got[-1].mean == 0 and abs(got[-1].variance - 1) < 1e-12


def test_trailing_sums_run_over_entries_and_departures(spark):
    import random

    from pitlake.operators.asof import trailing_values

    rng = random.Random(5)
    rows = [(k, rng.choice("ab"), rng.randrange(-30, 90), rng.choice([None, 1, 2, 5])) for k in range(300)] + [(300, "a", None, 4), (301, "a", None, 5)]
    df = spark.createDataFrame(rows, "id int, symbol string, t long, qty long")
    for width, bucket in ((7, None), (7, 24), (0, 1), (40, 41)):
        found = trailing_values(df, ["symbol"], "t", width, {"n": F.lit(1), "s": F.col("qty")}, bucket)
        got = {r.id: (r.symbol, r.t, r.qty, r.n, r.s) for r in found.collect()}
        for i, symbol, t, qty in rows:
            seen = [q for _, s, u, q in rows if s == symbol and (u is None if t is None else u is not None and t - width <= u <= t)]
            given = [q for q in seen if q is not None]
            assert got[i] == (symbol, t, qty, len(seen), sum(given) if given else None)
        # a frame that slides is summed up anew for each row
        frames = found._jdf.queryExecution().optimizedPlan().toString().split("specifiedwindowframe(RangeFrame, ")[1:]
        assert frames and all(f.startswith("unboundedpreceding") for f in frames) and len(got) == len(rows)
