"""Labels, folds, board and overfit statistics against hand values and plain Python."""

import math
import random
import statistics
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from pitlake.operators import evaluate as ev
from pitlake.operators import ledger as lg
from pitlake.operators import probes as pr
from pitlake.operators.asof import asof_join
from pitlake.operators.numbering import number, running_max, running_sum


def test_numbering_equals_one_window(spark):
    rows = [(i * 37 % 101, i, float(i % 7)) for i in range(300)]
    df = spark.createDataFrame(rows, "t long, id long, v double").repartition(7)
    order = [F.col("t"), F.col("id")]
    got = running_max(running_sum(number(df, order, F.floor(F.col("t") / 10)), F.col("v"), order, F.floor(F.col("t") / 10)), F.col("v"), order, F.floor(F.col("t") / 10))
    total, peak = 0.0, 0.0
    for pos, (r, want) in enumerate(zip(sorted(got.collect(), key=lambda r: (r.t, r.id)), sorted(rows))):
        total, peak = total + want[2], max(peak, want[2])
        assert (r.pos, r.total, r.peak) == (pos, total, peak)


@pytest.mark.parametrize("width", [None, 3, 100])
@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("strict", [False, True])
def test_asof(spark, width, forward, strict):
    left = [(k, t) for k in "ab" for t in [*range(0, 30, 4), None]]
    right = [(k, t * 3 % 31, i, t) for i, (k, t) in enumerate((k, t) for k in "abc" for t in range(10))] + [("a", 12, 99, 50), ("a", None, 100, 1)]
    got = asof_join(spark.createDataFrame(left, "k string, t long"), spark.createDataFrame(right, "k string, t long, i long, v long"), ["k"], "t", "t", ["i", "v"], forward=forward, strict=strict, ties=["i"], width=width, prefix="r_").collect()
    assert len(got) == len(left)
    for r in got:
        fit = [x for x in right if r.t is not None and x[1] is not None and x[0] == r.k and ((x[1] > r.t if strict else x[1] >= r.t) if forward else (x[1] < r.t if strict else x[1] <= r.t))]
        want = (min if forward else max)(fit, key=lambda x: (x[1], x[2]), default=None)
        assert (r.r_i, r.r_v) == ((want[2], want[3]) if want else (None, None))


def test_walk_forward_of_varied_intervals(spark):
    rows = [(i, 10 * i, 10 * i + (35 if i % 4 == 0 else 5)) for i in range(60)]
    spans = number(spark.createDataFrame(rows, "id long, start long, end long"), [F.col("start"), F.col("end"), F.col("id")], F.floor(F.col("start") / 100))
    got = ev.walk_forward(spans, 3, 20, 10, 12, 12).collect()
    for k in range(3):
        test = [r for r in rows if 20 + 10 * k <= r[0] < 30 + 10 * k]
        first, last = test[0][1], max(r[2] for r in test)
        train = [r[0] for r in rows[: 20 + 10 * k] if r[2] < first - 12 or r[1] > last + 12][-20:]
        assert sorted(r.id for r in got if r.fold == k and r.role == "test") == [r[0] for r in test]
        assert sorted(r.id for r in got if r.fold == k and r.role == "train") == train
    assert [r.fold for r in ev.fold_errors(ev.walk_forward(spans, 1, 1, 10, 1000, 0)).collect()] == [0]


BOARD = {"a": [0.51, 0.13, 0.47, 0.22, 0.66, 0.35], "b": [0.11, 0.93, -0.29, 0.87, 0.05, 0.41], "c": [0.3, 0.3, 0.3, 0.3, 0.3, 0.3], "quote_all": [0.0] * 6}


def board(spark):
    return spark.createDataFrame([(p, k, v) for p, s in BOARD.items() for k, v in enumerate(s)], "policy string, fold int, lift double")


def test_overfit_probability(spark):
    over = n = 0
    for inside in combinations(range(6), 3):
        mean = {p: sum(s[i] for i in inside) / 3 for p, s in BOARD.items()}
        out = {p: sum(s[i] for i in range(6) if i not in inside) / 3 for p, s in BOARD.items()}
        best = min(BOARD, key=lambda p: (-round(mean[p], 12), p))
        over += (1 + sum(v < out[best] - 1e-12 for v in out.values())) / 5 < 0.5
        n += 1
    r = ev.overfit_probability(board(spark)).first()
    assert (r.splits, r.overfit, r.pbo) == (n, over, over / n)
    assert ev.overfit_probability(board(spark).where("fold < 5")).count() == 0


def test_deflated_sharpe(spark):
    got = {r.policy: r for r in ev.with_probability(ev.deflated_sharpe_z(board(spark))).collect()}
    for p, s in BOARD.items():
        n, mu = len(s), sum(s) / len(s)
        var = sum((x - mu) ** 2 for x in s)
        if var < 1e-20:
            assert got[p].z is None and got[p].dsr is None
            continue
        sr, m2 = mu / math.sqrt(var / (n - 1)), var / n
        skew, kurt = (sum((x - mu) ** k for x in s) / n / m2 ** (k / 2) for k in (3, 4))
        z = (sr - math.sqrt(2 * math.log(4) / n)) * math.sqrt((n - 1) / (1 - skew * sr + (kurt - 1) / 4 * sr**2))
        assert abs(got[p].z - z) < 1e-9 and abs(got[p].dsr - 0.5 * math.erfc(-z / math.sqrt(2))) < 1e-9


def test_horizons_and_labels(spark):
    df = spark.createDataFrame([("10s",), ("250ms",), ("2m",), ("1h",), ("1d",), ("x",), (None,)], "h string")
    assert [r[0] for r in df.select(ev.horizon_seconds(F.col("h"))).collect()] == [10, 0.25, 120, 3600, 86400, None, None]
    m = spark.createDataFrame([(1, 101.0, 100.0), (-1, 101.0, 100.0), (0, 1.0, 1.0), (1, 1.0, 0.0)], "s int, m double, p double")
    assert [r[0] and round(r[0], 6) for r in m.select(ev.markout_bps(F.col("s"), F.col("m"), F.col("p"))).collect()] == [100.0, -100.0, None, None]


def test_rank_shift_blocks_the_leaky_policy(spark):
    a = spark.createDataFrame([("leak", 1), ("x", 2)], "policy string, rank int")
    b = spark.createDataFrame([("x", 1)], "policy string, rank int")
    assert {r.policy: (r.delta, r.status) for r in ev.rank_shift(a, b).collect()} == {"leak": (None, "blocked"), "x": (1, "ranked")}


def test_unpurged_rows_are_all_that_reach_the_test_block(spark):
    rows = [(i, 25 * i, 25 * i + 3600 + (i % 5) * 100) for i in range(600)]  # some 150 rows an hour
    spans = spark.createDataFrame(rows, "pos long, start long, end long")
    tests = spans.where("pos >= 300").withColumn("fold", F.floor((F.col("pos") - 300) / 100).cast("int")).select("fold", F.lit("test").alias("role"), "pos", "start", "end")
    got = {r.item for r in pr.overlap_leak(tests.unionByName(pr.unpurged(spans, tests)), "pos", 3600).collect()}
    want = set()
    for k in range(3):
        block = [r for r in rows if 300 + 100 * k <= r[0] < 400 + 100 * k]
        want |= {f"{k}:{p}" for p, s, e in rows[: 300 + 100 * k] if any(s <= z and a <= e for _, a, z in block)}
    assert got == want and len(want) > 3 * 140


def test_exact_medians(spark):
    rng = random.Random(2)
    for values in ([3.0], [1.0, 2.0], [5.0] * 7 + [None], [rng.choice([rng.random(), -1e300, 1e300, 0.0, 1e-300]) for _ in range(101)], [float(rng.randrange(5)) for _ in range(60)]):
        df = spark.createDataFrame([(v, float("nan")) for v in values] + [(None, float("inf"))], "a double, b double").repartition(3)
        some = [v for v in values if v is not None]
        assert ev.exact_medians(df, ["a", "b"], bins=5) == {"a": statistics.median(some), "b": None}


def test_slippage_grows_with_the_quantity_and_bars_stand_in(spark):
    orders = spark.createDataFrame([(1, "a", 1, 0, 10.0), (2, "a", -1, 0, 1.0), (3, "a", 1, 50, 2.0), (4, "a", 1, 500, 2.0)], "id long, symbol string, side int, t long, qty double")
    quotes = spark.createDataFrame([(9, "a", 5, 99.0, 101.0)], "seq long, symbol string, t long, bid double, ask double")
    bars = spark.createDataFrame([("a", 60, 80.0), ("a", 120, 90.0)], "symbol string, end long, close double")
    got = {r.id: (r.fill_px and round(r.fill_px, 6), r.fill_flag) for r in lg.market_fills(orders, quotes, 5, 10.0, 5.0, None, bars).collect()}
    assert got == {1: (101 * 1.01, None), 2: (99 * 0.999, None), 3: (80 * 1.002, "top_of_book_missing"), 4: (None, None)}


def test_breakout_from_a_price_of_zero(spark, tmp_path):
    from pitlake.plans.leaderboard import breakout_signal

    rows = [(k, f"2024-01-01 00:00:0{k}", 10, "view", v, '{"k": 1}') for k, v in enumerate((0.0, 0.0, 4.0, 2.0, 2.0, 3.0, 0.0, 5.0, 1.0))]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    events.selectExpr("event_id", "cast(ts as timestamp_ntz) as ts", "user_id", "event_type", "value", "props").write.parquet(f"{tmp_path}/events.parquet")
    got = breakout_signal(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(str(r.momentum), r.signal) for r in got] == [("None", "none")] * 5 + [("inf", "buy"), ("nan", "buy"), ("2500.0", "buy"), ("-5000.0", "sell")]


def test_breakout_agrees_with_its_sql_next_to_halves(spark, tmp_path):
    import duckdb

    from pitlake.plans import leaderboard, registry

    rng = random.Random(3)
    rows = [(k, k, 10, "view", rng.choice([rng.uniform(0.001, 0.02), rng.randrange(1, 60_000) / 100 * (1 + rng.randrange(60) / 1000), 0.0]), '{"k": 1}') for k in range(40_000)]
    events = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string, value double, props string")
    events.selectExpr("event_id", "cast(timestamp_seconds(1704067200 + s) as timestamp_ntz) as ts", "user_id", "event_type", "value", "props").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted((r.seq, r.symbol, repr(r.momentum), r.signal) for r in leaderboard.breakout_signal(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = sorted((s, y, repr(m), g) for s, y, m, g in con.execute(registry.ORACLE_SQL["breakout_signal"]).fetchall())
    assert len(want) == 40_000 and got == want


def test_markout_ladder_agrees_with_its_sql_at_a_price_of_zero_and_tied_quotes(spark, tmp_path):
    import duckdb

    from pitlake.plans import leaderboard, registry

    rows = [(k, f"2024-01-0{1 + k // 12} 0{k % 12 // 2}:00:00", 10 * (k % 3), "view" if k % 2 else "purchase", float(k * 7 % 5), '{"k": %d}' % (k % 4)) for k in range(48)]
    events = spark.createDataFrame(rows + [(100 + r[0], *r[1:4], r[4] + 2, r[5]) for r in rows], "event_id long, ts string, user_id long, event_type string, value double, props string")
    events.selectExpr("event_id", "cast(ts as timestamp_ntz) as ts", "user_id", "event_type", "value", "props").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(tuple(r) for r in leaderboard.markout_ladder(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(con.execute(registry.ORACLE_SQL["markout_ladder"]).fetchall())
    assert len(want) == 24 and got == want
