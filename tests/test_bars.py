"""Bars, labels, dispatch and replay on hand rows."""

import random
import time

from pyspark.sql import functions as F

from pitlake.operators import bars as br
from pitlake.operators import models as md
from pitlake.operators.asof import asof_join
from pitlake.streaming import ingest


def test_momentum_is_withheld_for_gaps_and_splits(spark):
    rows = [("s", t, t + 10, float(c)) for t, c in ((0, 100), (10, 110), (20, 121), (30, 60), (90, 66))]
    bars = spark.createDataFrame(rows, "symbol string, start long, end long, close double")
    splits = spark.createDataFrame([("s", 25)], "symbol string, effective long")
    got = [(r.momentum and round(r.momentum, 6), r.volatility is not None) for r in br.momentum(bars, 2, 40, splits).orderBy("start").collect()]
    # the split at 25 lies in the windows of the third and fourth bar
    assert got == [(None, False), (0.1, True), (None, False), (None, False), (None, False)]
    plain = br.momentum(bars, 3).orderBy("start").collect()
    assert abs(plain[2].momentum - 0.21) < 1e-12 and abs(plain[2].volatility) < 1e-12 and plain[1].momentum is None


def test_visibility_waits_for_end_and_delay(spark):
    bars = spark.createDataFrame([("s", 0, 10, 12, 1.0), ("s", 10, 20, 20, 2.0)], "symbol string, start long, end long, available long, close double")
    d = spark.createDataFrame([("s", t) for t in (11, 14, 15, 22, 23)], "symbol string, t long")
    assert [r.bar_close for r in br.last_visible(d, bars, 3).orderBy("t").collect()] == [None, None, 1.0, 1.0, 2.0]


def test_a_missing_bar_gives_no_label(spark):
    d = spark.createDataFrame([("a", 5), ("a", 15), ("a", 25)], "symbol string, decision long")
    bar = lambda s, t, p: (s, t, p, t + 10)
    rows = [bar("a", 10, 100.0), bar("a", 20, 110.0), bar("b", 10, 50.0), bar("b", 20, 50.0), bar("a", 40, 1.0)]
    bars = spark.createDataFrame(rows, "symbol string, start long, open double, available long")
    acts = spark.createDataFrame([(1, "a", 10, 3, 1, 0.0), (2, "a", 12, 2, 1, 5.0), (3, "b", 20, 1, 1, 1.0), (4, "b", 21, 5, 1, 1.0)], "id int, symbol string, effective long, split_num int, split_den int, dividend double")
    for given, label in ((acts.where("false"), 0.1), (acts, (2 * 110 + 5) / 100 - 1 - 1 / 50)):
        got = br.relative_labels(d, bars, "b", 0, 1, 10, 7, given, 4).collect()
        assert [(r.decision, r.entry, r.exit, round(r.label, 9), r.label_ready) for r in got] == [(5, 10, 20, round(label, 9), 37)]


def test_dispatch(spark):
    e = spark.createDataFrame([(1, "trade", '{"px": 2.5}'), (2, "quote", '{"bid": 1}'), (3, "other", "{}"), (4, "trade", None)], "event_id int, event_type string, payload string")
    good, bad = br.dispatch(e, {"trade": "px double", "quote": "bid double"})
    assert {r.event_id: (r.as_trade and r.as_trade.px, r.as_quote and r.as_quote.bid) for r in good.collect()} == {1: (2.5, None), 2: (None, 1.0)}
    assert sorted(r.event_id for r in bad.collect()) == [3, 4]


def test_vintages_use_what_was_ready(spark):
    schema = "key int, period int, value double, ready int"
    y = spark.createDataFrame([(1, 1, 10.0, 11), (1, 2, 20.0, 21), (1, 1, 15.0, 25), (1, 3, 30.0, 31)], schema)
    x = spark.createDataFrame([(1, 1, 1.0, 9), (1, 2, 2.0, 22), (1, 2, 3.0, 30)], schema)
    got = {r.decision: (r.x, r.y, r.target, r.target_ready) for r in md.vintage_pairs(x, y).collect()}
    # the first period's value was revised after the second's release, so its last vintage decides at 25
    assert got == {21: (1.0, 20.0, 10.0, 31)}


def replayed(spark, tmp_path, events, quotes, keep):
    """Runs the stream with one file of events and quotes a batch, in order of the batches."""
    spark.conf.set(*ingest.STATE_STORE)
    sides = {"e": ("symbol string, seq long, t long, asked long", events), "q": ("symbol string, seq long, t long, mid double", quotes)}
    for batch in range(len(events)):
        for name, (schema, rows) in sides.items():
            spark.createDataFrame(rows[batch], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        time.sleep(0.05)  # files are taken in order of their time of change
    read = lambda n: spark.readStream.schema(sides[n][0]).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{n}")
    query = ingest.replay(read("e"), read("q"), keep).writeStream.foreachBatch(lambda df, n: df.write.mode("append").parquet(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    return {(r.symbol, r.seq): (r.quote_seq, r.mid, r.status) for r in spark.read.parquet(f"{tmp_path}/out").collect()}


def test_replay_refuses_the_future_and_the_past(spark, tmp_path):
    events = [[("s", 1, 100, 100), ("s", 2, 100, 101), ("s", 3, 80, 80)], [("s", 4, 200, 200), ("s", 5, 200, 95), ("s", 6, 90, 90), ("s", 7, 201, 150), ("x", 8, 5, 5)]]
    quotes = [[("s", 11, 90, 1.0), ("s", 12, 100, 2.0)], [("s", 13, 150, 3.0), ("s", 14, 99, 4.0), ("s", 15, 202, 5.0)]]
    assert replayed(spark, tmp_path, events, quotes, 60) == {
        ("s", 1): (12, 2.0, "quote"), ("s", 2): (None, None, "future"), ("s", 3): (None, None, "no_quote"), ("s", 4): (13, 3.0, "quote"),
        ("s", 5): (11, 1.0, "quote"), ("s", 6): (None, None, "behind_clock"), ("s", 7): (13, 3.0, "quote"), ("x", 8): (None, None, "no_quote"),
    }


def test_replay_is_the_as_of_join(spark, tmp_path):
    rng = random.Random(1)
    times = [sorted(rng.sample(range(k * 100, k * 100 + 100), 24)) for k in range(3)]
    rows = [[(rng.choice("ab"), k * 100 + i, t) for i, t in enumerate(x)] for k, x in enumerate(times)]
    events = [[(*r, r[2]) for r in x[::2]] for x in rows]
    quotes = [[(*r, float(r[1])) for r in x[1::2]] for x in rows]
    got = replayed(spark, tmp_path, events, quotes, 10)
    e = spark.createDataFrame([r for x in events for r in x], "symbol string, seq long, t long, asked long")
    q = spark.createDataFrame([r for x in quotes for r in x], "symbol string, seq long, t long, mid double")
    want = {(r.symbol, r.seq): (r.q_seq, r.q_mid) for r in asof_join(e, q, ["symbol"], "t", "t", ["seq", "mid"], ties=["seq"], prefix="q_").collect()}
    assert {k: v[:2] for k, v in got.items()} == want and len(want) == 36


def test_momentum_over_a_close_of_zero(spark):
    bars = spark.createDataFrame([("s", t, t + 10, float(c)) for t, c in ((0, 0), (10, 5), (20, 10), (30, 20), (40, 0), (50, 0))], "symbol string, start long, end long, close double")
    got = [(r.momentum, r.volatility) for r in br.momentum(bars, 2).orderBy("start").collect()]
    assert [str(m) for m, _ in got] == ["None", "inf", "1.0", "1.0", "-1.0", "nan"]
    assert [str(v) for _, v in got] == ["None", "nan", "0.0", "0.0", "0.0", "nan"]
