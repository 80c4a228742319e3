"""Two clocks, revisions, rules, probes, ledgers, on hand rows."""

import pytest
from pyspark.sql import functions as F

from pitlake.functions import scalars as fn
from pitlake.operators import bitemporal as bt
from pitlake.operators import ledger as lg
from pitlake.operators import overlap as ov
from pitlake.operators import probes as pr
from pitlake.operators import rules as ru


def one(spark, column, **values):
    """Value of a column expression over one row of the values."""
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("x")])
    return df.select(column.alias("out")).first()[0]


def test_readiness_needs_every_instant(spark):
    assert one(spark, bt.ready_observed(F.lit(3), F.lit(9), F.lit(5))) == 9
    assert one(spark, bt.ready_observed(F.lit(3), F.lit(None).cast("int"))) is None
    assert one(spark, bt.ready_reconstructed(F.lit(None).cast("int"), F.lit(4))) is None


def test_visibility_before_choice(spark):
    rows = [(1, "k", 1, 1, 10, 10, None, 0, 1.0), (2, "k", 1, 2, 20, 20, 25, 0, 2.0), (3, "k", 1, 3, 30, 30, 31, 0, 3.0), (4, "k", 1, 9, None, 15, 16, 5, 4.0)]
    v = spark.createDataFrame(rows, "id int, key string, period int, source_order int, published int, observed int, reconstructed int, generation int, value double")
    at = lambda mode, snap, t: [r.id for r in bt.points(v, mode, snap, t).collect()]
    assert at("observed", 0, 12) == [1] and at("observed", 0, 25) == [2] and at("observed", 5, 25) == [4] and at("observed", 0, 5) == []
    assert at("reconstructed", 0, 24) == [] and at("reconstructed", 0, 25) == [2] and at("reconstructed", 5, 24) == [4]
    assert "observed" not in bt.points(v, "reconstructed", 9, 99).columns
    with pytest.raises(ValueError):
        bt.visible("other", 0, 0)


def test_a_retraction_hides_the_older_row(spark):
    f = spark.createDataFrame([(1, "k", 1, "active", "s", 5), (2, "k", 2, "retracted", "s", 8), (3, "m", 1, "active", "late", 5)], "id int, key string, revision int, status string, source_id string, ready int")
    s = spark.createDataFrame([("s", 1), ("late", 100)], "source_id string, ready int")
    assert [r.id for r in bt.fact_snapshot(f, s, 6, ["key"]).collect()] == [1]
    assert bt.fact_snapshot(f, s, 9, ["key"]).count() == 0
    c = spark.createDataFrame([("k", 1, 1.0), ("k", 1, 2.0), ("m", 1, 1.0), ("m", 1, 1.0)], "key string, revision int, value double")
    assert [r.key for r in bt.revision_conflicts(c, ["key"], ["value"]).collect()] == ["k"]


def test_many_decisions_are_each_a_snapshot(spark):
    v = spark.createDataFrame([(1, "a", 3, 1.0), (2, "a", 5, 2.0), (3, "b", 9, 3.0)], "id int, key string, ready int, value double")
    d = spark.createDataFrame([(2,), (3,), (5,), (8,), (9,)], "decision int")
    got = {(r.key, r.decision): r.id for r in bt.snapshot_many(d, v, ["key"], F.col("id")).collect()}
    assert got == {("a", 3): 1, ("a", 5): 2, ("a", 8): 2, ("a", 9): 2, ("b", 9): 3}


def test_half_open_validity_and_default_deny(spark):
    e = spark.createDataFrame([("e", 1, 0, True, 10, 20), ("e", 2, 15, False, 10, 20)], "id string, revision int, known int, active boolean, since int, until int")
    assert [bt.edge_snapshot(e, t).count() for t in (9, 10, 14, 15, 20)] == [0, 1, 1, 0, 0]
    p = spark.createDataFrame([("x", True, 9, {"research": True}), ("y", False, 9, {"research": True}), ("z", True, 9, {"other": True})], "provider string, enabled boolean, review_due int, purposes map<string,boolean>")
    rows = spark.createDataFrame([(n,) for n in "wxyz"], "provider string")
    assert [r.provider for r in bt.allowed(rows, p, "research", 5).collect()] == ["x"]
    assert bt.allowed(rows, p, "research", 9).count() == 0


def test_rules_name_what_is_broken(spark):
    t = spark.createDataFrame([("BTC", 1.0, 1.0, 1, 1, 2, 5), ("btc", -1.0, None, 0, 3, 2, None)], "symbol string, price double, quantity double, maker_side int, first_id int, last_id int, timestamp int")
    good, bad = ru.split(t, ru.trade_rules())
    assert good.count() == 1 and bad.first().violations == ["symbol", "price", "quantity", "maker_side", "ids", "time"]
    s = spark.sql("select date'2026-03-09' as date, 1773063000000 as open, 1773064800000 as decision, 1773086400000 as close union all select date'2026-03-08', 1773063000000, 1773064800000, 1773086400000")
    assert [r.date.day for r in ru.split(s, ru.session_rules())[0].collect()] == [9]
    b = spark.createDataFrame([(1, "p"), (1, "p"), (2, "p"), (2, "q")], "k int, v string")
    kept, clash = ru.merged(b, ["k"])
    assert [tuple(r) for r in kept.collect()] == [(1, "p")] and clash.count() == 2
    assert [r.k for r in ru.duplicates(b, ["k"]).orderBy("k").collect()] == [1, 2]


def test_overlap_is_closed_and_exact(spark):
    left = [(0, i, 5 * i, 5 * i + 7 * (i % 3)) for i in range(20)]
    right = [(0, 40, 45), (0, 83, 83), (1, 0, 100)]
    l, r = spark.createDataFrame(left, "f int, i int, start int, end int"), spark.createDataFrame(right, "f int, start int, end int")
    want = [i for f, i, a, b in left if any(f == g and a <= d and c <= b for g, c, d in right)]
    for width in (1, 4, 1000):
        assert sorted(x.i for x in ov.overlapping(l, r, ["f"], "start", "end", width).collect()) == want
    p = spark.createDataFrame([(0, 40), (0, 41), (0, 45), (0, 46)], "f int, t int")
    assert sorted(x.t for x in ov.within(p, r, ["f"], "t", "start", "end", 10).collect()) == [41, 45]
    assert sorted(x.t for x in ov.within(p, r, ["f"], "t", "start", "end", 10, closed=False).collect()) == [40, 41]


def test_probes(spark):
    f = spark.createDataFrame([("p", "maker_side", "markout"), ("p", " Markout_10s", "markout"), ("q", "markouts", "markout")], "policy string, feature string, target string")
    found = pr.target_leak(f)
    assert [r.item for r in found.collect()] == ["p: Markout_10s"]
    with pytest.raises(ValueError):
        pr.raise_if_hard(found)
    pr.raise_if_hard(found.where("false"))
    a, b = (spark.createDataFrame(x, "i int, prediction double") for x in ([(1, 1.0), (2, None), (3, 3.0)], [(1, 1.5), (2, None), (4, 1.0)]))
    assert sorted(r.item for r in pr.perturbation_leak(a, b, "i", 0.1).collect()) == ["1", "3", "4"]
    rows = spark.createDataFrame([(i, float(i)) for i in range(50)], "i int, v double")
    h = lambda df: pr.content_hash(df, [F.col("i")], F.floor(F.col("i") / 7)).first()
    assert h(rows) == h(rows.repartition(9)) and h(rows).rows == 50 and h(rows) != h(rows.withColumn("v", F.col("v") + 1))
    assert [r["v"] for r in pr.shift_labels(rows, [F.col("i")], "v", F.floor(F.col("i") / 7)).orderBy("i").collect()] == [*map(float, range(1, 50)), 0.0]


def test_scalars(spark):
    assert [one(spark, fn.micros_of(F.lit(t))) for t in ("1.5", "-0.000001", "1e3", "1.1234567", "x")] == [1_500_000, -1, None, None, None]
    assert [str(one(spark, fn.period_end(F.lit(t)))) for t in ("2024", "2024-02", "2024-02-03", "2024Q1")] == ["2024-12-31", "2024-02-29", "2024-02-03", "None"]
    ms = lambda c: one(spark, F.unix_millis(c))
    assert ms(fn.publication_instant(F.lit("2026-03-07").cast("date"), "America/New_York")) == 1772946000000  # 05:00 UTC
    assert ms(fn.publication_instant(F.lit("2026-03-08").cast("date"), "America/New_York")) == 1773028800000  # 04:00 UTC
    assert [ms(fn.to_timestamp_any(F.lit(v))) for v in ("1700000000123", 1700000000123, "2024-01-01 00:00:00", "no")] == [1700000000123, 1700000000123, 1704067200000, None]
    assert [one(spark, fn.to_boolean(F.lit(v))) for v in ("TRUE", "0", True, "2")] == [True, False, True, None]
    assert [one(spark, fn.clean_number(F.lit(v))) for v in ("1,234.5", "(NA)", " - ", "x")] == [1234.5, None, None, None]
    assert [one(spark, fn.bad_number(F.lit(v))) for v in ("1,234.5", "(NA)", "x")] == [False, False, True]
    assert one(spark, fn.redact_url(F.lit("http://a/?x=1&API_KEY=s3&token=t#f"))) == "http://a/?x=1&API_KEY=[REDACTED]&token=[REDACTED]#f"
    assert [one(spark, fn.allowed_host(F.lit(u), ["a.org"])) for u in ("https://x.a.org/p", "https://a.org", "http://a.org", "https://ba.org")] == [True, True, False, False]
    assert one(spark, fn.impact_price(F.lit(1_000_001), F.lit(1), F.lit(10), F.lit(5))) == 1_000_001 + 1001
    assert one(spark, fn.ceiling_fee(F.lit(1_000_001), F.lit(1))) == 101
    a = one(spark, fn.semantic_id(["m", "v"], ["m"]), m=None, v=1)
    assert len(a) == 64
    two = spark.sql("select map('a', 1, 'b', 2) as m union all select map('b', 2, 'a', 1)").select(fn.semantic_id(["m"], ["m"]).alias("i"))
    assert two.distinct().count() == 1


def test_total_return_and_fills(spark):
    spans = spark.createDataFrame([(1, "s", 10, 20, 100.0, 60.0)], "id int, symbol string, entry long, exit long, entry_px double, exit_px double")
    acts = spark.createDataFrame([(1, "s", 10, 1, 1, 9.0), (2, "s", 12, 1, 1, 1.0), (3, "s", 15, 2, 1, 0.0), (4, "s", 20, 1, 1, 0.5), (5, "s", 21, 1, 1, 9.0)], "id int, symbol string, effective long, split_num int, split_den int, dividend double")
    assert abs(lg.total_return(spans, acts, 4).first().total_return - ((2 * 60 + 1.0 + 2 * 0.5) / 100 - 1)) < 1e-12
    o = spark.createDataFrame([(1, "s", 1, 0, 100, 10.0, 3.0), (2, "s", -1, 0, 3, 10.0, 99.0)], "id int, symbol string, side int, t long, until long, limit double, qty double")
    p = spark.createDataFrame([(1, "s", 1, 10.0, 4.0), (2, "s", 2, 11.0, 4.0), (3, "s", 3, 9.0, 4.0), (4, "s", 50, 9.0, 4.0)], "seq long, symbol string, t long, px double, qty double")
    got = sorted((r.id, r.print_seq, r.filled) for r in lg.limit_fills(o, p, 0.5, [8, 2]).collect())
    assert got == [(1, 1, 2.0), (1, 3, 1.0), (2, 1, 2.0), (2, 2, 2.0)]
    s = spark.createDataFrame([("x", 100, 200), ("x", 300, 400)], "symbol string, open long, close long")
    a = spark.createDataFrame([(1, "x", 50), (2, "x", 120), (3, "x", 195), (4, "x", 199), (5, "x", 399)], "id int, symbol string, t long")
    assert [r.minute for r in lg.next_minute(a, s, ["symbol"], 10).orderBy("id").collect()] == [100, 130, 300, 300, None]


def test_funding_average_prefers_the_first_source(spark):
    a = spark.createDataFrame([("x", 1, 0.01), ("x", 2, float("nan"))], "symbol string, date int, funding double")
    b = spark.createDataFrame([("x", 1, 9.0), ("x", 3, 0.03), ("y", 1, None)], "symbol string, date int, funding_rate double")
    got = {r.symbol: round(r.funding_bps, 6) for r in lg.funding_average([a, b], ["funding", "funding_rate"]).collect()}
    assert got == {"x": 200.0, "y": 0.0}
