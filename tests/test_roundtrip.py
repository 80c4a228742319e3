"""Tables that are written and read back, and audits of whole queries, on hand rows."""

import pytest
from pyspark.sql import functions as F

from pitlake.operators import bitemporal as bt
from pitlake.operators import rules as ru
from pitlake.operators.numbering import sampled
from pitlake.sources import lake, sinks


def test_lake_files_have_their_place(spark, tmp_path):
    rows = [("sol", "20260101", 1.0), ("sol", "20260102", 2.0), ("a/b", "20260101", 3.0), ("sol", "20260101", 4.0)]
    df = spark.createDataFrame(rows, "coin string, date string, px double").repartition(3)
    assert sinks.write_lake(df, str(tmp_path), "silver", "fills") == 3
    files = sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*.parquet"))
    assert files == ["silver/fills/A-B/20260101.parquet", "silver/fills/SOL/20260101.parquet", "silver/fills/SOL/20260102.parquet"]
    read = lambda: {(r.coin_part, r.date_part, r.px) for r in lake.from_path(lake.scan(spark, lake.lake_path(str(tmp_path), "silver", "fills"), "coin string, px double")).collect()}
    assert read() == {("SOL", "20260101", 1.0), ("SOL", "20260101", 4.0), ("SOL", "20260102", 2.0), ("A-B", "20260101", 3.0)}
    sinks.write_lake(df.where("px = 2").withColumn("px", F.lit(9.0)), str(tmp_path), "silver", "fills")  # a day is replaced, the others stay
    assert ("SOL", "20260102", 9.0) in read() and len(read()) == 4 and not list(tmp_path.rglob(".staged*"))
    with pytest.raises(ValueError):
        sinks.write_lake(df.where("false"), str(tmp_path), "silver", "fills")


def test_sampled_places(spark):
    for n in (1, 2, 5, 7, 100, 299, 1000):
        for most in (2, 5, 7, 200):
            want = set(range(n)) if n <= most else {round(i * ((n - 1) / (most - 1))) for i in range(most)}
            got = {r.id for r in spark.range(n).where(sampled(F.col("id"), F.lit(n), most)).collect()}
            assert got == want, (n, most)


def test_layered_graph_shows_nothing_before_it_is_known(spark):
    nodes = spark.createDataFrame([("a", "Company", "Alpha", 1000), ("b", "Product", "Beta", 1000), ("c", "Product", "Gamma", 3000)], "id string, kind string, name string, known_from long")
    edges = spark.createDataFrame([("e", "knowledge", "a", "b", 2000, None), ("f", "source", "b", "c", 1000, 1400), ("g", "source", "a", "a", 1000, None)], "id string, layer string, a string, b string, known_from long, known_to long")

    def seen(t, text=""):
        n, e = bt.layered_graph(nodes, edges, t, text)
        return sorted(r.id for r in n.collect()), sorted(r.id for r in e.collect())

    assert seen(1500) == (["a", "b"], ["g"]) and seen(2500) == (["a", "b"], ["e", "g"]) and seen(1399) == (["a", "b"], ["f", "g"])
    assert seen(2500, "BETA") == (["b"], ["e"]) and seen(2500, "company") == (["a"], ["e", "g"]) and seen(500) == ([], [])


def test_evidence_needs_policy_capture_and_metadata(spark):
    v = spark.sql("select * from values (1, 'k', 9, 10, null, 1, 5.0, 1), (2, 'k', 9, 10, 11, 1, 6.0, 2), (3, 'm', 9, 10, 11, 1, 7.0, 1), (4, 'k', 9, 10, 11, 1, 8.0, 7) as t(id, key, published, observed, reconstructed, generation, value, capture_id)")
    captures = spark.sql("select * from values (1, 'u1', 'r1'), (2, 'u2', 'r2') as t(capture_id, url, receipt)")
    series = spark.sql("select * from values ('k', 'old', 'p', 1, 0), ('k', 'new', 'p', 2, 50), ('m', 'M', 'q', 1, 0) as t(key, name, provider, generation, known)")
    policies = spark.sql("select 'p' as provider, true as enabled, 999 as review_due, map('research', true) as purposes union all select 'q', true, 999, map('research', false)")
    ask = lambda mode, t: [(r.id, r.name, r.url, r.receipt) for r in bt.evidence(v.select("id"), v, captures, series, policies, "research", mode, 5, t).orderBy("id").collect()]
    assert ask("observed", 20) == [(1, "old", "u1", "r1"), (2, "old", "u2", "r2")] and ask("observed", 60)[0][1] == "new" and ask("observed", 9) == []
    assert ask("reconstructed", 20) == [(2, "old", "u2", None)]


def test_metrics_with_dimensions_do_not_count(spark):
    rows = spark.sql("select * from values ('e', 'm', 2, 2, 'f1', 1.0, map('geo', 'EU')), ('e', 'm', 1, 1, 'f2', 2.0, map()), ('e', 'm', 1, 1, 'f3', 3.0, null) as t(entity, metric, period_end, period_start, fact_key, value, dimensions)")
    assert [(r.period_end, r["keys"], r.ambiguous) for r in bt.latest_metric(rows).collect()] == [(1, 2, True)]
    assert [r.period_end for r in bt.latest_metric(rows.drop("dimensions")).collect()] == [2]


def test_sessions_and_clocks(spark):
    sessions = spark.createDataFrame([(100, 200), (300, 350)], "open long, close long")
    bars = spark.createDataFrame([(90, 110), (100, 110), (190, 200), (195, 205), (300, 350), (360, 370)], "start long, end long")
    assert [r.in_session for r in ru.within_sessions(bars, sessions, 50).orderBy("start").collect()] == [False, True, True, False, True, False]
    actions = spark.createDataFrame([(1, "s", 100), (2, "s", 300), (3, "s", 300), (4, "t", 300), (5, "s", 301)], "id int, symbol string, effective long")
    assert {r.id: (r.at_open, r.alone) for r in ru.at_session_open(actions, sessions).collect()} == {1: (True, True), 2: (True, False), 3: (True, False), 4: (True, True), 5: (False, True)}
    clocks = spark.createDataFrame([("instant", "Europe/Berlin", 5, 3, 4, 5), ("day", "Nowhere", None, 4, 3, 1), ("instant", "UTC", 5, None, 1, 4)], "precision string, zone string, published long, first_seen long, extracted long, modelled long")
    _, bad = ru.split(clocks, ru.availability_rules())
    assert sorted(r.violations for r in bad.collect()) == [["modelled"], ["precision", "zone", "published", "extracted"]]
    hashes = spark.createDataFrame([("a", "AB" * 32), ("", "ab" * 32), ("b", "xy" * 32), ("c", "ab")], "id string, content_sha256 string")
    good, _ = ru.split(hashes, ru.source_rules())
    assert [r.id for r in good.collect()] == ["a"]
