"""Parsers, the lake, sinks and incremental ingestion."""

import json
import re

import pytest
from pyspark.sql import functions as F

from pitlake.sources import documents as dc
from pitlake.sources import lake, sinks
from pitlake.streaming import ingest


def bodies(spark, *values, **more):
    rows = [(v if isinstance(v, str) else json.dumps(v), *more.values()) for v in values]
    return spark.createDataFrame(rows, ", ".join(["body string", *[f"{k} string" for k in more]]))


def test_bars_and_malformed(spark):
    good = {"bars": {"MU": [{"t": "2026-01-02T14:30:00Z", "o": 1.0, "h": 3.0, "l": 0.5, "c": 2.0, "v": 7}], "SPY": []}}
    r = dc.bars(bodies(spark, good, "not json")).collect()
    assert [(x.symbol, x.start, x.end - x.start, x.available_at - x.start, x.close) for x in r] == [("MU", 1767364200000, 60_000, 60_000, 2.0)]
    assert dc.malformed(bodies(spark, good, "not json"), "struct<bars:map<string,array<struct<t:string>>>>").count() == 1


def test_company_facts(spark):
    fact = lambda val, filed, accn, start="2025-01-01": {"start": start, "end": "2025-03-31", "val": val, "accn": accn, "filed": filed}
    doc = {"cik": "7", "facts": {"gaap": {"Revenue": {"units": {"USD": [fact("100", "2025-05-01", "b"), fact("90.5", "2025-04-01", "a"), fact("80", "2026-01-01", "z")]}}, "Cash": {"units": {"USD": [fact("5", "2025-04-01", "a", None), fact("6", "2025-04-01", "a2", None)]}}}}}
    f = dc.company_facts(bodies(spark, doc), "2025-12-31")
    got = sorted((r.tag, r.period_kind, str(r.period_start), r.value_micros, r.revision) for r in f.collect())
    assert got == [("Cash", "instant", "2025-03-31", 5_000_000, 1), ("Cash", "instant", "2025-03-31", 6_000_000, 2), ("Revenue", "duration", "2025-01-01", 90_500_000, 1), ("Revenue", "duration", "2025-01-01", 100_000_000, 2)]
    assert [r.tag for r in dc.same_day_conflicts(f).collect()] == ["Cash"]
    idx = {"cik": "0007", "filings": {"recent": {"accessionNumber": ["1-2-3", "4-5-6"], "primaryDocument": ["a.htm", "b.htm"], "filingDate": ["2025-01-02", "2025-01-03"], "acceptanceDateTime": ["2025-01-02T10:00:00Z", None]}}}
    got = dc.filing_index(bodies(spark, idx)).orderBy("accessionNumber").collect()
    assert [r.path for r in got] == ["data/7/123/a.htm", "data/7/456/b.htm"]
    assert [r.ms for r in dc.filing_index(bodies(spark, idx)).select(F.unix_millis("published").alias("ms")).orderBy("ms").collect()] == [1735812000000, 1735966800000]


def test_tables_of_statistics(spark):
    page = [{"page": 1, "pages": 1, "total": 2}, [{"indicator": {"id": "GDP"}, "country": {"id": "US"}, "date": "2024", "value": 1.5}, {"indicator": {"id": "GDP"}, "country": {"id": "US"}, "date": "2023", "value": None}]]
    assert [(r.series_id, str(r.period_end), r.value) for r in dc.indicators(bodies(spark, page))[0].collect()] == [("WB:GDP:US", "2024-12-31", 1.5), ("WB:GDP:US", "2023-12-31", None)]
    odd = [page[0], [{"indicator": {"id": "GDP"}, "country": {"id": "US"}, "date": "2024"}, {"indicator": {"id": "GDP"}, "country": {"id": "US"}, "date": "2024", "value": "broken"}, {"value": 1}]]
    assert sorted(r.fault for r in dc.indicators(bodies(spark, odd))[1].collect()) == ["no_identity", "no_value_field", "not_a_number"]
    assert [r.fault for r in dc.indicators(bodies(spark, {"message": "x"}))[1].collect()] == ["no_rows"] and dc.indicators(bodies(spark, odd))[0].count() == 0
    short = [{"page": 1, "pages": 2, "total": 2}, page[1]]
    assert dc.page_gaps(bodies(spark, page, source="a")).count() == 0 and dc.page_gaps(bodies(spark, short, source="a")).count() == 1
    raw = spark.createDataFrame([("S1 ", "2024", "M02", " 1,000.5 "), ("S1", "2024", "M13", "-"), ("S1", "2024", "S01", "1")], "series_id string, year string, period string, value string")
    assert [(r.series_id, str(r.period_start), str(r.period_end), r.value) for r in dc.statistics_rows(raw).collect()] == [("S1", "2024-02-01", "2024-02-29", 1000.5), ("S1:annual", "2024-01-01", "2024-12-31", None)]
    t, bad = dc.header_table(bodies(spark, [["time", "VAL"], ["2024-01", "5"], ["short"]]), ["VAL", "time"])
    assert [tuple(r) for r in t.collect()] == [("5", "2024-01")] and [(r.row, r.fault) for r in bad.collect()] == [(["short"], "width")]
    t, bad = dc.header_table(bodies(spark, [["time"], ["2024-01"]]), ["VAL", "time"])
    assert t.count() == 0 and [r.fault for r in bad.collect()] == ["column_missing"]
    trade = [["CTY_CODE", "CTY_NAME", "I_COMMODITY", "LDESC", "GEN_VAL_MO"], ["1", "A", "99", None, "5.5"], ["2", "B", "99", "all", "(S)"], [None, "B", "99", "all", "1"], ["3", "C", "99", "all", "x"], ["3"]]
    t, bad = dc.trade_values(bodies(spark, trade, month="2024-02"), "imports", "I_COMMODITY", "LDESC", "GEN_VAL_MO")
    assert sorted((r.series_id, r.title, str(r.period_end), r.value, r.dimensions["partner"]) for r in t.collect()) == [("CENSUS:imports:1:99:GEN_VAL_MO", "99", "2024-02-29", 5.5, "1"), ("CENSUS:imports:2:99:GEN_VAL_MO", "all", "2024-02-29", None, "2")]
    assert sorted(r.fault for r in bad.collect()) == ["no_identity", "not_a_number", "width"]
    wide = {"response": {"data": [{"period": "2024-05", "state": "TX", "price": "9.5", "price-units": "usd", "sales": "-"}]}}
    got = dc.facets(bodies(spark, wide), "elec", ["price", "sales"], ["state"]).collect()
    assert [(r.series_id.split(":")[:2], str(r.period_end), r.value, r.unit) for r in got] == [(["elec", "price"], "2024-05-31", 9.5, "usd"), (["elec", "sales"], "2024-05-31", None, None)]
    assert got[0].series_id.split(":")[2] == got[1].series_id.split(":")[2]
    tree = {"response": {"id": "r", "routes": [{"id": "c"}], "frequency": [{"id": "monthly"}], "startPeriod": "2001-01", "endPeriod": "2024"}}
    assert sorted((r.kind, r.name, str(r["last"])) for r in dc.route_catalogue(bodies(spark, tree)).collect()) == [("child", "c", "None"), ("frequency", "monthly", "2024-12-31")]
    io = {"Data": [{"Year": "2020", "RowCode": "11", "ColCode": "22", "DataValue": "1,5"}]}
    r = dc.input_output(bodies(spark, io), "T").first()
    assert (r.series_id, r.dimensions, r.value) == ("T:11:22", {"row": "11", "column": "22"}, 15.0)


def test_pages(spark):
    html = '<meta name="description" content="March 2026 Revenue was NT$ 285,957 Million"><p>2026/02/10 2026/04/10 2026/05/01</p>'
    p = spark.createDataFrame([("http://x/1", html), ("http://x/2", "<p>none</p>")], "url string, html string")
    got = dc.release_figure(p).withColumn("ms", F.unix_millis("published")).collect()
    assert [(str(r.period_end), r.value, r.ms) for r in got] == [("2026-03-31", 285_957e6, 1775836800000)]  # 16:00 UTC is midnight in Taipei
    page = """<a href="/x">1</a><a class="b" href="y#f">2</a><a href="//o.org/z">3</a><a href="mailto:a@b">4</a><a href="#t">5</a><a href="https://a.org/x">6</a><a id=x href='../up/./q?z=../w'>7</a><A href="no">-</A><a href=bare/..>8</a><a href="../../..">9</a><a data-href="/not">10</a>"""
    l = dc.links(spark.createDataFrame([(1, "https://a.org/d/e?q", page)], "page_id int, url string, html string"), "page_id")
    assert sorted((r.link, r.same_host) for r in l.collect()) == [("https://a.org/", True), ("https://a.org/d/", True), ("https://a.org/d/no", True), ("https://a.org/d/y", True), ("https://a.org/up/q?z=../w", True), ("https://a.org/x", True), ("https://o.org/z", False)]


def test_catalog_entries(spark):
    link = [{"rel": "child", "href": "provider"}, {"rel": "self", "href": "https://earth.example/stac/"}]
    xml = "<?xml version='1.0'?><mes:S xmlns:mes='urn:m' xmlns:str='urn:s' xmlns:com='urn:c'><str:Dataflows><str:Dataflow id='DF' agencyID='T'><com:Name>Global GDP</com:Name></str:Dataflow></str:Dataflows></mes:S>"
    docs = [
        ("https://c.example/api/3/search", "ckan", {"success": True, "result": {"count": 42, "results": [{"id": "d1", "title": "Copper", "notes": "flows", "license_title": "Open", "metadata_created": "2020-01-01", "tags": [{"name": "copper"}, {"display_name": "Cu", "name": "x"}], "resources": [{"url": "/copper.csv", "mimetype": "text/csv", "format": "CSV"}, {"url": None}]}]}}),
        ("https://earth.example/stac/", "stac", {"type": "Catalog", "links": link, "collections": [{"id": "temp", "title": 5, "description": ["a", "b"], "license": "proprietary", "keywords": ["k"], "extent": {"spatial": {"bbox": [[-180, -90, 180, 90]]}, "temporal": {"interval": [["2000-01-01", None]]}}, "links": [], "assets": {"d": {"href": "x.nc", "type": "nc"}}}]}),
        ("https://api.example/v1/openapi.json", "openapi", {"openapi": "3.1.0", "paths": {"/series": {"get": {"operationId": "series", "tags": ["data"]}}, "/orders": {"post": {"operationId": "o"}}}}),
        ("https://data.example/c.jsonld", "jsonld", {"@graph": [{"@type": ["x", "Dataset"], "name": "Wheat", "distribution": [{"accessURL": "/wheat.csv", "encodingFormat": "text/csv"}]}, {"@type": "Org", "@id": "o"}]}),
        ("https://one.example/", "dcat", {"@type": "dcat:Dataset", "@id": "urn:x", "name": "N", "url": "page"}),
        ("https://s.example/f", "sdmx", xml), ("https://s.example/j", "sdmx", {"dataflows": [{"id": "J", "name": "n"}, {"name": "nameless"}]}),
        ("u6", "ckan", {}), ("u7", "ogc", "oops"), ("u8", "ogc", {}), ("u9", "openapi", {}), ("u10", "sdmx", "<root/>"), ("u11", "ckan", {"success": False, "result": {"results": []}}), ("u12", "ogc", {"collections": [{"id": "fine"}, {"title": "no id"}]}),
        ("u13", "ckan", {"success": True, "result": {"results": []}}),
    ]
    df = spark.createDataFrame([(u, p, b if isinstance(b, str) else json.dumps(b)) for u, p, b in docs], "url string, protocol string, body string")
    found, bad = dc.catalog_entries(df)
    got = {r.external_id: r for r in found.collect()}
    assert {k: r.title for k, r in got.items()} == {"d1": "Copper", "temp": "temp", "GET /series": "series", "Wheat": "Wheat", "urn:x": "N", "DF": "Global GDP", "J": "n"}
    assert (got["d1"].keywords, [tuple(p) for p in got["d1"].distributions], got["d1"].license) == (["copper", "Cu"], [("https://c.example/copper.csv", "text/csv", "CSV")], "Open")
    assert json.loads(got["d1"].temporal) == {"metadata_created": "2020-01-01", "metadata_modified": None} and got["d1"].spatial is None
    assert json.loads(got["temp"].spatial)["bbox"][0][0] == -180 and json.loads(got["temp"].temporal)["interval"][0][1] is None
    assert (got["temp"].description, got["temp"].landing, got["temp"].distributions[0].url) == ("a, b", None, "https://earth.example/stac/x.nc")
    assert (got["GET /series"].landing, got["GET /series"].keywords) == ("https://api.example/series", ["data"])
    assert got["Wheat"].distributions[0].url == "https://data.example/wheat.csv" and got["urn:x"].landing == "https://one.example/page" and got["DF"].landing == "https://s.example/f"
    assert sorted(r.url for r in bad.collect()) == ["u10", "u11", "u12", "u6", "u7", "u8", "u9"]
    assert [tuple(r) for r in dc.catalog_links(df).collect()] == [("https://earth.example/stac/", "https://earth.example/stac/provider")]
    assert {r.url[-1]: r.total for r in dc.catalog_totals(df).collect() if r.total is not None} == {"h": 42, "j": 2, "2": 2}


def test_csv(spark):
    cells = spark.createDataFrame([("2024-01", "CA", "kg", "1.5"), ("2024-02", "", "kg", "")], "REF string, GEO string, UOM string, VALUE string")
    got = dc.csv_observations(cells, "d", "REF", "VALUE", "UOM").collect()
    assert [(r.dimensions, str(r.period_end), r.value) for r in got] == [({"GEO": "CA"}, "2024-01-31", 1.5), ({}, "2024-02-29", None)] and got[0].series_id != got[1].series_id
    with pytest.raises(Exception, match="not a number"):
        dc.csv_observations(cells.withColumn("VALUE", F.lit("x")), "d", "REF", "VALUE", "UOM").collect()
    assert {r.name: (r.missing, r.numeric, r.all_numeric, r.recognised) for r in dc.profile(cells).collect()} == {"REF": (0, 0, False, None), "GEO": (1, 0, False, None), "UOM": (0, 0, False, "unit"), "VALUE": (1, 1, True, "value")}
    odd = spark.createDataFrame([("NaN", "1e3"), ("Infinity", " 2"), ("5", "-7")], "Date string, other string")
    assert {r.name: (r.numeric, r.all_numeric, r.recognised) for r in dc.profile(odd).collect()} == {"Date": (1, False, "period"), "other": (2, False, None)}


def test_lake(spark, tmp_path):
    row = ("sol", 1_700_000_000_000, 10.0, 2.0, 20.0, "B", None, 1, None, 0.0, None, 1, None, "h", "d")
    for coin, date in (("SOL", "20260101"), ("SOL", "20260102"), ("BTC", "20260101")):
        spark.createDataFrame([row], lake.FILLS).coalesce(1).write.parquet(f"{tmp_path}/silver/fills/{coin}/{date}.parquet")
    path = lake.lake_path(str(tmp_path), "silver", "fills", "sol")
    got = lake.from_path(lake.scan(spark, path, lake.FILLS)).select("coin_part", "date_part").distinct().collect()
    assert sorted(map(tuple, got)) in ([("", "20260101"), ("", "20260102")], [("SOL", "20260101"), ("SOL", "20260102")]) or len(got) == 2
    assert lake.scan(spark, lake.lake_path(str(tmp_path), "gold", "markout"), "a int").count() == 0
    f = lake.fills(lake.scan(spark, path, lake.FILLS)).first()
    assert (f.symbol, f.side, f.sequence, f.trade_id) == ("SOL", "buy", 1, None)
    with pytest.raises(ValueError):
        lake.lake_path("r", "tin", "fills")
    m = spark.createDataFrame([(1, 1.0, None), (2, None, None)], "id int, markout_bps_10s double, markout_bps_1m double")
    assert [r.markouts for r in lake.markout_map(m).orderBy("id").collect()] == [{"10s": 1.0}, {}]
    assert [tuple(r) for r in lake.markout_long(m).collect()] == [(1, "10s", 1.0)]
    d = spark.createDataFrame([("20260130..20260202, 20260101,20260131",)], "s string").select(lake.requested_dates(F.col("s"))).first()[0]
    assert d == ["20260130", "20260131", "20260201", "20260202", "20260101"]
    assert spark.createDataFrame([("sol, btc/usd,SOL",)], "s string").select(lake.requested_symbols(F.col("s"))).first()[0] == ["SOL-PERP", "BTC-USD"]
    levels = spark.createDataFrame([("s", 1, 2.0, 1.0, 1.0), ("s", 1, -1.0, 3.0, 1.0)], "symbol string, timestamp int, percentage double, depth double, notional double")
    assert [x.percentage for x in lake.depth_snapshots(levels).first().levels] == [-1.0, 2.0]
    g = spark.createDataFrame([("s", 1)], "symbol string, date int")
    inv = lake.inventory(g.union(spark.createDataFrame([("t", 1)], g.schema)), g, g, 5)
    assert sorted((r.symbol, r.rows, r.evaluated) for r in inv.collect()) == [("s", 1, 1), ("t", 0, 0)]


def test_hashes(spark, tmp_path):
    for n, b in (("a", b"1"), ("b", b"2"), ("c", b"3")):
        (tmp_path / n).write_bytes(b)
    files = lake.file_hashes(spark, str(tmp_path))
    manifest = files.where(~F.col("path").endswith("/c")).select("path", F.when(F.col("path").endswith("/b"), "x").otherwise(F.col("sha256")).alias("sha256")).union(spark.createDataFrame([("gone", "y")], "path string, sha256 string"))
    got = {r.path.split("/")[-1]: r.status for r in lake.verify_hashes(files, manifest).collect()}
    assert got == {"a": "ok", "b": "changed", "c": "orphan", "gone": "missing"}


def test_sinks(spark, tmp_path):
    with pytest.raises(ValueError):
        sinks.write_table(spark.range(0), f"{tmp_path}/none")
    sinks.write_table(spark.range(6).withColumn("d", F.col("id") % 2), f"{tmp_path}/t", ["d"])
    assert spark.read.parquet(f"{tmp_path}/t").where("d = 1").count() == 3
    report = {"run_id": "r", "schema_version": 2, "created_ms": 5, "leaderboard": [{"policy": "a", "rank": 2, "lift": 0.5, "status": "audited"}, {"policy": "b", "rank": 1, "lift": 0.7, "status": "audited"}, {"policy": "l", "rank": 0, "lift": 9.0, "status": "blocked"}],
              "trials": [{"variant": "A", "decisions": [{"at": 1, "prediction": 0.5, "position": 1.0}], "scores": [], "account": {"events": [{"at": 2, "kind": "fill", "amount_micros": 3}]}}]}
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "report.json").write_text(json.dumps(report, indent=1))
    r = sinks.report_ledger(spark, str(tmp_path)).first()
    assert (r.policy, r.audited, r.blocked) == ("b", 2, 1)
    star = sinks.star_tables(spark, f"{tmp_path}/x")
    assert {k: v.count() for k, v in star.items()} == {"decisions": 1, "scores": 0, "events": 1}
    b = sinks.leaderboard_rows(spark.createDataFrame([("a", 1 / 3, None)], "policy string, lift double, dsr double")).first()
    assert b.lift.startswith("0.33333333333") and b.dsr is None and b.undefined == "dsr"
    c = spark.createDataFrame([("u", 1, "p", b"x"), ("v", 2, "p", b"x")], "url string, first_seen_at int, permission string, content binary")
    objects, seen = sinks.receipts(c)
    assert objects.count() == 1 and seen.count() == 2
    e = spark.sql("select 1 as a, 2 as capture_id, map('url', 'u', 'k', 'v') as extras")
    assert sinks.public_view(e, "reconstructed").first().asDict() == {"a": 1, "extras": {"k": "v"}}


SCHEMA = "key string, source_order long, observed long, value double, arrived timestamp"


def test_ingestion_in_any_order_of_files(spark, tmp_path):
    rows = [("a", 1, 10, 1.0), ("a", 1, 10, 1.0), ("a", 2, 20, 2.0), ("b", 1, 5, 3.0), ("b", 1, 6, 4.0), ("a", 0, 1, 9.0)]
    results = []
    for run, order in enumerate(([0, 1, 2, 3, 5], [5, 3, 2, 1, 0])):
        base = f"{tmp_path}/{run}"
        for n, i in enumerate(order):
            spark.createDataFrame([rows[i]], "key string, source_order long, observed long, value double").withColumn("arrived", F.lit("2024-01-01").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{base}/in")
            if n == 2:  # a second call goes on from the checkpoint
                ingest.run_available(spark, f"{base}/in", SCHEMA, f"{base}/cp", ingest.version_sink(f"{base}/t", f"{base}/q", ["observed", "value"], ["key"], "source_order"))
        for _ in range(2):
            ingest.run_available(spark, f"{base}/in", SCHEMA, f"{base}/cp", ingest.version_sink(f"{base}/t", f"{base}/q", ["observed", "value"], ["key"], "source_order"))
        t = spark.read.parquet(f"{base}/t")
        assert t.select("generation").distinct().count() > 1
        results.append(sorted((r.key, r.source_order, r.value) for r in t.collect()))
    assert results[0] == results[1] == [("a", 0, 9.0), ("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 3.0)]
    clash = spark.createDataFrame([rows[4]], "key string, source_order long, observed long, value double").withColumn("arrived", F.lit("2024-01-01").cast("timestamp"))
    clash.coalesce(1).write.mode("append").parquet(f"{base}/in")
    thin = ("arrived", "1 hour", ["key", "source_order", "observed", "value"])
    ingest.run_available(spark, f"{base}/in", SCHEMA, f"{base}/cp2", ingest.version_sink(f"{base}/t2", f"{base}/q2", ["observed", "value"], ["key"], "source_order"), thin=thin)
    stored, aside = spark.read.parquet(f"{base}/t2"), spark.read.parquet(f"{base}/q2")
    assert stored.where("key = 'a'").count() == 3 and aside.where("key = 'b'").count() + stored.where("key = 'b'").count() == 2
    assert [r.value for r in ingest.known_at(stored.where("key = 'a'"), 15, ["key"], "observed", ["source_order"]).collect()] == [1.0]


def test_a_batch_reads_the_folders_of_its_keys_only(spark, tmp_path):
    key, path = ["key"], f"{tmp_path}/store"
    rows = [(f"k{i}", i, 10 * i, float(i)) for i in range(400)]
    batch = spark.createDataFrame(rows, "key string, source_order long, observed long, value double")
    sink = ingest.version_sink(path, f"{tmp_path}/aside", ["observed", "value"], key, "source_order", 16)
    sink(batch.where("source_order < 200"), 0)
    sink(batch, 1)
    stored = spark.read.parquet(path)
    assert stored.count() == 400 and stored.where("generation = 1").count() == 200
    like = batch.withColumn("semantic_id", F.lit(""))
    few = batch.where("key = 'k7'")
    found = ingest.stored_for(few, path, like, 2, key, 16)
    folder = few.select(ingest.bucket_of(key, 16)).first()[0]
    assert {r.bucket for r in found.collect()} == {folder} and found.where("key = 'k7'").count() == 1
    filters = re.search(r"PartitionFilters: \[([^\]]*)", found._jdf.queryExecution().executedPlan().toString())[1]
    assert f"(bucket#" in filters and f"= {folder})" in filters and "generation#" in filters and len(stored.inputFiles()) > 16
    assert ingest.stored_for(few, path, like, 0, key, 16).count() == 0
    sink(few.withColumn("value", F.lit(-1.0)).unionByName(few), 2)  # a contradiction of what an earlier generation holds
    assert spark.read.parquet(path).count() == 400 and spark.read.parquet(f"{tmp_path}/aside").where("generation = 2").count() == 1
    ingest.compact(spark, path, f"{tmp_path}/one", like, key, 16)
    one = spark.read.parquet(f"{tmp_path}/one")
    assert one.count() == 400 and {r.first_generation for r in one.collect()} == {0, 1} and len(one.inputFiles()) <= 16


def test_metadata_sink_compares_with_stored_content(spark, tmp_path):
    sink = ingest.metadata_sink(f"{tmp_path}/m", "id", ["name"], "t", 4)
    schema = "id string, name string, t int"
    sink(spark.createDataFrame([("a", "x", 1), ("b", "y", 1)], schema), 0)
    sink(spark.createDataFrame([("a", "x", 2), ("b", "z", 2)], schema), 1)
    sink(spark.createDataFrame([("a", "w", 3), ("b", "z", 3)], schema), 2)
    assert sorted((r.id, r.t) for r in spark.read.parquet(f"{tmp_path}/m").collect()) == [("a", 1), ("a", 3), ("b", 1), ("b", 2)]


def test_metadata_changes_and_totals(spark):
    stored = spark.createDataFrame([("s", "old", 1)], "id string, name string, t int")
    stored = stored.withColumn("content_id", ingest.semantic_id(["name"]))
    batch = spark.createDataFrame([("s", "old", 2), ("s", "new", 3), ("s", "new", 4), ("s", "old", 5), ("n", "x", 1)], "id string, name string, t int")
    got = ingest.changed_metadata(batch, stored, "id", ["name"], "t").collect()
    assert sorted((r.id, r.t) for r in got) == [("n", 1), ("s", 3), ("s", 5)]
    p = spark.createDataFrame([("a", "1", 2, 4), ("a", "2", 2, 4), ("b", "1", 1, 2), ("b", "1", 1, 2), ("c", "1", 1, 2)], "run string, cursor string, rows int, total int")
    assert {r.run: r.status for r in ingest.reconcile_totals(p).collect()} == {"a": "ok", "b": "cursor_repeats", "c": "rows_differ"}
    day = 86_400_000_000
    assert ingest.overlap(spark.range(10).select((F.col("id") * day).alias("t")), "t", 9 * day, 7).count() == 7


def test_an_empty_horizon_is_an_error(spark):
    df = lake.markout_map(spark.createDataFrame([(1, 2.0, None), (2, None, None)], "id int, markout_bps_1h double, markout_bps_1d double"))
    assert [r.id for r in lake.with_horizon(df, "1h").collect()] == [1]
    with pytest.raises(ValueError):
        lake.with_horizon(df, "1d")
