from pyspark.sql import functions as F

import corpus_pipeline
from pitlake.llm import langid, line_dedup, packing, quality
from pitlake.llm.common import cut
from tests.llm.test_line_dedup import plain
from tests.llm.test_simhash import components, print_of


def test_stages_in_turn(spark):
    """Each stage against its own rule on what the one before kept."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "s", 0), (None, "A line. " * 30, "en", None, 1), (None, "A line. " * 30, "en", None, 1)], docs.schema)
    docs = cut(docs.unionByName(odd), "given")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "language", "line_dedup", "simhash", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = cut(stage(spark, docs, sf), name)
        after = docs.collect()
        if name != "packing":
            assert docs.columns == columns
        if name == "quality":
            labels = spark.read.parquet(f"{sf}/labels.parquet")
            good = {r.doc_id for r in labels.where("quality = 1").collect()}
            here = {r.doc_id for r in before}
            assert len({r.doc_id for r in after} & good) >= 0.95 * len(good & here)
        if name == "language":
            gone = {r.doc_id for r in before} - {r.doc_id for r in after}
            assert all(not any(c.isalpha() for c in r.text or "") for r in before if r.doc_id in gone and (len(r.text or "") < 20 or r.text is None))
            assert all(r.text and any(c.isalpha() for c in r.text) for r in after)
        if name == "line_dedup":
            want = plain([(r.doc_id, r.text) for r in before if r.doc_id is not None], 50)
            got = {r.doc_id: r.text for r in after}
            for r in before:
                if r.doc_id is not None:
                    left = "\n".join(x for p, x in enumerate(r.text.split("\n")) if p not in want[r.doc_id])
                    assert got.get(r.doc_id) == (left if left.split() or not want[r.doc_id] else None)
        if name == "simhash":
            root = components({r.doc_id: print_of(r.text) for r in before if r.doc_id is not None})
            assert sorted(r.doc_id for r in after if r.doc_id is not None) == sorted(i for i in root if root[i] == i)
            assert sum(r.doc_id is None for r in after) == min(1, sum(r.doc_id is None for r in before))
        if name == "packing":
            assert sum(r.length for r in after) == sum(len(r.text.split()) for r in before)


def test_empty_corpus(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, sf), name)
        assert docs.count() == 0


def test_registered():
    import __spark_entry__ as entry

    got = entry.queries()
    assert "pipeline" in got and all(any(n.startswith(f"op{k}_") for n in got) for k in range(1, 11))
    assert {"op3_url_filter", "op6_line_dedup"} <= entry.oracle_sql().keys()
    assert all(m.__doc__ for m in (langid, line_dedup, packing, quality))


def test_further_columns_pass_through(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    extra = {"score": -7.0, "predicted": 5, "lang_pred": "x", "cut": "x", "n_lines": "y", "__d": 1, "fp": "z", "row": "w", "h": 1}
    for k, v in extra.items():
        docs = docs.withColumn(k, F.lit(v))
    docs = cut(docs, "given")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == docs.columns
        assert all(r[k] == v for r in after.collect() for k, v in extra.items())


def test_one_row_of_each_group_stays(spark):
    rows = [(None, "a b c d e f", "x"), (None, "A b c d e f", "y"), (5, "a b c d e f", "z"), (5, "q r s t u v w", "z"), (5, "q r s t u v w", "z"), (None, "alone here", "z"), (4, None, "z"), (3, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = corpus_pipeline.keep_one_of_a_group(spark, docs, "")
    assert sorted((str(r.doc_id), r.text) for r in got.collect()) == [("3", ""), ("5", "a b c d e f"), ("5", "q r s t u v w"), ("None", "alone here")]
    twice = docs.unionByName(docs).repartition(5)
    assert got.exceptAll(corpus_pipeline.keep_one_of_a_group(spark, twice, "")).count() == 0


def test_run_deletes_its_steps(spark):
    from pitlake.llm.common import release, written

    release(spark)
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert len(written()) <= 3 and out.count() > 0
