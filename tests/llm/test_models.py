import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitlake.llm import langid, quality
from pitlake.llm.common import holdout


def test_holdout(spark):
    got = spark.range(200).select("id", holdout(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)


def test_trees_learn_and_traverse():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    model = quality.grow(x[:1500], y[:1500], trees=30)
    s = model.score(x[1500:])
    assert ((s > 0.5) == (y[1500:] > 0.5)).mean() > 0.95

    def one(row):
        total = model.base
        for f, t, v in zip(model.feature, model.threshold, model.value):
            at = 0
            while at < 2**model.depth - 1:
                at = 2 * at + 1 + bool(row[f[at]] > t[at])
            total += v[at]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(s[:50], [one(r) for r in x[1500:1550]])


def test_quality_on_held_out_documents(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.classify(docs.select("doc_id", "text"), labels).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 40 and np.mean([r.predicted == r["quality"] for r in got]) > 0.9


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (None, "", "b"), (2, "word " * 9, "c"), (2, "word " * 9, "c")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(2, 1), (2, None), (None, 0), (1, 0)], "doc_id long, quality int")
    got = quality.classify(docs, labels, trees=3).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    none = quality.classify(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_grams_are_counted_by_text():
    hits, of, has = langid.grams(["ab", None, "1 2", "A  b"], 1 << 10)
    assert has.tolist() == [True, False, False, True]
    assert np.bincount(of, minlength=4).tolist() == [4 + 3 + 2, 1, 1, 5 + 4 + 3]
    assert sorted(hits[of == 0]) == sorted(langid.grams(["AB"], 1 << 10)[0])


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs, langid.fit(docs)).where(holdout(F.col("doc_id")) & F.col("lang").isNotNull()).collect()
    assert len(got) > 100 and np.mean([r.lang_pred == r.lang for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_rows(spark):
    rows = [(1, "the cat", "en", 1), (2, "le chat", "fr", 1), (3, "el gato", None, 1), (4, None, "en", 1), (None, "the dog", "en", 1), (6, "12 !", "fr", 1), (6, "12 !", "fr", 1), (7, "", "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred int")
    got = langid.identify(docs, langid.fit(docs)).collect()
    assert len(got) == 8 and all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in got)
    assert {r.lang_pred for r in langid.identify(docs, langid.fit(docs.limit(0))).collect()} == {"und"}
    assert langid.identify(docs.limit(0), langid.fit(docs)).count() == 0


def slow_grams(text, buckets):
    """Hashed 1- to 3-grams, letter by letter."""
    folded = "".join(c if c.isalpha() else " " for c in f" {(text or '').lower()} ")
    folded = re.sub(" +", " ", folded)
    out = []
    for n in range(3):
        for i in range(len(folded) - n):
            h = 0
            for k in range(n + 1):
                h = (h * 0x9E3779B1 + ord(folded[i + k]) * 0x85EBCA6B + k) % 2**32
            out.append((h ^ h >> 15) % buckets)
    return out


def test_bayes_against_dictionaries(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    buckets, rows = 1 << 12, docs.collect()
    model = langid.fit(docs, buckets=buckets)
    counts = {}
    for r in rows:
        if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 5:
            for g in slow_grams(r.text, buckets):
                counts.setdefault(r.lang, Counter())[g] += 1
    assert model.langs == sorted(counts)
    some = [r.text for r in rows[:40]] + ["", None, "12", "a"]
    langs, share = model.predict(some)
    for text, lang, p in zip(some, langs, share):
        total = {}
        for k, c in counts.items():
            whole = sum(c.values()) + 0.5 * buckets
            total[k] = sum(np.log((c[g] + 0.5) / whole) for g in slow_grams(text, buckets))
        if text and any(map(str.isalpha, text)):
            best = min(total, key=lambda k: (-total[k], k))
            assert lang == best and abs(p - 1 / sum(np.exp(v - total[best]) for v in total.values())) < 1e-6
        else:
            assert (lang, p) == ("und", 0)


def test_every_language_is_learned(spark):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} " * 9, f"l{i % 300}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    told = {r.lang for r in docs.where(~holdout(F.col("doc_id"))).collect()}
    assert len(told) > 256 and langid.fit(docs, buckets=64).langs == sorted(told)
    with pytest.raises(ValueError, match="more than 2 languages"):
        langid.fit(docs, most_langs=2)
    rare = [(i, "ab cd", "x" if i % 10 else "y") for i in range(200)]
    model = langid.fit(spark.createDataFrame(rare, "doc_id long, text string, lang string"), prior=True)
    assert model.predict(["ab"])[0] == ["x"] and 0.8 < model.predict(["ab"])[1][0] < 1


@pytest.mark.parametrize("size", [1, 2, 5, 64, 1000])
def test_long_texts_count_like_whole_ones(size):
    for text in ("Ab  c ,,, d" * 20, "x" * 100, "   ", "ÀÉ 12 z\n\nq " * 9 + "end"):
        found = [langid.long_grams(text, 1 << 10, size)][0]
        parts = list(found)
        hits, _, has = langid.grams([text], 1 << 10)
        assert sorted(np.concatenate([h for h, _ in parts])) == sorted(hits) and any(x for _, x in parts) == has[0]


def test_a_text_beyond_the_chunk_is_learned_and_told(spark, monkeypatch):
    rows = [(i, ("der die das " if i % 2 else "the of and ") * (400 if i % 5 else 3), "de" if i % 2 else "en") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole = langid.fit(docs)
    before = whole.predict([t for _, t, _ in rows])
    monkeypatch.setattr(langid, "LONG", 100)
    after = whole.predict([t for _, t, _ in rows])
    assert before[0] == after[0] and np.allclose(before[1], after[1])


def slow_trees(x, y, trees, depth, rate, bins, least, l2):
    """The same boosting by trying every cut of every column in every node, row by row."""
    share = (y.sum() + 1) / (len(y) + 2)
    raw = np.full(len(y), np.log(share / (1 - share)))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)

        def node(rows, level):
            if level == depth:
                raw[rows] += -rate * g[rows].sum() / (h[rows].sum() + l2)
                return
            gt, ht, best = g[rows].sum(), h[rows].sum(), (1e-6, None)
            for j in range(x.shape[1]):
                for cut in np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])):
                    left = [i for i in rows if x[i, j] <= cut]
                    gl, hl = g[left].sum(), h[left].sum()
                    gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                    if hl >= least and ht - hl >= least and gain > best[0] + 1e-9:
                        best = gain, (j, cut)
            if best[1] is None:
                return node(rows, depth)
            j, cut = best[1]
            node([i for i in rows if x[i, j] <= cut], level + 1)
            node([i for i in rows if x[i, j] > cut], level + 1)

        node(list(range(len(y))), 0)
    return 1 / (1 + np.exp(-raw))


def test_trees_against_every_cut():
    rng = np.random.default_rng(3)
    x = rng.random((120, 3)).round(2)
    y = (x[:, 0] + x[:, 1] * (x[:, 2] > 0.5) + 0.2 * rng.random(120) > 0.9).astype(float)
    how = dict(trees=4, depth=2, rate=0.2, bins=8, least=1.0, l2=1.0)
    assert np.allclose(quality.grow(x, y, **how).score(x), slow_trees(x, y, **how))


def test_statistics_against_plain_counts():
    for t in ["One two TWO, three!\n\nfour 55 #x\nfour 55 #x\n", "a", "\u00c4hm \u00df \u4e16\u754c ok", "x " * 40_000, "{}" * 3000 + " end."]:
        got, words, raw = dict(zip(quality.FEATURES, quality.statistics(t))), t.encode().split(), t.encode()
        lines = [x for x in t.split("\n") if x.strip()]
        assert got["log_bytes"] == np.log1p(len(raw)) and got["log_words"] == np.log1p(len(words))
        assert np.isclose(got["mean_word"], np.mean([len(w) for w in words])) and np.isclose(got["sd_word"], np.std([len(w) for w in words]))
        assert got["digit_share"] == sum(chr(b).isdigit() for b in raw if b < 128) / len(raw) and got["high_share"] == sum(b > 127 for b in raw) / len(raw)
        assert got["space_share"] == sum(b in b" \t\n\r\v\f" for b in raw) / len(raw)
        assert got["unique_words"] == len(set(words)) / len(words) and got["top_word"] == max(map(words.count, set(words))) / len(words)
        assert got["repeat_next"] == sum(a == b for a, b in zip(words, words[1:])) / len(words)
        assert got["lines_per_word"] == len(lines) / len(words) and got["unique_lines"] == len(set(lines)) / len(lines)
        p = np.array(list(Counter(raw).values())) / len(raw)
        assert np.isclose(got["entropy"], -(p * np.log2(p)).sum())


def test_a_repeated_labelled_id_is_learned_once(spark):
    docs = spark.range(5000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("w "), F.col("id").cast("string")).alias("text"))
    labels = spark.createDataFrame([(7, 1)], "doc_id long, quality int")
    assert np.isclose(quality.fit(docs, labels, trees=1).base, np.log(2))  # one row: (1 + 1) / (1 + 2)


def test_output_names_spare_columns(spark):
    docs = spark.createDataFrame([(1, "the cat", -7.0, "x")], "doc_id long, text string, score double, lang_pred string")
    model = langid.fit(docs.withColumn("lang", F.lit("en")))
    got = langid.identify(docs, model, ("a", "b")).collect()[0]
    assert (got.score, got.lang_pred) == (-7.0, "x") and got.a in ("en", "und")
