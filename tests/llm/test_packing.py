import random

import numpy as np
from pyspark.sql import functions as F

from pitlake.llm import packing


def plain(items, capacity):
    """Best fit by looking at every bin."""
    bins, out = [], [None] * len(items)
    for i in sorted(range(len(items)), key=lambda i: -items[i][0]):
        n, s, c = items[i]
        fits = [(capacity - sum(items[j][0] for j in b), k) for k, b in enumerate(bins) if sum(items[j][0] for j in b) + n <= capacity and not any((s is not None and items[j][1] == s) or (c is not None and items[j][2] == c) for j in b)]
        if not fits:
            bins.append([])
        k = min(fits)[1] if fits else len(bins) - 1
        out[i] = (k, len(bins[k]))
        bins[k].append(i)
    return out


def test_best_fit_against_every_bin():
    rng = random.Random(1)
    for _ in range(60):
        items = [(rng.randint(1, 20), rng.choice([None, "a", "b", "c", "d"]), rng.choice([None, *"pqrstu"])) for _ in range(rng.randint(0, 60))]
        assert packing.best_fit(items, 20) == plain(items, 20)


def test_pack_is_whole_and_keeps_apart(spark):
    rows = [(i, "w " * (i % 300), f"s{i % 3 if i % 2 else 0}", i) for i in range(400)]
    rows += [(None, "x y", None, 0), (7, "w " * 7, "s7", 1), (7, "w " * 7, "s7", 1), (900, None, "s1", 2), (901, "", None, 3), (902, "long " * 1000, "s1", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, bin_id int")
    got = packing.pack(docs, capacity=256, chunk=100).collect()
    assert sum(r.length for r in got) == sum(len((t or "").split()) for _, t, _, _ in rows)
    source = {i: s for i, _, s, _ in rows[:400]}
    bins = {}
    for r in got:
        if r.bin_id is None:
            assert r.length == 0
        else:
            bins.setdefault(r.bin_id, []).append(r)
    for inside in bins.values():
        assert sum(r.length for r in inside) <= 256
        assert sorted(r.slot for r in inside) == list(range(len(inside)))
        known = [source[r.doc_id] for r in inside if r.doc_id in source and r.doc_id != 7]
        assert len(known) == len(set(known))
    long = sorted((r.piece, r.start, r.length) for r in got if r.doc_id == 902)
    assert long == [(0, 0, 256), (1, 256, 256), (2, 512, 256), (3, 768, 232)]
    assert len({r.bin_id for r in got if r.doc_id == 902}) == 4


def test_copies_stay_apart_and_nothing_is_empty(spark):
    docs = spark.createDataFrame([(i, "same  text" if i % 2 else "Same text", f"s{i}") for i in range(6)], "doc_id long, text string, source string")
    assert packing.pack(docs).select("bin_id").distinct().count() == 6
    assert packing.pack(docs.limit(0)).count() == 0
    assert packing.pack(docs, cluster=F.lit(None)).select("bin_id").distinct().count() == 1


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_near_groups_against_every_pair():
    rng = random.Random(3)
    for _ in range(40):
        sets = []
        for _ in range(60):
            if sets and rng.random() < 0.6:
                base = set(rng.choice(sets))
                sets.append(set(sorted(base)[rng.randint(0, 3) :]) | {rng.randrange(200) for _ in range(rng.randint(0, 3))})
            else:
                sets.append({rng.randrange(200) for _ in range(rng.randint(0, 40))})
        root = list(range(60))
        for i in range(60):
            for j in range(i):
                if sets[i] and sets[j] and jaccard(sets[i], sets[j]) >= 0.8:
                    a, b = sorted((root[i], root[j]))
                    root = [a if r == b else r for r in root]
        assert packing.near_groups([np.array(sorted(x), np.uint64) for x in sets]) == root
    assert packing.near_groups([]) == []


def test_near_copies_stay_apart(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(12):
        words = [f"w{rng.randrange(500)}" for _ in range(80)]
        for k in range(4):
            texts.append(" ".join([*words[k:], *[f"new{k}{i}" for i in range(k)]]))
    docs = spark.createDataFrame([(i, t, f"s{i}") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    shingles = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    bins = {}
    for r in packing.pack(docs).collect():
        bins.setdefault(r.bin_id, []).append(r.doc_id)
    assert len(bins) == 4
    assert not [(i, j) for b in bins.values() for i in b for j in b if i < j and jaccard(shingles[i], shingles[j]) >= 0.8]


def test_repeated_rows_are_dealt_to_many_chunks(spark):
    docs = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b").alias("text"), F.lit(None).cast("string").alias("source"))
    got = packing.pack(docs, chunk=100, cluster=F.lit(None)).collect()
    per = {}
    for r in got:
        per[r.bin_id >> 32] = per.get(r.bin_id >> 32, 0) + 1
    assert len(got) == 3000 and len(per) == 30 and max(per.values()) < 250


def test_shingles_against_sets_of_words():
    rng = random.Random(8)
    texts = [" ".join(rng.choice("aBcDe") for _ in range(rng.randint(0, 9))) for _ in range(200)]
    sets, own = packing.Shingles(), [t.lower().split() for t in texts]
    got = [frozenset(sets.of(t).tolist()) for t in texts]
    want = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset() for w in own]
    for i in range(200):
        for j in range(i):
            assert len(got[i] & got[j]) == len(want[i] & want[j])


def test_long_texts_are_hashed_in_parts():
    rng = random.Random(2)
    for _ in range(30):
        text = "".join(rng.choice("ab\u00e9\u3000 \t\n") for _ in range(rng.randint(0, 400)))
        want = packing.Shingles().of(text).tolist()
        for step in (1, 3, 50):
            assert packing.Shingles(step=step).of(text).tolist() == want
    assert len(packing.Shingles().hashes("word " * 3_000_000)) == 3_000_000
    assert len(packing.Shingles().of("w" * 20_000_000)) == 1


def test_chunks_are_bounded_by_bytes(spark):
    docs = spark.range(200).selectExpr("id AS doc_id", "repeat(concat('w', id, ' '), 2000) AS text", "concat('s', id) AS source")
    per = {}
    for r in packing.pack(docs, chunk_bytes=100_000).collect():
        per.setdefault(r.bin_id >> 32, set()).add(r.doc_id)
    assert len(per) >= 15 and sum(map(len, per.values())) == 200
    assert len({r.bin_id >> 32 for r in packing.pack(docs, chunk_bytes=100_000, cluster=F.lit(None)).collect()}) == 1
