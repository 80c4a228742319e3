import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from pitlake.llm import common, simhash


def print_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps):
    """Smallest id reachable, by comparing all pairs."""
    ids = list(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_fingerprint():
    for t in (None, "", " \n", "One", "one TWO", "Ä ß\x0bc d e e e e", "a b c " * 50, "x\xa0y z w"):
        assert simhash.fingerprint(simhash.hashes(t)) == print_of(t)


@pytest.mark.parametrize("dense", [2, 32])
def test_links_and_components_against_all_pairs(spark, dense):
    rng = random.Random(dense)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for f in fps[:20]:  # chains of one to three bits a step
        for _ in range(rng.randint(1, 12)):
            for _ in range(rng.randint(1, 3)):
                f ^= 1 << rng.randrange(64)
            fps.append(f)
    fps = list(dict.fromkeys(fps))
    signed = {i: f - (1 << 64) if f >> 63 else f for i, f in enumerate(fps)}
    frame = spark.createDataFrame([(f,) for f in signed.values()], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(frame, dense)).collect()}
    want = components(dict(enumerate(fps)))
    group = {}
    for i in want:
        group.setdefault(want[i], set()).add(signed[i])
    for members in group.values():
        assert len(members) == 1 or {roots[m] for m in members} == {min(members)}
        if len(members) == 1:
            assert roots.get(*members, *members) == next(iter(members))


def test_near_duplicates(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    extra = [(5000, None), (5001, ""), (None, "\t"), (None, "left alone here"), (5002, "left alone here"), (5002, "left alone here")]
    both = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string")).withColumn("fp", F.lit("clash"))
    got = simhash.near_duplicates(both).collect()
    assert len(got) == both.count()
    fps = {r.doc_id: print_of(r.text) for r in both.where("doc_id is not null").collect()}
    want = components(fps)
    for r in got:
        if r.doc_id is not None:
            assert (r.fingerprint, r.component_id) == (f"{fps[r.doc_id]:016x}", want[r.doc_id])
    assert {r.component_id for r in got if r.doc_id is None} == {5000, 5002}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_cut_survives_reading_twice(spark):
    df = common.cut(spark.range(10).withColumn("a", F.array("id")), "t")
    assert df.count() == df.count() == 10
    assert common.release(spark) >= 1 and common.release(spark) == 0
