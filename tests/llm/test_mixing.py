import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from pitlake.llm import mixing


def aims(sizes):
    """Targets by sharing the excess round by round, in fractions."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full, share = sum(sizes.values()), set(), Fraction(0)
    while True:
        open_ = [s for s in order if s not in full]
        if not open_:
            break
        share = Fraction(total - sum(3 * sizes[s] for s in full), sum(weight[s] for s in open_))
        more = {s for s in open_ if 3 * sizes[s] < weight[s] * share}
        if not more:
            break
        full |= more
    return {s: float(3 * sizes[s]) if s in full else float(weight[s] * share) for s in order}


def docs(spark):
    rows = [(i, " ".join(["w"] * (i * 37 % 200)) + "\t\n", ("b", "a", None, "ü", "z", "tiny")[min(i % 8, 5)] if i % 40 else "tiny") for i in range(600)]
    rows += [(None, "one two", "a")] * 30 + [(7, "\x0bx y\x0c z\x1c", "b")] * 25 + [(8, None, "empty"), (9, "", None), (10, "w " * 60_000, "a")]
    return rows, spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, source string, size int, taken string")


def test_targets_and_takings(spark):
    rows, df = docs(spark)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    totals = {}
    for _, t, s in rows:
        totals[s] = totals.get(s, 0) + size(t)
    want = aims(totals)
    got = mixing.taken(df).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in got) == sorted((d is None, d or 0, size(t)) for d, t, _ in rows)
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    by = {}
    for r in got:
        by[r.source_size, r.target] = by.get((r.source_size, r.target), 0) + r.taken
    assert len(by) == len(totals)
    for s, n in totals.items():
        target, took = next((b, v) for (a, b), v in by.items() if a == n)
        assert target == pytest.approx(want[s], rel=1e-12) and abs(took - want[s]) <= 4 * mixing.BLOCK
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.taken)
    again = mixing.taken(df.repartition(7, "text")).collect()
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_schedule_keeps_every_stretch_at_its_share(spark):
    _, df = docs(spark)
    rows, sources = mixing.placed(df, (5, 2, 1), 3)
    slots = mixing.schedule(sources, 16).orderBy("slot").collect()
    share = {r.rank: r.target for r in sources.collect()}
    total = sum(share.values())
    assert [r.slot for r in slots] == list(range(len(slots)))
    seen = dict.fromkeys(share, 0)
    for i, r in enumerate(slots):
        assert r.turn == seen[r.rank]
        seen[r.rank] += 1
        assert all(abs(n - (i + 1) * share[k] / total) < 4 for k, n in seen.items())


def test_pieces_are_blocks(spark):
    _, df = docs(spark)
    mixed = mixing.mix(df, block=32)
    sums = mixed.groupBy("slot").agg(F.sum("words").alias("n"), F.countDistinct("source").alias("s")).collect()
    assert max(r.n for r in sums) == 32 and sum(r.n < 32 for r in sums) <= 6
    # no word of a document is taken twice in one repeat
    assert mixed.groupBy("row", "repeat", "first").count().where("count > 1").count() == 0


def test_points_are_the_golden_sequence(spark):
    ids = [0, 1, 2, 12345, (1 << 20) + 3, (1 << 39) + 77]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "i long").select(mixing.point(F.col("i"))).collect()]
    assert got == [i * mixing.GOLDEN % (1 << 40) for i in ids]


def test_nothing_to_mix(spark):
    assert mixing.taken(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    blank = spark.createDataFrame([(1, " ", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert sorted(tuple(r) for r in mixing.taken(blank).collect()) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
