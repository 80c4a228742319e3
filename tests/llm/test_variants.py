import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pitlake.llm import variants


def words_of(rows):
    """Counts of the runs after the planted deletions, one run at a time."""
    out = Counter()
    lower = {c: c + 32 for c in range(65, 91)}
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            out[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def plain(counts):
    out = {}
    for w, n in counts.items():
        by = sorted((-counts[x], x) for x in counts if near(w, x))
        good = by and -by[0][0] >= 5 * n
        out[w] = [by[0][1] if good else None, n, len(by), -by[0][0] if good else None]
    for w in out:
        last = w
        while out[last][0]:
            last = out[last][0]
        out[w].insert(1, last)
    return {w: tuple(v) for w, v in out.items()}


def found(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_words_on_texts(spark):
    rng = np.random.default_rng(3)
    stems = ["Garden", "gardens", "Übermut", "übermut", "ÜBERMUT", "straße1straße", "çaççaç", "market", "markets", "x×y÷zz", "short"]
    rows = [(int(k) if k % 7 else None, " ".join(rng.choice(stems, 40))) for k in range(60)]
    rows += [(1, None), (2, ""), (3, "-- 12 !"), (3, "gardens"), (3, "gardens")]
    docs = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "doc_id long, text string, n int, word string")
    counts = variants.counted_words(docs)
    assert {r.word: r.n for r in counts.collect()} == words_of(rows)
    assert found(variants.variants(counts)) == plain(words_of(rows))


def test_long_texts_are_cut_between_words(spark):
    text = "winter " * 40_000 + "w" * 200_000 + " 𝔘𝔫" * 30_000 + "winters"
    rows = [(k, text) for k in range(1, 6)]
    got = variants.counted_words(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.word: r.n for r in got.collect()} == words_of(rows)


@pytest.mark.parametrize("cell", [2, 7, 2048])
def test_near_words_against_all_pairs(spark, cell):
    """Small cells build deep tops and cut cells of anagrams into blocks."""
    rng = np.random.default_rng(5)
    words = {"".join(rng.choice(list("abcé"), rng.integers(4, 8))) for _ in range(260)}
    words |= {"".join(rng.permutation(list("abcdefg"))) for _ in range(60)} | {"abcdefg"[:i] + "h" + "abcdefg"[i:] for i in range(8)}
    counts = {w: int(rng.choice([5, 6, 30, 160, 900, 5000])) for w in sorted(words)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = found(variants.variants(df, sample=200, cell=cell))
    assert got == plain(counts)


def test_chains_ties_and_nothing(spark):
    counts = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "zzzzzz": 7, "zzzzzy": 40, "zzzzzx": 40}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = found(variants.variants(df))
    assert got == plain(counts)
    assert got["aaaaaa"] == ("aaaaab", "aaabbb", 5, 1, 25) and got["zzzzzz"][0] == "zzzzzx"
    none = spark.createDataFrame([], "doc_id long, text string")
    assert variants.variants(variants.counted_words(none)).count() == 0
