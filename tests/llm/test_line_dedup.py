import random

from pitlake.llm import line_dedup


def plain(docs, words):
    """Delete each line of each run that stands, with as many words, at an earlier place; every run is tried."""
    texts = {}
    for d, t in docs:
        if t is not None:
            parts = t.split("\n")
            texts[d] = [(p, x, len(x.split())) for p, x in enumerate(parts) if x.split()]
    first, gone = {}, {d: set() for d in texts}
    for d in sorted(texts):
        lines = texts[d]
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                first.setdefault(tuple(x for _, x, _ in lines[i:j]), (d, i))
    for d, lines in texts.items():
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                if sum(w for *_, w in lines[i:j]) >= words and first[tuple(x for _, x, _ in lines[i:j])] < (d, i):
                    gone[d].update(p for p, *_ in lines[i:j])
    return {d: sorted(g) for d, g in gone.items()}


def test_against_every_run(spark):
    rng = random.Random(4)
    for words in (3, 7):
        docs = []
        for d in range(25):
            lines = [rng.choice(["", " ", *[f"{c} " * rng.choice([1, 1, 2]) for c in "abcde"]]).strip(" ") if rng.random() < 0.9 else "  " for _ in range(rng.randint(0, 14))]
            docs.append((d, "\n".join(lines)))
        docs += [(100, docs[3][1]), (101, None), (102, "")]
        frame = spark.createDataFrame([(d, t, "kept", 5) for d, t in docs], "doc_id long, text string, n_lines string, other int")
        want = plain(docs, words)
        for r in line_dedup.dedup_lines(frame, words).collect():
            t = dict(docs)[r.doc_id]
            assert list(r["cut"]) == want.get(r.doc_id, [])
            assert r.other == 5 and r.n_lines == (0 if t is None else t.count("\n") + 1)
            assert r.text == (None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in want[r.doc_id]))


def test_repeated_rows_and_null_ids(spark):
    body = "one two three\nfour five six"
    rows = [(2, body), (2, body), (None, body), (3, "zero\n" + body + "\nend"), (3, "other text of the id\n" + body)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in line_dedup.dedup_lines(docs, 5).collect()]
    assert sorted(got, key=str) == sorted([(2, ""), (2, ""), (None, body), (3, "zero\nend"), (3, "other text of the id")], key=str)
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0
