import os
import random

import pyarrow as pa
import pytest

from pitlake.llm import sentencepiece_codec as sc
from pitlake.llm.queries import MODEL

ODD = [
    "", "hello world", "a  b", " x", "x ", "\n\n", "Ｆullｗidth é é", "a\xa0b", "日本語 <s> </s> <unk> <0x0A>", "a\x00b", "▁x",
    "tab\there", "    def f(x):\n        return  x", "   ", "﷐ a b", "naïve Grüße мир 你好世界 " + "a" * 500,
    "x" * 1000 + " " * 40 + "y", "the ▁▁ of", "aaaaaaaab bbbbaaa", "🎉🎉 ok", "w" * 50_000,
    "naïve🎉Größe" * 1000 + " " + "ab" * 3000, "a" * 4094 + " " + "a" * 4095, " " * 5000 + "x",
]

needs_model = pytest.mark.skipif(not os.path.exists(MODEL), reason="no model file")


def ids_of(codec, texts):
    flat, sizes = codec.encode(pa.array(texts, pa.string()))
    out, at = [], 0
    for n in sizes:
        out.append(flat[at : at + n].tolist())
        at += n
    return out


@needs_model
def test_same_as_the_library_and_round_trip(spark, sf):
    import sentencepiece

    sp, codec = sentencepiece.SentencePieceProcessor(model_file=MODEL), sc.Codec.load(MODEL)
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect() if r.text]
    for text, mine in zip(texts, ids_of(codec, texts)):
        want = sp.encode(text)
        assert mine == want, text[:60]
        assert codec.decode(mine) == text.replace("▁", " ") == sp.decode(want)


def test_unigram_is_the_best_path():
    rng = random.Random(3)
    pieces = ["<unk>", *sorted({"".join(rng.choice("ab▁") for _ in range(rng.randint(1, 4))).replace("▁", "") or "a" for _ in range(12)} | {"a", "b", "▁", "▁a", "▁ab"})]
    scores = [0.0] + [-rng.random() * 5 for _ in pieces[1:]]
    codec = sc.Codec(pieces, scores, {0}, {}, 0, bpe=False)

    def best(word):
        if not word:
            return 0.0
        return max((codec.scores[codec.ids[word[:k]]] + best(word[k:]) for k in range(1, len(word) + 1) if word[:k] in codec.ids), default=float("-inf"))

    words = sorted({"▁" + "".join(rng.choice("ab") for _ in range(rng.randint(0, 9))) for _ in range(60)})
    for word, ids in zip(words, codec.encode_words(words)):
        assert "".join(pieces[i] for i in ids) == word
        assert abs(sum(scores[i] for i in ids) - best(word)) < 1e-9
        assert codec._encode_long(word).tolist() == list(ids)


@needs_model
def test_memory_of_a_long_word():
    import tracemalloc

    codec, rng = sc.Codec.load(MODEL), random.Random(5)
    word = sc.MARK + "".join(rng.choice("abcdefghij") for _ in range(200_000))
    codec.encode_words([word[:5000]])
    tracemalloc.start()
    ids = codec.encode_words([word])[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert "".join(codec.pieces[i] for i in ids) == word
    assert peak < 80 * len(word)


@needs_model
def test_decoding_of_whole_batches():
    codec = sc.Codec.load(MODEL)
    lists = [*ids_of(codec, ODD), [], [198], [3, 258, 1], [codec.byte_ids[0xE2], 28705]]
    both = pa.array([*lists, None], pa.list_(pa.int32()))
    assert codec.decode_all(both).to_pylist() == [*map(codec.decode, lists), ""]
    assert codec.decode_all(both.slice(3, 5)).to_pylist() == [codec.decode(x) for x in lists[3:8]]


@needs_model
def test_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 1), (None, None, 2), (2, "", 3), (2, "", 3), (3, "c" * 3000, 4)], "doc_id long, text string, ids int")
    got = sc.decode(sc.encode(docs, MODEL), MODEL).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted([("1", "a b"), ("None", ""), ("2", ""), ("2", ""), ("3", "c" * 3000)])
    assert all(r.n_tokens == len(r.ids) for r in got)
    assert sc.encode(docs.limit(0), MODEL).count() == 0
