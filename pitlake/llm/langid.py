"""Language ID: multinomial naive Bayes over hashed character n-grams; languages are equally likely beforehand unless fit() is asked for their shares.

Log probabilities are one matrix (buckets x languages), broadcast to the tasks. A batch of texts is hashed
in one numpy pass; the rows of the matrix that its n-grams hit are summed for each text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitlake.llm.common import holdout, slices

UNDETERMINED = "und"
ORDERS = 3
_LETTER = None


def _letters() -> np.ndarray:
    """For each code point, itself if it is a letter and a space if not."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((i if chr(i).isalpha() else 32 for i in range(0x110000)), np.uint32, 0x110000)
    return _LETTER


def grams(texts: list[str | None], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed 1- to ORDERS-grams of all texts, the number of the text that each is of, and whether each text has a letter.

    Case is folded, what is no letter counts as a space, and runs of spaces as one; each text is set between spaces."""
    low = [" " + t.lower() + " " if t else " " for t in texts]
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(low), dtype=np.int32), [len(t) for t in low])
    points = _letters()[points]
    space = points == 32
    keep = np.ones(len(points), bool)
    keep[1:] = ~(space[1:] & space[:-1] & (owner[1:] == owner[:-1]))
    points, owner = points[keep], owner[keep]
    has = np.zeros(len(low), bool)
    has[owner[points != 32]] = True
    hashed, of, h = [], [], np.zeros(len(points), np.uint32)
    for n in range(ORDERS):
        m = len(points) - n
        if m <= 0:
            break
        h = h[:m] * np.uint32(0x9E3779B1) + points[n:] * np.uint32(0x85EBCA6B) + np.uint32(n)
        same = owner[:m] == owner[n:]
        x = h ^ (h >> np.uint32(15))
        hashed.append((x & np.uint32(buckets - 1))[same])
        of.append(owner[:m][same])
    return np.concatenate(hashed) if hashed else np.zeros(0, np.uint32), np.concatenate(of) if of else np.zeros(0, np.int32), has


#: Characters of a text that are hashed at once; a longer text is hashed in chunks.
LONG = 1 << 20


def long_grams(text: str, buckets: int, size: int = LONG) -> Iterator[tuple[np.ndarray, bool]]:
    """The hashed n-grams of one text, chunk by chunk, and whether the chunk has a letter: in all, those of grams() of the whole text.

    Chunks end after a space where there is one; the last characters are carried on, so that n-grams across chunks count."""
    carried, start = np.array([32], np.uint32), 0
    while start <= len(text):
        end = len(text) if start + size >= len(text) else text.rfind(" ", start, start + size) + 1 or start + size
        piece = text[start:end].lower() + (" " if end == len(text) else "")
        points = _letters()[np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)]
        space = np.concatenate([carried[-1:], points]) == 32
        points = points[~(space[1:] & space[:-1])]
        both, h, out = np.concatenate([carried, points]), np.zeros(len(carried) + len(points), np.uint32), []
        for n in range(min(ORDERS, len(both))):
            m = len(both) - n
            h = h[:m] * np.uint32(0x9E3779B1) + both[n:] * np.uint32(0x85EBCA6B) + np.uint32(n)
            x = h ^ (h >> np.uint32(15))
            # those within the carried characters have been counted, but for the first space
            out.append((x & np.uint32(buckets - 1))[max(0, len(carried) - n) if start else 0 :])
        yield np.concatenate(out), bool((points != 32).any())
        carried, start = both[-(ORDERS - 1) :], end if end < len(text) else len(text) + 1


@dataclass
class Bayes:
    langs: list[str]
    logp: np.ndarray  # buckets x languages
    prior: np.ndarray | None = None  # log shares of the languages; all alike if not given

    def totals(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each text and language, and whether each text has a letter."""
        large = [i for i, t in enumerate(texts) if t and len(t) > LONG]
        hits, of, has = grams([None if i in large else t for i, t in enumerate(texts)] if large else texts, len(self.logp))
        total = np.stack([np.bincount(of, self.logp[:, k][hits], len(texts)) for k in range(len(self.langs))], axis=1) if self.langs else np.zeros((len(texts), 0))
        for i in large:
            total[i] = 0
            for found, letters in long_grams(texts[i], len(self.logp)):
                has[i] |= letters
                total[i] += np.bincount(found, minlength=len(self.logp)).astype(float) @ self.logp
        return total if self.prior is None else total + self.prior, has

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text and its posterior; UNDETERMINED and 0 for a text without letters."""
        if not self.langs:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        total, has = self.totals(texts)
        best = total.argmax(1)
        share = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        return [self.langs[k] if ok else UNDETERMINED for k, ok in zip(best, has)], np.where(has, share, 0.0)


def fit(docs: DataFrame, max_docs_per_lang: int = 2000, most_langs: int = 1024, buckets: int = 1 << 15, alpha: float = 0.5, prior: bool = False) -> Bayes:
    """Learn from text and non-null lang of documents outside the hold-out.

    max_docs_per_lang bounds the sample: of a language with more documents, each is taken with the chance that gives
    as many, by a hash of its id. Every language is learned; more than most_langs raise ValueError, as the model (256 kB a language) goes to
    each task. prior: whether the languages' shares of the documents count beforehand. Rows without an id are not learned from. The counts that
    tasks return are one row of `buckets` numbers for each language and task."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~holdout(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(most_langs + 1).collect()}
    if len(sizes) > most_langs:
        raise ValueError(f"more than {most_langs} languages")
    shares = {lang: min(1.0, max_docs_per_lang / n) for lang, n in sizes.items()}
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)).cast("double") / (1 << 32)
    share = F.try_element_at(F.create_map(*[F.lit(x) for pair in shares.items() for x in pair]), F.col("lang")) if shares else F.lit(0.0)
    rows = known.where(spread < share).select("text", "lang")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in slices(batches, "text"):
            langs = b.column("lang").to_pylist()
            names = sorted(set(langs))
            at = np.array([names.index(x) for x in langs], np.int64)
            texts = b.column("text").to_pylist()
            large = [i for i, t in enumerate(texts) if len(t) > LONG]
            hits, of, _ = grams([None if i in large else t for i, t in enumerate(texts)] if large else texts, buckets)
            # a null stands for a single space, which a large text has no further
            grid = np.bincount(at[of] * buckets + hits, minlength=len(names) * buckets).reshape(-1, buckets)
            for i in large:
                grid[at[i]] -= np.bincount(grams([None], buckets)[0], minlength=buckets)
                for part, _ in long_grams(texts[i], buckets):
                    grid[at[i]] += np.bincount(part, minlength=buckets)
            for name, row in zip(names, grid):
                sums[name] = sums.get(name, 0) + row
        for name, row in sums.items():
            some = np.flatnonzero(row)
            yield pa.record_batch([pa.array([name] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(row[some].astype(np.int64))], ["lang", "bucket", "n"])

    found = rows.mapInArrow(counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = found.column("lang").to_pylist()
    langs = sorted(set(names))
    counts = np.zeros((buckets, len(langs)))
    if langs:
        place = {x: k for k, x in enumerate(langs)}
        counts[found.column("bucket").to_numpy(), [place[x] for x in names]] = found.column("n").to_numpy()
    smooth = counts + alpha
    seen = np.array([sizes[x] for x in langs], float)
    return Bayes(langs, np.log(smooth / smooth.sum(0, keepdims=True)) if langs else counts, np.log(seen / seen.sum()) if prior and langs else None)


def identify(docs: DataFrame, model: Bayes, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Add lang_pred and score, or the given names, to every row of docs; columns named alike are replaced, repeated rows stay.

    A text that is null or has no letter gets UNDETERMINED and 0; equally likely languages go to the first name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages doubles: 1 MB for four languages, 256 MB at most
    kept = docs.drop(*names)
    schema = T.StructType([*kept.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 20):
            langs, share = shared.value.predict(b.column("text").to_pylist())
            yield pa.record_batch([*b.columns, pa.array(langs, pa.string()), pa.array(share)], [*b.schema.names, *names])

    return kept.mapInArrow(named, schema)
