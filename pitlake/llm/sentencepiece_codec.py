"""SentencePiece encoding and decoding by a shared-prefix Viterbi search.

A text is cut into marked words (each with the spaces before it, written as U+2581), since no piece crosses into a mark. The
distinct words of a batch are sorted, which lists a trie in depth-first order: the forward states over a
word's prefixes are a stack, kept down to the prefix it shares with the word before. The pieces that end at
a letter are found by an automaton over the pieces, whose state is on the stack too. For a unigram model a
state is the best score of a path to there. A BPE model has no additive score; there a path is open
when each two neighbouring pieces are what merging them anew gives back, and exactly one path is open to
each prefix, so the state is its last piece. Both are the same traversal with another rule for a step.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitlake.llm.common import slices

MARK = "▁"
#: Letters from which a word is searched by itself, with its states in arrays.
LONG = 4096
_BREAK = "﷐"  # a non-character; a batch with one in a text is cut without it


class _States:
    """What encode_words() keeps of each prefix, for one long word: 8 bytes a letter, 16 with scores."""

    def __init__(self, scored: bool):
        self.start, self.piece, self.score = array("i", [0]), array("i", [-2]), array("d", [0.0]) if scored else None

    def __len__(self) -> int:
        return len(self.start)

    def __getitem__(self, i: int) -> tuple[int, int, float]:
        return self.start[i], self.piece[i], 0.0 if self.score is None else self.score[i]

    def append(self, start: int, piece: int, score: float) -> None:
        self.start.append(start)
        self.piece.append(piece)
        if self.score is not None:
            self.score.append(score)


class Codec:
    """Encoder and decoder of one model: pieces with scores, byte pieces for what no piece spells."""

    def __init__(self, pieces: list[str], scores: list[float], special: set[int], byte_of: dict[int, int], unknown: int = 0, bpe: bool = True):
        self.pieces, self.unknown, self.bpe = pieces, unknown, bpe
        self.ids = {p: i for i, p in enumerate(pieces) if i not in special and i not in byte_of}
        self.scores, self.costs = scores, [-x for x in scores]
        self.byte_of, self.byte_ids = byte_of, {b: i for i, b in byte_of.items()}
        self.longest = max(map(len, self.ids), default=1)
        self.special = special
        self._fits: dict[int, bool] = {}
        self._spelled: pa.Array | None = None
        self._known: dict[str, Sequence[int]] = {}
        self.ways: list[dict[str, int]] = []  # the automaton, made when a first text is encoded
        self.floor = min((scores[i] for i in self.ids.values()), default=0.0) - 10.0

    @classmethod
    def load(cls, path: str) -> Codec:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        bytes_ = {i: int(sp.id_to_piece(i)[3:5], 16) for i in range(n) if sp.is_byte(i)}
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        pieces, scores = [sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)]
        if any(MARK in p.lstrip(MARK) for i, p in enumerate(pieces) if i not in special):
            raise ValueError("a piece goes on into another word")
        return cls(pieces, scores, special, bytes_, sp.unk_id(), bpe=_kind(path) == 2)

    def _automaton(self) -> None:
        """Nodes of the trie of all pieces: their ways on, the node of the longest proper suffix, and the pieces that end there."""
        self.ways = [{}]
        ends = [-1]
        for piece, i in self.ids.items():
            node = 0
            for c in piece:
                if (to := self.ways[node].get(c)) is None:
                    to = self.ways[node][c] = len(self.ways)
                    self.ways.append({})
                    ends.append(-1)
                node = to
            ends[node] = i
        self.suffix = [0] * len(self.ways)
        self.ending: list[tuple[tuple[int, int], ...]] = [()] * len(self.ways)  # (length, id), longest first
        level, length = [0], 0
        while level:
            after = []
            length += 1
            for node in level:
                for c, to in self.ways[node].items():
                    if node:
                        self.suffix[to] = self.move(self.suffix[node], c)
                    own = ((length, ends[to]),) if ends[to] >= 0 else ()
                    self.ending[to] = own + self.ending[self.suffix[to]]
                    after.append(to)
            level = after

    def move(self, node: int, c: str) -> int:
        while (to := self.ways[node].get(c)) is None:
            if not node:
                return 0
            node = self.suffix[node]
        return to

    # --- merges: the rule itself, for two pieces at a time and for runs of marks, whose merges tie ---------

    def merge(self, word: str) -> list[int]:
        """Merge neighbours by best score, the leftmost first on ties; what no piece spells stays single."""
        parts: list[str | None] = list(word)
        left, right = array("i", range(-1, len(parts) - 1)), array("i", range(1, len(parts)))
        right.append(-1)
        heap: list[tuple[float, int, int]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (i := self.ids.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (self.costs[i], a, i))

        for a in range(len(parts) - 1):
            offer(a, a + 1)
        while heap:
            _, a, i = heapq.heappop(heap)
            b, whole = right[a], self.pieces[i]
            if parts[a] is None or b < 0 or parts[a] + parts[b] != whole:
                continue
            parts[a], parts[b], right[a] = whole, None, right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [t for p in parts if p is not None for t in self._spell(p)]

    def _spell(self, piece: str) -> list[int]:
        if (i := self.ids.get(piece)) is not None:
            return [i]
        raw = piece.encode("utf-8", "surrogatepass")
        return [self.byte_ids[b] for b in raw] if len(self.byte_ids) == 256 else [self.unknown]

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the letters of two pieces anew gives just these two."""
        key = a << 32 | b
        if (got := self._fits.get(key)) is None:
            if len(self._fits) > 1 << 19:
                self._fits.clear()
            got = self._fits[key] = self.merge(self.pieces[a] + self.pieces[b]) == [a, b]
        return got

    # --- the shared search --------------------------------------------------------------------------------

    def encode_words(self, words: list[str]) -> list[Sequence[int]]:
        """Ids of each of the sorted distinct marked words."""
        if not self.ways:
            self._automaton()
        out, before, move, ending = [], "", self.move, self.ending
        step = self._bpe_step if self.bpe else self._unigram_step
        # of each prefix: the automaton's node, and where the last piece begins, its id (-1: a letter without piece), its
        # score, and the ids up to there, kept for short prefixes only, as copying them takes the square of the length
        nodes, came = [0], [(0, -2, 0.0, ())]
        for word in words:
            if self.bpe and word.startswith(MARK + MARK):
                out.append(self.merge(word))
                continue
            if len(word) >= LONG:
                out.append(self._encode_long(word))
                continue
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del came[shared + 1 :], nodes[shared + 1 :]
            node = nodes[shared]
            for c in word[shared:]:
                node = move(node, c)
                nodes.append(node)
                start, piece, score = step(len(came), ending[node], came)
                path = came[start][3] if start < 40 else None
                if path is not None:
                    path += (piece,) if piece >= 0 else tuple(self._spell(c))
                came.append((start, piece, score, path))
            path, at = came[-1][3], len(word)
            if path is None:
                back = []
                while at > 0:
                    start, piece = came[at][:2]
                    back.append(self._spell(word[start:at]) if piece < 0 else (piece,))
                    at = start
                path = [i for p in reversed(back) for i in p]
            out.append(path)
            before = word
        return out

    def _encode_long(self, word: str) -> array:
        """encode_words() of one word that is too long to be worth sharing its prefixes."""
        step, states, node = self._bpe_step if self.bpe else self._unigram_step, _States(not self.bpe), 0
        for c in word:
            node = self.move(node, c)
            states.append(*step(len(states), self.ending[node], states))
        back, at = array("i"), len(word)
        while at > 0:
            start, piece, _ = states[at]
            back.extend((piece,) if piece >= 0 else reversed(self._spell(word[start:at])))
            at = start
        back.reverse()
        return back

    def _bpe_step(self, end: int, ending: tuple, came: list) -> tuple[int, int, float]:
        known = self._fits
        for length, t in ending:
            prior = came[end - length][1]
            if prior < 0 or (ok if (ok := known.get(prior << 32 | t)) is not None else self.fits(prior, t)):
                return end - length, t, 0.0
        return end - 1, -1, 0.0

    def _unigram_step(self, end: int, ending: tuple, came: list) -> tuple[int, int, float]:
        best = (end - 1, -1, came[end - 1][2] + self.floor)
        for length, t in ending:
            if (s := came[end - length][2] + self.scores[t]) > best[2]:
                best = (end - length, t, s)
        return best

    # --- texts ----------------------------------------------------------------------------------------------

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and how many each has. Null counts as empty; an empty text has none."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        full = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(MARK, pc.replace_substring(texts, " ", MARK), ""))
        if pc.any(pc.match_substring(texts, _BREAK)).as_py():
            import re

            lists = pa.array([re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", t) for t in full.to_pylist()], pa.list_(pa.string()))
        else:
            lists = pc.split_pattern(pc.replace_substring_regex(full, f"{MARK}+", _BREAK + "\\0"), _BREAK)
        words = lists.flatten()
        coded = words.dictionary_encode()
        place, distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        if len(self._known) > 1 << 17:  # words of earlier batches; a bound on memory, not on what is encoded
            self._known.clear()
        known = self._known
        fresh = sorted(w for w in distinct if w not in known)
        known.update(zip(fresh, self.encode_words(fresh)))
        ids = [known[w] for w in distinct]
        for w in fresh:
            if len(w) > 64:  # long words are hardly met again
                del known[w]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.int32, int(sizes.sum()))
        begin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        each = sizes[place] if len(place) else np.zeros(0, np.int64)
        ends = np.cumsum(each)
        at = np.arange(int(each.sum())) - np.repeat(ends - each, each) + np.repeat(begin[place] if len(place) else each, each)
        bounds = np.concatenate([[0], ends])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return flat[at], np.diff(bounds)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: byte pieces make up UTF-8, marks are spaces, the leading one goes, control pieces are silent."""
        raw = b"".join(
            bytes([self.byte_of[i]]) if i in self.byte_of else b"" if i in self.special else self.pieces[i].encode("utf-8", "surrogatepass") for i in ids
        )
        text = raw.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


    def decode_all(self, lists: pa.ListArray) -> pa.Array:
        """decode() of each list; a null list is empty. Pieces are looked up and joined for the whole batch at once."""
        if self._spelled is None:
            spelled = [bytes([self.byte_of[i]]) if i in self.byte_of else b"" if i in self.special else p.encode("utf-8", "surrogatepass") for i, p in enumerate(self.pieces)]
            self._spelled = pa.array(spelled, pa.binary())
        lists = pc.fill_null(lists, pa.scalar([], lists.type)) if lists.null_count else lists
        raw = pc.binary_join(pa.ListArray.from_arrays(pa.array(lists.offsets.to_numpy() - lists.offsets[0].as_py()), self._spelled.take(lists.flatten())), b"")
        try:
            text = pc.replace_substring(raw.cast(pa.string()), MARK, " ")
        except pa.ArrowInvalid:  # byte pieces that make up no UTF-8
            text = pa.array([b.decode("utf-8", "replace").replace(MARK, " ") for b in raw.to_pylist()], pa.string())
        return pc.if_else(pc.starts_with(text, " "), pc.utf8_slice_codeunits(text, 1), text)


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a protocol buffer message; fixed-width values as bytes."""
    at = 0

    def whole() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
            if byte < 128:
                return value

    while at < len(raw):
        key = whole()
        if key & 7 == 0:
            yield key >> 3, whole()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or whole()
            yield key >> 3, raw[at : at + size]
            at += size


def _kind(path: str) -> int:
    """Type of a model file, 1 (unigram) or 2 (merges); ValueError for what encode() does not do.

    That is: other types, text that is normalised or stripped first, no mark before the first word, marks behind words."""
    with open(path, "rb") as f:
        parts = {k: dict(_fields(v)) for k, v in _fields(f.read()) if k in (2, 3)}
    trained, norm = parts.get(2, {}), parts.get(3, {})  # trainer and normaliser settings, defaults where a field is missing
    kind = trained.get(3, 1)
    if kind not in (1, 2) or norm.get(2) or not norm.get(3, 1) or norm.get(4, 1) or trained.get(24, 0):
        raise ValueError("only unigram and merge models that take texts as they are")
    return kind


_LOADED: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _LOADED:
        _LOADED[path] = Codec.load(path)
    return _LOADED[path]


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids (array of int) and n_tokens of every row; model is the path of a model file on each node.

    Null and empty texts have no ids. Repeated rows stay; other columns are left out."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in slices(batches, "text", 6 << 20):
            flat, sizes = c.encode(b.column("text"))
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.record_batch([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(sizes)], ["doc_id", "ids", "n_tokens"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())])
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(encoded, schema)


def decode(rows: DataFrame, model: str) -> DataFrame:
    """rows with the column text decoded from ids (null: empty); a column named text is replaced, others pass through."""
    kept = rows.drop("text")

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                yield pa.record_batch([*part.columns, c.decode_all(part.column("ids"))], [*part.schema.names, "text"])

    return kept.mapInArrow(decoded, T.StructType([*kept.schema.fields, T.StructField("text", T.StringType())]))
