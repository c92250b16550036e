"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding keeps an agenda of adjacent symbol pairs ordered by vocabulary score, then by position, and merges the best
pair until none is left; characters outside the vocabulary fall back to their UTF-8 byte pieces. Short words take their turns together: each row of an
array is the agenda of one word, and each turn merges every word's best pair. A text is cut where
no vocabulary piece can span the cut (before a space mark that follows another character), so equal words of a list of texts are
merged once, and those that come again in later lists are remembered. Every new word of an Arrow batch is checked against the sentencepiece library before it is used
(and whole texts are, in the tests): ``agrees`` says whether the library's ids are equal for all of a text's words. The
library decodes the ids.

Edge cases: null and empty texts give no ids and an empty decoded text; very long words use the same heap, in
n log n; texts of any length are encoded whole; repeated rows each get a row; pairs of equal score merge from the left; an
empty table gives an empty result; a kept column that is named like a result is called ``<name>_kept``.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameline.llm.common import arrow_rows, kept, release_memory, written

MARK = "▁"
SHORT, NEVER = 24, float("inf")
REMEMBERED = 250_000  # words that one Python worker remembers at most, besides those of the texts at hand; beyond it the memory starts anew
SEEN = 1 << 22  # hashes of words that were met once; a word is remembered from its second list of texts on


class MergeVocabulary:
    """Pieces, scores and byte pieces of a merge-type model, read through the library."""

    def __init__(self, model):
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.ids = {pieces[i]: i for i in plain}
        self.costs = {pieces[i]: -model.get_score(i) for i in plain}
        self.bytes = {int(pieces[i][1:-1], 16): i for i in range(n) if model.is_byte(i)}
        self.unknown = model.unk_id()
        spans = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        self.cut = None if spans else re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self._number_pairs()

    def _number_pairs(self) -> None:
        """Numbers for pieces and their characters, and the pairs of these that are pieces, by sorted keys. A pair's rank is that of the piece's score."""
        single = sorted(set("".join(self.ids)))
        symbols = list(dict.fromkeys([*self.ids, *single]))
        number = {s: k for k, s in enumerate(symbols)}
        self.none = len(symbols)  # past a word's end; a character in no piece has the numbers behind
        self.id_of = np.array([*(self.ids.get(s, -1) for s in symbols), -1], np.int32)
        self.points = np.array([*map(ord, single), 1 << 31], np.int64)
        self.of_point = np.array([*(number[c] for c in single), self.none])
        scores = sorted({self.costs[p] for p in self.ids})
        self.no_pair, rank = len(scores), {c: k for k, c in enumerate(scores)}
        pairs = sorted(((left << 32) + right, rank[self.costs[p]], number[p]) for p in self.ids for i in range(1, len(p)) if (left := number.get(p[:i])) is not None and (right := number.get(p[i:])) is not None)
        self.pair_keys = np.array([*(k for k, _, _ in pairs), np.iinfo(np.int64).max], np.int64)
        self.pair_ranks = np.array([*(r for _, r, _ in pairs), self.no_pair], np.int32)
        self.pair_made = np.array([*(m for _, _, m in pairs), self.none])

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols, ``no_pair`` where they are no piece."""
        keys = (left << 32) + right
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], self.no_pair)

    def merge_all(self, words: list[str]) -> list[bytes]:
        """Packed ids of many words, as ``merge`` gives them one by one."""
        out: list[bytes | None] = [None] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        for low, high in pairwise((0, 6, 9, 12, 16, SHORT)):  # few symbols are padded
            chosen = order[np.searchsorted(sizes[order], low, "right") : np.searchsorted(sizes[order], high, "right")].tolist()
            for k, ids in zip(chosen, self._merge_block([words[k] for k in chosen]) if chosen else [], strict=True):
                out[k] = ids
        return [array("i", self.merge(w)).tobytes() if ids is None else ids for w, ids in zip(words, out, strict=True)]

    def _merge_block(self, words: list[str]) -> list[bytes | None]:
        """The agendas of words of up to ``SHORT`` symbols, turn by turn; None for words that keep a character which is in pieces but none itself."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        at = np.searchsorted(self.points, points)
        sym = np.full((len(words), int(sizes.max())), self.none)
        sym[np.arange(sym.shape[1]) < sizes[:, None]] = np.where(self.points[at] == points, self.of_point[at], self.none + 1 + points)
        ended, rows = np.full_like(sym, self.none), np.arange(len(words))
        rank = self._ranks(sym[:, :-1], sym[:, 1:])
        while rank.size:
            best = rank.argmin(axis=1)  # the leftmost of equal ones
            live = rank[np.arange(rows.size), best] < self.no_pair
            ended[rows[~live], : sym.shape[1]] = sym[~live]
            rows, best, sym, rank = rows[live], best[live], sym[live], rank[live]
            each, places = np.arange(rows.size), np.arange(sym.shape[1] - 1)
            made = self.pair_made[np.searchsorted(self.pair_keys, (sym[each, best] << 32) + sym[each, best + 1])]
            sym = np.take_along_axis(sym, places + (places > best[:, None]), axis=1)
            sym[each, best] = made
            places = places[:-1]
            rank = np.take_along_axis(rank, places + (places >= best[:, None]), axis=1)
            for k in (best - 1, best):  # the pairs on both sides of what was made
                own = np.flatnonzero((k >= 0) & (k < places.size))
                rank[own, k[own]] = self._ranks(sym[own, k[own]], sym[own, k[own] + 1])
        ended[rows, : sym.shape[1]] = sym  # one symbol is left
        ids = self.id_of[np.minimum(ended, self.none)]
        there = ended != self.none
        packed, ends = ids[there].tobytes(), np.cumsum([0, *there.sum(axis=1) * 4]).tolist()
        out = [packed[i:j] for i, j in pairwise(ends)]
        for k in np.flatnonzero((there & (ids < 0)).any(axis=1)).tolist():
            row = ended[k][there[k]].tolist()
            known = all(s > self.none or self.id_of[s] >= 0 for s in row)
            out[k] = array("i", self._pieces_of(row)).tobytes() if known else None
        return out

    def _pieces_of(self, row: list[int]) -> list[int]:
        """Ids of numbered symbols; characters in no piece by their bytes."""
        out = []
        for s in row:
            if s < self.none:
                out.append(int(self.id_of[s]))
            else:
                self._spell(chr(s - self.none - 1), out)
        return out

    def _spell(self, symbol: str, out: list[int]) -> None:
        if self.bytes:
            out += [self.bytes[b] for b in symbol.encode("utf-8")]
        elif not out or out[-1] != self.unknown:
            out.append(self.unknown)

    def merge(self, word: str) -> list[int]:
        """Ids of one stretch of text, by the agenda of adjacent pairs."""
        costs = self.costs
        n = len(word)
        if n <= SHORT:
            return self._pieces(self._merge_short(word))
        sym = list(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            pair = sym[i] + sym[i + 1]
            if (s := costs.get(pair)) is not None:
                agenda.append((s, i, pair))
        heapq.heapify(agenda)
        while agenda:
            _, i, pair = heapq.heappop(agenda)
            left = sym[i]
            if left is None or (j := after[i]) >= n or left + sym[j] != pair:
                continue
            sym[i], sym[j] = pair, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                grown = pair + sym[k]
                if (s := costs.get(grown)) is not None:
                    heapq.heappush(agenda, (s, i, grown))
            h = before[i]
            if h >= 0:
                grown = sym[h] + pair
                if (s := costs.get(grown)) is not None:
                    heapq.heappush(agenda, (s, h, grown))
        return self._pieces([s for s in sym if s is not None])

    def _merge_short(self, word: str) -> list[str]:
        """The same agenda as a plain list, which is faster for a few symbols."""
        cost = self.costs.get
        sym = list(word)
        agenda = [cost(word[i : i + 2], NEVER) for i in range(len(word) - 1)]
        while agenda and (best := min(agenda)) != NEVER:
            i = agenda.index(best)
            sym[i] = pair = sym[i] + sym.pop(i + 1)
            agenda.pop(i)
            if i:
                agenda[i - 1] = cost(sym[i - 1] + pair, NEVER)
            if i < len(agenda):
                agenda[i] = cost(pair + sym[i + 1], NEVER)
        return sym

    def _pieces(self, sym: list[str]) -> list[int]:
        ids, out = self.ids, []
        try:
            return [ids[s] for s in sym]
        except KeyError:
            pass  # some symbols need their bytes
        for s in sym:
            if (i := ids.get(s)) is not None:
                out.append(i)
            else:
                self._spell(s, out)
        return out


class Codec:
    """Encodes and decodes lists of texts; remembers words that come again."""

    def __init__(self, body: bytes, remembered: int = REMEMBERED):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=body)
        self.vocabulary = MergeVocabulary(self.model)
        self.words: dict[str, bytes] = {}
        self.differ: set[str] = set()
        self.seen, self.n_seen = bytearray(SEEN), 0
        self.remembered = remembered

    def normalized(self, texts: list[str]) -> list[str]:
        return [self.model.normalize(t) for t in texts]

    def met_before(self, word: str) -> bool:
        """Whether the word's hash was met; most words of a corpus come once, and would take most of the memory."""
        at = hash(word) & (SEEN - 1)
        if self.seen[at]:
            return True
        self.seen[at] = 1
        self.n_seen += 1
        return False

    def remember(self, words: set[str]) -> list[str]:
        """Merges words and checks them against the library, which puts a mark before what it is given. Gives the words to ``forget`` after their texts."""
        new = [w for w in words if w not in self.words]
        if len(self.words) + len(new) > self.remembered:
            self.words = {w: self.words[w] for w in words if w in self.words}
        ours = self.vocabulary.merge_all(new)
        theirs = [self.library_ids(w) if not w.strip(MARK) else ids for w, ids in zip(new, self.model.encode([w.removeprefix(MARK) for w in new], num_threads=1), strict=True)]
        self.words.update(zip(new, ours, strict=True))
        self.differ.update(w for w, a, b in zip(new, ours, theirs, strict=True) if a != array("i", b).tobytes())
        if self.n_seen > SEEN // 4:
            self.seen, self.n_seen = bytearray(SEEN), 0
        return [w for w in new if not self.met_before(w)]

    def forget(self, words: list[str]) -> None:
        for w in words:
            del self.words[w]

    def library_ids(self, marks: str) -> list[int]:
        """The library's ids of space marks at a text's end; it gives none for the empty text that would put one mark before itself."""
        return self.model.encode("a" + " " * len(marks))[len(self.model.encode("a")) :]

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        """Ids of each text, and whether the library agrees with the agenda; where it does not, the ids are the library's. Words are kept as packed ids and joined, not copied id by id."""
        marked = self.normalized(texts)
        if (cut := self.vocabulary.cut) is None:
            ours = [np.array(self.vocabulary.merge(m), np.int32) for m in marked]
            return self.settled(texts, ours, [a.tolist() == b for a, b in zip(ours, self.model.encode(texts, num_threads=1), strict=True)])
        parts = [cut.findall(m) for m in marked]
        once = self.remember(set().union(*parts))
        ours = [np.frombuffer(b"".join(map(self.words.__getitem__, p)), np.int32) for p in parts]
        agrees = [not self.differ or self.differ.isdisjoint(p) for p in parts]
        self.forget(once)
        return self.settled(texts, ours, agrees)

    def settled(self, texts: list[str], ours: list[np.ndarray], agrees: list[bool]) -> tuple[list[np.ndarray], list[bool]]:
        """The library's ids of texts where it may not agree."""
        return [a if ok else np.array(self.model.encode(t, num_threads=1), np.int32) for t, a, ok in zip(texts, ours, agrees, strict=True)], agrees


_CODECS: dict[tuple[str, int], Codec] = {}


def codec(body: bytes, remembered: int = REMEMBERED) -> Codec:
    """One codec for each model and Python worker, which Spark uses for many tasks."""
    key = (hashlib.sha256(body).hexdigest(), remembered)
    if key not in _CODECS:
        _CODECS[key] = Codec(body, remembered)
    return _CODECS[key]


def slices(texts: pa.Array, limit: int = 256 << 10) -> Iterator[list[str]]:
    """Null as empty, in lists of about ``limit`` characters."""
    part, size = [], 0
    for t in texts:
        part.append(t.as_py() or "")
        size += len(part[-1])
        if size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode_pieces(docs: DataFrame, text: str, model_path: str, keep: Sequence[str] = (), remembered: int = REMEMBERED) -> DataFrame:
    """``keep`` columns, ``ids`` (array of int), ``decoded`` (string) and ``agrees`` for each row. Fewer words ``remembered`` take less memory and more time, with the same result."""
    with open(model_path, "rb") as f:
        body = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file, a few MB
    chosen = docs.select(*kept(keep, ["ids", "decoded", "agrees", "__text"]), F.col(text).alias("__text"))
    keep = chosen.columns[:-1]
    fields = [chosen.schema[k] for k in keep]
    schema = T.StructType([*fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType()), T.StructField("agrees", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(body.value, remembered)
        for batch in batches:
            at = 0
            for part in slices(batch.column("__text")):
                ours, agrees = own.encode(part)
                decoded = own.model.decode([a.tolist() for a in ours], num_threads=1)
                ends = np.cumsum([0, *map(len, ours)])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ours), pa.int32()))
                rows = batch.slice(at, len(part))
                at += len(part)
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(k) for k in keep), ids, pa.array(decoded, pa.string()), pa.array(agrees, pa.bool_())],
                    names=[*keep, "ids", "decoded", "agrees"],
                )
        release_memory()

    return chosen.mapInArrow(run, schema)


def piece_digests(encoded: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Lengths and SHA-256 digests of the ids and of the decoded text, computed by Spark."""
    return encoded.select(
        *keep,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "agrees",
    )


def text_digests(docs: DataFrame, text: str, model_path: str, keep: Sequence[str], remembered: int = REMEMBERED) -> DataFrame:
    """``piece_digests`` of each row's text as a written table. Batches are small meanwhile: an executor's tasks hold their batches at once, in vectors that double as they grow, besides the workers' copies."""
    with arrow_rows(docs.sparkSession, 512):
        return written(piece_digests(encode_pieces(docs, text, model_path, keep, remembered), keep), "piece-digests")
