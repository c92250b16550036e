"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram's vector is the elementwise product (binding) of its letters'
vectors, each rolled (permuted) by its place. A text's vector is the sum (bundle) of its n-grams' vectors, a language's
prototype the sum over all its training texts. A text gets the language whose prototype has the largest cosine.

Letters are the Unicode letters of the lower-cased text; each run of anything else is one boundary symbol. Vectors come
from a seed and the code point, so every worker has the same ones.

A text's likeness is its product with that prototype, divided by what a text of as many n-grams of the language has on
average: 1 for the language's own texts at every length, near 0 where n-grams are shared by chance only. It is a cosine
floor that depends on the number of n-grams and on how often they repeat.

Fit: each task counts its texts' n-grams by language, Spark sums them by (language, n-gram), and tasks bundle shares of
the sums; only ``languages x dim`` numbers reach the driver. Prediction is a map without a shuffle.

Memory: a task holds one slice of a text's letters, the counts of the n-grams it has met (given to Spark and started
anew at ``HELD``), and the vectors of ``Space.MOST`` n-grams, one byte a component.

Edge cases: null texts, and texts without a letter, are ``und`` with score 0; so is every text if nothing could be
learned. Ties go to the alphabetically first language. Repeated rows each get a row and each count in a fit; texts of any
length are counted whole, ``SLICE`` letters at a time; an empty table gives an empty result. A kept column that is
named like a result is called ``<name>_kept``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameline.llm.common import kept, release_memory

UNDETERMINED = "und"
SHIFT = 21  # bits of a code point in an n-gram's code
SLICE = 1 << 18  # letters counted at once
HELD = 1 << 20  # distinct n-grams that a task counts before it gives them to Spark
WIDTH = 4096  # n-grams whose vectors are summed at once


@dataclass(frozen=True)
class Profile:
    """Hyperdimensional model: ``prototypes`` is languages x dim, ``seen`` the n-grams that each one sums."""

    languages: tuple[str, ...]
    prototypes: np.ndarray
    n: int = 3
    dim: int = 1024
    seed: int = 17
    seen: tuple[int, ...] = ()


_LETTER = np.zeros(0x110000, bool)


def _letters() -> np.ndarray:
    if not _LETTER.any():
        _LETTER[:] = [chr(i).isalpha() for i in range(0x110000)]
    return _LETTER


def ngram_codes(text: str, n: int) -> Iterator[np.ndarray]:
    """Codes of the text's n-grams, slice by slice: its letters between boundaries (0), ``SHIFT`` bits each. Nothing without a letter."""
    lowered, before, any_letter, made = text.lower(), np.zeros(1, np.int64), False, False
    for at in range(0, len(lowered), SLICE):
        points = np.frombuffer(lowered[at : at + SLICE].encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[points]
        any_letter = any_letter or bool(letter.any())
        marked = np.concatenate([before, np.where(letter, points, 0).astype(np.int64), np.zeros(int(at + SLICE >= len(lowered)), np.int64)])
        marked = marked[np.concatenate([[True], (marked[1:] != 0) | (marked[:-1] != 0)])]
        before = marked[max(0, marked.size - n + 1) :]
        if marked.size >= n and any_letter:
            made = True
            yield _packed(marked, n)
    if any_letter and not made:
        yield _packed(np.concatenate([before, np.zeros(n - before.size, np.int64)]), n)


def _packed(marked: np.ndarray, n: int) -> np.ndarray:
    code = marked[: marked.size - n + 1]
    for k in range(1, n):
        code = (code << SHIFT) | marked[k : marked.size - n + 1 + k]
    return code


class Space:
    """Vectors of letters and n-grams; remembers the n-grams' up to a bound, in one block of memory."""

    MOST = 40_000

    def __init__(self, n: int, dim: int, seed: int):
        self.n, self.dim, self.seed = n, dim, seed
        self.letters: dict[int, np.ndarray] = {}
        self.codes, self.rows = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.vectors = np.empty((self.MOST, dim), np.int8)  # memory is taken as rows are written

    def letter(self, point: int) -> np.ndarray:
        if point not in self.letters:
            if len(self.letters) >= self.MOST:
                self.letters.clear()
            self.letters[point] = (np.random.default_rng([self.seed, point]).integers(0, 2, self.dim) * 2 - 1).astype(np.int8)
        return self.letters[point]

    def bind(self, codes: np.ndarray) -> np.ndarray:
        out = np.ones((codes.size, self.dim), np.int8)
        for place in range(self.n):
            points = (codes >> (SHIFT * (self.n - 1 - place))) & ((1 << SHIFT) - 1)
            distinct, which = np.unique(points, return_inverse=True)
            out *= np.stack([np.roll(self.letter(int(p)), self.n - 1 - place) for p in distinct])[which]
        return out

    def of(self, codes: np.ndarray) -> np.ndarray:
        """Vectors of at most ``WIDTH`` sorted distinct codes, as float32."""
        new = np.setdiff1d(codes, self.codes, assume_unique=True)
        if new.size:
            if self.codes.size + new.size > self.MOST:
                self.codes, self.rows, new = self.codes[:0], self.rows[:0], codes
            first = self.codes.size
            self.vectors[first : first + new.size] = self.bind(new)
            at = np.searchsorted(self.codes, new)
            self.codes, self.rows = np.insert(self.codes, at, new), np.insert(self.rows, at, np.arange(first, first + new.size))
        return self.vectors[self.rows[np.searchsorted(self.codes, codes)]].astype(np.float32)


def bundle(space: Space, texts: list[np.ndarray]) -> np.ndarray:
    """Bundles of texts given as code arrays: counts times n-gram vectors, ``WIDTH`` n-grams at a time."""
    every = np.concatenate(texts)
    owner = np.repeat(np.arange(len(texts)), [t.size for t in texts])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    ends = np.append(first, every.size)
    which = np.repeat(np.arange(first.size), np.diff(ends))
    out = np.zeros((len(texts), space.dim), np.float32)
    for at in range(0, first.size, WIDTH):
        codes = every[first[at : at + WIDTH]]
        part = slice(ends[at], ends[min(at + WIDTH, first.size)])
        counts = np.bincount(owner[part] * codes.size + which[part] - at, minlength=len(texts) * codes.size)
        out += counts.reshape(len(texts), codes.size).astype(np.float32) @ space.of(codes)
    return out


class Tally:
    """Counts of codes: what comes in is put together every ``SLICE`` codes."""

    def __init__(self) -> None:
        self.codes, self.seen = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.new: list[np.ndarray] = []
        self.size = 0

    def add(self, codes: np.ndarray) -> None:
        self.new.append(codes)
        self.size += codes.size
        if self.size >= SLICE:
            self.settle()

    def settle(self) -> None:
        if not self.new:
            return
        found, seen = np.unique(np.concatenate(self.new), return_counts=True)
        every, seen = np.concatenate([self.codes, found]), np.concatenate([self.seen, seen])
        self.codes, which = np.unique(every, return_inverse=True)
        self.seen = np.bincount(which, seen, self.codes.size).astype(np.int64)
        self.new, self.size = [], 0


def ngram_totals(docs: DataFrame, text: str, label: str, n: int) -> DataFrame:
    """(lang, code, n_seen): n-gram counts of all texts by language; counted in the task, then summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies: dict[str, Tally] = {}

        def given() -> Iterator[pa.RecordBatch]:
            for lang, t in tallies.items():
                t.settle()
                for at in range(0, t.codes.size, 65536):
                    codes, seen = t.codes[at : at + 65536], t.seen[at : at + 65536]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * codes.size, pa.string()), pa.array(codes, pa.int64()), pa.array(seen, pa.int64())], names=["lang", "code", "n_seen"])
            tallies.clear()

        for batch in batches:
            for lang, body in zip(batch.column("lang").to_pylist(), batch.column("body"), strict=True):
                own = tallies.setdefault(lang, Tally())
                for codes in ngram_codes(body.as_py(), n):
                    own.add(codes)
                    if own.codes.size > HELD:
                        yield from given()
                        own = tallies.setdefault(lang, Tally())
            if sum(t.codes.size + t.size for t in tallies.values()) > HELD:
                yield from given()
        yield from given()
        release_memory()

    rows = docs.select(F.col(label).alias("lang"), F.col(text).alias("body")).dropna()
    return rows.mapInArrow(run, "lang string, code long, n_seen long").groupBy("lang", "code").agg(F.sum("n_seen").alias("n_seen"))


def fit_profiles(docs: DataFrame, text: str, label: str, n: int = 3, dim: int = 1024, seed: int = 17) -> Profile:
    """Prototypes of all non-null labels, from all rows of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, sums, total = Space(n, dim, seed), {}, {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            codes, seen = batch.column("code").to_numpy(), batch.column("n_seen").to_numpy()
            for lang in sorted(set(langs.tolist())):
                mine = langs == lang
                total[lang] = total.get(lang, 0) + int(seen[mine].sum())
                own, weight = codes[mine], seen[mine]
                for at in range(0, own.size, WIDTH):
                    sums[lang] = sums.get(lang, 0) + weight[at : at + WIDTH].astype(np.float64) @ space.bind(own[at : at + WIDTH]).astype(np.float64)
        del space
        for lang, v in sums.items():
            value = np.append(v.astype(np.int64), total[lang])  # the number of n-grams comes after the last place
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (dim + 1), pa.string()), pa.array(range(dim + 1), pa.int32()), pa.array(value)], names=["lang", "place", "value"])
        release_memory()

    shares = ngram_totals(docs, text, label, n).mapInArrow(run, "lang string, place int, value long")
    rows = shares.groupBy("lang", "place").agg(F.sum("value").alias("value")).collect()  # languages x dim numbers
    languages = tuple(sorted({r["lang"] for r in rows}))
    sums = np.zeros((len(languages), dim + 1))
    at = {lang: i for i, lang in enumerate(languages)}
    for r in rows:
        sums[at[r["lang"]], r["place"]] = r["value"]
    return Profile(languages, sums[:, :dim], n, dim, seed, tuple(int(k) for k in sums[:, dim]))


def predict_language(docs: DataFrame, text: str, profile: Profile, keep: Sequence[str] = (), likeness: bool = False) -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score`` (the cosine, between 0 and 1) for each row, and ``likeness`` if asked for."""
    chosen = docs.select(*kept(keep, ["lang_pred", "score", "likeness", "__text"]), F.col(text).alias("__text"))
    keep = chosen.columns[:-1]
    schema = T.StructType([*(chosen.schema[k] for k in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    norms = np.linalg.norm(profile.prototypes, axis=1, keepdims=True)
    unit = (profile.prototypes / np.where(norms > 0, norms, 1)).T
    if likeness:
        schema = T.StructType([*schema, T.StructField("likeness", T.DoubleType())])
    own = norms[:, 0] / np.maximum(profile.seen, 1)  # length of a prototype for each n-gram of it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Space(profile.n, profile.dim, profile.seed)
        for batch in batches:
            langs, scores = [UNDETERMINED] * batch.num_rows, [0.0] * batch.num_rows
            alike = [0.0] * batch.num_rows
            block, rows, size = [], [], 0

            def judged(numbers: list[int], v: np.ndarray, sizes: np.ndarray) -> None:
                length = np.linalg.norm(v, axis=1, keepdims=True)
                near = (v / np.where(length > 0, length, 1)) @ unit
                best, most = near.argmax(axis=1), near.max(axis=1)
                ratio = most * length[:, 0] / np.maximum(sizes, 1) / np.where(own[best] > 0, own[best], 1)
                for row, k, c, a in zip(numbers, best, most, ratio, strict=True):
                    langs[row], scores[row], alike[row] = profile.languages[k], float(min(1.0, max(0.0, c))), float(a)

            for row, body in enumerate(batch.column("__text") if profile.languages else []):
                text_ = body.as_py() or ""
                total, length = np.zeros((1, profile.dim)), 0
                for codes in ngram_codes(text_, profile.n):
                    if 2 * len(text_) <= SLICE:  # lower-casing makes two of some letters
                        block.append(codes)
                        rows.append(row)
                        size += codes.size
                    else:  # its slices are summed before they are judged
                        total += bundle(space, [codes])
                        length += codes.size
                if length:
                    judged([row], total, np.array([length]))
                if size >= SLICE or len(block) >= 256:
                    judged(rows, bundle(space, block).astype(np.float64), np.array([codes.size for codes in block]))
                    block, rows, size = [], [], 0
            if block:
                judged(rows, bundle(space, block).astype(np.float64), np.array([codes.size for codes in block]))
            columns = [*(batch.column(k) for k in keep), pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            if likeness:
                columns.append(pa.array(alike, pa.float64()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        del space
        release_memory()

    return chosen.mapInArrow(run, schema)
