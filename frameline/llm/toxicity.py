"""Toxicity of texts by a factorization machine over hashed terms.

Terms of a text are its distinct words and the runs of ``GRAM`` letters of each (with a mark at the word's start, so that inflected and compounded forms share
terms), hashed to 30 bits. Counts of each term under both labels, summed before they are shuffled, choose the ``TERMS`` terms that say most by the likelihood ratio; their
number bounds the model, and a term must say more than the best of so many terms would by chance. The machine gives each of them a weight and a vector of ``RANK`` numbers. The logit is the sum of the weights of a text's terms and of the inner products
of all their pairs, in time linear in the number of terms; so a pair, as of an insult and whom it is said of, can count for what neither
term says alone. Labels are learned by gradient steps, each a Spark job over the written terms of the sample: a task gives the sum of its rows' gradients.

Labels are learned from a sample of about ``LABELLED`` rows of each label, chosen by a hash of the key and weighted to the shares of the whole; fewer are all taken. Of texts that share their ``SKETCH`` smallest word hashes, as copies do, those
of one label teach once. Every text is scored, and as a whole.

Edge cases: null, empty and blank texts have no terms and the score of the bias, which is near the share of label 1; rows without a key
or label teach nothing, and repeated ones teach once; without any labels all scores are 0.25; an empty table has no scores; repeated rows are scored alike; ties of
terms are broken by their hash; kept columns that are named like a result are called ``<name>_kept``.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameline.llm.common import kept, release_memory, words_of, written

GRAM = 5
HASHED = (1 << 30) - 1
TERMS = 4096
RANK = 8
LABELLED = 20_000  # rows of each label to learn from
LEAST = 3  # texts that a term must be in
SKETCH = 3  # smallest word hashes that copies share
STEPS = 60
TASKS = 8  # that a gradient step has; its rows are few
RATE, DECAY = 0.3, 1e-4
AT_ONCE = 256  # texts whose terms are held at once
WORDS = 100_000  # whose terms a task remembers


@dataclass(frozen=True)
class Machine:
    """Bias, weight and vector of each term (by its hash, in rising order)."""

    terms: np.ndarray
    bias: float
    weights: np.ndarray
    vectors: np.ndarray


def terms_of(word: str) -> list[int]:
    """The hashes of a word's terms; the word itself counts as one as well."""
    marked = f"^{word}"
    return [zlib.crc32(t.encode("utf-8", "surrogatepass")) & HASHED for t in (marked + "$", *(marked[k : k + GRAM] for k in range(len(marked) - GRAM + 1)))]


def _texts_terms(wanted: dict[int, int] | None) -> Callable[[list[str | None]], Iterator[np.ndarray]]:
    """For texts the sorted numbers of their distinct terms: those wanted, or all by their hashes. Words that were met keep their terms until there are too many."""
    known: dict[str, tuple[int, ...]] = {}

    def run(texts: list[str | None]) -> Iterator[np.ndarray]:
        for text in texts:
            found: set[int] = set()
            for word in set((text or "").lower().split()):
                terms = known.get(word)
                if terms is None:
                    if len(known) >= WORDS:
                        known.clear()
                    every = terms_of(word)
                    terms = tuple(every if wanted is None else [wanted[t] for t in every if t in wanted])
                    if len(word) < 64:
                        known[word] = terms
                if terms:
                    found.update(terms)
            yield np.array(sorted(found), np.int64)

    return run


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n, toxic) for each few texts (text, label)."""
    terms = _texts_terms(None)
    for batch in batches:
        for start in range(0, batch.num_rows, AT_ONCE):
            part = batch.slice(start, AT_ONCE)
            each = list(terms(part.column("text").to_pylist()))
            sizes = [len(e) for e in each]
            if not sum(sizes):
                continue
            label = np.repeat(part.column("label").to_numpy(zero_copy_only=False), sizes)
            term, place = np.unique(np.concatenate(each), return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(np.bincount(place).astype(np.int64)), pa.array(np.bincount(place, label).astype(np.int64))], names=["term", "n", "toxic"])
    release_memory()


def _flat(each: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.zeros(0, np.int64), *each]), np.repeat(np.arange(len(each)), [len(e) for e in each])


def _logits(ids: np.ndarray, row: np.ndarray, n: int, bias: float, weights: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logits of n texts with flat terms, and the sum of each text's vectors."""
    sums = np.stack([np.bincount(row, vectors[ids, f], n) for f in range(vectors.shape[1])], 1) if n else np.zeros((0, vectors.shape[1]))
    squares = np.bincount(row, (vectors**2).sum(1)[ids], n)
    return bias + np.bincount(row, weights[ids], n) + ((sums**2).sum(1) - squares) / 2, sums


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _gradient(rows: DataFrame, bias: float, weights: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Sum over the rows (ids, label, weight) of the gradients by bias, weights and vectors, in one flat array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + weights.size + vectors.size)
        for batch in batches:
            for start in range(0, batch.num_rows, 4 * AT_ONCE):
                part = batch.slice(start, 4 * AT_ONCE)
                ids, row = _flat([np.asarray(i, np.int64) for i in part.column("ids").to_pylist()])
                z, sums = _logits(ids, row, part.num_rows, bias, weights, vectors)
                miss = (_sigmoid(z) - part.column("label").to_numpy(zero_copy_only=False)) * part.column("weight").to_numpy(zero_copy_only=False)
                own = np.bincount(ids, miss[row], weights.size)
                by_vector = np.stack([np.bincount(ids, (miss[:, None] * sums)[row, f], weights.size) for f in range(vectors.shape[1])], 1) - vectors * own[:, None]
                total += np.concatenate([[miss.sum()], own, by_vector.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["g"])

    return np.sum([np.frombuffer(r["g"]) for r in rows.mapInArrow(run, "g binary").collect()], axis=0)


def chosen_labels(labels: DataFrame, key: str, label: str, most: int = LABELLED) -> DataFrame:
    """(key, label, weight): about ``most`` rows of each label, and how many rows each stands for."""
    rows = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).select(key, (F.col(label) == 1).cast("long").alias("label")).distinct()
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {k: min(1.0, most / n) for k, n in sizes.items()}
    weight = F.when(F.col("label") == 1, F.lit(1 / share.get(1, 1.0))).otherwise(F.lit(1 / share.get(0, 1.0)))
    place = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1_000_003)) / 1_000_003
    return rows.filter(place < F.when(F.col("label") == 1, F.lit(share.get(1, 1.0))).otherwise(F.lit(share.get(0, 1.0)))).withColumn("weight", weight)


def fit_machine(docs: DataFrame, key: str, text: str, labels: DataFrame, label: str, most: int = LABELLED) -> Machine:
    """Learns (key, label) rows, label 1 as toxic, on the texts of ``docs``."""
    texts, chosen = docs.select(key, F.col(text).alias("text")), written(chosen_labels(labels, key, label, most), "chosen-labels")
    few = F.broadcast if chosen.count() <= 4 * most else lambda df: df
    sketch = F.slice(F.array_sort(F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w))), 1, SKETCH)
    once = texts.join(few(chosen), key).groupBy(sketch.alias("sketch"), "label").agg(F.min(F.struct(key, "weight")).alias("first")).select("first.*", "label")
    sample = texts.join(few(written(once, "chosen-texts")), key).select("text", "label", "weight")
    sizes = {r["label"]: r for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight")).collect()}
    clean, toxic = ((sizes[k]["n"], sizes[k]["weight"]) if k in sizes else (0, 0.0) for k in (0, 1))
    empty = Machine(np.zeros(0, np.int64), float(np.log((toxic[1] + 0.5) / (clean[1] + 1.5))), np.zeros(0), np.zeros((0, RANK)))
    if not clean[0] or not toxic[0]:
        return empty
    counts = sample.select("text", "label").mapInArrow(_count_terms, "term long, n long, toxic long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    counts = written(counts.filter(F.col("n") >= LEAST), "term-counts")
    share = toxic[0] / (toxic[0] + clean[0])
    part = lambda seen, wanted: F.when(seen > 0, seen * F.log(seen / wanted)).otherwise(0.0)
    told = part(F.col("toxic"), F.col("n") * share) + part(F.col("n") - F.col("toxic"), F.col("n") * (1 - share))
    by_chance = float(np.log(max(1, counts.count())))
    best = sorted(r["term"] for r in counts.filter(told > by_chance).orderBy(F.desc(told), "term").limit(TERMS).select("term").collect())
    if not best:
        return empty
    wanted = {t: k for k, t in enumerate(best)}

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = _texts_terms(wanted)
        for batch in batches:
            each = [e.tolist() for e in terms(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(each, pa.list_(pa.int64())), batch.column("label"), batch.column("weight")], names=["ids", "label", "weight"])
        release_memory()

    rows = written(sample.mapInArrow(ids, "ids array<long>, label long, weight double"), "toxic-terms").coalesce(TASKS)
    start = np.random.default_rng(12).normal(0, 0.05, (len(best), RANK))
    at = np.concatenate([[empty.bias], np.zeros(len(best)), start.ravel()])
    seen = np.full(at.size, 1e-8)
    for _ in range(STEPS):
        weights, vectors = at[1 : 1 + len(best)], at[1 + len(best) :].reshape(len(best), RANK)
        slope = _gradient(rows, float(at[0]), weights, vectors) / (clean[1] + toxic[1])
        slope[1:] += DECAY * at[1:]
        seen += slope**2
        at = at - RATE * slope / np.sqrt(seen)
    return Machine(np.array(best), float(at[0]), at[1 : 1 + len(best)], at[1 + len(best) :].reshape(len(best), RANK))


def score_toxicity(docs: DataFrame, text: str, machine: Machine, keep: Sequence[str]) -> DataFrame:
    """(keep, score, predicted): the probability of label 1, and 1 where it is a half or more."""
    names = kept(keep, ["score", "predicted"])
    chosen = docs.select(F.col(f"`{text}`").alias("__text"), *names)
    out = [f for f in chosen.schema.fields if f.name != "__text"]
    schema = T.StructType([*out, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    wanted = {int(t): k for k, t in enumerate(machine.terms)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = _texts_terms(wanted)
        for batch in batches:
            scores = []
            for start in range(0, batch.num_rows, AT_ONCE):
                each = list(terms(batch.column("__text").slice(start, AT_ONCE).to_pylist()))
                ids, row = _flat(each)
                scores.append(_sigmoid(_logits(ids, row, len(each), machine.bias, machine.weights, machine.vectors)[0]))
            score = np.concatenate([np.zeros(0), *scores])
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in out), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[f.name for f in schema.fields])
        release_memory()

    return chosen.mapInArrow(run, schema)
