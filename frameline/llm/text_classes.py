"""Classes of texts, which a language model takes as a context: texts whose pairs of bytes are distributed alike.

1. ``text_shares``: one pass gives each training text's shares of ``FEATURES`` hashed pairs of bytes, one byte each.
2. ``fit_classes``: sums and products of the shares give the directions in which texts differ most; the sides of these are the first
   classes, and each of ``ROUNDS`` passes over the shares gives each text to the class under which its pairs are likeliest. Spark adds up
   whole numbers, so every partitioning finds the same classes. Only sums of a fixed size reach the driver.
3. ``unit_classes``: what a unit may know is the class of the words before it: of the first ``FIRST`` words from there on, of the first
   4 * ``FIRST`` later, and so on. The first ``FIRST`` units of a text are in class ``CLASSES``, of their own.

Without training texts, or if all are alike, every unit is in that class or in class 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameline.llm.common import release_memory

FEATURES = 128
CLASSES = 8
ROUNDS = 6
FIRST = 8
LIMITS = FIRST * 4 ** np.arange(25)
PARTS = 2047  # a text's shares are whole numbers of so many parts, and at most 255
STEPS = 1024.0  # weights are whole numbers of 1 / STEPS, so that sums are exact in any order
HASHED = (np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 7)).astype(np.int64)


def pair_counts(buf: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """(rows, FEATURES): counts of the hashed pairs of bytes, of which the second is in that row; rows from ``rows`` on are left out."""
    pairs = HASHED[(buf[:-1].astype(np.uint16) << np.uint16(8)) | buf[1:]]
    return np.bincount(row[1:] * FEATURES + pairs, minlength=(rows + 1) * FEATURES)[: rows * FEATURES].reshape(rows, FEATURES)


def shares(buf: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each text's shares of pairs; ``buf`` has the texts back to back, of ``sizes`` bytes."""
    row = np.repeat(np.arange(sizes.size), sizes)
    row[(np.cumsum(sizes) - sizes)[sizes > 0]] = sizes.size  # a pair lies within a text
    counts = pair_counts(buf, row, sizes.size)
    return np.minimum(np.rint(counts * (PARTS / np.maximum(counts.sum(axis=1, keepdims=True), 1))), 255).astype(np.uint8)


def text_shares(docs: DataFrame, text: str, lower: np.ndarray, stretch: int = 1 << 20) -> DataFrame:
    """(body): packed shares of the texts of ``docs``; a row for each stretch of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            column = batch.column(text)
            ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset).astype(np.int64)
            data, at, bodies = np.frombuffer(column.buffers()[2] or b"", np.uint8), 0, []
            while at < len(column):
                n = max(1, int(np.searchsorted(ends[at + 1 :], ends[at] + stretch, side="right")))
                bodies.append(pack.compress(shares(lower[data[ends[at] : ends[at + n]]], np.diff(ends[at : at + n + 1])).tobytes()))
                at += n
            yield pa.RecordBatch.from_arrays([pa.array(bodies, pa.binary())], names=["body"])
        release_memory()

    return docs.select(text).mapInArrow(run, "body binary")


def _summed(packed: DataFrame, width: int, of) -> np.ndarray:
    """Sum of ``of(shares)``, a vector of ``width`` whole numbers, over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, unpack = np.zeros(width, np.int64), zstandard.ZstdDecompressor()
        for batch in batches:
            for body in batch.column("body"):
                total += of(np.frombuffer(unpack.decompress(body.as_py()), np.uint8).reshape(-1, FEATURES).astype(np.float64)).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["at", "value"])

    out = np.zeros(width)
    for row in packed.mapInArrow(run, "at int, value long").groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[row["at"]] = row["value"]
    return out


def _by_class(x: np.ndarray, mine: np.ndarray) -> np.ndarray:
    out = np.zeros((CLASSES, FEATURES))
    np.add.at(out, mine, x)
    return out.ravel()


def fit_classes(packed: DataFrame) -> np.ndarray:
    """(CLASSES, FEATURES): what each pair of bytes says for each class, in steps of 1 / STEPS."""
    moments = _summed(packed, 1 + FEATURES + FEATURES * FEATURES, lambda x: np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()]))
    n, total, products = max(moments[0], 1.0), moments[1 : 1 + FEATURES], moments[1 + FEATURES :].reshape(FEATURES, FEATURES)
    mean = total / n
    _, directions = np.linalg.eigh(products / n - np.outer(mean, mean))
    axes = directions[:, -(CLASSES.bit_length() - 1) :]
    axes = np.rint(STEPS * axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])]))
    middle = np.rint(mean @ axes)
    bits = 1 << np.arange(axes.shape[1])
    sums = _summed(packed, CLASSES * FEATURES, lambda x: _by_class(x, (x @ axes > middle) @ bits))
    for turn in range(ROUNDS):
        seen = sums.reshape(CLASSES, FEATURES)
        weights = np.rint(STEPS * np.log((seen + 0.5) / (seen.sum(axis=1, keepdims=True) + 0.5 * FEATURES)))
        if turn < ROUNDS - 1:
            sums = _summed(packed, CLASSES * FEATURES, lambda x, w=weights: _by_class(x, (x @ w.T).argmax(axis=1)))
    return weights


def unit_classes(buf: np.ndarray, first: np.ndarray, text: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Class of each unit, from the bytes of its text before the unit's stretch. ``first`` are the units' first bytes, in order; every text has a unit."""
    starts = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    level = np.searchsorted(LIMITS, np.arange(first.size) - starts[text], side="right")
    at = np.flatnonzero(np.concatenate([[True], (level[1:] != level[:-1]) | (text[1:] != text[:-1])]))
    goes_on = np.concatenate([level[at][1:] > 0, [False]])
    known = int(goes_on.sum())
    number = np.where(goes_on, np.cumsum(goes_on) - 1, known)
    sizes = np.diff(first[at], append=buf.size)
    sizes[0] += first[0]
    row = np.repeat(number, sizes)
    row[first[at[level[at] == 0]]] = known  # a pair lies within a text
    scores = np.cumsum(np.concatenate([np.zeros((1, CLASSES)), pair_counts(buf, row, known) @ weights.T]), axis=0)
    own = np.full(at.size, CLASSES)
    later = np.flatnonzero(level[at] > 0)
    opening = np.maximum.accumulate(np.where(level[at] == 0, np.arange(at.size), 0))
    own[later] = (scores[number[later - 1] + 1] - scores[number[opening[later]]]).argmax(axis=1)
    return np.repeat(own, np.diff(at, append=first.size))
