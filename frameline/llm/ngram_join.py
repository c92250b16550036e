"""Exact Jaccard join of word n-gram sets by universe partition and pigeonhole.

Sets of up to H differing members agree in full on one of H + 1 segments of the universe, or on all but one member of a
segment if that segment counts twice. Sizes fall into bands; each band hashes shingles into segments of its own and
indexes each set's segment subsets, and the one-deletion neighbourhoods of the first ``twice`` segments. ``allocate``
picks ``twice`` by cost from how many documents the corpus has in each band: few and large segments cost more index rows
and make fewer chance meetings. A set is indexed in its own band and in the next one if it can link there.

Empty segments agree by chance, so with ``spare`` more segments than needed a set of at most ``spare`` empty ones is not indexed
under them: two linked sets leave ``spare + 1`` segments alike, of which at most ``spare`` are empty in either of them if one
has so few. Sets with more empty segments are indexed under those as well, and so meet each other. Segments that count twice are always indexed.

1. ``shingle_index``: one pass gives each row's set size, set digest and parity bitmap. Equal sets become one node.
2. ``packed_signatures_of`` and ``met_in_buckets``: a second pass over the nodes' texts gives their index rows, which are dealt by hash in packs and never written as a table; nodes that share
   one meet in a bucket, which is sorted. Each node is first verified against the best of its buckets' smallest nodes only.
3. Nodes of a bucket that are still in different components are compared in bounded blocks by parity bitmaps, whose
   distance never exceeds the sets' difference, so nothing is lost: first the nearest pairs that join all components of a block which
   any pair joins, fewer than it has nodes; then, in the buckets where that left pairs out, the same again and at last all that are still apart,
   both by larger bitmaps, which few pairs beyond the limit pass. Every pair that passes is verified on whole
   sets. Thus large groups of near copies cost links by the number of their members, not of their pairs.

Shingles are 64-bit hashes of words. All steps read tables in the shared folder.

Edge cases: null texts and texts without a word have an empty set and link with nothing; a text of fewer words than n is
one shingle; rows with equal ids are one document with several texts; a row without an id is returned without a
component; repeated rows each get a row; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameline.llm.common import LOWER, UPPER, arrow_rows, release_memory, written
from frameline.llm.links import component_roots

GROWTH = 1.25  # largest over smallest size of a band
LARGEST = 1 << 30  # no set is larger
CHUNK = 2048  # nodes of a bucket that are compared at once
BITS_PER_DIFFERENCE = 3  # of the parity bitmap
FINER = 12  # the same where nodes are looked at again
PAIR_COST = 0.05  # of comparing two bitmaps, against writing an index row
MEETING_COST = 16  # of an index row by which sets meet by chance: it is written, joined and dealt again with its bitmap
SPARE = (0, 1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128)
SIGNATURE = (1 << 48) - 1  # bits of an index row that are kept; two of ten billion are equal by chance about once in 3 * 10 ** 14 pairs
PACK = 1 << 19  # index rows that are dealt to buckets at once
BUCKET = 1 << 18  # index rows of a bucket, about
CUT = 1 << 14  # index rows of a pack at most
KNOWN = 1 << 17  # words whose hashes are kept
SMALL_SIDE = 2_000_000  # ids that may be broadcast; beyond it they are joined by shuffle

_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@dataclass(frozen=True)
class Band:
    """Sizes from ``low`` to ``high``; ``twice`` of its segments count twice, ``spare`` more than needed make up for empty ones."""

    low: int
    high: int
    differ: int
    twice: int = 0
    spare: int = 0

    @property
    def segments(self) -> int:
        return self.differ + 1 - self.twice

    @property
    def parts(self) -> int:
        return self.segments + self.spare


def bands(num: int, den: int) -> list[Band]:
    """Bands of sizes for links at ``num / den``; ``differ`` bounds what two linked sets of a band may differ by."""
    out, low = [], 1
    high = max(1, (den + num - 1) // (2 * (den - num)))  # up to here, linked sets are equal
    while low <= LARGEST:
        out.append(Band(low, high, 2 * high * (den - num) // (den + num)))
        low = high + 1
        high = max(low, int(low * GROWTH))
    return out


def index_rows(band: Band) -> float:
    """Index rows of a set of the band's largest size."""
    return band.parts + band.high * band.twice / band.parts


def _at_least(x: int, n: int, q: float) -> float:
    """Probability of x or more successes of n."""
    term, fewer = (1 - q) ** n, 0.0
    for k in range(min(x, n + 1)):
        fewer += term
        term *= (n - k) / (k + 1) * q / (1 - q)
    return max(0.0, 1 - fewer)


def _by_chance(band: Band) -> tuple[float, float, float]:
    """Probabilities that one of the smallest sets is indexed under a segment that holds nothing, that a segment holds nothing, and that it holds one shingle."""
    m = band.parts
    none = (1 - 1 / m) ** band.low
    single = band.low / m * (1 - 1 / m) ** (band.low - 1)
    return none * _at_least(band.spare, max(0, m - band.twice - 1), none), none, single  # empty, in a set that has more empty ones than are spare


def chance_meetings(band: Band) -> float:
    """Share of all pairs of the band's smallest sets that meet without a common shingle, in segments that hold nothing (or one shingle)."""
    if band.parts == 1:
        return 0.0
    indexed, none, single = _by_chance(band)
    return (band.parts - band.twice) * indexed**2 + band.twice * (none**2 + 2 * none * single)


def chance_rows(band: Band) -> float:
    """Index rows of one of the band's smallest sets by which it can meet others without a common shingle."""
    if band.parts == 1:
        return 0.0
    indexed, none, single = _by_chance(band)
    return (band.parts - band.twice) * indexed + band.twice * (none + single)


def allocate(every: list[Band], sizes: dict[int, int]) -> list[Band]:
    """The bands with ``twice`` and ``spare`` of least cost, given how many documents each band (by its place) has.

    Rows that meet by chance cost by themselves, not only by the pairs that they make: so a small corpus has about as many index rows a document as a large one."""
    out = []
    for k, band in enumerate(every):
        n = sizes.get(k, 0)
        steps = sorted({(band.differ + 1) // 2 * i // 16 for i in range(17)})
        tried = [replace(band, twice=t, spare=x) for t in steps for x in SPARE if x <= (band.differ + 1) // 4] if n else [band]
        out.append(min(tried, key=lambda b: (n * (index_rows(b) + MEETING_COST * chance_rows(b)) + n * n / 2 * chance_meetings(b) * PAIR_COST, b.twice, b.spare)))
    return out


def rows_to_index(plan: list[Band], sizes: dict[int, int], num: int, den: int) -> float:
    """Index rows of all documents, about: each is indexed in its own band and in those above in which it can link."""
    total = 0.0
    for k, n in sizes.items():
        total += n * sum(index_rows(b) for j, b in enumerate(plan[k:]) if j == 0 or plan[k].high * den >= num * b.low)
    return total


class _Words(dict):
    """64-bit hashes of words; starts anew when it holds ``KNOWN``, since memory of many small values is not all given back to the system."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, n: int, words: _Words) -> np.ndarray:
    """Sorted distinct hashes of the text's n-word shingles."""
    body = (text or "").encode("utf-8").translate(_FOLD).split()
    if not body:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, body), np.uint64, len(body))
    size = min(n, h.size)
    with np.errstate(over="ignore"):
        own = np.full(h.size - size + 1, size, np.uint64)
        for k in range(size):
            own = mixed(own * _A + h[k : h.size - size + 1 + k])
    return np.unique(own)


def signatures(tokens: np.ndarray, plan: list[Band], starts: np.ndarray, num: int, den: int) -> np.ndarray:
    """Index rows of a set, in its own band and in the bands above in which it can link."""
    out, size = [], tokens.size
    k = int(np.searchsorted(starts, size, side="right")) - 1
    first = k
    while k < len(plan) and (k == first or size * den >= num * plan[k].low):
        band = plan[k]
        m = band.parts
        segment = ((tokens >> np.uint64(32)) % np.uint64(m)).astype(np.int64)
        low = np.bincount(segment, (tokens & np.uint64(0xFFFFFFFF)).astype(np.float64), m).astype(np.uint64)
        high = np.bincount(segment, (tokens >> np.uint64(32)).astype(np.float64), m).astype(np.uint64)
        with np.errstate(over="ignore"):
            total = (high << np.uint64(32)) + low + (np.arange(m, dtype=np.uint64) * _A ^ np.uint64(k + 1) * _C)
            empty = np.bincount(segment, minlength=m) == 0
            empty[: band.twice] = False
            out.append(mixed(total if empty.sum() > band.spare else total[~empty]))
            if band.twice:
                inside = segment < band.twice
                out.append(mixed(total[segment[inside]] - tokens[inside]))
        k += 1
    return np.unique(np.concatenate(out) & np.uint64(SIGNATURE))


def set_digest(tokens: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return int(mixed(tokens ^ _A).sum().astype(np.int64)), int(mixed(tokens ^ _C).sum().astype(np.int64))


def parity_bitmap(tokens: np.ndarray, num: int, den: int, per_difference: int = BITS_PER_DIFFERENCE) -> bytes:
    """Parity of the set's members by hash, in a power of two of bits, so that a larger bitmap can be folded to a smaller one."""
    differ = 2 * tokens.size * (den - num) // (den + num)
    width = max(64, 1 << (per_difference * (differ + 1) - 1).bit_length())
    odd = np.bincount((tokens & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def shingle_index(docs: DataFrame, key: str, text: str, n: int, num: int, den: int) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, bits) for each row; the last three are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            sizes, d1, d2, bits = [], [], [], []
            for body in batch.column("body"):
                tokens = shingle_set(body.as_py(), n, words)
                sizes.append(tokens.size)
                if not tokens.size:
                    for out in (d1, d2, bits):
                        out.append(None)
                    continue
                for out, digest in zip((d1, d2), set_digest(tokens), strict=True):
                    out.append(digest)
                bits.append(parity_bitmap(tokens, num, den))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(bits, pa.binary())],
                names=["doc_id", "n_shingles", "d1", "d2", "bits"],
            )
        words.clear()
        release_memory()

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("body"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, bits binary")


def chosen_texts(docs: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """(node, body) of the documents whose ids are in ``wanted(node)``."""
    few = wanted.limit(SMALL_SIDE + 1).count() <= SMALL_SIDE
    rows = docs.select(F.col(key).cast("long").alias("node"), F.col(text).alias("body"))
    return rows.join(F.broadcast(wanted) if few else wanted, "node", "left_semi")


def shingle_sets(docs: DataFrame, key: str, text: str, n: int, wanted: DataFrame) -> DataFrame:
    """(node, tokens) of the documents whose ids are in ``wanted(node)``; packed sorted hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            sets = [shingle_set(b.as_py(), n, words).tobytes() for b in batch.column("body")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], names=["node", "tokens"])
        words.clear()
        release_memory()

    return chosen_texts(docs, key, text, wanted).mapInArrow(run, "node long, tokens binary")


def finer_bitmaps(docs: DataFrame, key: str, text: str, n: int, num: int, den: int, wanted: DataFrame) -> DataFrame:
    """(node, n_shingles, bits) of ``wanted(node)``, with bitmaps that leave few pairs beyond the limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            sizes, bits = [], []
            for body in batch.column("body"):
                tokens = shingle_set(body.as_py(), n, words)
                sizes.append(tokens.size)
                bits.append(parity_bitmap(tokens, num, den, FINER))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary())], names=["node", "n_shingles", "bits"])
        words.clear()
        release_memory()

    rows = chosen_texts(docs, key, text, wanted).mapInArrow(run, "node long, n_shingles long, bits binary")
    return rows.filter("n_shingles > 0")


def possible(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs ``(a, b)`` that sizes and parity bitmaps allow to link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for m, n, x, y in zip(batch.column("m").to_pylist(), batch.column("n").to_pylist(), batch.column("x"), batch.column("y"), strict=True):
                x, y = x.as_buffer(), y.as_buffer()
                rows = _folded([x, y], min(len(x), len(y)))
                keep.append(den * min(m, n) >= num * max(m, n) and int(np.bitwise_count(rows[0] ^ rows[1]).sum()) * (den + num) <= (m + n) * (den - num))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    own = nodes.select("node", "n_shingles", "bits")
    both = pairs.select("a", "b").join(own.toDF("b", "n", "y"), "b").join(own.toDF("a", "m", "x"), "a")
    return both.select("a", "b", "m", "n", "x", "y").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, key: str, text: str, n: int, num: int, den: int) -> DataFrame:
    """The pairs ``(a, b)`` whose whole sets link. ``pairs`` must be a written table: it is read more than once."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    with arrow_rows(docs.sparkSession, 1024):
        sets = written(shingle_sets(docs, key, text, n, wanted), "join-sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = np.intersect1d(x, y, assume_unique=True).size
                keep.append(common > 0 and den * common >= num * (x.size + y.size - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = sets.toDF("a", "x"), sets.toDF("b", "y")
    return pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _folded(bits: list, width: int) -> np.ndarray:
    """Bitmaps as rows of 64-bit words, all folded to ``width`` bytes."""
    out = np.empty((len(bits), width // 8), np.uint64)
    for k, b in enumerate(bits):
        row = np.frombuffer(b, np.uint64)
        out[k] = row if row.size == width // 8 else np.bitwise_xor.reduce(row.reshape(-1, width // 8), axis=0)
    return out


def _spanning(a: np.ndarray, b: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Places of the pairs ``(a, b)`` of labels that join all labels that pairs connect, nearest pairs first: fewer than there are labels.

    In each turn every group of labels takes its nearest pair to another group; equal ones are taken by place, so no pairs close a ring."""
    order = np.argsort(far, kind="stable")
    a, b = a[order], b[order]
    group, open_, taken = np.arange(max(a.max(), b.max()) + 1), np.arange(a.size), []
    while True:
        open_ = open_[group[a[open_]] != group[b[open_]]]
        if not open_.size:
            return order[np.concatenate(taken)] if taken else np.zeros(0, np.int64)
        first = np.full(group.size, a.size)
        np.minimum.at(first, group[a[open_]], open_)
        np.minimum.at(first, group[b[open_]], open_)
        chosen = np.unique(first[first < a.size])
        taken.append(chosen)
        x, y = group[a[chosen]], group[b[chosen]]
        root = np.arange(group.size)
        while (root[x] != root[y]).any():
            low = np.minimum(root[x], root[y])
            np.minimum.at(root, x, low)
            np.minimum.at(root, y, low)
            root = root[root]
        group = root[group]


def _close_pairs(node: np.ndarray, comp: np.ndarray, size: np.ndarray, side: np.ndarray, bits: list, num: int, den: int, best: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs of a bucket's block that lie in different components and whose bitmaps allow a link, and whether ``best`` left any out."""
    rows = _folded(bits, min(map(len, bits)))
    found = []
    left, right = np.flatnonzero(side <= 0), np.flatnonzero(side >= 0)
    step = max(1, (1 << 21) // (right.size * rows.shape[1] + 1))
    for at in range(0, left.size, step):
        i = left[at : at + step]
        both = size[i][:, None] + size[right][None, :]
        fits = (comp[i][:, None] != comp[right][None, :]) & (den * np.minimum(size[i][:, None], size[right][None, :]) >= num * np.maximum(size[i][:, None], size[right][None, :]))
        p, q = np.nonzero(fits)
        if not p.size:
            continue
        apart = np.concatenate([np.bitwise_count(rows[i[p[s : s + 65536]]] ^ rows[right[q[s : s + 65536]]]).sum(axis=1, dtype=np.int64) for s in range(0, p.size, 65536)])
        ok = apart * (den + num) <= both[p, q] * (den - num)
        found.append(np.stack([i[p[ok]], right[q[ok]], apart[ok]]))  # places and distances, all whole numbers
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), False
    i, j, apart = np.concatenate(found, axis=1)
    every = i.size
    if best and i.size:
        kept = _spanning(*np.unique(comp, return_inverse=True)[1][[i, j]], apart / (size[i] + size[j]))
        i, j = i[kept], j[kept]
    return np.minimum(node[i], node[j]), np.maximum(node[i], node[j]), i.size < every


def cross_pairs(buckets: DataFrame, nodes: DataFrame, roots: DataFrame, num: int, den: int, best: bool) -> DataFrame:
    """Distinct pairs ``(a, b)`` of nodes that share a bucket, lie in different components and may link, and rows ``(null, null, sig)``
    of the buckets in which ``best`` left pairs out.

    Large buckets are cut into chunks, and every two chunks are a block of their own.
    """
    labelled = nodes.select("node", "n_shingles", "bits").join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
    rows = buckets.join(labelled.select("node", "comp"), "node")
    open_ = rows.groupBy("sig").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.count(F.lit(1)).alias("many")).filter("least < most").select("sig", "many")
    rows = buckets.join(open_, "sig").join(labelled, "node")
    chunks = F.ceil(F.col("many") / CHUNK).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), chunks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    rows = rows.select("sig", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.signum(F.col("own") - F.col("other")).cast("int").alias("side"), "node", "comp", "n_shingles", "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def compared(t: pa.Table) -> pa.RecordBatch:
            cols = {c: t.column(c).to_numpy() for c in ("sig", "i", "j", "side", "node", "comp", "n_shingles")}
            bits = [x.as_buffer() for x in t.column("bits")]
            change = np.flatnonzero((np.diff(cols["sig"]) != 0) | (np.diff(cols["i"]) != 0) | (np.diff(cols["j"]) != 0)) + 1
            a, b, left_out = [], [], []
            for s, e in zip(np.concatenate([[0], change]), np.concatenate([change, [t.num_rows]]), strict=True):
                if e - s > 1:
                    x, y, less = _close_pairs(cols["node"][s:e], cols["comp"][s:e], cols["n_shingles"][s:e], cols["side"][s:e], bits[s:e], num, den, best)
                    if less:
                        left_out.append(int(cols["sig"][s]))
                    a.append(x)
                    b.append(y)
            none = np.zeros(0, np.int64)
            pairs = np.unique(np.stack([np.concatenate([none, *a]), np.concatenate([none, *b])], axis=1), axis=0)
            pairs = pairs[pairs[:, 0] != pairs[:, 1]]
            none = [None] * len(left_out)
            columns = [pa.array([*pairs[:, 0].tolist(), *none], pa.int64()), pa.array([*pairs[:, 1].tolist(), *none], pa.int64()), pa.array([*[None] * len(pairs), *left_out], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["a", "b", "sig"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            keys = [held.column(c)[-1].as_py() for c in ("sig", "i", "j")]
            last = (held.column("sig").to_numpy() == keys[0]) & (held.column("i").to_numpy() == keys[1]) & (held.column("j").to_numpy() == keys[2])
            whole = int(np.argmax(last))  # rows of the last block are at the end
            if whole:
                yield compared(held.slice(0, whole).combine_chunks())
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield compared(held.combine_chunks())
        held = None
        release_memory()

    found = rows.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j").mapInArrow(run, "a long, b long, sig long")
    return found.distinct()


def _planes(x: np.ndarray) -> bytes:
    """64-bit numbers as all their first bytes, all their second bytes and so on, so that what they have in common compresses."""
    return x.view(np.uint8).reshape(-1, 8).T.tobytes()


def _numbers(planes: pa.Scalar) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes.as_buffer(), np.uint8).reshape(8, -1).T).view(np.int64).reshape(-1)


def _packs(rows: Iterator[tuple[np.ndarray, np.ndarray]], buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, sigs, nodes) of index rows (signatures, nodes): dealt to buckets by signature, ``PACK`` at once."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def dealt() -> Iterator[pa.RecordBatch]:
        sig, node = (np.concatenate(x) for x in zip(*held, strict=True))
        bucket = bucket_of(sig, buckets)
        order = np.argsort(bucket, kind="stable")
        sig, node, own = sig[order], node[order], bucket[order]
        cuts = np.flatnonzero(np.diff(own)) + 1
        spans = [(k, min(k + CUT, j)) for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), own.size], strict=True) for k in range(i, j, CUT)]
        parts = [[_planes(x[i:j]) for i, j in spans] for x in (sig, node)]
        packs = pa.RecordBatch.from_arrays([pa.array([int(own[i]) for i, _ in spans], pa.int32()), *(pa.array(x, pa.binary()) for x in parts)], names=["bucket", "sigs", "nodes"])
        return (packs.slice(k, 64) for k in range(0, packs.num_rows, 64))

    n = 0
    for sig, node in rows:
        if sig.size:
            held.append((sig, node))
            n += sig.size
        if n >= PACK:
            yield from dealt()
            held, n = [], 0
    if held:
        yield from dealt()
    held = []
    release_memory()


def packed_signatures(rows: DataFrame, buckets: int) -> DataFrame:
    """(bucket, sigs, nodes): the index rows of ``rows(node, sigs)`` dealt to buckets by their signatures, as packed 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = ((b.column("sigs"), b.column("node").to_numpy()) for b in batches)
        return _packs(((sigs.flatten().to_numpy(), np.repeat(node, sigs.value_lengths().to_numpy())) for sigs, node in lists), buckets)

    return rows.mapInArrow(run, "bucket int, sigs binary, nodes binary")


def packed_signatures_of(docs: DataFrame, key: str, text: str, n: int, num: int, den: int, plan: list[Band], nodes: DataFrame, buckets: int) -> DataFrame:
    """``packed_signatures`` of ``nodes(node, d1, d2)``, made from their texts and dealt by the same worker, so that index rows are on disk once, on their way to a bucket."""
    starts = np.array([b.low for b in plan])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()

        def rows() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in batches:
                for node, d1, d2, body in zip(*(batch.column(c) for c in ("node", "d1", "d2", "body")), strict=True):
                    tokens = shingle_set(body.as_py(), n, words)
                    if tokens.size and set_digest(tokens) == (d1.as_py(), d2.as_py()):  # an id may have other texts
                        sig = signatures(tokens, plan, starts, num, den).view(np.int64)
                        yield sig, np.full(sig.size, node.as_py(), np.int64)
            words.clear()

        return _packs(rows(), buckets)

    wanted = nodes.select("node", "d1", "d2")
    few = wanted.limit(SMALL_SIDE + 1).count() <= SMALL_SIDE
    rows = docs.select(F.col(key).cast("long").alias("node"), F.col(text).alias("body")).join(F.broadcast(wanted) if few else wanted, "node")
    return rows.select("node", "d1", "d2", "body").mapInArrow(run, "bucket int, sigs binary, nodes binary")


def bucket_of(sig: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(sig.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)


def met_in_buckets(packs: DataFrame) -> DataFrame:
    """(sig, node, center): the nodes of each index row that several nodes have, and the smallest of them.

    Nearly all index rows are of one node only, so they are not rows of Spark's: they travel in packs, and each bucket of about ``BUCKET`` is sorted
    on its own. An index row that very many nodes have is 16 bytes for each of them there.
    """

    def met(packs: pa.Table) -> pa.Table:
        sig, node = (np.concatenate([_numbers(x) for x in packs.column(c)]) for c in ("sigs", "nodes"))
        order = np.argsort(sig)
        sig = sig[order]
        again = sig[1:] == sig[:-1]
        shared = np.concatenate([again, [False]]) | np.concatenate([[False], again])
        sig, node = sig[shared], node[order[shared]]
        order = np.lexsort((node, sig))
        sig, node = sig[order], node[order]
        new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])])[: sig.size]  # a node may have a row more than once
        sig, node = sig[new], node[new]
        first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])[: sig.size])
        many = np.diff(first, append=sig.size)
        center, several = np.repeat(node[first], many), np.repeat(many, many) > 1
        return pa.table({"sig": sig[several], "node": node[several], "center": center[several]})

    return packs.groupBy("bucket").applyInArrow(met, "sig long, node long, center long")


def met_nodes(index: DataFrame, nodes: DataFrame) -> DataFrame:
    """``met_in_buckets`` of the nodes of an index ``(doc_id, d1, d2, sigs)`` that is at hand as a table."""
    wanted = nodes.select(F.col("node").alias("doc_id"), "d1", "d2")
    few = wanted.limit(SMALL_SIDE + 1).count() <= SMALL_SIDE
    rows = index.join(F.broadcast(wanted) if few else wanted, ["doc_id", "d1", "d2"], "left_semi").select(F.col("doc_id").alias("node"), "sigs")
    every = index.agg(F.sum(F.size("sigs"))).first()[0] or 0
    return met_in_buckets(packed_signatures(rows, -(-every // BUCKET) or 1))


def jaccard_components(docs: DataFrame, key: str, text: str, n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` for each row: components of links with Jaccard of ``num / den`` or more."""
    every = bands(num, den)
    marks = "".join(chr(c) for c in (0x20, *range(9, 14)))
    # Texts by the logarithm of their white space, near enough for a cost: a few hundred groups, whatever the corpus.
    spaces = F.length(text) - F.length(F.translate(F.col(text), marks, "")) + 1
    counts = docs.filter(F.col(text).isNotNull()).groupBy(F.floor(F.log2(spaces) * 8).alias("eighth")).count().collect()
    starts, sizes = [b.low for b in every], Counter()
    for r in counts:
        sizes[bisect_right(starts, 2 ** (r["eighth"] / 8 + 0.01)) - 1] += r["count"]
    plan = allocate(every, sizes)
    with arrow_rows(docs.sparkSession, 1024):
        index = written(shingle_index(docs, key, text, n, num, den), "join-index")
    real = index.filter("n_shingles > 0 and doc_id is not null")
    firsts = real.groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.min_by(F.struct("n_shingles", "bits"), "doc_id").alias("s"))
    nodes = written(firsts.select("node", "d1", "d2", "s.*"), "join-nodes")
    with arrow_rows(docs.sparkSession, 1024):
        packs = packed_signatures_of(docs, key, text, n, num, den, plan, nodes, int(rows_to_index(plan, sizes, num, den) // BUCKET) + 1)
        buckets = written(met_in_buckets(packs), "join-buckets")
    small = nodes.select("node", "n_shingles", "bits")
    near = buckets.filter("node > center").groupBy("node", "center").agg(F.count(F.lit(1)).alias("shared"))
    stars = near.groupBy("node").agg(F.max_by("center", F.struct("shared", -F.col("center"))).alias("center")).select(F.col("center").alias("a"), F.col("node").alias("b"))
    links = written(verified(written(possible(stars, small, num, den), "join-pairs"), docs, key, text, n, num, den), "join-links")
    meet = buckets.select("sig", "node").distinct()
    for look, best in enumerate((True, True, False)):
        if look == 1:
            with arrow_rows(docs.sparkSession, 1024):
                small = written(finer_bitmaps(docs, key, text, n, num, den, meet.select("node").distinct()), "join-bitmaps")
        pairs = written(cross_pairs(meet, small, component_roots(links, "join-stars"), num, den, best), "join-pairs")
        links = written(links.union(verified(pairs.filter("sig IS NULL"), docs, key, text, n, num, den)), "join-links")
        meet = written(meet.join(pairs.filter("sig IS NOT NULL").select("sig").distinct(), "sig", "left_semi"), "join-left")
        if meet.isEmpty():  # no bucket has pairs that were not looked at
            break
    roots = component_roots(links, "join-stars")
    of_node = nodes.select("node", "d1", "d2").join(roots, "node", "left").select("d1", "d2", F.coalesce("root", "node").alias("component_id"))
    rows = index.select("doc_id", "n_shingles", "d1", "d2").join(of_node, ["d1", "d2"], "left")
    return rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
