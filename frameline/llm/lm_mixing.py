"""Language-model scoring by online logistic context mixing.

A text is the sequence of its lower-cased words and its end, as in the base score; the model's probability is that of
this sequence. A unit is a word and the space that closes it, or the end, with its kind of start (of the text, after a
sentence mark, or other). A unit's bytes are coded bit by bit along a fixed binary tree. Hashed contexts (the
last 1, 2, 3, 4 and 6 bytes and all bytes since the unit's start) each predict the next bit from how often it was 0 and
1 there in training; their log-odds are mixed with weights that a gate picks (by how often the longest contexts were
seen), and the mix is refined by an adaptive map from (gate, mixed log-odds) to the rate observed. A text's score is
the sum of its units' log10 probabilities. These contexts start with the unit, so equal units cost the same and are
counted, learned and scored once for the whole corpus and not once for each occurrence.

What came before the unit is seen by the phrase. Units form phrases of ``PHRASE`` words or so, cut where the units' own hashes say so. The
hashed context of a phrase is the whole phrase before it (or a text's start); it predicts one bit, whether what follows is something
that follows it in a training text, at a rate learned by gate (how often the context was seen, and whether the phrase before was such
a hit). The probability of the phrase is rate * n(context, phrase) / n(context) + (1 - rate) * product of its units'. A text of the training set
is predicted without its own phrases. Units, words and phrases are counted exactly, in tables that grow with the corpus; only the
slots of the spelling contexts are of fixed size.

1. ``gather``: texts become blocks of about ``BLOCK`` bytes with their distinct units, unit counts, packed unit numbers, and phrases.
2. ``unit_counts``: one shuffle by word gives every block's units the corpus counts of the unit and of its word. A word has one row for
   each block and unit, so the most common word is no larger a part of the rows than any other that all blocks hold.
3. ``count_slots``: each task counts its units in tables of a fixed number of slots, the method's own memory bound; Spark
   sums them slice by slice. Only the summed tables (sum of ``SLOTS``, 2 bytes each) reach the driver.
4. ``learn``: groups of units, dealt by hash, predict their units with one occurrence of the unit itself taken out, correct the weights
   after each small step, and fill the map; Spark adds up whole numbers. Groups and their order depend on the units alone, so the
   result is the same for every partitioning.
5. ``phrase_totals``, ``phrase_rates``: the same for phrases.
6. Units are scored, and blocks put the scores of their units and phrases together. In a text, the model is refined by what the
   text has shown so far: unit number n + 1 has probability (k + t * model) / (n + t) if it came k times before, and
   the text's probability is the mean over the strengths t in ``REFINE``, one of which keeps the model as it is.
   The unigram base score comes from the same counts.

``n_bytes`` are the bytes coded: of the words, one for what closes each, and one for the end; ``bits_per_byte`` is the score by these.
Case and kinds of white space are not coded.

All steps after the first read tables in the shared folder, so a lost executor costs its own tasks only.

Edge cases: a null text is the empty text: one end token, and the end coded at its start; without training texts every
token is unknown and bits are even; repeated rows each get a row and each count in training (and so predict each other); a text longer
than a block gets a block of its own, whole; equal hashes of two units or phrases are one; a key column named like a result is called
``<name>_kept``; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameline.llm.common import arrow_rows, kept, release_memory, written
from frameline.llm.text_classes import fit_classes, text_shares, unit_classes

ORDERS = (1, 2, 3, 4, 6, 64)  # bytes of context; the last has all bytes since the unit's start
BY_CLASS = (True, True, True, True, False, True)  # whether a context holds the class of what came before the unit
BITS = (18, 20, 21, 22, 23, 23)  # of each predictor's table
SLOTS = tuple(1 << b for b in BITS)
K = len(ORDERS)
END = 0xFF  # the byte that ends a text, which UTF-8 never uses
BLOCK = 8 << 20
STRETCH = 1 << 20  # bytes handled at once
SLICE = 1 << 16  # slots in a row of the summed tables
UNIT = 16.0  # log-odds are kept in steps of 1/16
LEVELS = 5  # of how often a context was seen: never, once, up to 3, up to 15, more
GATES = LEVELS * LEVELS
STEP, RIDGE = 1 << 14, 20.0  # bits between two corrections of the weights, and what holds the first corrections back
GROUP = 20_000  # units that are learned from together, about
FIXED = float(1 << 20)  # what tasks learn is added up in steps of 1 / FIXED, so that no order of adding matters
PHRASE = 32  # words of a phrase on average
PHRASE_GATES = LEVELS * 3  # how often the phrase before was seen, and whether it was hit: first of its text, missed, hit
REFINE = (2000.0, 200.0, 20.0)  # strengths of the model against the text so far, besides the model alone
LOG_E = float(np.log10(np.e))
# Bytes of common text from frequent to rare, which shapes the coding tree.
FREQUENT = b" etaonihsrdlucmgfpwbyv,.k\n-TSAIECxqjz'\xc3\"PDMLORN\xa9HBFWGU0123456789:;!?()\xff"
# How a unit's last byte is written in the unit's name: a space after a word, END after the last one.
TERMINATORS = {0x20: "s", END: "e"}

BLOCK_SCHEMA = "block long, body binary, units array<string>, seen array<long>, phrases binary, keys array<long>, keys_seen array<long>, n_texts int"


class Tree:
    """Binary code of the 256 bytes, short for frequent ones: nodes and bits on the way to each byte."""

    def __init__(self) -> None:
        weight = np.full(256, 2e-4)
        for rank, byte in enumerate(FREQUENT):
            weight[byte] = 1 / (rank + 4)
        heap = [(w, s, s) for s, w in enumerate(weight.tolist())]
        heapq.heapify(heap)
        children: dict[int, tuple[int, int]] = {}
        for node in range(256, 511):
            (wa, _, a), (wb, _, b) = heapq.heappop(heap), heapq.heappop(heap)
            children[node] = (a, b)
            heapq.heappush(heap, (wa + wb, node, node))
        paths: dict[int, list[tuple[int, int]]] = {510: []}
        for node in range(510, 255, -1):
            for bit, child in enumerate(children[node]):
                paths[child] = [*paths[node], (node - 256, bit)]
        self.length = np.array([len(paths[s]) for s in range(256)], np.int64)
        self.depth = int(self.length.max())
        spread = np.arange(256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        self.offset = np.zeros((self.depth, 256), np.uint64)
        self.bit = np.zeros((self.depth, 256), np.int64)
        for s in range(256):
            for d, (node, bit) in enumerate(paths[s]):
                self.offset[d, s], self.bit[d, s] = spread[node], bit


TREE = Tree()
_ODD = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_POWERS: list[np.ndarray] = []
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E), END]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
IS_STOP = np.zeros(256, bool)
IS_STOP[[*b".!?:"]] = True


def prefix_hashes(buf: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of the bytes from each ``first`` up to each ``last`` (not included)."""
    if not _POWERS or _POWERS[0].size <= buf.size:
        size = 1 << max(21, buf.size.bit_length())
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)])) for x in (_ODD, _INVERSE)]
    power, inverse = _POWERS
    sums = np.zeros(buf.size + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[: buf.size], out=sums[1:])
    own = (sums[last] - sums[first]) * inverse[first]
    own = (own ^ (own >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return own ^ (own >> np.uint64(29))


class Names:
    """Unit names (kind of start, word, terminator) as bytes to code."""

    def __init__(self, units: pa.Array):
        units = units.cast(pa.binary())
        offsets = np.frombuffer(units.buffers()[1], np.int32, len(units) + 1, 4 * units.offset).astype(np.int64)
        self.first, self.last = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
        self.buf = np.frombuffer(units.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].copy()
        back = np.zeros(256, np.uint8)
        for byte, letter in TERMINATORS.items():
            back[ord(letter)] = byte
        self.by_class = np.zeros(len(units), np.uint64)
        if len(units):
            self.buf[self.last - 1] = back[self.buf[self.last - 1]]
            start = self.buf[self.first] - np.uint8(ord("0"))
            self.by_class = (start >> 2).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
            self.buf[self.first] = (start & 3) + np.uint8(ord("0"))
        coded = np.ones(self.buf.size, bool)
        coded[self.first] = False
        self.places = np.flatnonzero(coded)
        self.owner = np.repeat(np.arange(len(units)), self.last - self.first)

    def bits(self) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
        """For each depth of the tree: the places still coded there, their bits and their slots in each table."""
        places, start = self.places, self.first[self.owner[self.places]]
        symbols = self.buf[places]
        by_class = self.by_class[self.owner[places]]
        hashes = [prefix_hashes(self.buf, np.maximum(start, places - k), places) + np.uint64(k) + (by_class if own else np.uint64(0)) for k, own in zip(ORDERS, BY_CLASS, strict=True)]
        for d in range(TREE.depth):
            if d:
                keep = np.flatnonzero(TREE.length[symbols] > d)
                if not keep.size:
                    return
                places, symbols, hashes = places[keep], symbols[keep], [h[keep] for h in hashes]
            offset = TREE.offset[d][symbols]
            yield places, TREE.bit[d][symbols], [((h ^ offset) * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - b)).astype(np.int64) for h, b in zip(hashes, BITS, strict=True)]


def log_odds(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Smoothed log-odds in steps of 1/UNIT, as int8; 0 where nothing was seen."""
    return np.clip(np.rint(UNIT * np.log((ones + 0.25) / (zeros + 0.25))), -127, 127).astype(np.int8)


LEVEL = np.zeros(256, np.int64)
LEVEL[1], LEVEL[2:4], LEVEL[4:16], LEVEL[16:] = 1, 2, 3, 4


def start_weights() -> np.ndarray:
    return np.full((GATES, K), 0.3)


def mixed(x: list[np.ndarray], gate: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Mixed log-odds in steps of 1/UNIT, from -128 to 127."""
    total = np.zeros(gate.size, np.float32)
    for k in range(K):
        total += x[k] * weights[:, k].astype(np.float32)[gate]
    return np.clip(np.rint(total), -128, 127).astype(np.int64)


def without_one(x: np.ndarray, n: np.ndarray, bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds and counts of slots after one occurrence of ``bit`` is taken out; counts of 255 stand for more and stay."""
    ones = np.clip(np.rint((n + 0.5) / (1 + np.exp(-x / UNIT)) - 0.25), 0, n)
    few = (n < 255) & (n > 0)
    zeros = n - ones
    ones, zeros = np.where(few, np.maximum(ones - bit, 0), ones), np.where(few, np.maximum(zeros - (1 - bit), 0), zeros)
    return np.where(few, log_odds(zeros, ones), x).astype(np.int8), np.where(few, n - 1, n)


def _without_one_of_each() -> tuple[np.ndarray, np.ndarray]:
    """Log-odds after ``without_one`` of every log-odds, count and bit, by ``(log-odds + 128) * 512 + count * 2 + bit``, and the level of the count that is left."""
    x, n, bit = (v.ravel() for v in np.meshgrid(np.arange(-128, 128).astype(np.int8), np.arange(256), np.arange(2), indexing="ij"))
    odds, left = without_one(x, n, bit)
    return odds, LEVEL[left].astype(np.int8)


WITHOUT_ONE, LEVEL_LEFT = _without_one_of_each()


def learn_online(names: Names, times: np.ndarray, tables: list[np.ndarray], seen: list[np.ndarray]) -> np.ndarray:
    """Sums over (gate) of weights times bits, bits, and the map's (gate, log-odds, bit) counts, in one vector."""
    weights, observed, used = start_weights(), np.zeros((GATES, 256, 2)), np.zeros(GATES)
    parts = []
    for at, bit, slots in names.bits():
        bit8, keys = bit.astype(np.int8), []
        for k, s in enumerate(slots):
            key = tables[k].take(s).astype(np.int64)
            key += 128
            key <<= 8
            key += seen[k].take(s)
            key <<= 1
            key += bit8
            keys.append(key)
        gate = LEVEL_LEFT.take(keys[-1]) * np.int8(LEVELS) + LEVEL_LEFT.take(keys[-2])
        parts.append((at, bit8, gate, np.stack([WITHOUT_ONE.take(k) for k in keys])))
    if not parts:
        return np.zeros(GATES * K + GATES + GATES * 512)
    at, bits, gate = (np.concatenate([p[i] for p in parts]) for i in range(3))
    x = np.concatenate([p[3] for p in parts], axis=1)
    del parts
    order = np.argsort((at * 2654435761) % (1 << 32), kind="stable")  # units in no order of theirs
    at, bits, gate, x = at[order], bits[order], gate[order], x[:, order]
    weigh = times[names.owner[at]].astype(np.float64)
    curve = np.tile(np.eye(K) * RIDGE, (GATES, 1, 1))
    for k in range(0, bits.size, STEP):
        xs, g, b, w = x[:, k : k + STEP], gate[k : k + STEP], bits[k : k + STEP], weigh[k : k + STEP]
        np.add.at(observed, (g, mixed(list(xs), g, weights) + 128, b), w)
        xs = xs / UNIT
        p = 1 / (1 + np.exp(-(xs * weights[g].T).sum(axis=0)))
        pull, bend = w * (b - p), w * np.maximum(p * (1 - p), 1e-4)
        by_gate, ends = np.argsort(g, kind="stable"), np.cumsum(np.bincount(g, minlength=GATES))
        xs, w, pull, bend = xs.T[by_gate], w[by_gate], pull[by_gate], bend[by_gate]
        for i in np.flatnonzero(np.diff(ends, prepend=0)):
            own = slice(ends[i - 1] if i else 0, ends[i])
            mine = xs[own].T
            used[i] += w[own].sum()
            curve[i] += (mine * bend[own]) @ mine.T
            weights[i] += np.linalg.solve(curve[i], mine @ pull[own])
    return np.concatenate([(weights * used[:, None]).ravel(), used, observed.ravel()])


def log_probabilities(observed: np.ndarray) -> np.ndarray:
    """log10 of the refined probability by (gate, bit, log-odds): the rate observed there, drawn to the plain mix."""
    plain = 1 / (1 + np.exp(-np.arange(-128, 128) / UNIT))
    rate = (observed[:, :, 1] + 30 * plain) / (observed.sum(axis=2) + 30)
    one = np.clip((plain + 3 * rate) / 4, 1e-6, 1 - 1e-6)
    return np.log10(np.stack([1 - one, one], axis=1))


def unit_scores(names: Names, tables: list[np.ndarray], seen: list[np.ndarray], weights: np.ndarray, refined: np.ndarray) -> np.ndarray:
    """log10 probability of each unit."""
    sums, flat = np.zeros(names.first.size), refined.ravel()
    for at, bit, slots in names.bits():
        x = [tables[k].take(s) for k, s in enumerate(slots)]
        gate = LEVEL[seen[-1].take(slots[-1])] * LEVELS + LEVEL[seen[-2].take(slots[-2])]
        sums += np.bincount(names.owner[at], flat[((gate << 1 | bit) << 8) + mixed(x, gate, weights) + 128], sums.size)
    return sums


def units_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts back to back: the lower-cased bytes with END after each text, and each unit's first byte, the byte after
    its last, kind of start, and text. A unit is a word or a text's end, which is a unit without bytes."""
    sizes = np.diff(ends, prepend=0)
    buf = np.full(data.size + sizes.size + 1, END, np.uint8)
    buf[np.arange(data.size) + np.repeat(np.arange(sizes.size), sizes)] = LOWER[data]
    space = IS_SPACE[buf]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    first, last, close = edge[0::2], edge[1::2], ends + np.arange(sizes.size)
    order = np.argsort(np.concatenate([2 * last, 2 * close + 1]), kind="stable")
    first, last = np.concatenate([first, close])[order], np.concatenate([last, close])[order]
    is_end = order >= order.size - close.size
    text = np.cumsum(is_end) - is_end
    kind = np.full(first.size, ord("3"), np.uint8)
    kind[1:][IS_STOP[buf[last[:-1] - 1]]] = ord("2")
    kind[1:][is_end[:-1]] = ord("0")
    kind[:1] = ord("0")
    return buf, first, last, kind, text


def scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def phrases_of(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of hashes of units and their texts: each phrase's number of units, text, and the keys of what comes before it and of both.

    A phrase ends where the hash of two units next to each other says so, and with its text; equal stretches of two texts
    are thus cut alike. The first phrase of a text comes after nothing.
    """
    first = np.concatenate([[True], text[1:] != text[:-1]])
    before = np.where(first, np.uint64(0), np.concatenate([np.zeros(1, np.uint64), words[:-1]]))
    cut = scrambled(words ^ before * _ODD) % np.uint64(PHRASE) == 0
    cut |= np.concatenate([first[1:], [True]])
    last = np.flatnonzero(cut) + 1
    start = np.concatenate([[0], last[:-1]])
    own = prefix_hashes(words, start, last)
    context = np.where(first[start], np.uint64(1), np.concatenate([np.zeros(1, np.uint64), own[:-1]]))
    return last - start, text[start], scrambled(context * _ODD + np.uint64(3)), scrambled((context ^ np.uint64(5)) * _INVERSE + own)


def block_units(data: np.ndarray, ends: np.ndarray, train: np.ndarray, classes: np.ndarray) -> tuple[pa.StringArray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """Distinct unit names from frequent to rare, their counts in training texts, the unit numbers, sizes and coded bytes of texts, and
    the phrases: units, texts, and two keys of each."""
    hashes, seen, total, spans, bodies, numbers, per_text, coded, phrases, base, at = [], [], [], [], [], [], [], [], [], 0, 0
    begins = np.concatenate([[0], ends])
    while at < ends.size:
        n = max(1, int(np.searchsorted(ends[at:], begins[at] + STRETCH, side="right")))
        buf, first, last, kind, text = units_of(data[begins[at] : begins[at + n]], ends[at : at + n] - begins[at])
        words = prefix_hashes(buf, first, last)
        kind += (4 * unit_classes(buf, first, text, classes)).astype(np.uint8)
        phrases.append(phrases_of(words, text))
        phrases[-1][1][:] += at
        coded.append(np.bincount(text, last - first + 1, n).astype(np.int64))
        own = words ^ ((kind + (first == last) * np.uint8(64)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        found, where, inverse = np.unique(own, return_index=True, return_inverse=True)
        hashes.append(found)
        numbers.append(inverse)
        per_text.append(np.bincount(text, minlength=n))
        seen.append(np.bincount(inverse, train[at : at + n][text], found.size))
        total.append(np.bincount(inverse, minlength=found.size))
        length = last[where] - first[where] + 2  # with the kind of start before and the terminator after
        stop = np.cumsum(length)
        body = buf[np.maximum(np.arange(int(stop[-1])) + np.repeat(first[where] - 1 - (stop - length), length), 0)]
        body[stop - length], body[stop - 1] = kind[where], np.where(length == 2, ord("e"), ord("s"))
        bodies.append(body)
        spans.append(np.stack([base + stop - length, length], axis=1))
        base += int(stop[-1])
        at += n
    every, body, span = np.concatenate(hashes), np.concatenate(bodies), np.concatenate(spans)
    found, where, inverse = np.unique(every, return_index=True, return_inverse=True)
    often = np.argsort(-np.bincount(inverse, np.concatenate(total), found.size), kind="stable")
    place = np.empty(found.size, np.int64)
    place[often] = np.arange(found.size)
    counts = np.bincount(inverse, np.concatenate(seen), found.size).astype(np.int64)[often]
    start, length = span[where[often], 0], span[where[often], 1]
    stop = np.cumsum(length)
    take = np.arange(int(stop[-1])) + np.repeat(start - (stop - length), length)
    offsets = np.concatenate([[0], stop]).astype(np.int32)
    units = pa.StringArray.from_buffers(found.size, pa.py_buffer(offsets.tobytes()), pa.py_buffer(body[take].tobytes()))
    ends_of = np.cumsum([0, *map(len, hashes)])
    sequence = np.concatenate([place[inverse[ends_of[i] : ends_of[i + 1]]][x] for i, x in enumerate(numbers)])
    return units, counts, sequence, np.concatenate(per_text), np.concatenate(coded), tuple(np.concatenate(x) for x in zip(*phrases, strict=True))


def pack_phrases(phrases: tuple[np.ndarray, ...], train: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """A block's phrases, its distinct keys, and how often training texts have each."""
    units, text, context, both = phrases
    keys, which = np.unique(np.concatenate([context, both]), return_inverse=True)
    seen = np.bincount(which, np.tile(train[text], 2), keys.size).astype(np.int64)
    numbers = np.concatenate([units, text, which]).astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers).tobytes() + train.tobytes()), keys.view(np.int64), seen


def open_phrases(body: bytes, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Units, texts, and places of the two keys of each phrase; whether each text is one to learn from."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8)
    planes = raw[: raw.size - texts].reshape(4, -1).astype(np.int64)
    numbers = planes[0] + (planes[1] << 8) + (planes[2] << 16) + (planes[3] << 24)
    return *np.split(numbers, 4), raw[raw.size - texts :].astype(bool)


def phrase_state(body: bytes, texts: int, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each phrase: units, text, whether its text is one to learn from, gate, and how often other training texts have what
    comes before it and both. A text's own occurrences never count: no text predicts itself."""
    units, text, context, both, train = open_phrases(body, texts)
    counts = []
    for place in (context, both):
        key = text * (totals.size + 1) + place
        _, which, times = np.unique(key, return_inverse=True, return_counts=True)
        counts.append(totals[place] - np.where(train[text], times[which], 0))
    n_context, n_both = counts
    first = np.concatenate([[True], text[1:] != text[:-1]]) if text.size else np.zeros(0, bool)
    was_hit = np.concatenate([[False], n_both[:-1] > 0]) if text.size else first
    gate = LEVEL[np.minimum(n_context, 255)] * 3 + np.where(first, 0, np.where(was_hit, 2, 1))
    return units, text, train[text], gate, n_context, n_both


def _pack(keys: pa.RecordBatch, sequence: np.ndarray, per_text: np.ndarray, sizes: np.ndarray) -> bytes:
    """Rows, unit numbers by byte planes (which compress well) and sizes."""
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, keys.schema) as w:
        w.write_batch(keys)
    planes = sequence.astype("<u4").view(np.uint8).reshape(-1, 4).T
    head = np.array([sink.tell(), sequence.size, per_text.size], np.int64)
    body = [head, np.frombuffer(sink.getvalue(), np.uint8), np.ascontiguousarray(planes).ravel(), per_text.astype(np.int64), sizes.astype(np.int64)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(x.tobytes() for x in body))


def _unpack(body: bytes) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(body)
    size, n, texts = np.frombuffer(raw, np.int64, 3).tolist()
    keys = pa.ipc.open_stream(raw[24 : 24 + size]).read_next_batch()
    planes = np.frombuffer(raw, np.uint8, 4 * n, 24 + size).reshape(4, n)
    sequence = planes[0] + (planes[1].astype(np.int64) << 8) + (planes[2].astype(np.int64) << 16) + (planes[3].astype(np.int64) << 24)
    per_text, sizes = np.frombuffer(raw[24 + size + 4 * n :], np.int64).reshape(2, texts)
    return keys, sequence, per_text, sizes


def _offsets(column: pa.Array) -> np.ndarray:
    return np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset).astype(np.int64)


def refined_scores(sequence: np.ndarray, per_text: np.ndarray, log_p: np.ndarray, phrases: tuple[np.ndarray, ...], rates: np.ndarray, refine: Sequence[float]) -> np.ndarray:
    """log10 probability of each text: units refined by the text's own earlier ones, and phrases by what followed elsewhere."""
    text = np.repeat(np.arange(per_text.size), per_text)
    key = text * (int(sequence.max(initial=0)) + 1) + sequence
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], np.diff(key[order]) != 0]) if key.size else np.zeros(0, bool)
    place = np.arange(key.size)
    before = np.empty(key.size)
    before[order] = place - np.maximum.accumulate(np.where(new, place, 0))
    so_far = place - np.repeat(np.cumsum(per_text) - per_text, per_text)
    plain = log_p[sequence]
    p = 10.0**plain
    units, owner, _, gate, n_context, n_both = phrases
    phrase = np.repeat(np.arange(units.size), units)
    known = n_context > 0
    hit = np.where(known, rates[gate], 0.0)
    copied = np.log10(np.maximum(hit * n_both / np.maximum(n_context, 1), 1e-300))

    def total(unit: np.ndarray) -> np.ndarray:
        spelled = np.bincount(phrase, unit, units.size) + np.log10(1 - hit)
        return np.bincount(owner, np.where(known & (n_both > 0), np.logaddexp(spelled / LOG_E, copied / LOG_E) * LOG_E, spelled), per_text.size)

    ways = [total(plain)]
    for t in refine:
        ways.append(total(np.where(before > 0, np.log10((before + t * p) / t), plain) + np.log10(t / (so_far + t))))
    best = np.max(ways, axis=0)
    return best + np.log10(np.mean([10.0 ** (w - best) for w in ways], axis=0))


def gather(docs: DataFrame, keys: list[str], classes: np.ndarray) -> DataFrame:
    """Blocks of ``docs(keys..., __text, __train)`` with their distinct units and phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32

        def done(part: list[pa.RecordBatch]) -> pa.RecordBatch:
            nonlocal number
            rows = pa.Table.from_batches(part).combine_chunks().to_batches()[0]
            text = rows.column("__text")
            offsets = _offsets(text)
            data, ends = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]
            train = np.array(rows.column("__train").to_pylist(), bool)
            units, seen, sequence, per_text, coded, phrases = block_units(data, ends, train, classes)
            body = _pack(rows.select([*keys, "__train"]), sequence, per_text, coded)
            packed, own, own_seen = pack_phrases(phrases, train)
            number += 1
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([body], pa.binary()), one(units), one(pa.array(seen, pa.int64())), pa.array([packed], pa.binary()), one(pa.array(own)), one(pa.array(own_seen)), pa.array([rows.num_rows], pa.int32())],
                names=["block", "body", "units", "seen", "phrases", "keys", "keys_seen", "n_texts"],
            )

        part, size = [], 0
        for batch in batches:
            at, offsets = 0, _offsets(batch.column("__text"))
            while at < batch.num_rows:
                n = max(1, int(np.searchsorted(offsets[at + 1 :], offsets[at] + BLOCK - size, side="right")))
                part.append(batch.slice(at, n))
                size += int(offsets[at + n] - offsets[at])
                at += n
                if size >= BLOCK or at < batch.num_rows:
                    yield done(part)
                    part, size = [], 0
        if part:
            yield done(part)
            part = []
        release_memory()

    return docs.mapInArrow(run, BLOCK_SCHEMA)


def unit_counts(gathered: DataFrame) -> DataFrame:
    """(block, place, unit, n_unit, n_word, new_unit, new_word): a row for each block's unit, sorted by word and unit.

    ``new_unit`` and ``new_word`` mark one row of each unit and word. A text's end counts as the empty word.
    """
    rows = gathered.select("block", F.posexplode(F.arrays_zip("units", "seen")).alias("place", "u")).select("block", "place", F.col("u.units").alias("unit"), F.col("u.seen").alias("n"))
    rows = rows.withColumn("word", F.expr("substring(unit, 2, length(unit) - 2)"))
    word, unit = Window.partitionBy("word"), Window.partitionBy("word", "unit")
    ranked = Window.partitionBy("word").orderBy("unit", "block")
    counted = rows.select(
        "block", "place", "unit",
        F.sum("n").over(word).alias("n_word"),
        F.sum("n").over(unit).alias("n_unit"),
        F.lag("unit").over(ranked).alias("before"),
    )
    return counted.select("block", "place", "unit", "n_unit", "n_word", (~F.col("unit").eqNullSafe(F.col("before"))).alias("new_unit"), F.col("before").isNull().alias("new_word"))


def _buffered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    part, n = [], 0
    for batch in batches:
        part.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(part).combine_chunks()
            part, n = [], 0
    if part:
        yield pa.Table.from_batches(part).combine_chunks()


def opened(tables: bytes) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Log-odds and counts of each table, from ``count_slots``."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(tables), np.uint8)
    ends = np.cumsum([0, *SLOTS, *SLOTS])
    parts = [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return [x.view(np.int8) for x in parts[:K]], parts[K:]


def count_slots(units: DataFrame) -> bytes:
    """Compressed: each table's log-odds and counts (up to 255) over all training units. ``units(unit, n_unit)``, each unit once."""

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(2 * n, np.uint32) for n in SLOTS]
        for rows in _buffered(batches, 8_000):
            names, times = Names(rows.column("unit").combine_chunks()), rows.column("n_unit").to_numpy().astype(np.uint32)
            for at, bit, slots in names.bits():
                by = times[names.owner[at]]
                for k in range(K):
                    np.add.at(counts[k], slots[k] * 2 + bit, by)
        pack = zstandard.ZstdCompressor(level=1)
        for k in range(K):
            for at in range(0, SLOTS[k], SLICE):
                part = counts[k][2 * at : 2 * (at + SLICE)]
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([at], pa.int32()), pa.array([pack.compress(np.ascontiguousarray(part.reshape(-1, 2).T).tobytes())], pa.binary())], names=["k", "at", "body"])
            counts[k] = part = None
        release_memory()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for k, at, body in zip(batch.column("k").to_pylist(), batch.column("at").to_pylist(), batch.column("body"), strict=True):
                part = np.frombuffer(unpack.decompress(body.as_py()), np.uint32).reshape(2, -1).astype(np.int64)
                sums[k, at] = sums[k, at] + part if (k, at) in sums else part
        for (k, at), part in sums.items():
            body = log_odds(part[0], part[1]).tobytes() + np.minimum(part.sum(axis=0), 255).astype(np.uint8).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([at], pa.int32()), pa.array([body], pa.binary())], names=["k", "at", "body"])

    schema = "k int, at int, body binary"
    tables = [(np.zeros(n, np.int8), np.zeros(n, np.uint8)) for n in SLOTS]
    for row in written(units.mapInArrow(share, schema).repartition("k", "at").mapInArrow(add, schema), "lm-slots").toLocalIterator():
        half = len(row["body"]) // 2
        tables[row["k"]][0][row["at"] : row["at"] + half] = np.frombuffer(row["body"], np.int8, half)
        tables[row["k"]][1][row["at"] : row["at"] + half] = np.frombuffer(row["body"], np.uint8, half, half)
    return zstandard.ZstdCompressor(level=1).compress(b"".join(t[i].tobytes() for i in (0, 1) for t in tables))


def learn(units: DataFrame, tables) -> tuple[np.ndarray, np.ndarray]:
    """Weights and refined log probabilities, learned by all tasks; ``tables`` is the broadcast of ``count_slots``."""
    width = GATES * K + GATES + GATES * 512

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        odds, seen = opened(tables.value)

        def learned(part: pa.Table) -> np.ndarray:
            return np.rint(FIXED * learn_online(Names(part.column("unit").combine_chunks()), part.column("n_unit").to_numpy(), odds, seen)).astype(np.int64)

        held: pa.Table | None = None
        for rows in _buffered(batches, GROUP):
            held = rows if held is None else pa.concat_tables([held, rows])
            cuts = np.flatnonzero(np.diff(held.column("g").to_numpy())) + 1  # the last group may go on
            for a, b in pairwise([0, *cuts.tolist()]):
                total += learned(held.slice(a, b - a))
            held = held.slice(int(cuts[-1])) if cuts.size else held
        if held is not None:
            total += learned(held)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["at", "value"])
        del odds, seen, held
        release_memory()

    # Groups and their order are set by the units alone, so every partitioning learns the same.
    groups = max(1, -(-units.count() // GROUP))
    dealt = units.withColumn("g", F.pmod(F.xxhash64("unit"), F.lit(groups))).repartition("g").sortWithinPartitions("g", "unit")
    total = np.zeros(width)
    for row in dealt.mapInArrow(run, "at int, value long").groupBy("at").agg(F.sum("value").alias("value")).collect():
        total[row["at"]] = row["value"] / FIXED
    used = total[GATES * K : GATES * (K + 1)]
    weights = np.where(used[:, None] > 0, total[: GATES * K].reshape(GATES, K) / np.maximum(used[:, None], 1), start_weights())
    return weights, log_probabilities(total[GATES * (K + 1) :].reshape(GATES, 256, 2))


def phrase_totals(gathered: DataFrame) -> DataFrame:
    """(block, body): packed shares of each block's keys with how often all training texts have them.

    A key has one row for each block that has it, so even a phrase that all texts share is a small part of the rows.
    """
    rows = gathered.select("block", F.posexplode(F.arrays_zip("keys", "keys_seen")).alias("place", "k")).select("block", "place", F.col("k.keys").alias("key"), F.col("k.keys_seen").alias("n"))
    counted = rows.select("block", "place", F.sum("n").over(Window.partitionBy("key")).alias("n_key")).filter("n_key > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for rows_ in _buffered(batches, 200_000):
            block, place, n_key = (rows_.column(c).to_numpy() for c in ("block", "place", "n_key"))
            order = np.argsort(block, kind="stable")
            parts = np.split(order, np.flatnonzero(np.diff(block[order])) + 1)
            yield pa.RecordBatch.from_arrays([pa.array([int(block[i[0]]) for i in parts], pa.int64()), pa.array([pack.compress(place[i].astype(np.int32).tobytes() + n_key[i].astype(np.int64).tobytes()) for i in parts], pa.binary())], names=["block", "body"])

    return counted.mapInArrow(run, "block long, body binary")


def _key_totals(bodies, size: int) -> np.ndarray:
    out, unpack = np.zeros(size, np.int64), zstandard.ZstdDecompressor()
    for body in bodies:
        raw = unpack.decompress(body.as_py())
        n = len(raw) // 12
        out[np.frombuffer(raw, np.int32, n)] = np.frombuffer(raw, np.int64, n, 4 * n)
    return out


def phrase_rates(gathered: DataFrame, totals: DataFrame) -> np.ndarray:
    """By gate, how often a phrase of a training text followed as in another one, with half a hit and half a miss added."""

    def run(blocks: pa.Table, own: pa.Table) -> pa.Table:
        found = np.zeros((PHRASE_GATES, 2), np.int64)
        for body, size, texts in zip(blocks.column("phrases"), blocks.column("n_keys").to_pylist(), blocks.column("n_texts").to_pylist(), strict=True):
            _, _, train, gate, n_context, n_both = phrase_state(body.as_py(), texts, _key_totals(own.column("body"), size))
            use = train & (n_context > 0)
            np.add.at(found, (gate[use], (n_both[use] > 0).astype(int)), 1)
        return pa.table({"gate": pa.array(range(PHRASE_GATES), pa.int32()), "missed": pa.array(found[:, 0]), "hit": pa.array(found[:, 1])})

    blocks = gathered.select("block", "phrases", F.size("keys").alias("n_keys"), F.col("n_texts"))
    rows = blocks.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(run, "gate int, missed long, hit long").groupBy("gate").agg(F.sum("missed").alias("missed"), F.sum("hit").alias("hit")).collect()
    out = np.full(PHRASE_GATES, 0.5)
    for r in rows:
        out[r["gate"]] = (r["hit"] + 0.5) / (r["hit"] + r["missed"] + 1)
    return out


def scored_units(counted: DataFrame, tables, model) -> DataFrame:
    """(block, body): packed shares of each block's units with word counts and scores; a run of equal units is scored once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds, seen = opened(tables.value)
        weights, refined = model.value
        pack = zstandard.ZstdCompressor(level=1)
        for rows in _buffered(batches, 50_000):
            runs = rows.column("unit").combine_chunks().dictionary_encode()
            score = unit_scores(Names(runs.dictionary), odds, seen, weights, refined)[runs.indices.to_numpy()].astype(np.float32)
            block, place, n_word = (rows.column(c).to_numpy() for c in ("block", "place", "n_word"))
            order = np.argsort(block, kind="stable")
            cuts = np.flatnonzero(np.diff(block[order])) + 1
            parts = np.split(order, cuts)
            bodies = [pack.compress(place[i].astype(np.int32).tobytes() + score[i].tobytes() + n_word[i].astype(np.int64).tobytes()) for i in parts]
            yield pa.RecordBatch.from_arrays([pa.array([int(block[i[0]]) for i in parts], pa.int64()), pa.array(bodies, pa.binary())], names=["block", "body"])
        del odds, seen
        release_memory()

    return counted.select("block", "place", "n_word", "unit").mapInArrow(run, "block long, body binary")


def _shares(bodies: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A block's word counts and scores by unit number."""
    unpack, parts = zstandard.ZstdDecompressor(), []
    for body in bodies:
        raw = unpack.decompress(body.as_py())
        n = len(raw) // 16
        parts.append((np.frombuffer(raw, np.int32, n), np.frombuffer(raw, np.float32, n, 4 * n), np.frombuffer(raw, np.int64, n, 8 * n)))
    place, score, count = (np.concatenate([p[i] for p in parts]) for i in range(3))
    n_word, log_p = np.zeros(place.size, np.int64), np.zeros(place.size)
    n_word[place], log_p[place] = count, score
    return n_word, log_p


def score_texts(docs: DataFrame, text: str, train: str, keys: list[str], refine: Sequence[float] = REFINE, by_phrase: bool = True) -> DataFrame:
    """``keys``, ``train``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``, ``n_bytes``, ``bits_per_byte``.

    Tokens are lower-cased words and one end for each text. The base score is the unigram log10 probability with 0.5
    added to every count. Without ``refine`` and ``by_phrase``, the score is the mixed bit predictors' alone.
    """
    spark = docs.sparkSession
    made = ["train", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"]
    rows = docs.select(*kept(keys, [*made, "__text", "__train"]), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"), F.coalesce(F.col(f"`{train}`"), F.lit(False)).alias("__train"))
    keys = rows.columns[:-2]
    with arrow_rows(spark, 512):
        classes = fit_classes(written(text_shares(rows.filter("__train"), "__text", LOWER), "lm-shares"))
        gathered = written(gather(rows, keys, classes), "lm-blocks")
    counted = written(unit_counts(gathered), "lm-units")
    sums = counted.filter("new_word").agg(F.coalesce(F.sum("n_word"), F.lit(0)).alias("n"), F.count_if(F.col("n_word") > 0).alias("v")).first()
    total, distinct = sums["n"], sums["v"]
    units = counted.filter(F.col("new_unit") & (F.col("n_unit") > 0)).select("unit", "n_unit")
    tables = count_slots(units)
    shared = spark.sparkContext.broadcast(tables)  # 2 bytes for each of sum(SLOTS) slots at most, whatever the corpus
    weights, refined = learn(units, shared)
    model = spark.sparkContext.broadcast((weights, refined))
    totals = written(phrase_totals(gathered), "lm-phrases")
    rates = phrase_rates(gathered, totals) if by_phrase else np.zeros(PHRASE_GATES)
    schema = T.StructType(
        [*(rows.schema[k] for k in keys), T.StructField("train", T.BooleanType())]
        + [T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known", "train_tokens")]
        + [T.StructField(n, T.DoubleType()) for n in ("base_score", "score")]
        + [T.StructField("n_bytes", T.LongType()), T.StructField("bits_per_byte", T.DoubleType())]
    )
    denominator = float(np.log10(total + 0.5 * (distinct + 1)))

    def score(blocks: pa.Table, own: pa.Table) -> pa.Table:
        of_phrase = own.column("of_phrase").to_numpy(zero_copy_only=False).astype(bool)
        out = []
        for body, packed, size in zip(blocks.column("body"), blocks.column("phrases"), blocks.column("n_keys").to_pylist(), strict=True):
            keyed, sequence, per_text, sizes = _unpack(body.as_py())
            n_word, log_p = _shares(own.filter(pa.array(~of_phrase)).column("body"))
            phrases = phrase_state(packed.as_py(), per_text.size, _key_totals(own.filter(pa.array(of_phrase)).column("body"), size))
            text = np.repeat(np.arange(per_text.size), per_text)
            add = lambda v: np.bincount(text, v[sequence], per_text.size)
            coded, base = refined_scores(sequence, per_text, log_p, phrases, rates, refine), add(np.log10(n_word + 0.5)) - per_text * denominator
            columns = [per_text, add(n_word > 0).astype(np.int64), np.full(per_text.size, total, np.int64), base, coded, sizes, -coded / np.log10(2) / sizes]
            out.append(pa.Table.from_arrays([*keyed.columns, *map(pa.array, columns)], names=schema.names))
        return pa.concat_tables(out)

    blocks = gathered.select("block", "body", "phrases", F.size("keys").alias("n_keys"))
    own = scored_units(counted, shared, model).withColumn("of_phrase", F.lit(False)).unionByName(totals.withColumn("of_phrase", F.lit(True)))
    return blocks.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(score, schema)
