"""Language-model scores by online logistic context mixing.

A text is coded word by word, each word by binary decisions:

1. flags: is it the word that followed the last two words most often, or else the one that followed the last word;
2. if not, the steps of its Huffman code among the frequent words, in which one symbol, the escape, stands for all others;
3. after an escape, the letters and a space at the end, each by steps of a Huffman code of its rank after the letter before.

Each decision is predicted from several hashed contexts: words before, what the last flags said, the last very common word (which
tells language and topic), the last letters of the word, its beginning. A context's slot holds how often each answer came there. The predictions are mixed in
the logistic domain by weights that a gate selects, and an adaptive map refines the mixed probability by what came true at such
probabilities. Learning is online: a batch is predicted from what came before it, then weights, map and counts take it in.

A corpus is learned in shards, one a task, each online over all its texts. Counts add up; weights are averaged by the decisions behind
them; of a context's successors the one of most hits stays. Words are counted exactly for the whole corpus: what is gathered are the
counts of all words and each shard's tables. The tables that scoring needs have a fixed number of slots, so they can be broadcast.

Everything that precedes a decision in its text is known before it, so the probabilities of all texts add up to at most 1.
"""

from __future__ import annotations

import ctypes
import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut

#: Words with a code of their own at most; how many of them are very common; bytes of the first and the largest batch.
WORDS, COMMON, FIRST_BATCH, BATCH = 1 << 18, 64, 1 << 17, 1 << 22
#: Slots (as bits) of the successors of one and of two words, and of the contexts of flags, steps and letters.
RUNS, FLAG, STEPS, LETTERS = (19, 22), (10, 18, 11), (WORDS.bit_length(), 20), (16, 18, 19, 19, 19)
#: Buckets of a successor's reliability, range and bins of the map, what is added to counts, learning rate, decisions of a step.
BUCKETS, LIMIT, BINS, PRIOR, RATE, STEP = 16, 12.0, 33, 0.4, 0.2, 8192
#: Numbers of a block that shards are added up in, shards added at a time, distinct words held while counting.
BLOCK, FAN, HELD = 1 << 16, 32, 400_000

_u = np.uint64
#: Longer words are hashed and compared one by one.
LONG = 64
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_START, _M1, _M2 = 0x9E3779B97F4A7C15, _u(0xBF58476D1CE4E5B9), _u(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _u(30))) * _M1
    x = (x ^ (x >> _u(27))) * _M2
    return x ^ (x >> _u(31))


def _slots(bits: int, *parts: np.ndarray) -> np.ndarray:
    h = np.zeros(1, np.uint64)
    for p in parts:
        h = (h ^ p.astype(np.uint64)) * _M1
        h ^= h >> _u(32)
    return ((h * _M2) >> _u(64 - bits)).view(np.int64)


def _give_back() -> None:
    """Returns freed memory to the system: workers are used again by later stages, which have tables of their own."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def huffman(weights, rank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Canonical Huffman codes: each symbol's bits as a number, how many they are (52 at most), and what numbers the inner nodes.

    The inner nodes of a depth have neighbouring beginnings, so the beginning plus a number for the depth counts them from 0.
    """
    n = len(weights)
    order = np.argsort(weights, kind="stable").tolist()
    w = [*map(float, weights), *([0.0] * (n - 1))]
    parent = np.zeros(2 * n - 1, np.int64)
    leaf, head = 0, n
    for new in range(n, 2 * n - 1):
        for _ in range(2):
            if leaf < n and (head >= new or w[order[leaf]] <= w[head]):
                least, leaf = order[leaf], leaf + 1
            else:
                least, head = head, head + 1
            parent[least] = new
            w[new] += w[least]
    at, size = np.arange(n), np.zeros(n, np.int64)
    while (live := at != 2 * n - 2).any():
        size += live
        at = np.where(live, parent[at], at)
    place = np.lexsort((np.arange(n) if rank is None else rank, size))
    longest = int(size.max(initial=0))
    ends = np.cumsum(2.0 ** (longest - size[place])).astype(np.int64)  # exact below 2^53
    bits = np.zeros(n, np.int64)
    bits[place] = np.concatenate([[0], ends[:-1]]) >> (longest - size[place])
    leaves = np.bincount(size, minlength=longest + 1)
    below = np.zeros(longest + 2, np.int64)  # nodes of each depth
    below[0] = 1
    for depth in range(longest + 1):
        below[depth + 1] = 2 * (below[depth] - leaves[depth])
    inner = below[: longest + 1] - leaves
    return bits, size, np.cumsum(inner) - inner - (2 ** np.arange(longest + 1) - inner)


def _windows(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one number; the last seven places have none."""
    return np.ndarray((max(len(data) - 7, 0),), "<u8", data, strides=(1,))


def _joined(words: list[bytes]) -> np.ndarray:
    """Between spaces, with room for a window at any place."""
    return np.frombuffer(b" " + b" ".join(words) + b" " + bytes(8), np.uint8)


class Words:
    """A table of distinct words: finds the numbers of many words at once by hashes, probing from slot to slot, and compares all their bytes."""

    def __init__(self, words: list[bytes]):
        self.data, self.size = _joined(words), np.fromiter(map(len, words), np.int64, len(words))
        self.start = 1 + np.cumsum(self.size + 1) - (self.size + 1)
        self.long = {w: i for i, w in enumerate(words) if len(w) > LONG}
        self.head = self._part(self.data, self.start, self.size, 0)
        self.bits = max(4, (4 * len(words)).bit_length())
        self.table = np.full(1 << self.bits, -1, np.int32)
        at = np.flatnonzero(self.size <= LONG)
        slot = self._slot(self.hashes(self.data, self.start, self.size)[at])
        while len(at):
            free = self.table[slot] < 0
            self.table[slot[free]] = at[free]
            left = self.table[slot] != at
            at, slot = at[left], (slot[left] + 1) & (len(self.table) - 1)

    @staticmethod
    def _part(data: np.ndarray, start: np.ndarray, size: np.ndarray, i: int) -> np.ndarray:
        """The bytes from 8 * i on, eight at most, as a number."""
        return _windows(data)[start + 8 * i] & _MASK.take(np.minimum(size - 8 * i, 8))

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> _u(64 - self.bits)).astype(np.int64)

    @classmethod
    def hashes(cls, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        h = _mix((cls._part(data, start, np.minimum(size, LONG), 0) + size.astype(np.uint64) * _u(_START)) * _M1)
        at = np.flatnonzero((size > 8) & (size <= LONG))
        for i in range(1, LONG // 8):
            if not len(at):
                break
            h[at] = _mix((h[at] ^ cls._part(data, start[at], size[at], i)) * _M2)
            at = at[size[at] > 8 * (i + 1)]
        for i in np.flatnonzero(size > LONG).tolist():
            h[i] = xxhash.xxh64_intdigest(data[start[i] : start[i] + size[i]].data)
        return h

    def find(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Numbers of words, by their ``hashes``; for others, how many words the table has."""
        out = np.full(len(start), len(self.size), np.int32)
        head = self._part(data, start, size, 0)
        at, slot = None, self._slot(h)
        while True:
            found = self.table.take(slot)
            here = np.flatnonzero(found >= 0)
            found, slot = found.take(here), slot.take(here)
            at = here if at is None else at.take(here)
            if not len(at):
                break
            same = (self.head.take(found) == head.take(at)) & (self.size.take(found) == size.take(at))
            more = np.flatnonzero(same & (size.take(at) > 8))
            for i in range(1, LONG // 8):
                if not len(more):
                    break
                a, b, n = at[more], found[more], size[at[more]]
                equal = self._part(data, start[a], n, i) == self._part(self.data, self.start[b], n, i)
                same[more[~equal]] = False
                more = more[equal & (n > 8 * (i + 1))]
            out[at[same]] = found[same]
            at, slot = at[~same], (slot[~same] + 1) & (len(self.table) - 1)
        for i in np.flatnonzero(size > LONG).tolist():
            out[i] = self.long.get(data[start[i] : start[i] + size[i]].tobytes(), len(self.size))
        return out


class Code:
    """The words with a code of their own, in order of falling counts, and the code of letters.

    Words seen once get a code only if all words do. Each then weighs what such words are worth (Good and Turing): words seen twice make up as much
    of other text as their occurrences less one. While learning they are coded as unseen, which they would be without that occurrence.
    """

    def __init__(self, words: list[bytes], counts: list[int], rest: int):
        n = np.array(counts, np.int64)
        self.words, self.counts, self.escape = words, n, len(words)
        self.sure = int((n > 1).sum())
        once = len(n) - self.sure
        worth = min(1.0, 2 * int((n == 2).sum()) / once) if once else 1.0
        rank = np.empty(len(words) + 1, np.int64)
        rank[[*sorted(range(len(words)), key=words.__getitem__), len(words)]] = np.arange(len(words) + 1)
        self.steps = huffman([*np.where(n > 1, n, worth), max(rest + once, 1)], rank)
        bits, size, _ = self.steps
        self.order = np.argsort(bits << (size.max() - size))  # symbols by their codes from left to right
        self.place = np.argsort(self.order)
        data = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.int64)
        pairs = np.bincount(data[:-1] * 256 + data[1:], minlength=65536).reshape(256, 256)
        order = np.argsort(-pairs, axis=1, kind="stable")
        self.rank = np.empty((256, 256), np.int64)
        np.put_along_axis(self.rank, order, np.arange(256)[None, :], axis=1)
        self.letters = huffman(np.take_along_axis(pairs, order, axis=1).sum(axis=0) + 1)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")} | {"words": b" ".join(self.words)}

    def __setstate__(self, state: dict):
        self.__dict__ = state | {"words": state["words"].split(b" ") if state["escape"] else []}

    @property
    def table(self) -> Words:
        if not hasattr(self, "_table"):
            self._table = Words(self.words)
        return self._table


def _steps(code: tuple[np.ndarray, np.ndarray, np.ndarray], symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each step of each symbol: place of the symbol, number of the node, bit."""
    bits, size, shift = code
    n = size.take(symbols)
    owner = np.repeat(np.arange(len(symbols)), n)
    depth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    rest = bits.take(symbols).take(owner) >> (n.take(owner) - 1 - depth)
    return owner, (rest >> 1) + shift.take(depth), rest & 1


def _nodes(code: tuple[np.ndarray, np.ndarray, np.ndarray], symbols: np.ndarray, group: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """The steps of distinct symbols that are sorted by group, then by code, depth by depth.

    Places of the symbols that have this step; where in those the run of each answer of each node begins and the answer; where in the answers
    each node begins and its number.
    """
    bits, size, shift = code
    bits, size = bits.take(symbols), size.take(symbols)
    longest = int(size.max(initial=0))
    at, way = np.arange(len(symbols)), group << longest | bits << (longest - size)
    size = size.astype(np.int8)
    for depth in range(longest):
        on = np.flatnonzero(size > depth)
        if len(on) < len(at):
            at, way, size = at.take(on), way.take(on), size.take(on)
        rest = way >> (longest - 1 - depth)
        runs = np.flatnonzero(np.append(True, rest[1:] != rest[:-1]))
        rest = rest.take(runs)
        node = rest >> 1
        heads = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        yield at, runs, rest & 1, heads, (node.take(heads) & ((1 << depth) - 1)) + shift[depth]


class Tokens:
    """The words of some texts and an end each, with their contexts."""

    def __init__(self, texts: list[bytes], code: Code, learn: bool = False, ends: list[bool] | None = None):
        self.data = _joined(texts)
        stops = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))  # the space after each text
        space = (self.data[:-8] == 32) | (self.data[:-8] - np.uint8(9) < 5)
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        start, size = edges[::2], edges[1::2] - edges[::2]
        until = np.searchsorted(start, stops)
        ended = np.ones(len(texts), bool) if ends is None else np.array(ends, bool)
        self.start, self.size = np.insert(start, until[ended], stops[ended]), np.insert(size, until[ended], 0)
        self.sizes, n = np.diff(until, prepend=0) + ended, len(self.start)
        h = Words.hashes(self.data, self.start, self.size)
        self.known = code.table.find(self.data, self.start, self.size, h)
        self.id = np.where(self.known >= code.sure, code.escape, self.known) if learn else self.known
        self.starts = np.cumsum(self.sizes) - self.sizes
        first = self.starts[self.sizes > 0]
        self.one, self.two = (_mix(x) for x in self._before(h, first))
        at = np.maximum.accumulate(np.where(self.known < min(COMMON, code.escape), np.arange(n), -1))
        at = np.concatenate([[-1], at[:-1]])[:n]
        self.cls = np.where(at >= np.repeat(self.starts, self.sizes), self.known.take(np.maximum(at, 0)), COMMON).astype(np.int64) if n else np.zeros(0, np.int64)
        self.first = first

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.start[i] + self.size[i]].tobytes()

    def spelled(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of some words, each with a space at its end, and how many those are."""
        sizes = self.size[at] + 1
        ends = np.cumsum(sizes)
        data = self.data.take(np.arange(ends[-1]) + np.repeat(self.start[at] - ends + sizes, sizes))
        data[ends - 1] = 32
        return data, sizes

    @staticmethod
    def _before(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one = np.concatenate([[_u(_START)], h[:-1]])[: len(h)]
        one[first] = _START
        two = np.concatenate([[_u(_START)], one[:-1]])[: len(h)]
        two[first] = _START
        return one + _u(1), one * _u(3) + _mix(two)


class Successors:
    """For a slot of contexts, the word that followed most often: the context's tag and the word, its hits and the times that others came."""

    def __init__(self, bits: int):
        self.bits = bits
        self.entry = np.full(1 << bits, -1, np.int64)  # tag and word, in one number for one access
        self.hits, self.others = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)

    def learn(self, context: np.ndarray, word: np.ndarray) -> None:
        if not len(context):
            return
        key = ((context >> _u(64 - self.bits)) << _u(35)) | ((context & _u(0xFFFF)) << _u(19)) | word.astype(np.uint64)
        key.sort()
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        n, key = np.diff(heads, append=len(key)), key[heads]
        best, total = self._best(key >> _u(19), n)
        key, n = key[best], n[best]
        slot = (key >> _u(35)).astype(np.int64)
        best, _ = self._best(slot, n)  # one context a slot
        self.merge(slot[best], (key[best] & _u((1 << 35) - 1)).astype(np.int64), n[best], (total - n)[best])

    @staticmethod
    def _best(group: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the first largest number in each run of equal groups, and the sums of the runs."""
        heads = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        if len(heads) == len(group):
            return heads, n
        top = np.repeat(np.maximum.reduceat(n, heads), np.diff(heads, append=len(group)))
        return np.minimum.reduceat(np.where(n == top, np.arange(len(n)), len(n)), heads), np.add.reduceat(n, heads)

    def merge(self, slot: np.ndarray, entry: np.ndarray, hits: np.ndarray, others: np.ndarray) -> None:
        """Take in entries of distinct slots: equal ones add up, else the one of more hits stays."""
        e, h, o = self.entry[slot], self.hits[slot].astype(np.int64), self.others[slot].astype(np.int64)
        agree, same = e == entry, (e >> 19) == (entry >> 19)
        win = ~agree & (hits > h)
        others = np.where(agree, o + others, np.where(same, np.where(win, others + h + o, o + hits + others), np.where(win, others, o)))
        hits = np.where(agree, h + hits, np.where(win, hits, h))
        most = 1 << 30
        self.hits[slot], self.others[slot] = np.minimum(hits, most), np.minimum(others, most)
        self.entry[slot] = np.where(win, entry, e)

    @staticmethod
    def _buckets(h: np.ndarray, o: np.ndarray) -> np.ndarray:
        """Reliability; none (0) where other words came more often."""
        level = np.array([0, 0, 3, 6, 6, 9, 9, 9, 9, 12], np.uint8).take(np.minimum(h, 9))
        return np.where(o <= h, level + (o > 0) + (4 * o > h) + np.uint8(1), np.uint8(0))

    def settle(self) -> None:
        """All buckets at once, with which scoring needs a single access."""
        self.entry = np.where(self.entry >= 0, self.entry | (self._buckets(self.hits, self.others).astype(np.int64) << 35), -1)
        self.hits = self.others = None

    def look(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The word foreseen (-1 for none) and its bucket (0 for none)."""
        slot = (context >> _u(64 - self.bits)).astype(np.int64)
        e = self.entry.take(slot)
        bucket = e >> 35 if self.hits is None else self._buckets(self.hits.take(slot), self.others.take(slot))
        bucket = np.where((e >= 0) & ((e >> 19) & 0xFFFF == (context & _u(0xFFFF)).astype(np.int64)), bucket, 0).astype(np.int64)
        return np.where(bucket > 0, e & ((1 << 19) - 1), -1), bucket


class Layer:
    """The predictors of one kind of decision: counts by hashed context, gated weights, the adaptive map."""

    def __init__(self, bits: tuple[int, ...], gates: int, rows: int, gated: tuple[int, ...] = ()):
        self.bits, self.gates, self.rows, self.gated, k = bits, gates, rows, gated, len(bits)
        self.count = [np.zeros(2 << b, np.int32) for b in bits]  # 2 * slot + answer; a shard's fit in 31 bits
        self.w = np.full((k + 1, gates), 0.1 + 0.6 / k, np.float32)  # the last is a bias
        self.w[k] = 0
        self.seen, self.map, self.n = np.full((k + 1, gates), 1e-3), np.zeros(rows * BINS * 2), 0

    def settle(self) -> None:
        """What prediction needs, from the counts as they are: by slot the stretched share of ones and the level of its count."""
        prior = np.float32(PRIOR)
        self.stretched = [np.log((c[1::2].astype(np.float32) + prior) / (c[::2].astype(np.float32) + prior)) for c in self.count]
        self.level = {i: np.array([0, 1, 2, 2, 3], np.uint8).take(np.minimum(n, 4)) + (n > 15) + (n > 63) + (n > 255) for i in self.gated for n in [self.count[i][1::2] + self.count[i][::2]]}
        middle, seen = squash(np.linspace(-LIMIT, LIMIT, BINS)), self.map.reshape(self.rows, BINS, 2)
        self.refined = ((seen[..., 1] + 20 * middle) / (seen.sum(axis=2) + 20)).astype(np.float32).ravel()

    def levels(self, i: int, slots: np.ndarray) -> np.ndarray:
        return self.level[i].take(slots).astype(np.int64)

    def mixed(self, x: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        z = self.w[-1].take(gate)
        for w, v in zip(self.w, x):
            z += w.take(gate) * v
        return np.clip(z, -LIMIT, LIMIT, out=z)

    def _place(self, z: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = (z + np.float32(LIMIT)) * np.float32((BINS - 1) / (2 * LIMIT))
        low = np.minimum(at.astype(np.int64), BINS - 2)
        at -= low.astype(np.float32)
        return row * BINS + low, at

    def chance(self, slots: list[np.ndarray], gate: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Probability of a one: the mean of the mixed probability and of what came true near it."""
        z = self.mixed([t.take(s) for t, s in zip(self.stretched, slots)], gate)
        at, part = self._place(z, row)
        low = self.refined.take(at)
        p = (squash(z) + low + (self.refined.take(at + 1) - low) * part) * np.float32(0.5)
        return np.clip(p, 1e-7, 1 - 1e-7)

    def score(self, slots: list[np.ndarray], gate: np.ndarray, row: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """log10 probability of each answer."""
        return np.log10(np.abs(self.chance(slots, gate, row) - (1 - bit)))

    def learn(self, slots: list[np.ndarray], gate: np.ndarray, row: np.ndarray, bit: np.ndarray, zeros: np.ndarray | None = None) -> None:
        """Predict from what was settled, step by step; correct weights and map; count. With ``zeros``, equal decisions are given once, with how often a one (``bit``) and a zero came."""
        values = np.ones((len(slots) + 1, STEP), np.float32)  # the last is the bias
        for a in range(0, len(bit), STEP):
            part = slice(a, a + STEP)
            g, y, none = gate[part], bit[part], None if zeros is None else zeros[part]
            times = None if none is None else y + none
            x = values[:, : len(g)]
            for v, s, at in zip(x, self.stretched, slots):
                s.take(at[part], out=v, mode="clip")
            z = self.mixed(x[:-1], g)
            error = y.astype(np.float32) - (squash(z) if times is None else squash(z) * times.astype(np.float32))
            size = np.sqrt(np.maximum(np.bincount(g, weights=times, minlength=self.gates), 1))
            for i, v in enumerate(x):
                slope = np.bincount(g, weights=error * v, minlength=self.gates) / size
                self.seen[i] += slope * slope
                self.w[i] += (RATE * slope / np.sqrt(self.seen[i])).astype(np.float32)
            at, high = self._place(z, row[part])
            low, bins = 1 - high, len(self.map) // 2
            if times is None:
                at = at * 2 + y
                self.map += np.bincount(at, weights=low, minlength=2 * bins) + np.bincount(at + 2, weights=high, minlength=2 * bins)
            else:
                for answer, n in enumerate((none, y)):
                    self.map[answer::2] += np.bincount(at, weights=low * n, minlength=bins) + np.bincount(at + 1, weights=high * n, minlength=bins)
        self.n += len(bit) if zeros is None else int(bit.sum() + zeros.sum())
        # both counts of a slot are one number for one access
        both = np.left_shift(np.int64(1), 32 * bit) if zeros is None else (bit << 32) + zeros
        for c, s in zip(self.count, slots):
            np.add.at(c.view("<i8"), s, both)


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Model:
    """Successors of two words and of one, and the layers of decisions."""

    def __init__(self, code: Code):
        self.code = code
        self.successors = [Successors(b) for b in RUNS]
        self.flags = [Layer(FLAG, BUCKETS, BUCKETS) for _ in RUNS]
        self.steps, self.letters = Layer(STEPS, 49, 7, (0, 1)), Layer(LETTERS, 28, 7, (3, 4))

    @property
    def layers(self) -> list[Layer]:
        return [*self.flags, self.steps, self.letters]

    def learn(self, t: Tokens) -> None:
        """Online: predict from what was learned before, then take in."""
        for layer in self.layers:
            layer.settle()
        self._run(t, True)
        coded = t.known != self.code.escape  # what is spelled can't be foreseen as a word
        for s, context in zip(self.successors, (t.one, t.two)):
            s.learn(context[coded], t.known[coded])

    def score(self, t: Tokens) -> np.ndarray:
        """log10 probability of each word, after ``ready``."""
        return self._run(t, False)

    def _run(self, t: Tokens, learn: bool) -> np.ndarray:
        out, left = np.zeros(len(t.id)), np.ones(len(t.id), bool)
        (one, sure1), (two, sure2) = (s.look(context) for s, context in zip(self.successors, (t.one, t.two)))
        same = one == two
        state = np.where(sure2 > 0, 1 + (two == t.id), 0)  # what the flags of the words before have said
        past, last = np.zeros(len(t.id), np.int64), state
        for power in (9, 3, 1):
            last = np.concatenate([[0], last[:-1]])[: len(state)]
            last[t.first] = 0
            past += power * last
        for layer, word, sure, other, twice in ((self.flags[1], two, sure2, sure1, same), (self.flags[0], one, np.where(same, 0, sure1), sure2, ~same)):
            at = np.flatnonzero((sure > 0) & left)
            k, bit = sure[at], (word[at] == t.id[at]).astype(np.int64)
            slots = [k * 27 + past[at], _slots(FLAG[1], word[at], past[at] // 9), (k * BUCKETS + other[at]) * 2 + twice[at]]
            if learn:
                layer.learn(slots, k, k, bit)
            else:
                out[at] += layer.score(slots, k, k, bit)
            left[at[bit == 1]] = False
        self._code(t, np.flatnonzero(left), out, learn)
        self._spell(t, np.flatnonzero(left & (t.id == self.code.escape)), out, learn)
        return out

    def _code(self, t: Tokens, at: np.ndarray, out: np.ndarray, learn: bool) -> None:
        """Steps of codes depend on the word and the last common word, so each such pair is done once, and so is each node that the pairs of a common word share."""
        if not len(at):
            return
        code = self.code
        key = ((t.cls[at] * len(code.order) + code.place.take(t.id[at])).astype(np.uint64) << _u(32)) | np.arange(len(at), dtype=np.uint64)
        key.sort()
        back, pair = (key & _u(0xFFFFFFFF)).astype(np.int64), (key >> _u(32)).astype(np.int64)
        head = np.append(True, pair[1:] != pair[:-1])
        which, pair = np.cumsum(head) - 1, pair[head]
        cls = pair // len(code.order)
        nodes = _nodes(code.steps, code.order.take(pair - cls * len(code.order)), cls)
        if learn:
            until, steps = np.concatenate([[0], np.cumsum(np.bincount(which))]), []
            for some, runs, bit, heads, node in nodes:
                first = until.take(some.take(runs))  # symbols with a step at a node are neighbours
                n = until.take(some.take(np.append(runs[1:], len(some)) - 1) + 1) - first
                total = np.add.reduceat(n, heads)
                zeros = np.where(bit.take(heads) == 1, 0, n.take(heads))
                steps.append([x.astype(np.int32) for x in (cls.take(some.take(runs.take(heads))), node, total - zeros, zeros)])
            if steps:  # nodes of all depths and common words in each slice, else it would see one part of the code only
                group, node, ones, zeros = map(np.concatenate, zip(*steps))
                slices = -(-len(node) // STEP)
                for i in range(slices):
                    part = slice(i, None, slices)
                    self.steps.learn(*self._contexts(group[part].astype(np.int64), node[part].astype(np.int64)), ones[part].astype(np.int64), zeros[part].astype(np.int64))
            return
        cost = np.zeros(len(pair))
        for some, runs, bit, heads, node in nodes:
            p = self.steps.chance(*self._contexts(cls.take(some.take(runs.take(heads))), node)).repeat(np.diff(heads, append=len(runs)))
            cost[some] += np.log10(np.abs(p - (1 - bit))).repeat(np.diff(runs, append=len(some)))
        out[at[back]] += cost[which]

    def _contexts(self, group: np.ndarray, node: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Slots, gates and rows of the map for steps at nodes."""
        slots = [node, _slots(STEPS[1], group, node)]
        level = self.steps.levels(1, slots[1])
        return slots, level * 7 + self.steps.levels(0, node), level

    def _spell(self, t: Tokens, at: np.ndarray, out: np.ndarray, learn: bool) -> None:
        sizes = t.size[at] + 1
        for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(np.cumsum(sizes) >> 15)) + 1):  # about 32 KB at a time
            if not len(part):
                continue
            owner, slots, bit = self._letters(*t.spelled(at[part]), t.one[at[part]])
            level = self.letters.levels(3, slots[3])
            gate = level * 4 + np.minimum(self.letters.levels(4, slots[4]), 3)
            if learn:
                self.letters.learn(slots, gate, level, bit)
            else:
                out[at[part]] += np.bincount(owner, weights=self.letters.score(slots, gate, level, bit), minlength=len(part))

    def _letters(self, data: np.ndarray, sizes: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Contexts: the last one to four letters of the word; its beginning and the word before."""
        starts = np.cumsum(sizes) - sizes
        word = np.repeat(np.arange(len(sizes)), sizes)
        depth = np.arange(len(data)) - starts[word]
        last = []
        for n in (1, 2, 3, 4):
            x = np.concatenate([np.full(n, 32, np.uint8), data[:-n]])[: len(data)].astype(np.uint64)
            x[depth < n] = 32
            last.append(x)
        # hash of the beginning: sums of powers, moved to the word's start
        up, down = (np.cumprod(np.full(len(data), p, np.uint64)) for p in (_START, pow(_START, -1, 2**64)))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + _u(1)) * _M1 * up)])
        begin = (sums[:-1] - sums[starts][word]) * down[starts][word] + depth.astype(np.uint64)
        contexts = [last[0]]
        for n in (1, 2, 3):
            contexts.append(contexts[-1] | (last[n] << _u(8 * n)) | _u(n << 48))
        contexts.append(begin * _u(3) + before[word])
        owner, node, bit = _steps(self.code.letters, self.code.rank[last[0].astype(np.int64), data])
        slots, step = [], node.astype(np.uint64) * _u(_START)
        for b, c in zip(LETTERS, contexts):
            x = _mix(c).take(owner)
            x += step
            x *= _M2
            x ^= x >> _u(29)
            x *= _M1
            x >>= _u(64 - b)
            slots.append(x.view(np.int64))
        return word.take(owner), slots, bit

    # shards

    def blocks(self) -> Iterator[tuple[str, int, bytes]]:
        """All that was learned, in pieces that ``add_blocks`` adds up."""
        for i, layer in enumerate(self.layers):
            yield f"weights {i}", 0, _pack(w=layer.w.astype(np.float64) * layer.n, seen=layer.seen, map=layer.map, n=np.array([layer.n]))
            for j, c in enumerate(layer.count):
                for b in range(0, len(c), BLOCK):
                    if (part := c[b : b + BLOCK]).any():
                        yield f"counts {i} {j}", b // BLOCK, _pack(count=part)
        for i, s in enumerate(self.successors):
            for b in range(0, len(s.entry), BLOCK):
                if len(at := np.flatnonzero(s.entry[b : b + BLOCK] >= 0)):
                    e, at = s.entry[b + at], at + b
                    yield f"successors {i}", b // BLOCK, _pack(step=np.diff(at - b, prepend=0), word=e & 0x7FFFF, tag=e >> 19, hits=s.hits[at], others=s.others[at])

    def take(self, kind: str, block: int, data: bytes) -> None:
        """Put a block that was added up over all shards in its place."""
        name, i, *j = kind.split()
        part, at = _unpack(data), slice(block * BLOCK, (block + 1) * BLOCK)
        if name == "successors":
            self.successors[int(i)].merge(block * BLOCK + np.cumsum(part["step"]), part["tag"] << 19 | part["word"], part["hits"], part["others"])
        elif name == "counts":
            self.layers[int(i)].count[int(j[0])][at] = np.minimum(part["count"], (1 << 30) - 1)  # only their proportions count then
        elif part["n"][0]:
            layer = self.layers[int(i)]
            layer.w, layer.map, layer.n = (part["w"] / part["n"][0]).astype(np.float32), part["map"], int(part["n"][0])

    def ready(self) -> Model:
        """Settled, without what only learning needs."""
        for s in self.successors:
            s.settle()
        for layer in self.layers:
            layer.settle()
            layer.count, layer.seen, layer.map = [], None, None
        return self

    def __getstate__(self):
        """Small enough to be sent to every task: half precision, compressed; the code goes by itself."""
        for layer in self.layers:
            layer.stretched = [x.astype(np.float16) for x in layer.stretched]
        return {"data": _squeeze({k: v for k, v in self.__dict__.items() if k != "code"})}

    def __setstate__(self, state: dict):
        self.__dict__ = _stretch(state["data"])
        for layer in self.layers:
            layer.stretched = [x.astype(np.float32) for x in layer.stretched]


def _squeeze(x: dict) -> bytes:
    data = pickle.dumps(x, pickle.HIGHEST_PROTOCOL)
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _stretch(data: bytes) -> dict:
    return pickle.loads(pa.decompress(memoryview(data)[8:], int.from_bytes(data[:8], "little"), "zstd"))


def _pack(**arrays: np.ndarray) -> bytes:
    """Whole numbers are kept in the smallest type that holds them."""
    small = {k: v.astype(np.min_scalar_type(int(v.max(initial=0)))) if v.dtype.kind in "iu" and v.min(initial=0) >= 0 else v for k, v in arrays.items()}
    return _squeeze(small)


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    return {k: v.astype(np.int64) if v.dtype.kind in "iu" else v for k, v in _stretch(data).items()}


def add_blocks(kind: str, parts: list[bytes]) -> bytes:
    """One block of several shards' blocks, in the order given."""
    first, *rest = map(_unpack, parts)
    if kind.startswith("successors"):
        s = Successors(BLOCK.bit_length() - 1)
        for p in (first, *rest):
            s.merge(np.cumsum(p["step"]), p["tag"] << 19 | p["word"], p["hits"], p["others"])
        at = np.flatnonzero(s.entry >= 0)
        e = s.entry[at]
        return _pack(step=np.diff(at, prepend=0), word=e & 0x7FFFF, tag=e >> 19, hits=s.hits[at], others=s.others[at])
    for p in rest:
        first = {k: v + p[k] for k, v in first.items()}
    return _pack(**first)


_SPACES = b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"


def batches_of(texts: Iterator[tuple], size: int, most: int = BATCH) -> Iterator[list[tuple]]:
    """Groups of (text, whether it ends there, ...) of about so many bytes, at first ``size``, then twice as many each time up to ``most``; longer texts come in pieces."""
    group, held = [], 0
    for text, *rest in texts:
        at = 0
        while at < len(text) or at == 0:
            end = len(text)
            if end - at > most:
                end = max(text.rfind(c, at, at + most) for c in _SPACES) + 1 or at + most
            group.append((text[at:end], end == len(text), *rest))
            held, at = held + end - at, max(end, 1)
            if held >= size:
                yield group
                group, held, size = [], 0, min(2 * size, most)
    if group:
        yield group


def _texts(batches: Iterator[pa.RecordBatch], *columns: int) -> Iterator[tuple]:
    """The texts of the last column as lower-case bytes, with other columns of their rows."""
    for batch in batches:
        others = [batch.column(i).to_pylist() for i in columns]
        for text, *rest in zip(batch.column(batch.num_columns - 1).cast(pa.large_binary()), *others):
            yield (text.as_py() or b"").lower(), *rest


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
        counts.clear()
        return out

    for (text,) in _texts(batches):
        counts.update(text.split())
        counts[b""] += 1
        if len(counts) >= HELD:
            yield flush()
    yield flush()


def _class_of(n: Column) -> Column:
    """Counts fall into a bounded number of classes: exact up to 64, then eighths of powers of two."""
    return F.when(n <= 64, n).otherwise(F.floor(F.log2(n.cast("double")) * 8) + 16).cast("int")


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
_RATED = "row long, doc_id long, held_out boolean, n_tokens long, n_bytes long, known long, base double, score double, rare array<long>"


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_col: str = "held_out", words: int = WORDS) -> DataFrame:
    """``RESULT`` for every row: tokens, those known from training, unigram score, the model's score (log10) and bits per byte.

    Rows whose ``held_col`` is not true are learned from. Words are ``[^\\x20\\x09-\\x0D]+``, A to Z lower-cased, and an end.
    Null texts are empty: one token, the end. Repeated rows count and are scored each; ids are cast to long, null ids stay. With nothing to
    learn from all words are spelled. An empty table gives no rows; other columns are ignored. Contexts start anew every ``BATCH`` bytes of a text.
    At most ``words`` words have a code of their own: the most frequent, without those of the least count that would not all fit.
    """
    spark = docs.sparkSession
    held = F.coalesce(F.col(held_col), F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held"), F.col(text_col).alias("text"))
    train = rows.where("not held").select("text")
    counted = train.mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = cut(counted.withColumn("class", _class_of(F.col("n"))))
    classes = sorted(((r["class"], r["w"], r["n"]) for r in counted.groupBy("class").agg(F.count("*").alias("w"), F.sum("n").alias("n")).collect()), reverse=True)
    n_words, n_train = sum(w for _, w, _ in classes), sum(n for _, _, n in classes)
    least, held_words, held_tokens = 1 << 30, 0, 0
    for c, w, n in classes:
        if held_words + w > words:
            break
        least, held_words, held_tokens = c, held_words + w, held_tokens + n
    top = counted.where(F.col("class") >= least).select("word", "n").toArrow().sort_by([("n", "descending"), ("word", "ascending")])  # ``words`` rows at most
    code = Code(top["word"].to_pylist(), top["n"].to_pylist(), n_train - held_tokens)
    del top
    own = spark.sparkContext.broadcast(code)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for group in batches_of(_texts(batches), FIRST_BATCH):
            model = model or Model(own.value)
            model.learn(Tokens([t for t, _ in group], own.value, True, [e for _, e in group]))
        if model:
            part = TaskContext.get().partitionId()
            for kind, block, data in model.blocks():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([kind]), pa.array([block], pa.int64()), pa.array([data], pa.binary())], ["part", "kind", "block", "data"])
        del model
        _give_back()

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        data = add_blocks(key[0], rows["data"].tolist())
        return pd.DataFrame({"part": [key[2]], "kind": [key[0]], "block": [key[1]], "data": [data]})

    blocks, schema = train.mapInArrow(learn, "part long, kind string, block long, data binary"), "part long, kind string, block long, data binary"
    shards = train.rdd.getNumPartitions()
    while True:  # FAN shards at a time, so that no task holds more than FAN blocks
        blocks = blocks.groupBy("kind", "block", F.floor(F.col("part") / FAN).alias("group")).applyInPandas(add, schema)
        shards = -(-shards // FAN)
        if shards <= 1:
            break
    model = Model(code)
    for r in blocks.select("kind", "block", "data").collect():  # the fixed size of the tables
        model.take(r["kind"], r["block"], bytes(r["data"]))
    known = np.log10((np.append(code.counts, 0) + 1) / (n_train + n_words + 1))
    shared = spark.sparkContext.broadcast((model.ready(), known))
    del model

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (model, base), code = shared.value, own.value
        model.code = code
        number, part, open_ = 0, TaskContext.get().partitionId(), None
        for group in batches_of(_texts(batches, 0, 1), BATCH):
            t = Tokens([g[0] for g in group], code, ends=[g[1] for g in group])
            scores, unknown = model.score(t), t.known == code.escape
            bases = np.where(unknown, 0, base.take(t.known))
            ends, out = (t.starts + t.sizes).tolist(), [[] for _ in range(9)]
            for (text, last, doc_id, held), a, b in zip(group, t.starts.tolist(), ends):
                rare = [xxhash.xxh64_intdigest(t.word(i), 42) for i in (a + np.flatnonzero(unknown[a:b])).tolist()]
                now = [b - a, int(t.size[a:b].sum()) + b - a, b - a - len(rare), float(bases[a:b].sum()), float(scores[a:b].sum()), rare]
                open_ = [x + y for x, y in zip(open_, now)] if open_ else now
                if last:
                    for column, value in zip(out, ((part << 33) + number, doc_id, held, *open_)):
                        column.append(value)
                    number, open_ = number + 1, None
            signed = pa.array(np.fromiter((h for r in out[8] for h in r), np.uint64).view(np.int64))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in out[8]])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out[:8], _TYPES)] + [pa.ListArray.from_arrays(offsets, signed)], [f.split()[0] for f in _RATED.split(", ")])

    rated = cut(rows.mapInArrow(rate, _RATED))
    # words without a code are looked up among all counted words, by the same hash
    rare = rated.select("row", F.explode("rare").alias("h")).groupBy("row", "h").agg(F.count("*").alias("times"))
    others = counted.where(F.col("class") < least).select(F.xxhash64("word").alias("h"), "n")
    found = rare.join(others.hint("merge"), "h").groupBy("row").agg(F.sum("times").alias("known_rare"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("gain"))
    zero = F.log10(F.lit(float(n_train + n_words + 1)))
    out = rated.withColumn("unknown", F.size("rare")).drop("rare").join(found, "row", "left")
    base = F.col("base") - F.col("unknown") * zero + F.coalesce("gain", F.lit(0.0))
    known_n = (F.col("known") if n_train else F.lit(0)) + F.coalesce("known_rare", F.lit(0))
    return out.select("doc_id", F.col("held_out"), "n_tokens", known_n.cast("long").alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"), base.alias("base_score"), "score", (-F.col("score") * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"))


_TYPES = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
