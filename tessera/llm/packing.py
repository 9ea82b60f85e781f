"""Packing documents into sequences by multiway Karmarkar-Karp differencing.

Documents are tokenised once (ids are merged by rank, which gives the tokenizer file's ids where they count up in the order of merges, as is checked); only pieces (id, start, length, checksum, and the ids of those that may be cut again) are shuffled. Documents that fit a sequence stay
whole. From longer ones, which lie in several sequences anyway, whole sequences are cut off and the rest is cut into short pieces of one length and an end. The pieces are dealt into bins of bounded size by a hash of row and
place, so no key can make a bin large. In each bin, differencing merges the two partial partitions of largest spread, the
large windows of one with the small windows of the other, until one near-equal partition is left. If a window
exceeds the capacity, the bin is packed again with one window more, up to a small share of the windows. What windows still hold beyond the capacity is
cut off, from pieces of long documents where there are any, and goes to the windows that have room.
"""

from __future__ import annotations

import heapq
import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tessera.llm.bpe import SpacedCodec
from tessera.llm.common import cut

#: Tokens of a sequence, of the longest piece of a longer document besides whole sequences, id that ends a document, pieces of a bin.
CAPACITY, LONGEST, END_ID, BIN = 1024, 256, 0, 2048
#: Windows for each of which there may be one more than the least possible.
SPARE = 256

OUTPUT = ("start", "length", "ids_crc32", "doc_tokens", "bin_key", "ids", "sequence_id", "offset", "_bin", "_ids")
PIECE = "start long, length long, ids_crc32 long, doc_tokens long, bin_key long, _ids binary"


def difference(sizes: list[int], m: int) -> list[int]:
    """Window (0 to m - 1) of each size, by largest differencing into m windows."""
    n = len(sizes)
    if m == 1 or n == 0:
        return [0] * n
    nodes: list[tuple | None] = [None] * n
    heap = []
    for i, size in enumerate(sizes):
        sums = np.zeros(m, np.int64)
        sums[0] = size
        heap.append((-size, i, sums))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        sums = x + y[::-1]  # both descend: largest meets smallest
        order = np.argsort(-sums, kind="stable")
        sums = sums[order] - sums[order[-1]]
        nodes.append((a, b, order))
        heapq.heappush(heap, (-int(sums[0]), len(nodes) - 1, sums))
    window, todo = [0] * n, [(heap[0][1], np.arange(m))]
    while todo:
        k, at = todo.pop()
        if nodes[k] is None:
            window[k] = int(at[0])
            continue
        a, b, order = nodes[k]
        of = np.empty(m, np.int64)
        of[order] = at  # window of each slot before it was sorted
        todo += [(a, of), (b, of[::-1])]
    return window


def windows(sizes: list[int], capacity: int = CAPACITY, spare: int | None = None) -> list[int]:
    """Window of each size, none over capacity; the window count starts at the least possible and rises while one is exceeded.

    If it may rise by ``spare`` only, windows can be over capacity in the end.
    """
    m = max(1, -(-sum(sizes) // capacity))
    last = None if spare is None else m + spare
    while True:
        found = difference(sizes, m)
        if not sizes or m == last or np.bincount(found, weights=sizes).max() <= capacity:
            return found
        m += 1


def level(sizes: list[int], window: list[int], loose: list[bool], capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """(index, start, length, window) of all pieces, after windows over capacity have given their excess to those with room.

    The excess comes off the ends of the window's loose pieces, largest first, then of its largest other pieces. The parts cut off go where they
    fit closest, largest first, and are cut again only if they fit nowhere.
    """
    held: dict[int, list[int]] = {}
    for i, w in enumerate(window):
        held.setdefault(w, []).append(i)
    out, moved, rooms = [], [], []
    for w in range(max(held, default=-1) + 1):
        own = held.get(w, [])
        excess = sum(sizes[i] for i in own) - capacity
        if excess < 0:
            rooms.append((-excess, w))
        for i in sorted(own, key=lambda i: (not loose[i], -sizes[i])):
            off = min(max(excess, 0), sizes[i])
            excess -= off
            if off:
                moved.append((off, i, sizes[i] - off))
            if off < sizes[i]:
                out.append((i, 0, sizes[i] - off, w))
    rooms.sort()
    for size, i, start in sorted(moved, reverse=True):
        while size:
            k = min(bisect_left(rooms, (size, -1)), len(rooms) - 1)
            room, w = rooms.pop(k)
            part = min(size, room)
            out.append((i, start, part, w))
            if part < room:
                insort(rooms, (room - part, w))
            size, start = size - part, start + part
    return out


def read_tokenizer(path: str) -> tuple[dict[bytes, int], list[str]]:
    """Ranks of a byte-level BPE tokenizer's file whose ids count up in the order of its merges, and its special tokens."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    vocab, merges = file["model"]["vocab"], file["model"]["merges"]
    for i, merge in enumerate(merges):
        if vocab["".join(merge.split(" ") if isinstance(merge, str) else merge)] != 256 + i:
            raise ValueError("ids are not in the order of merges")
    # printable bytes stand for themselves in the file, the others for the characters from 256 on, in order
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    special = {t["content"] for t in file["added_tokens"]}
    return {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in special}, sorted(special)


class _Ids:
    def __init__(self, path: str, pattern: str):
        ranks, self.special = read_tokenizer(path)
        self.codec, self.library = SpacedCodec(ranks, pattern), Tokenizer.from_file(path) if self.special else None

    def encode(self, text: str) -> np.ndarray:
        """Ids as the tokenizers library gives them; texts with the string of a special token go to that library itself."""
        if any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.frombuffer(self.codec.encode(text), np.uint32)


@lru_cache(2)
def _ids(path: str, pattern: str) -> _Ids:
    return _Ids(path, pattern)


def cuts(n: int, capacity: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens: all of it if it fits, else whole sequences, then pieces of ``longest`` and what is left of it."""
    if n <= capacity:
        return [(0, n)]
    edges = [*range(0, n - n % capacity, capacity), *range(n - n % capacity, n, longest), n]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def pieces(docs: DataFrame, path: str, pattern: str, text_col: str = "text", capacity: int = CAPACITY, longest: int = LONGEST, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The rows without their text, once for each piece: ``PIECE``. Every document ends with ``end_id``; null texts are empty.

    ``_ids`` has little-endian unsigned 32-bit ids, null for whole sequences unless ``with_ids``.
    """
    kept = [f for f in docs.schema if f.name != text_col and f.name not in OUTPUT]
    schema = T.StructType(kept + list(T.StructType.fromDDL(PIECE)))

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end, row = _ids(path, pattern), np.array([end_id], "<u4"), 0
        for batch in batches:
            texts, at, columns = batch.column(batch.schema.get_field_index(text_col)), [], [[] for _ in range(6)]
            for i, text in enumerate(texts):
                ids = np.concatenate([own.encode(text.as_py() or ""), end])
                for start, length in cuts(len(ids), capacity, longest):
                    part = ids[start : start + length].tobytes()
                    crc = zlib.crc32(part)
                    at.append(i)
                    for column, value in zip(columns, (start, length, crc, len(ids), zlib.crc32(b"%d %d %d" % (row, start, crc)), part if with_ids or length < capacity else None)):
                        column.append(value)
                row += 1
            rest = [batch.column(batch.schema.get_field_index(f.name)).take(pa.array(at, pa.int64())) for f in kept]
            own_columns = [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(columns[5], pa.binary())]
            yield pa.RecordBatch.from_arrays(rest + own_columns, names=schema.fieldNames())

    return docs.select(*(f.name for f in kept), text_col).mapInArrow(tokenise, schema)


def pack(docs: DataFrame, path: str, pattern: str, text_col: str = "text", capacity: int = CAPACITY, longest: int = LONGEST, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row for each piece of each document: the columns of the row but its text, then start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for.

    Sequences hold at most ``capacity`` tokens and have no gap from 0; each token lies in exactly one piece. Ties are broken
    by the order of start, length and checksum. Null and empty texts are one piece that holds ``end_id``. An
    empty table gives no rows. Input columns that are named like an output are left out.
    """
    found = cut(pieces(docs, path, pattern, text_col, capacity, longest, end_id, with_ids))
    n_bins = max(1, found.count() // BIN)
    added = "sequence_id long, offset long" + (", ids array<int>" if with_ids else "")
    schema = T.StructType([f for f in found.schema if f.name not in ("bin_key", "_ids")] + list(T.StructType.fromDDL(added)))

    def deal(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "ids_crc32", "start"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        whole = int((rows["length"] == capacity).sum())
        sizes, loose = rows["length"].tolist()[whole:], (rows["doc_tokens"] > capacity).tolist()[whole:]
        window = windows(sizes, capacity, sum(sizes) // capacity // SPARE)
        parts = [(i, 0, capacity, i) for i in range(whole)] + [(i + whole, start, n, w + whole) for i, start, n, w in level(sizes, window, loose, capacity)]
        at, skip, length, window = np.array(parts, np.int64).T
        rows = rows.iloc[at].reset_index(drop=True)
        for i in np.flatnonzero(length < rows["length"].to_numpy()):
            part = rows.at[i, "_ids"][4 * skip[i] : 4 * (skip[i] + length[i])]
            rows.at[i, "_ids"], rows.at[i, "ids_crc32"] = part, zlib.crc32(part)
        rows["start"], rows["length"], rows["sequence_id"] = rows["start"] + skip, length, window + (int(key[0]) << 32)
        rows = rows.sort_values(["sequence_id", "length"], ascending=[True, False], kind="stable")
        rows["offset"] = rows.groupby("sequence_id")["length"].cumsum() - rows["length"]
        if with_ids:
            rows["ids"] = [np.frombuffer(x, "<u4").astype(np.int32) for x in rows["_ids"]]
        return rows[schema.fieldNames()]

    binned = found.withColumn("_bin", F.col("bin_key") % n_bins).drop("bin_key")
    return binned.groupBy("_bin").applyInPandas(lambda key, rows: deal(key, rows.drop(columns="_bin")), schema)
