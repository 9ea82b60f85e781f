"""Document fingerprints by locally consistent parsing.

A text's bytes are cut into phrases of two to a few symbols; each phrase gets a name, a hash of what it holds, and the
names are parsed again, level by level, until few are left. Cuts are made by deterministic coin tossing: every symbol is
compared with the one before it, the lowest bit that differs gives a short label, and doing it again leaves labels of
a few bits; a cut falls where labels have a local maximum. A cut therefore depends only on a few symbols around it, so equal
substrings have equal phrases inside, wherever they stand. Runs of one symbol have no differing bit and become a phrase of
their own, named by symbol and length.

The fingerprint keeps the ``SKETCH`` smallest hashes of the phrase names of level ``FIRST`` and above, which estimates how many phrases
two documents share. One rule holds for texts of all sizes, so that an edit that moves a text over some size changes no more than it holds.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import let, partitions

#: Rounds of coin tossing, names kept, symbols parsed at a time.
TOSSES, SKETCH, BATCH = 3, 64, 1 << 20
#: First level whose names count, in texts of every size.
FIRST = 2
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _squeeze_runs(x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each run of one symbol in a document as one symbol, named by symbol and length."""
    new = first.copy()
    new[1:] |= x[1:] != x[:-1]
    at = np.flatnonzero(new)
    if len(at) == len(x):
        return x, first
    length = np.diff(at, append=len(x)).astype(np.uint64)
    out = x[at]
    long_ = length > 1
    out[long_] = _mix(out[long_] + length[long_] * np.uint64(0x9E3779B97F4A7C15))
    return out, first[at]


def _lowest_bit(d: np.ndarray) -> np.ndarray:
    """Place of the lowest set bit of 64-bit numbers other than 0."""
    low = (d & (~d + np.uint64(1))).astype(np.float64)  # powers of two are exact
    return (np.frexp(low)[1] - 1).astype(np.uint8)


def cuts(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where phrases begin: a mask over symbols, of which neighbours in a document differ."""
    before = np.empty_like(x)
    before[0], before[1:] = ~x[0], x[:-1]
    before[first] = ~x[first]
    place = _lowest_bit(x ^ before)
    label = place * np.uint8(2) + ((x >> place.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)
    bits = np.array([0] + [(d & -d).bit_length() - 1 for d in range(1, 256)], np.uint8)
    for _ in range(TOSSES - 1):
        before = np.empty_like(label)
        before[0], before[1:] = label[0] ^ 1, label[:-1]
        before[first] = label[first] ^ 1
        place = bits[label ^ before]
        label = place * np.uint8(2) + ((label >> place) & np.uint8(1))
    peak = first.copy()
    if len(x) > 2:
        peak[1:-1] |= (label[1:-1] > label[:-2]) & (label[1:-1] >= label[2:]) & ~first[2:]
        peak[1:] &= ~first[:-1] | first[1:]  # a phrase has two symbols at least, if there are two
    return peak


def name(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Names of the phrases that begin at ``starts``: a hash of their symbols in order."""
    place = (np.arange(len(x)) - np.repeat(starts, np.diff(starts, append=len(x)))).astype(np.uint64)
    return _mix(np.add.reduceat(_mix(x + (place + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)), starts))


def sketches(texts: list[bytes]) -> list[np.ndarray]:
    """The smallest hashed names of each text, in order; equal texts have equal sketches, an empty text an empty one."""
    keep: list[list[np.ndarray]] = [[] for _ in texts]
    data = np.frombuffer(b"".join(texts), np.uint8)
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    x = _mix(data.astype(np.uint64) + np.uint64(1))
    level = 0
    while len(x):
        first = np.empty(len(x), bool)
        first[0], first[1:] = True, doc[1:] != doc[:-1]
        heads = np.flatnonzero(first)
        sizes = np.diff(heads, append=len(x))
        ended = sizes == 1  # a single name is the last level
        counted = np.full(len(heads), level >= FIRST) | ended
        if counted.any():
            hashed = (_mix(x ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)
            for h, n in zip(heads[counted], sizes[counted]):
                part = np.sort(hashed[h : h + n])
                keep[doc[h]].append(part[np.append(True, part[1:] != part[:-1])][:SKETCH])  # names that repeat count once
        go_on = np.repeat(~ended, sizes)
        x, doc, first = x[go_on], doc[go_on], first[go_on]
        if not len(x):
            break
        short, head = _squeeze_runs(x, first)
        doc = doc[first][np.cumsum(head) - 1]
        starts = np.flatnonzero(cuts(short, head))
        x, doc, level = name(short, starts), doc[starts], level + 1
    return [np.unique(np.concatenate(k))[:SKETCH] if k else np.zeros(0, np.uint32) for k in keep]


def all_sketches(texts: list[bytes]) -> list[np.ndarray]:
    """``sketches`` of texts that are parsed together up to ``BATCH`` bytes; a longer text takes about 60 bytes of memory for each of its own."""
    out, group, held = [], [], 0
    for t in texts:
        if group and held + len(t) > BATCH:
            out += sketches(group)
            group, held = [], 0
        group.append(t)
        held += len(t)
    return out + (sketches(group) if group else [])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the smallest names of both that both have, 0 to 1; two empty sketches are alike."""
    both = np.union1d(a, b)[:SKETCH]
    return 1.0 if not len(both) else float(np.isin(both, np.intersect1d(a, b, assume_unique=True), assume_unique=True).mean())


def text_of(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the beginning of the following text, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _bounds_above(bounds: list[int], value: Column) -> Column:
    """How many of the descending bounds are above a value, in about twice the root of their number of steps."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    literal = lambda x: F.split(F.lit(" ".join(map(str, x))), " ").cast("array<long>")  # noqa: E731  folded to one literal
    above = lambda x: F.size(F.filter(x, lambda b: b > value))
    coarse = above(literal(bounds[::step]))
    return let(coarse, lambda c: F.when(c == 0, 0).otherwise((c - 1) * step + above(F.slice(literal(bounds), (c - 1) * step + 1, step))))


def with_following(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows dealt into ranges of descending id, with the row that follows each range at its end (``_extra``).

    Ids alone are sampled for the bounds of ranges; a range's first row is sent once more, to the range before it, and the last range is
    followed by the first row of all. So no task holds more than a range, and texts are shuffled once. Null ids come last.
    """
    spark = docs.sparkSession
    # as many ranges as partitions that were read, or as shuffles have, so that a range is about a block of input
    n = max(partitions(spark), docs.select(id_col).rdd.getNumPartitions(), 1)
    ids = docs.select(F.col(id_col).alias("_id"))
    bounds = sorted({b for b in (ids.agg(F.percentile_approx("_id", [i / n for i in range(1, n)], 10 * n)).first()[0] or [])}, reverse=True)
    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    ranged = base.withColumn("_range", F.when(F.col("_id").isNull(), len(bounds)).otherwise(_bounds_above(bounds, F.col("_id"))))
    order = [F.desc_nulls_last("_id"), F.xxhash64("_text")]
    heads = ranged.groupBy("_range").agg(F.max("_id").alias("_id"))  # one row a range
    before = Window.orderBy("_range")
    moved = heads.withColumn("_to", F.lag("_range").over(before))
    last = F.lit(heads.agg(F.max("_range")).first()[0])
    moved = moved.withColumn("_to", F.coalesce("_to", last))
    extra = ranged.join(F.broadcast(moved), (ranged["_range"] == moved["_range"]) & ranged["_id"].eqNullSafe(moved["_id"])).select(ranged["_id"], "_text", moved["_to"].alias("_range"))
    rows = ranged.withColumn("_extra", F.lit(False)).unionByName(extra.withColumn("_extra", F.lit(True)))
    return rows.repartition(n, "_range").sortWithinPartitions("_range", "_extra", *order)


RESULT = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``RESULT`` for each row: fingerprints of its text and of its edited text, and likeness to the latter and to the next row's text.

    The next row is that of the next smaller id, after the last the first. Rows of one id follow each other in order of a hash
    of their texts; a single row follows itself. Null texts are empty; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: tuple | None = None  # a row whose follower is not known yet
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = [r for r in batch.slice(at, 256).to_pylist()]
                marks = all_sketches([r["_text"].encode("utf-8", "replace") for r in rows])
                pairs = []
                for row, mark in zip(rows, marks):
                    if waiting is not None and waiting[0]["_range"] == row["_range"]:
                        pairs.append((*waiting, row["_text"], mark))
                    # of several extra rows (one id) only the first follows
                    waiting = None if row["_extra"] else (row, mark)
                texts = [edited(r["_text"], follow) for r, _, follow, _ in pairs]
                raw = [t.encode("utf-8", "replace") for t in texts]
                out = [
                    (r["_id"], len(r["_text"]), hashlib.sha256(e).hexdigest(), text_of(m), text_of(em), likeness(m, em), likeness(m, fm))
                    for (r, m, _, fm), e, em in zip(pairs, raw, all_sketches(raw))
                ]
                if out:
                    columns = list(zip(*out))
                    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [f.split()[0] for f in RESULT.split(", ")])

    return with_following(docs, id_col, text_col).mapInArrow(run, RESULT)


def fingerprint():
    """A Column function from text to its fingerprint; null and empty texts have an empty one, equal texts equal ones, a text of any length is parsed whole."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([text_of(s) for s in all_sketches([(t or "").encode("utf-8", "replace") for t in texts])])

    return F.pandas_udf(run, "string")
