"""Exact dedup by composable polynomial fingerprints, confirmed by a chunkwise comparison of the bytes.

A text's bytes, A to Z lower-cased, are the coefficients of a polynomial; its values at two fixed points modulo 2**61 - 1 are the fingerprint.
Values combine: that of two strings in a row is the first one's, times the point to the power of the second's length, plus the second one's. So the chunks of a
huge text are hashed by any number of tasks, each value is shifted by the bytes that follow its chunk, and a sum gives the fingerprint
that the whole text would give.

Texts of equal length and fingerprint are a class. All of its texts are compared with one of them, the leader, chunk by chunk: chunks are the rows of a
sort-merge join whose other side holds one row a class and chunk, so a class of any size streams past its leader and may be split over tasks. Only
texts that differ leave the join. They form a class of their own and the comparison is repeated for them alone, until none differs; so the result is
exact whatever the fingerprints do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import among, ascii_lower, bitmap, cut, partitions

#: The modulus and the two points; bytes hashed in one product, in which sums stay below 2**53; bytes of a chunk.
PRIME, POINTS, BLOCK, CHUNK = (1 << 61) - 1, (0x1B873593CC9E2D51, 0x0E6546B64D2C7F35), 4096, 1 << 16
#: What a class of equal texts is known by.
_CLASS = ["n", "f1", "f2", "class"]


@cache
def _powers() -> np.ndarray:
    """High and low 31 bits of each point's powers, the highest power first."""
    out = np.empty((BLOCK, 2 * len(POINTS)))
    for k, point in enumerate(POINTS):
        x = 1
        for i in range(BLOCK - 1, -1, -1):
            out[i, 2 * k : 2 * k + 2] = x >> 31, x & 0x7FFFFFFF
            x = x * point % PRIME
    return out


@cache
def _step() -> list[int]:
    return [pow(point, BLOCK, PRIME) for point in POINTS]


def fingerprint(data: bytes) -> tuple[int, ...]:
    """Values of the polynomial of the bytes plus one, at each point. Empty strings give zeros."""
    symbols = np.frombuffer(data, np.uint8).astype(np.float64)
    symbols += 1
    head, powers = len(symbols) % BLOCK, _powers()
    out = [0] * len(POINTS)
    for row in [symbols[:head] @ powers[BLOCK - head :], *(symbols[head:].reshape(-1, BLOCK) @ powers)]:
        for k, step in enumerate(_step()):
            out[k] = (out[k] * step + (int(row[2 * k]) << 31) + int(row[2 * k + 1])) % PRIME
    return tuple(out)


def shifted(values: tuple[int, ...], n: int) -> tuple[int, ...]:
    """The values with ``n`` more bytes to follow."""
    return tuple(v * pow(point, n, PRIME) % PRIME for v, point in zip(values, POINTS))


def combined(left: tuple[int, ...], right: tuple[int, ...], n: int) -> tuple[int, ...]:
    """The fingerprint of two strings in a row, the right one ``n`` bytes long."""
    return tuple((a + b) % PRIME for a, b in zip(shifted(left, n), right))


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * len(kinds), kinds)], names)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, rid, text, n``; ``rid`` also tells texts of one id apart."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text")).select("id", _rid(F.col("id"), F.col("text")).alias("rid"), "text", F.octet_length("text").cast("long").alias("n"))


def _rid(row_id: Column, text: Column) -> Column:
    return F.concat_ws(":", F.hex(F.xxhash64(text)), row_id.cast("string"))


def _chunks(rows: DataFrame) -> DataFrame:
    """The huge texts' chunks, written: ``id, rid, n, sha, i, chunk``. They lie in many files, so that one text is hashed by many tasks."""
    lowered = rows.where(F.col("n") > CHUNK).select("id", "rid", "n", ascii_lower(F.col("text")).cast("binary").alias("data"))
    of = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK)), lambda i: F.substring("data", (i * CHUNK + 1).cast("int"), F.lit(CHUNK)))
    out = lowered.select("id", "rid", "n", F.sha2("data", 256).alias("sha"), F.posexplode(of).alias("i", "chunk"))
    return cut(out.repartition(partitions(rows.sparkSession), "rid", "i"))


def _ordinary(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("n") <= CHUNK).select("id", "rid", "n", F.col("text").cast("binary").alias("data"))


def _fingerprints(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """``id, rid, n, f1, f2, sha`` of every row, repeats included."""
    kind = rows.schema["id"].dataType.simpleString()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lowered = [x.as_py().lower() for x in batch.column(3)]
            found = [(*fingerprint(x), hashlib.sha256(x).hexdigest()) for x in lowered]
            own = _batch(found, [pa.int64(), pa.int64(), pa.string()], ["f1", "f2", "sha"])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *own.columns], ["id", "rid", "n", "f1", "f2", "sha"])

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            after = [max(0, n - (i + 1) * CHUNK) for n, i in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist())]
            found = [shifted(fingerprint(x.as_py()), k) for x, k in zip(batch.column(5), after)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *_batch(found, [pa.int64()] * 2, ["f1", "f2"]).columns], ["id", "rid", "n", "sha", "i", "f1", "f2"])

    ordinary = _ordinary(rows).mapInArrow(whole, f"id {kind}, rid string, n long, f1 long, f2 long, sha string")
    parts = chunks.mapInArrow(terms, f"id {kind}, rid string, n long, sha string, i int, f1 long, f2 long")
    # rows that repeat have the same chunks: each counts once, and the row is given as often as it was there
    parts = parts.groupBy("id", "rid", "n", "sha", "i").agg(F.min("f1").alias("f1"), F.min("f2").alias("f2"), F.count("*").alias("times"))
    folded = lambda c: (F.sum(F.col(c).cast("decimal(20,0)")) % F.lit(PRIME).cast("decimal(20,0)")).cast("long").alias(c)
    huge = parts.groupBy("id", "rid", "n", "sha").agg(folded("f1"), folded("f2"), F.min("times").alias("times"))
    huge = huge.select("id", "rid", "n", "f1", "f2", "sha", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int")))).drop("col")
    return ordinary.unionByName(huge)


def _classes(members: DataFrame) -> DataFrame:
    """Classes of more than one row: size, largest id, and the row that leads. Combined inside tasks, so a class of any size is a few rows."""
    lead = F.max(F.struct("id", "rid"))["rid"].alias("lead")
    return cut(members.groupBy(*_CLASS).agg(F.count("*").alias("size"), F.max("id").alias("keep"), lead).where("size > 1"))


def _differing(rows: DataFrame, chunks: DataFrame, members: DataFrame, classes: DataFrame, first: bool) -> DataFrame:
    """``rid`` of the members whose bytes are not those of the leader of their class; ``first``: all rows are members, of class 0."""
    wanted = bitmap(classes.select("f1"), "f1")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lowered = [x.as_py().lower() for x in batch.column(2)]
            found = [fingerprint(x) for x in lowered]
            at = np.flatnonzero(wanted(np.array([f[0] for f in found], np.int64))) if found else np.zeros(0, int)
            own = _batch([(*found[k], 0, lowered[k]) for k in at], [pa.int64(), pa.int64(), pa.int32(), pa.binary()], ["f1", "f2", "i", "chunk"])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at)) for c in range(2)), *own.columns], ["rid", "n", "f1", "f2", "i", "chunk"])

    def taken(of: DataFrame) -> DataFrame:
        out = of.select("rid", "n", "data").mapInArrow(parts, "rid string, n long, f1 long, f2 long, i int, chunk binary")
        return out.withColumn("class", F.lit(0)) if first else out.join(members.select("rid", "class").distinct().hint("merge"), "rid")

    huge = members.where(F.col("n") > CHUNK).join(classes.select(*_CLASS), _CLASS, "left_semi").select("rid", "f1", "f2", "class").distinct()
    huge = chunks.select("rid", "n", "i", "chunk").join(huge, "rid")
    known = _ordinary(rows) if first else among(_ordinary(rows), members.select("rid"), "rid")
    # one row a class and chunk, written: so the join's sides are plain exchanges and a class that many rows share is split over tasks
    leaders = taken(among(known, classes.select("lead"), "lead", of="rid")).unionByName(huge)
    leaders = leaders.join(classes.select(*_CLASS, "lead"), _CLASS).where(F.col("lead") == F.col("rid"))
    leaders = cut(leaders.dropDuplicates([*_CLASS, "i"]).select(*_CLASS, "i", F.col("chunk").alias("own")))
    return taken(known).unionByName(huge).join(leaders.hint("merge"), [*_CLASS, "i"]).where("chunk <> own").select("rid").distinct()


def groups_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: ``id, rid, keep_id, group_size`` (long), ``kept``, ``text_sha256`` of the text with A to Z lower-cased.

    Texts are equal if they are the same after lower-casing A to Z; a null text is an empty one. Of equal texts the row of the largest id stays; rows that repeat that id
    with an equal text all stay, and all count in ``group_size``. A null id is less than any other: such rows go if an equal text has an id, and
    all stay if none has. Texts of any length are compared in chunks. An empty table gives no rows. Other columns are ignored.
    """
    rows = _rows(docs, id_col, text_col)
    chunks = _chunks(rows)
    members = cut(_fingerprints(rows, chunks)).withColumn("class", F.lit(0))
    out, first = None, True
    while True:
        classes = _classes(members)
        apart = cut(_differing(rows, chunks, members, classes, first))
        if settled := apart.isEmpty():
            stay = members
        else:  # what is not its leader's text is a class of its own and is compared again
            stay = members.join(apart, "rid", "left_anti")
            classes = _classes(stay)
        named = stay.join(classes.select(*_CLASS, "size", "keep").hint("merge"), _CLASS, "left")
        keep = F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("keep"))
        named = named.select("id", "rid", keep.alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), keep.eqNullSafe(F.col("id")).alias("kept"), F.col("sha").alias("text_sha256"))
        out = named if out is None else out.unionByName(named)
        if settled:
            return out
        members, first = cut(members.join(apart, "rid", "left_semi").withColumn("class", F.col("class") + 1)), False


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one of each group of equal texts left, in all their columns, whatever the names. See ``groups_of`` for which one. Only texts that may go are moved."""
    gone = cut(groups_of(docs, id_col, text_col).where("not kept").select("rid").distinct())
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"))
    row = row.withColumn("rid", _rid(F.col("d")[id_col], F.coalesce(F.col("d")[text_col], F.lit(""))))
    out = among(row, gone, "rid").join(gone.hint("merge"), "rid", "left_anti").unionByName(among(row, gone, "rid", apart=True))
    return out.select(*(F.col("d")[c].alias(c) for c in docs.columns))
