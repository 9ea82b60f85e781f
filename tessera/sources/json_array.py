"""JSON arrays read in parts: one file of any size is many tasks.

A byte in the middle of such a file may lie inside a string, so a part can't tell by itself where records begin. What it can tell is how it changes the state: whether it
holds an odd number of quotes that no backslash escapes, and how much deeper it leads, inside a string or outside of one. So a first pass gives one row a part. Parts
of a file are chained in order, which gives the state in which each begins. In a second pass each part gives the records that begin in it and reads on
to the end of the last one. In UTF-8 no byte of a longer character looks like a quote, a backslash or a bracket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.scratch import cut

#: Bytes of a part.
PART = 8 << 20

_OPEN, _CLOSE, _QUOTE, _ESCAPE = np.frombuffer(b"{[", np.uint8), np.frombuffer(b"}]", np.uint8), ord('"'), ord("\\")


def marks(data: bytes, escaped: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of quotes that are not escaped; places of brackets, in strings or not, and +1 or -1 for each. ``escaped``: the first byte follows a backslash that escapes it."""
    b = np.frombuffer(data, np.uint8)
    quotes = np.flatnonzero(b == _QUOTE)
    slashes = np.flatnonzero(b == _ESCAPE)
    if len(slashes) and len(quotes):
        # backslashes in a row before each quote
        starts = np.append(True, np.diff(slashes) > 1)
        run = np.arange(len(slashes)) - np.maximum.accumulate(np.where(starts, np.arange(len(slashes)), 0)) + 1
        if escaped and slashes[0] == 0:
            first = np.append(np.flatnonzero(starts)[1:], len(slashes))[0]
            run[:first] -= 1
        at = np.searchsorted(slashes, quotes - 1)
        odd = (at < len(slashes)) & (slashes[np.minimum(at, len(slashes) - 1)] == quotes - 1) & (run[np.minimum(at, len(slashes) - 1)] % 2 == 1)
        quotes = quotes[~odd]
    if escaped and len(quotes) and quotes[0] == 0:
        quotes = quotes[1:]
    brackets = np.flatnonzero(np.isin(b, np.concatenate([_OPEN, _CLOSE])))
    return quotes, brackets, np.where(np.isin(b[brackets], _OPEN), 1, -1)


def _outside(quotes: np.ndarray, brackets: np.ndarray, in_string: bool) -> np.ndarray:
    """Which of the brackets lie outside of strings."""
    return (np.searchsorted(quotes, brackets) + in_string) % 2 == 0


class _File:
    """A file by byte ranges, wherever the path leads (local, or a store that Arrow opens)."""

    def __init__(self, path: str):
        # Spark writes local paths as file:/a, Arrow wants file:///a
        where, name = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
        self.file = where.open_input_file(name)

    def read(self, start: int, n: int) -> bytes:
        return self.file.read_at(n, start)

    def escaped(self, start: int) -> bool:
        """Whether the byte at ``start`` follows an odd number of backslashes."""
        n, step = 0, 64
        while start > 0:
            piece = self.read(max(0, start - step), min(step, start))
            own = len(piece) - len(piece.rstrip(b"\\"))
            n, start = n + own, start - len(piece)
            if own < len(piece):
                break
        return n % 2 == 1


def _scan(rows: pd.DataFrame) -> pd.DataFrame:
    out = []
    for path, start, n in rows[["path", "start", "n"]].itertuples(index=False):
        f = _File(path)
        quotes, brackets, steps = marks(f.read(start, n), f.escaped(start))
        out.append((path, start, n, len(quotes) % 2, *(int(steps[_outside(quotes, brackets, inside)].sum()) for inside in (False, True))))
    return pd.DataFrame(out, columns=["path", "start", "n", "odd", "depth_out", "depth_in"])


def chained(parts: pd.DataFrame) -> pd.DataFrame:
    """The state in which each part of a file begins. Raises if the file ends inside a string or a bracket."""
    parts, inside, depth, states = parts.sort_values("start"), False, 0, []
    for odd, out, in_ in parts[["odd", "depth_out", "depth_in"]].itertuples(index=False):
        states.append((inside, depth))
        inside, depth = inside ^ bool(odd), depth + (in_ if inside else out)
    if inside or depth:
        raise ValueError(f"{parts['path'].iloc[0]}: the array is not closed")
    parts["inside"], parts["depth"] = [s for s, _ in states], [d for _, d in states]
    return parts[["path", "start", "n", "inside", "depth"]]


def records_of(f, start: int, n: int, inside: bool, depth: int, more: int = 1 << 16) -> Iterator[str]:
    """The records that begin in a part, as texts; the last may end beyond it."""
    data, escaped = f.read(start, n), f.escaped(start)
    while True:
        quotes, brackets, steps = marks(data, escaped)
        out = _outside(quotes, brackets, inside)
        at, steps = brackets[out], steps[out]
        after = depth + np.cumsum(steps)
        begins = at[(steps == 1) & (after == 2)]
        ends = at[(steps == -1) & (after == 1)]
        begins = begins[begins < n]
        ends = ends[ends >= begins[0]][: len(begins)] if len(begins) else ends[:0]
        if len(ends) == len(begins):
            break
        piece = f.read(start + len(data), more)  # until the last record ends
        if not piece:
            raise ValueError("a record is not closed")
        data, more = data + piece, 2 * more
    for a, b in zip(begins.tolist(), ends.tolist()):
        yield data[a : b + 1].decode()


def array_parts(spark: SparkSession, path: str, part: int = PART) -> DataFrame:
    """``path, start, n, inside, depth`` of the parts of the files at a path, written. Only sizes are read to plan; each part is read by a task of its own."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    parts = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(part).cast("long"))).alias("start"), "length")
    parts = parts.select("path", "start", F.least(F.lit(part), F.col("length") - F.col("start")).cast("long").alias("n")).where("n > 0")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    scan = lambda batches: map(_scan, batches)
    scanned = cut(parts.repartition(n, "path", "start").mapInPandas(scan, "path string, start long, n long, odd int, depth_out long, depth_in long"))
    return cut(scanned.groupBy("path").applyInPandas(lambda rows: chained(rows), "path string, start long, n long, inside boolean, depth long"))


def read_json_array(spark: SparkSession, path: str, schema: T.StructType, part: int = PART) -> DataFrame:
    """The records of files that hold one JSON array of objects each, in the columns of the schema, like Spark's multi-line reader in FAILFAST mode, but a file is read by many tasks.

    Strings may hold brackets, quotes and backslashes; records may hold arrays and objects, and may be longer than a part. Fields that a record lacks are null, those that the
    schema lacks are left out. Elements that are no objects are skipped. A record that does not fit the schema raises, as does a file whose array is not closed.
    Empty files and arrays give no rows. Files are found by Spark and opened by Arrow, so the path must be in a store that both know. UTF-8 only.
    """
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path_, start, size, inside, depth in zip(*(c.to_pylist() for c in batch.columns)):
                held: list[str] = []
                for text in records_of(_File(path_), start, size, inside, depth):
                    held.append(text)
                    if len(held) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["json"])
                        held = []
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["json"])

    texts = array_parts(spark, path, part).repartition(n, "path", "start").mapInArrow(read, "json string")
    return texts.select(F.from_json("json", schema, {"mode": "FAILFAST"}).alias("record")).select("record.*")
