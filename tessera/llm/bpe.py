"""Byte-level BPE encoding and decoding by overlapping chunks.

Every text is cut into chunks that overlap. Each chunk is pre-tokenised by itself, so chunks are independent work. The
pattern looks ahead but never back: what follows a boundary depends only on the text from there on. So where two chunks have a
boundary in common inside their overlap, they agree from there on, and the second takes over. The last boundaries of a chunk
can still be moved by text beyond its end and are left out. If an overlap has no common boundary (one giant run), the
text from the last sure boundary is pre-tokenised again with a longer chunk, so results are always those of the whole text. This holds for any pattern that
does not look back and looks at most ``LOOK`` characters ahead of a pre-token that ends there.

Then pieces are encoded; the ids of pieces that were met are remembered.

The same holds between the segments of a huge text, which are rows of their own: any number of tasks encode them, each says how many ids it has at each boundary of
its overlaps, and of two neighbours' boundaries the first in common tells how many ids of each to take.
"""

from __future__ import annotations

import base64
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import cut, partitions

#: Code points of a chunk and of its overlap with the next; look-ahead of the pattern; pieces whose ids are remembered, and code points of the longest of them.
CHUNK, OVERLAP, LOOK, REMEMBERED, LONGEST = 2048, 96, 4, 150_000, 64
#: Rows whose ids are held at once.
ROWS = 512
#: Code points of a segment of a huge text and of its overlap with the next.
SEGMENT, SHARED = 1 << 16, 1 << 10


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def pre_tokens(find: Callable[[str], list[str]], text: str, start: int, end: int) -> tuple[list[str], list[int]]:
    """The pre-tokens of ``text[start:end]`` and their ends; those that the text beyond ``end`` may move are left out."""
    found = find(text[start:end])
    ends = list(accumulate(map(len, found), initial=start))[1:]
    if end < len(text):
        keep = bisect_right(ends, end - LOOK)
        del found[keep:], ends[keep:]
    return found, ends


def stitch(find: Callable[[str], list[str]], text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """The pre-tokens of a whole text, from its chunks, in time that grows with its length."""
    n = len(text)
    out, ends = pre_tokens(find, text, 0, min(chunk, n))
    done, at = [], 0  # ``out`` begins at ``at``
    for start in range(chunk - overlap, n - overlap, chunk - overlap):
        end = min(start + chunk, n)
        last = ends[-1] if ends else at
        if last >= end:
            continue  # a giant run has been followed to beyond this chunk
        more, more_ends = pre_tokens(find, text, start, end)
        known = set(ends[bisect_right(ends, start) :])
        k = next((k for k, e in enumerate(more_ends) if e in known), None)
        if k is None:
            # no boundary in common: go on from the last sure one, with ever longer pieces
            done += out
            at, size = last, chunk
            while True:
                out, ends = pre_tokens(find, text, at, min(at + size, n))
                if ends or at + size >= n:
                    break
                size *= 2
            continue
        keep = bisect_right(ends, more_ends[k])
        done += out[:keep]
        out, ends, at = more[k + 1 :], more_ends[k + 1 :], more_ends[k]
    done += out
    last = ends[-1] if ends else at
    if last < n:  # the run of a chunk that was passed over
        done += pre_tokens(find, text, last, n)[0]
    return done


class Codec:
    """Encoder and decoder of a table of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.find = regex.compile(pattern).findall
        self.merge = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.known: dict[str, bytes] = {}

    def _coded(self, pieces: list[str]) -> list[bytes]:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        long: dict[str, bytes] = {}
        for piece in set(pieces).difference(known):
            (known if len(piece) <= LONGEST else long)[piece] = array("I", self.merge(piece)).tobytes()
        return [long[p] if p in long else known[p] for p in pieces] if long else list(map(known.__getitem__, pieces))

    def encode(self, text: str) -> bytes:
        """Ids as unsigned 32-bit numbers of the machine's byte order."""
        return b"".join(self._coded(stitch(self.find, text)))

    def encode_segment(self, text: str, start: int, last: bool, shared: int) -> tuple[bytes, dict[int, int], dict[int, int]]:
        """Ids of a segment that begins at ``start``, and the number of ids before each boundary of its two overlaps, by place.

        What the text beyond the segment may move is left out.
        """
        pieces = stitch(self.find, text)
        ends = list(accumulate(map(len, pieces)))
        if not last:
            keep = bisect_right(ends, len(text) - LOOK)
            del pieces[keep:], ends[keep:]
        coded = self._coded(pieces)
        counts = dict(zip([0, *ends], accumulate((len(c) // 4 for c in coded), initial=0)))
        head = {start + e: n for e, n in counts.items() if e <= shared}
        return b"".join(coded), head, {} if last else {start + e: n for e, n in counts.items() if e >= len(text) - shared}

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class SpacedCodec(Codec):
    """The same ids, faster, for patterns by which a pre-token never goes on from another character to a space.

    Then a text falls at its spaces into units that are encoded alike wherever they stand, unless a run of white space has a space
    inside or at the end of the text. Ids of units are remembered, and only new units are pre-tokenised and merged.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__(ranks, pattern)
        self.odd = regex.compile(r"\s (?:\s|\Z)")
        self.units: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        if self.odd.search(text):
            return super().encode(text)
        first, *units = text.split(" ")
        known = self.units
        if len(known) > REMEMBERED:
            known.clear()
        for unit in set(units).difference(known):
            known[unit] = array("I", self.merge(" " + unit)).tobytes()
        return (array("I", self.merge(first)).tobytes() if first else b"") + b"".join(map(known.__getitem__, units))


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


def encoder(path: str, pattern: str):
    """A Column function from text to ids (array<int>).

    Null and empty texts give an empty array, texts of any length are encoded whole, equal texts alike, an empty table gives no rows. A Column has no name
    to clash with.
    """

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path, pattern)
        for texts in batches:
            yield _id_arrays([own.encode(t.as_py() or "") for t in texts])

    return F.arrow_udf(encode, "array<int>")


def decoder(path: str, pattern: str):
    """A Column function from ids to the bytes that they stand for. Null and empty arrays give no bytes; an unknown or null id raises."""

    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path, pattern)
        for ids in batches:
            yield _texts_of(own, ids)

    return F.arrow_udf(decode, "binary")


def _id_arrays(coded: list[bytes]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(c) // 4 for c in coded])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(coded))]))


def _texts_of(own: Codec, ids: pa.Array) -> pa.Array:
    return pa.array([own.decode(i.values.to_pylist()) if i.is_valid else b"" for i in ids], pa.binary())


def _segments(huge: DataFrame, segment: int, shared: int) -> DataFrame:
    """``_rid, _k, _start, _last, _part`` of each segment, written; the first one of a text also has ``_row``. A text's segments lie in many files."""
    schema = T.StructType([T.StructField("_row", huge.schema["_row"].dataType), *T.StructType.fromDDL("_rid string, _k int, _start long, _last boolean, _part string")])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text, rid = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                starts = range(0, len(text) - shared, segment - shared)
                for k, start in enumerate(starts):
                    row = batch.column(0).take(pa.array([i if k == 0 else None], pa.int64()))
                    own = [[rid], [k], [start], [k == len(starts) - 1], [text[start : start + segment]]]
                    yield pa.RecordBatch.from_arrays([row, *(pa.array(c, t) for c, t in zip(own, (pa.string(), pa.int32(), pa.int64(), pa.bool_(), pa.string())))], names=schema.fieldNames())

    return cut(huge.mapInArrow(split, schema).repartition(partitions(huge.sparkSession), "_rid", "_k"))


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out: str = "ids", decoded: str | None = None, keep_text: bool = True, segment: int = SEGMENT, shared: int = SHARED) -> DataFrame:
    """The rows with the ids of their text as ``out`` (array<int>), and as ``decoded``, if named, the bytes those ids stand for.

    Many tasks encode the segments of a text longer than ``segment``. Null and empty texts give an empty array; equal texts are encoded alike; rows that repeat, and rows with a null id, stay as they are; an empty table
    gives no rows. Input columns named ``out`` or ``decoded`` are replaced. A huge text whose neighbouring segments have no boundary in common (one pre-token fills their
    overlap) is put together again and encoded in one row.
    """
    kept = [f for f in docs.schema if f.name not in (out, decoded) and (keep_text or f.name != text_col)]
    is_huge = F.coalesce(F.char_length(F.col(f"`{text_col}`")), F.lit(0)) > segment
    schema = T.StructType(kept + [T.StructField(out, T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded, T.BinaryType())] if decoded else []))

    def encode_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = codec(path, pattern)
        for batch in batches:
            for part in (batch.slice(i, ROWS) for i in range(0, batch.num_rows, ROWS)):
                ids = _id_arrays([known.encode(t.as_py() or "") for t in part.column(len(kept))])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], ids] + ([_texts_of(known, ids)] if decoded else []), names=schema.fieldNames())

    def encode_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = codec(path, pattern)
        for batch in batches:
            starts, lasts, parts = (batch.column(i).to_pylist() for i in (3, 4, 5))
            found = [known.encode_segment(part, start, last, shared) for start, last, part in zip(starts, lasts, parts)]
            counts = [pa.array([list(f[i].items()) for f in found], pa.map_(pa.int64(), pa.int32())) for i in (1, 2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], _id_arrays([f[0] for f in found]), *counts], names=coded_schema.fieldNames())

    others = [F.col(f"`{f.name}`") for f in kept]
    text = F.col(f"`{text_col}`").alias("_text")
    # a row is known by its place in its partition, so a lost task must find its rows in the same order again, as a scan does
    rid = F.monotonically_increasing_id().cast("string")
    segments = _segments(docs.where(is_huge).select(F.struct(*others).alias("_row"), text, rid.alias("_rid")), segment, shared)
    coded_schema = T.StructType([*segments.schema.fields[:3], *T.StructType.fromDDL("_ids array<int>, _head map<bigint,int>, _tail map<bigint,int>")])
    coded = cut(segments.mapInArrow(encode_parts, coded_schema))

    of_text = Window.partitionBy("_rid").orderBy("_k")
    meet = F.when(F.col("_k") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect(F.map_keys("_head"), F.map_keys(F.lag("_tail").over(of_text)))))
    met = coded.withColumn("_meet", meet).withColumn("_next", F.lead("_meet").over(of_text)).withColumn("_is_last", F.lead("_k").over(of_text).isNull())
    begin, until = F.element_at("_head", F.col("_meet")), F.when(F.col("_is_last"), F.size("_ids")).otherwise(F.element_at("_tail", F.col("_next")))
    taken = F.when(F.col("_meet").isNotNull() & until.isNotNull(), F.slice("_ids", begin + 1, until - begin))
    row = F.first("_row", ignorenulls=True).alias("_row")
    whole = met.select("_rid", "_row", "_k", taken.alias("_ids")).groupBy("_rid").agg(row, F.array_sort(F.collect_list(F.struct("_k", "_ids"))).alias("_all"), F.bool_and(F.col("_ids").isNotNull()).alias("_ok"))
    whole = cut(whole.select("_rid", "_row", "_ok", F.when(F.col("_ok"), F.flatten(F.transform("_all", lambda x: x["_ids"]))).alias("_ids")))

    again = segments.join(whole.where("not _ok").select("_rid"), "_rid", "left_semi")
    piece = F.when(F.col("_last"), F.col("_part")).otherwise(F.substring("_part", 1, segment - shared))
    again = again.groupBy("_rid").agg(row, F.array_sort(F.collect_list(F.struct("_k", piece.alias("_part")))).alias("_all"))
    again = again.select("_row", encoder(path, pattern)(F.array_join(F.transform("_all", lambda x: x["_part"]), "")).alias("_ids"))
    huge = whole.where("_ok").select("_row", "_ids").unionAll(again).select(*(F.col("_row")[f.name].alias(f.name) for f in kept), F.col("_ids").alias(out))
    if decoded:
        huge = huge.withColumn(decoded, decoder(path, pattern)(out))
    return docs.where(~is_huge).select(*others, text).mapInArrow(encode_rows, schema).unionAll(huge)
