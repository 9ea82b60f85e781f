"""Ranked lexical search over document shards of integer impacts.

The index is a table with one row a shard: the shard's documents, its terms, and for each term the documents that hold it with their impacts, one term after another
(compressed sparse rows). An impact is all of a term's score in a document but the term's weight, in whole numbers, and is computed when the index is
built. Weights depend on how many documents hold a term, which the shards' own row lengths tell, so no table of all terms is made.

A search takes the queries in blocks of bounded size. A block is sent to all tasks; each shard adds up its rows term by term into an array with a
place for each of its documents, and keeps the best of them for each query. A task merges its shards' best, and the rest are merged by ranked windows,
first in parts. Ties are settled by the smaller id at every step, so the result does not depend on how documents are dealt into shards.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut

#: Documents and bytes of text of a shard; terms of all queries of a block, repeats included; parts in which a query's candidates meet first.
SHARD_DOCS, SHARD_BYTES, BLOCK_TERMS, PARTS = 1 << 14, 1 << 24, 1 << 19, 32
#: Fixed values of the score: scale of weights, scale of impacts, steps of a length, half of them at the mean length, and the weight of a length beside the frequency.
WEIGHT, IMPACT, STEPS, HALF, LENGTH = 1000, 1_000_000_000, 100, 50, 20

#: Every byte but letters, digits and those of other characters than ASCII turns to a blank, A to Z to a to z.
_TERMS = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()

INDEX = "ids array<bigint>, terms array<binary>, ends array<int>, docs binary, impacts binary"
FOUND = "item long, doc_id long, score long, part int"


@dataclass(frozen=True)
class Index:
    """The shards, how many documents hold a term, and how many terms they hold with repeats."""

    shards: DataFrame
    n_docs: int
    n_terms: int


def terms_of(data: bytes) -> list[bytes]:
    """Maximal runs of letters, digits and characters beyond ASCII; A to Z lower-cased."""
    return data.translate(_TERMS).split()


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("data")).where("id is not null and octet_length(data) > 0")


def _bounds(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a document's length adds below the line of an impact."""
    return STEPS - HALF + (HALF * n * n_docs) // n_terms


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index of all documents, written in the shared folder.

    Documents without a term (null and empty texts too) are in no shard and count nowhere. Rows with a null id are left out. Rows that repeat an id are documents
    of their own, whose scores are returned each. A document of any length is taken whole; one that is larger than a shard is a shard. Other columns are ignored.
    """
    texts = _texts(docs, id_col, text_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(terms_of(x.as_py())) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([sum(map(bool, n))], pa.int64()), pa.array([sum(n)], pa.int64())], ["docs", "terms"])

    total = texts.select("data").mapInArrow(count, "docs long, terms long").agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    n_docs, n_terms = total

    def shard(ids: list[int], lists: list[np.ndarray], names: dict[bytes, int]) -> pa.RecordBatch:
        n = np.array([len(x) for x in lists], np.int64)
        keys, tf = np.unique(np.concatenate(lists).astype(np.int64) * len(ids) + np.repeat(np.arange(len(ids)), n), return_counts=True)
        term, doc = np.divmod(keys, len(ids))
        impacts = IMPACT * tf.astype(np.int64) // (1000 * tf + LENGTH * _bounds(n, n_docs, n_terms)[doc])
        ends = np.cumsum(np.bincount(term, minlength=len(names)))
        columns = [[ids], [list(names)], [ends.astype(np.int32)], [doc.astype("<u4").tobytes()], [impacts.astype("<u4").tobytes()]]
        kinds = [pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["ids", "terms", "ends", "docs", "impacts"])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lists, names, size = [], [], {}, 0
        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = terms_of(data.as_py())
                if not words:
                    continue
                if ids and (len(ids) >= SHARD_DOCS or size + len(data.as_buffer()) > SHARD_BYTES):
                    yield shard(ids, lists, names)
                    ids, lists, names, size = [], [], {}, 0
                ids.append(i)
                lists.append(np.fromiter((names.setdefault(w, len(names)) for w in words), np.int32, len(words)))
                size += len(data.as_buffer())
        if ids:
            yield shard(ids, lists, names)

    return Index(cut(texts.mapInArrow(shards, INDEX)), n_docs, n_terms)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0, of equal ones those of the smallest ids; in no order."""
    at = np.flatnonzero(scores > 0)
    if len(at) <= k:
        return at
    least = scores[at][np.argpartition(scores[at], len(at) - k)[len(at) - k]]
    above, ties = at[scores[at] > least], at[scores[at] == least]
    return np.concatenate([above, ties[np.argsort(ids[ties], kind="stable")[: k - len(above)]]])


def _blocks(items: DataFrame) -> Iterator[dict[int, list[bytes]]]:
    """The items' terms in blocks of ``BLOCK_TERMS``; the driver holds one block, and a larger item alone."""
    block: dict[int, list[bytes]] = {}
    held = 0
    for row in items.toLocalIterator():
        terms = list(map(bytes, row["terms"]))
        if block and held + len(terms) > BLOCK_TERMS:
            yield block
            block, held = {}, 0
        block[row["item"]] = terms
        held += len(terms)
    if block:
        yield block


def _search_block(index: Index, block: dict[int, list[bytes]], k: int) -> DataFrame:
    sc = index.shards.sparkSession.sparkContext
    names = sorted({t for terms in block.values() for t in terms})
    sent = sc.broadcast(names)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, total = pa.array(sent.value, pa.binary()), np.zeros(len(sent.value), np.int64)
        for batch in batches:
            for terms, ends in zip(batch.column(0), batch.column(1)):
                at = pc.index_in(wanted, value_set=terms.values).fill_null(-1).to_numpy()
                lengths = np.diff(ends.values.to_numpy(), prepend=0)
                total[at >= 0] += lengths[at[at >= 0]]
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["term", "df"])

    found = index.shards.select("terms", "ends").mapInArrow(frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    weight = {names[r["term"]]: math.floor(WEIGHT * math.log((2 * index.n_docs + 2) / (2 * r["df"] + 1))) for r in found.collect()}  # one row a term of the block
    number = {t: i for i, t in enumerate(names)}
    queries = sc.broadcast({item: (np.array([number[t] for t in terms if weight.get(t)], np.int64), np.array([weight[t] for t in terms if weight.get(t)], np.int64)) for item, terms in block.items()})

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, kept = pa.array(sent.value, pa.binary()), {}
        for batch in batches:
            for row in zip(*batch.columns):
                ids, ends = row[0].values.to_numpy(), row[2].values.to_numpy().astype(np.int64)
                docs, impacts = np.frombuffer(row[3].as_buffer(), "<u4"), np.frombuffer(row[4].as_buffer(), "<u4")
                at = pc.index_in(wanted, value_set=row[1].values).fill_null(-1).to_numpy()
                starts = np.append(0, ends[:-1])
                total = np.zeros(len(ids), np.int64)
                for item, (terms, weights) in queries.value.items():
                    rows = at[terms]
                    total[:] = 0
                    for r, w in zip(rows[rows >= 0], weights[rows >= 0]):
                        span = slice(starts[r], ends[r])
                        total[docs[span]] += w * impacts[span].astype(np.int64)
                    top = best(total, ids, k)
                    if len(top):
                        old = kept.get(item, (np.zeros(0, np.int64),) * 2)
                        scores, own = np.concatenate([old[0], total[top]]), np.concatenate([old[1], ids[top]])
                        top = best(scores, own, k)
                        kept[item] = scores[top], own[top]
        part = np.int32(min((int(own[0]) for _, own in kept.values()), default=0) % PARTS)
        sizes = [len(own) for _, own in kept.values()]
        columns = [np.repeat(np.array(list(kept), np.int64), sizes), np.concatenate([np.zeros(0, np.int64), *(own for _, own in kept.values())]), np.concatenate([np.zeros(0, np.int64), *(s for s, _ in kept.values())])]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(np.full(sum(sizes), part, np.int32))], ["item", "doc_id", "score", "part"])

    return index.shards.mapInArrow(score, FOUND)


def search(index: Index, items: DataFrame, item_col: str = "item_id", text_col: str = "text", k: int = 50) -> DataFrame:
    """``item_id, rank`` (int, from 1), ``doc_id, score`` (long): the k documents of each item with the highest scores above 0, equal ones by ascending id.

    An item's terms count once each; those of rows that repeat an item's id are put together. Items without a term, with a null id or without a hit give no row.
    An empty index or no items give no rows.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sorted(set(terms_of(x.as_py()))) for x in batch.column(1)], pa.list_(pa.binary()))], ["item", "terms"])

    texts = _texts(items, item_col, text_col).mapInArrow(split, "item long, terms array<binary>")
    held = cut(texts.select("item", F.explode("terms").alias("term")).distinct().groupBy("item").agg(F.sort_array(F.collect_list("term")).alias("terms")))
    out = None
    for block in _blocks(held.orderBy("item")):
        found = _search_block(index, block, k)
        for by in (["item", "part"], ["item"]):
            rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "doc_id"))
            found = found.withColumn("rank", rank).where(F.col("rank") <= k)
        found = found.select(F.col("item").alias(item_col), "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(cut(found))
    return out if out is not None else held.where("false").select(F.col("item").alias(item_col), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
