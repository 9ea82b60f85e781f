"""Near-dedup by circulant MinHash, banding and exact verification.

Two permutations give all coordinates of a signature: the first scatters a document's shingles over the ring of 32-bit
numbers, the second is applied to the ring shifted by k for coordinate k, and the smallest value counts. Bands of
coordinates are hashed into buckets.

Buckets are not turned into pairs. Documents with equal sets share one representative. Each bucket names as its centre the member
that sits in the largest buckets, so the buckets of a family of copies agree on a centre, and a document belongs to
the cluster of every centre that its buckets name: any two documents of one bucket are in one cluster. Each cluster
gets its texts once and is compared on full sets. A cluster of more than ``BLOCK`` documents is dealt into blocks, each of which gets the centre.
Only spanning links leave a task.

What no block links to the centre of a large cluster may be like documents of other blocks. Such documents are not sent to all of them: the sets of these clusters' documents are
read once more, as rows of hashes, and each keeps its rarest shingles, so many that two documents as like as asked share one of them (a prefix filter, which misses none). Shingles that only one
document has are no buckets, so a family whose members are unlike for what is their own leaves few. The buckets are clustered and compared as before, and what is
still open in a large cluster then is compared with that cluster's other blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import among, cut
from tessera.llm.components import components

#: Coordinates of a band; chance to miss a pair at the very threshold; documents of a block; words and coordinate cells at a time.
ROWS, MISS, BLOCK, REMEMBERED, CELLS = 5, 1e-6, 512, 150_000, 1 << 18

_hashes: dict[bytes, int] = {}


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of a text, A to Z lower-cased."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if len(_hashes) > REMEMBERED:
        _hashes.clear()
    for w in set(words).difference(_hashes):
        _hashes[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes; a text of fewer words is one shingle, one without words has none."""
    h = word_hashes(text)
    if len(h) == 0:
        return h
    width, n = min(words, len(h)), max(1, len(h) - words + 1)
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    out = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ (out >> np.uint64(27)))


def _permute(x: np.ndarray, one: int, two: int) -> np.ndarray:
    """A permutation of the 32-bit numbers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(one)
    x ^= x >> np.uint32(15)
    x *= np.uint32(two)
    x ^= x >> np.uint32(16)
    return x


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash: coordinate k is the least pi(sigma(x) + k)."""
    ring = _permute((shingles ^ (shingles >> np.uint64(32))).astype(np.uint32), 0x7FEB352D, 0x846CA68B)
    shifts = np.arange(coordinates, dtype=np.uint32)[:, None]
    out = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    step = max(1, CELLS // coordinates)
    for at in range(0, len(ring), step):
        np.minimum(out, _permute(ring[None, at : at + step] + shifts, 0x85EBCA6B, 0xC2B2AE35).min(axis=1), out=out)
    return out


def bands_for(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands that miss a pair of the very threshold with a chance of at most ``miss``."""
    return math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))


def _signatures(words: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shifts = np.arange(bands, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            n, keys, hashes, sizes = [], [], [], []
            for text in batch.column(1):
                found = shingle_set(text.as_py(), words)
                n.append(len(found))
                keys.append(xxhash.xxh128_digest(found.tobytes()))
                sizes.append(bands if len(found) else 0)
                if len(found):
                    own = signature(found, bands * ROWS).astype(np.uint64).reshape(bands, ROWS)
                    h = shifts[:, 0].copy()
                    for i in range(ROWS):
                        h = (h ^ (h >> np.uint64(29)) ^ own[:, i]) * np.uint64(0xBF58476D1CE4E5B9)
                    hashes.append((h ^ (h >> np.uint64(32))).view(np.int64))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(hashes) if hashes else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), lists], ["id", "n_shingles", "set_key", "bands"])

    return run


def linked(a: np.ndarray | int, b: np.ndarray | int, shared: np.ndarray | int, percent: int):
    """Whether 100 * intersection is at least percent * union, in whole numbers."""
    return 100 * shared >= percent * (a + b - shared)


def spanning_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect what all links of similar enough sets connect. The first set is tried against all others first."""
    k = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(k), sizes)
    names, codes = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(names)))])
    holders = owner[np.argsort(codes, kind="stable")]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    comp, links = np.arange(k), []

    def join(i: int) -> None:
        own = codes[starts[i] : starts[i + 1]]
        shared = np.bincount(np.concatenate([holders[ends[c] : ends[c + 1]] for c in own]) if len(own) else own, minlength=k)
        for j in np.flatnonzero(linked(sizes[i], sizes, shared, percent) & (comp != comp[i]) & (shared > 0)):
            if comp[j] != comp[i]:
                links.append((i, int(j)))
                comp[comp == comp[j]] = comp[i]

    join(0)
    done = {0}
    while True:
        # documents of the largest part need not be tried: each other one is tried against all
        largest = np.bincount(comp, minlength=k).argmax()
        open_ = [i for i in range(k) if comp[i] != largest and i not in done]
        if not open_:
            return links
        for i in open_:
            if i not in done and comp[i] != largest:
                join(i)
            done.add(i)


def _clusters(buckets: DataFrame) -> DataFrame:
    """``centre, rep, own, nb`` from ``rep, h``: the members of each cluster, the block of each, and how many blocks there are. Written."""
    sizes = buckets.groupBy("h").agg(F.count("*").alias("size")).where("size > 1")
    shared = cut(buckets.join(sizes, "h"))
    weight = shared.groupBy("rep").agg(F.sum("size").alias("weight"))
    centre = shared.join(weight, "rep").groupBy("h").agg(F.max(F.struct("weight", (-F.col("rep")).alias("neg"))).alias("best"))
    centre = centre.select("h", (-F.col("best.neg")).alias("centre"))
    members = cut(shared.join(centre, "h").select("centre", "rep").distinct())
    blocks = members.groupBy("centre").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nb"))
    return cut(members.join(blocks, "centre").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int")))


def _compared(texts: DataFrame, dealt: DataFrame, words: int, percent: int) -> DataFrame:
    """``centre, a, b``: links that span the members of each group ``centre, i, j``."""

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("rep")
        rows = pd.concat([rows[rows["rep"] == key[0]], rows[rows["rep"] != key[0]].sort_values("rep")])
        ids = rows["rep"].to_numpy()
        found = spanning_links([shingle_set(t, words) for t in rows["text"]], percent)
        return pd.DataFrame([(key[0], ids[i], ids[j]) for i, j in found], columns=["centre", "a", "b"])

    # the same plan at every size: a broadcast of small inputs would not hold for large ones. Only texts that may be wanted are moved
    rows = dealt.join(among(texts, dealt, "rep").hint("merge"), "rep")
    return rows.groupBy("centre", "i", "j").applyInPandas(lambda key, r: compare(key, r), "centre long, a long, b long")


def _with_centres(dealt: DataFrame) -> DataFrame:
    """Each block with its cluster's centre: texts are sent once, the centre once a block."""
    every = F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("i")
    first = dealt.where("rep <> centre").select("centre", "rep", F.col("own").alias("i")).unionByName(dealt.where("rep = centre").select("centre", "rep", every))
    return cut(first.withColumn("j", F.col("i")))


def _open(dealt: DataFrame, links: DataFrame) -> DataFrame:
    """The members of clusters of several blocks that their block does not link to the centre."""
    settled = links.where("a = centre or b = centre").select("centre", F.when(F.col("a") == F.col("centre"), F.col("b")).otherwise(F.col("a")).alias("rep")).distinct()
    return cut(dealt.where("nb > 1 and rep <> centre").join(settled, ["centre", "rep"], "left_anti"))


def _rare_buckets(texts: DataFrame, dealt: DataFrame, left: DataFrame, words: int, percent: int) -> DataFrame:
    """``rep, h``: the rarest shingles of the documents in open clusters, of which any two documents that are as like as asked share one; only shingles of two documents or more, one of them open."""
    concerned = cut(dealt.join(left.select("centre").distinct(), "centre", "left_semi").select("rep").distinct())

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t.as_py(), words).view(np.int64) for t in batch.column(1)]
            n = np.array([len(x) for x in found], np.int64)
            reps = np.repeat(batch.column(0).to_numpy(), n)
            yield pa.RecordBatch.from_arrays([pa.array(reps), pa.array(np.concatenate([np.zeros(0, np.int64), *found])), pa.array(np.repeat(n, n))], ["rep", "h", "n"])

    # rows that repeat an id hold its text each
    rows = among(texts, concerned, "rep").join(concerned.hint("merge"), "rep", "left_semi").mapInArrow(sets, "rep long, h long, n long").distinct()
    held = rows.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    rows = cut(rows.join(cut(held).hint("merge"), "h"))
    # shingles of one document come first in the order, and need no row: what they take of the prefix is what is missing here
    own = Window.partitionBy("rep")
    place = F.row_number().over(own.orderBy("df", "h")) + F.col("n") - F.count("*").over(own)
    prefix = rows.withColumn("place", place).where(100 * F.col("place") <= (100 - percent) * F.col("n") + 100)
    # what two sets share from their first common shingle on is no more than what is left of either, so a set is in no link here if even the smallest set is too large for that
    room = (F.col("n") - F.col("place") + 1) * (100 + percent) - percent * F.col("n")
    prefix = cut(prefix.select("rep", "h", "n", room.alias("room")))
    open_ = prefix.join(left.select("rep").distinct(), "rep", "left_semi").select("h").distinct()
    of = prefix.groupBy("h").agg(F.min("n").alias("least"), F.max("room").alias("most")).join(open_, "h", "left_semi")
    return prefix.join(cut(of).hint("merge"), "h").where((F.col("room") >= percent * F.col("least")) & (F.col("most") >= percent * F.col("n"))).select("rep", "h")


def components_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """``id, n_shingles, component`` for every row: the smallest id that links reach, itself included.

    Two documents are linked if 100 * intersection >= percent * union of their shingle sets. Documents without words are
    linked with nothing. Rows with a null id are left out. Rows that repeat an id are given once each, with the component of their
    own set. An empty table gives no rows. A pair at the very threshold is missed with a chance of ``MISS``.
    """
    bands = bands_for(percent / 100)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    signed = cut(texts.mapInArrow(_signatures(words, bands), "id long, n_shingles long, set_key binary, bands array<long>"))
    sets = signed.where("n_shingles > 0")
    # one row of each set, combined inside tasks first: copies never meet; rows of one id may hold different sets, so a set is known by its key
    reps = cut(sets.groupBy("set_key").agg(F.min(F.struct("id", "bands")).alias("one")).select("set_key", F.col("one.id").alias("rep"), F.col("one.bands").alias("bands")))
    texts = texts.select(F.col("id").alias("rep"), "text")
    dealt = _clusters(reps.select("rep", F.explode("bands").alias("h")).distinct())
    near = cut(_compared(texts, _with_centres(dealt), words, percent))
    edges, left = near.select("a", "b"), _open(dealt, near)
    if not left.isEmpty():
        # first among those that share a rare shingle, then, in clusters that are large even so, against the other blocks
        dealt = _clusters(_rare_buckets(texts, dealt, left, words, percent))
        near = cut(_compared(texts, _with_centres(dealt), words, percent))
        edges, left = edges.unionByName(near.select("a", "b")), _open(dealt, near)
        if not left.isEmpty():
            open_blocks = cut(left.select("centre", F.col("own").alias("o")).distinct())
            pair = lambda o, k: (F.least(o, k).alias("i"), F.greatest(o, k).alias("j"))
            mine = left.select("centre", "rep", "own", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("k")).where("k <> own").select("centre", "rep", *pair(F.col("own"), F.col("k")))
            theirs = dealt.where("nb > 1 and rep <> centre").join(open_blocks, "centre").where("o <> own").select("centre", "rep", *pair(F.col("own"), F.col("o")))
            edges = edges.unionByName(_compared(texts, cut(mine.unionByName(theirs).distinct()), words, percent).select("a", "b"))
    found = components(edges).withColumnRenamed("id", "rep")
    # one row a set, written: copies meet their set's row only, in a join whose hot keys can be split
    named = cut(reps.select("set_key", "rep").join(found, "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component")))
    out = signed.join(named.hint("merge"), "set_key", "left")
    return out.select("id", "n_shingles", F.coalesce("component", "id").alias("component"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The documents with one of each group left: that of the smallest id. Rows with a null id stay; of rows that repeat a kept id, all stay."""
    found = components_of(docs, id_col, text_col, words, percent).where("id <> component").select(F.col("id").alias("_gone")).distinct()
    return docs.join(found, F.col(id_col) == F.col("_gone"), "left_anti")
