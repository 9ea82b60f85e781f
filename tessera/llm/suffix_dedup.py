"""Removal of long repeated byte strings by column-wise suffix sorting of many passages.

1. Anchors. Of every ``length - gram + 1`` neighbouring grams the one of least hash is an anchor. Whether a gram is chosen depends only on the bytes
   around it, so two equal strings of ``length`` bytes have an anchor at the same place. First only the hashes of anchors are counted (about
   one for each ``gram / 2`` bytes). Most occur once and are left out from there on, by a bitmap of fixed size that lets some others pass too.
   For the rest a digest of the passage around goes along: all bytes that a string of ``length`` bytes through the anchor can reach.
2. Equal passages. Where the same anchor has the same passage twice, the whole passage is repeated. Copies end here.
3. Unequal passages. What shares an anchor but not the passage is compared: one passage of each kind, lined up at the anchor.
   From the last column to the first, one symbol of every passage is put in front of its suffix: the column's symbols in
   suffix order are the column's Burrows-Wheeler transform, a stable sort by symbol gives the next order, and common prefixes
   grow by one or fall to the least between neighbours. Since equal strings lie at the same place, suffixes of one column
   need only be compared with each other, so a column replaces the last one (positional transform) and a round
   costs one step a passage.
4. Hot anchors. Where more than ``HOT`` unequal passages share an anchor, they are split by all the bytes of a string: each of the few hundred places at which a
   string of ``length`` bytes through the anchor can start gives a row with the string's digest, and rows are counted, combined inside tasks. So no task meets all passages of an anchor.

Texts are moved only if they hold such a passage, or lose bytes; a bitmap of fixed size tells which do not. If a bitmap fills up, more is moved and results
stay the same. All lengths are judged on the input, so the result does not depend on any order of removal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import among, bitmap, cut, partitions

#: Bytes of a gram at most (or half of the least length), bytes hashed at a time, passages sorted at a time, unequal passages of an anchor from which on it is hot.
GRAM, BATCH, TOGETHER, HOT = 200, 1 << 20, 8192, 1 << 16

_VALUES = np.random.default_rng(5).integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_LOW = np.uint64(0xFFFFF)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        _POWERS[:] = [np.cumprod(np.full(size, p, np.uint64)) for p in (_BASE, pow(_BASE, -1, 2**64))]
    return _POWERS[0][:n], _POWERS[1][:n]


def anchors(data: bytes, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors; a text shorter than ``length`` has none."""
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(data) > BATCH:
        step = BATCH - length + 1  # every string of ``length`` bytes lies in one of the pieces
        parts = [(s, *anchors(data[s : s + BATCH], length, gram)) for s in range(0, len(data) - length + 1, step)]
        at, first = np.unique(np.concatenate([s + a for s, a, _ in parts]), return_index=True)
        return at, np.concatenate([h for _, _, h in parts])[first]
    b, window = np.frombuffer(data, np.uint8), length - gram + 1
    up, down = _powers(len(data))
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_VALUES[b] * up, out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[: len(b) - gram + 1]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    least = key = (h & ~_LOW) | (_LOW - np.arange(len(h), dtype=np.uint64))  # of equal hashes the last is least
    step = 1
    while step * 2 <= window:
        least, step = np.minimum(least[:-step], least[step:]), step * 2
    if step < window:
        n = len(key) - window + 1
        least = np.minimum(least[:n], least[window - step : window - step + n])
    at = np.unique(_LOW - (least & _LOW)).astype(np.int64)
    return at, h[at]


def repeated_starts(passages: list[bytes], left: np.ndarray, group: np.ndarray, lengths: list[int], gram: int = GRAM) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length: first and last start, from the anchor, of the strings of so many bytes through it that another passage of the group has too; 1 and 0 if none.

    ``left`` is the number of bytes before the anchor; ``group`` ascends. Passages of a group differ.
    """
    m, length = len(passages), max(lengths)
    reach, out = length - gram, [(np.full(m, 1, np.int64), np.zeros(m, np.int64)) for _ in lengths]
    columns = np.zeros((reach + length, m), np.uint16)  # 0: the document has no byte there
    for i, p in enumerate(passages):
        at = reach - left[i]
        columns[at : at + len(p), i] = np.frombuffer(p, np.uint8)
        columns[at : at + len(p), i] += 1
    group = np.unique(group, return_inverse=True)[1]
    head = np.append(True, group[1:] != group[:-1])  # places of a group stay the same through all rounds
    wide = group.astype(np.uint16) if group[-1] < 65536 else group
    order, common = np.arange(m), np.zeros(m + 1, np.int32)
    for c in range(reach + length - 1, -1, -1):
        symbol = columns[c][order]
        same = np.append(False, symbol[1:] == symbol[:-1]) & ~head
        if (same | head).all():
            common[:m] = np.where(same & (symbol > 0), common[:m] + 1, 0)
        else:
            by = np.argsort(symbol, kind="stable")
            by = by[np.argsort(wide[by], kind="stable")]
            symbol = symbol[by]
            pair = np.flatnonzero(np.append(False, symbol[1:] == symbol[:-1]) & ~head & (symbol > 0))
            grown = np.zeros(m + 1, np.int32)
            if len(pair):
                spans = np.empty(2 * len(pair), np.int64)
                spans[::2], spans[1::2] = by[pair - 1] + 1, by[pair] + 1
                grown[pair] = np.minimum.reduceat(common, spans)[::2] + 1
            order, common = order[by], grown
        for size, (low, high) in zip(lengths, out):
            if gram - size <= c - reach <= 0:  # the string holds the anchor's gram
                hit = np.flatnonzero(common[:m] >= size)
                found = order[np.concatenate([hit - 1, hit])]
                none = low[found] > high[found]
                high[found[none]] = c - reach
                low[found] = c - reach
    return out


def spans_of(docs: DataFrame, key_: str, text_col: str, lengths: list[int]) -> DataFrame:
    """``key_, kind, start, end`` of stretches that are repeated for the length of number ``kind``, which may overlap; ``key_`` (binary) tells different texts apart."""
    least, length = min(lengths), max(lengths)
    gram = min(GRAM, least // 2)
    reach = length - gram
    rows = docs.select(F.col(key_).alias("rid"), F.col(text_col).alias("text")).where(F.octet_length("text") >= least)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [anchors(text.as_py().encode("utf-8", "replace"), least, gram)[1] for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64))], ["h"])

    counted = rows.select("text").mapInArrow(hashes, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    shared = bitmap(counted, "h")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = text.as_py().encode("utf-8", "replace")
                at, found = anchors(data, least, gram)
                passing = shared(found.view(np.int64))
                at, found = at[passing], found[passing]
                left, right = np.minimum(at, reach), np.minimum(len(data) - at, length)
                # the place of the anchor counts too: in a short text two anchors may have the whole text around them
                digests = [xxhash.xxh3_64_intdigest(data[a:b], n) for a, b, n in zip((at - left).tolist(), (at + right).tolist(), left.tolist())]
                for column, values in zip(out, ([rid] * len(at), found.view(np.int64), np.array(digests, np.uint64).view(np.int64), at, left, right)):
                    column.append(values)
            rids = pa.array([r for part in out[0] for r in part], pa.binary())
            yield pa.RecordBatch.from_arrays([rids] + [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64)).cast(t) for c, t in zip(out[1:], [pa.int64()] * 2 + [pa.int32()] * 3)], names)

    names = ["rid", "h", "d", "pos", "l", "r"]
    found = cut(rows.mapInArrow(find, "rid binary, h long, d long, pos int, l int, r int"))
    kinds = found.groupBy("h", "d").agg(F.count("*").alias("n"), F.min(F.struct("rid", "pos", "l", "r")).alias("one"))
    anchors_ = kinds.groupBy("h").agg(F.sum("n").alias("all"), F.count("*").alias("kinds")).where(F.col("all") > 1).drop("all")
    kinds = cut(kinds.join(anchors_, "h"))
    equal = found.join(kinds.where("n > 1").select("h", "d"), ["h", "d"])
    equal = equal.select("rid", F.explode(F.array(*(F.when(F.col("l") + F.col("r") >= size, F.lit(i)) for i, size in enumerate(lengths)))).alias("kind"), (F.col("pos") - F.col("l")).alias("start"), (F.col("pos") + F.col("r")).alias("end")).where("kind is not null")

    # a kind that occurs once is looked for in the others; one that occurs more often is covered above and only compared with
    places = kinds.where("kinds > 1").select("h", (F.col("n") == 1).alias("single"), (F.col("kinds") > HOT).alias("hot"), "one.*")
    wanted = cut(places.groupBy("rid").agg(F.collect_list(F.struct("h", "single", "hot", "pos", "l", "r")).alias("places")))
    held = among(rows, wanted, "rid").hint("merge").join(wanted, "rid").select("rid", "text", "places")
    hot = places.where("hot").limit(1).count() > 0

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rid, text, places in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                data = text.as_py().encode("utf-8", "replace")
                out += [(p["h"], p["single"], rid, p["pos"], p["l"], data[p["pos"] - p["l"] : p["pos"] + p["r"]]) for p in places if not p["hot"]]
            columns = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.bool_(), pa.binary(), pa.int32(), pa.int32(), pa.binary()))], ["h", "single", "rid", "pos", "l", "passage"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def settle(part: list[tuple]) -> pa.RecordBatch:
            unique = list({(r[0], r[2], r[3]): r for r in part}.values())  # rows that repeat hold the same place
            found = repeated_starts([r[5] for r in unique], np.array([r[4] for r in unique]), np.array([r[0] for r in unique]), lengths, gram)
            hits = [(r[2], i, int(r[3] + a), int(r[3] + b + size)) for i, (size, (low, high)) in enumerate(zip(lengths, found)) for r, a, b in zip(unique, low, high) if a <= b and r[1]]
            columns = list(zip(*hits)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int32(), pa.int32(), pa.int32()))], ["rid", "kind", "start", "end"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if len(held) >= TOGETHER and row[0] != held[-1][0]:
                    yield settle(held)
                    held = []
                held.append(row)
        if held:
            yield settle(held)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each string through a hot anchor: its place beside the anchor and its digest."""
        for batch in batches:
            for rid, text, places in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                data = text.as_py().encode("utf-8", "replace")
                for p in (p for p in places if p["hot"]):
                    for kind, size in enumerate(lengths):
                        starts = np.arange(max(p["pos"] - min(p["l"], size - gram), 0), min(p["pos"], len(data) - size) + 1, dtype=np.int32)
                        digests = np.fromiter((xxhash.xxh3_64_intdigest(data[s : s + size]) for s in starts.tolist()), np.uint64, len(starts)).view(np.int64)
                        n, of = len(starts), lambda v, t: pa.repeat(pa.scalar(v, t), len(starts))  # noqa: B023
                        columns = [of(p["h"], pa.int64()), of(p["single"], pa.bool_()), of(rid, pa.binary()), of(kind, pa.int32()), pa.array(starts), pa.array(starts - np.int32(p["pos"])), pa.array(digests)]
                        if n:
                            yield pa.RecordBatch.from_arrays(columns, ["h", "single", "rid", "kind", "start", "off", "w"])

    passages = held.mapInArrow(extract, "h long, single boolean, rid binary, pos int, l int, passage binary")
    unequal = passages.repartition(partitions(docs.sparkSession), "h").sortWithinPartitions("h").mapInArrow(compare, "rid binary, kind int, start int, end int")
    out = equal.union(unequal)
    if hot:
        strings = cut(held.where(F.exists("places", lambda p: p["hot"]))).mapInArrow(windows, "h long, single boolean, rid binary, kind int, start int, off int, w long")
        key = ["h", "kind", "off", "w"]
        twice = cut(strings.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key))
        end = F.col("start") + F.element_at(F.array(*map(F.lit, lengths)), F.col("kind") + 1)
        out = out.union(strings.where("single").join(twice.hint("merge"), key).select("rid", "kind", "start", end.alias("end")))
    return out.withColumnRenamed("rid", key_)


def remove_spans(text: str, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, int, int]:
    """What is left of the bytes, how many are gone, and in how many stretches."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    gone = np.cumsum(edge[:-1]) > 0
    return data[~gone].tobytes(), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum())


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, out: str = "dedup", as_text: bool = False, also: int | None = None) -> DataFrame:
    """The documents with a column ``out``: ``kept`` (binary), ``n_bytes``, ``n_removed``, ``n_spans``, ``n_also`` (long).

    Each byte goes that a string of ``length`` bytes covers which also starts anywhere else, in this document or another. ``n_also`` counts the bytes
    covered by such strings of ``also`` bytes, which stay (null if not asked for). Null texts are empty, texts below ``length`` stay whole. A row that repeats with the same id is a place like any other, so its text
    goes too. A stretch may end inside a character: ``kept`` holds the bytes as they are, or with ``as_text`` a string without
    the characters that were cut. An empty table gives no rows. A column named ``out`` is replaced; all others stay, whatever their names.
    """
    lengths = [length, *([also] if also else [])]
    kind = "string" if as_text else "binary"
    schema = f"kept {kind}, n_bytes long, n_removed long, n_spans long, n_also long"
    inner = F.col("d")
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"))  # no name of the input can clash with those used here
    text = F.coalesce(inner[text_col], F.lit(""))
    rid = F.unhex(F.md5(F.concat(F.coalesce(inner[id_col].cast("string"), F.lit("")), F.lit("\0"), text)))  # 128 bits
    keyed = row.select("d", rid.alias("rid"))
    found = cut(spans_of(keyed.select("rid", text.alias("text")), "rid", "text", lengths))
    spans = found.groupBy("rid").agg(*(F.collect_list(F.when(F.col("kind") == i, F.struct("start", "end"))).alias(f"spans{i}") for i in range(len(lengths))))

    @F.pandas_udf(schema)
    def cut_out(texts: pd.Series, starts: pd.Series, ends: pd.Series, others: pd.Series, until: pd.Series) -> pd.DataFrame:
        rows = []
        for t, a, b, c, d in zip(texts, starts, ends, others, until):
            kept, n, stretches = remove_spans(t, np.asarray(a), np.asarray(b))
            more = remove_spans(t, np.asarray(c), np.asarray(d))[1] if also else None
            rows.append((kept.decode("utf-8", "ignore") if as_text else kept, len(kept) + n, n, stretches, more))
        return pd.DataFrame(rows, columns=["kept", "n_bytes", "n_removed", "n_spans", "n_also"])

    last = f"spans{len(lengths) - 1}"
    joined = among(keyed, found, "rid").hint("merge").join(spans, "rid", "left")
    of = lambda c, end: F.transform(F.coalesce(F.col(c), F.array().cast("array<struct<start:int,end:int>>")), lambda s: s[end])
    joined = joined.select("d", cut_out(text, of("spans0", "start"), of("spans0", "end"), of(last, "start"), of(last, "end")).alias("o"))
    size, zero = F.octet_length(text).cast("long"), F.lit(0).cast("long")
    whole = F.struct(text.cast(kind).alias("kept"), size.alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), (zero if also else F.lit(None).cast("long")).alias("n_also"))
    both = joined.unionByName(among(keyed, found, "rid", apart=True).select("d", whole.alias("o")))
    return both.select(*(inner[c].alias(c) for c in docs.columns if c != out), F.col("o").alias(out))
