"""Merkle manifest of a dataset: a tree of digests for each source, and one over the sources.

Rank. A leaf's place in its tree is its exact rank in its group, found without sorting a group as a whole. The order key is a string of digits (of the id, or of the
source's bytes); the keys' common beginning is skipped, and leaves are counted by group and the first digits, one digit more at a time, until no count is above
``ENOUGH``. Each level of the histogram is summed up inside its parent only, some 16**``DIGITS`` counts at a time; so a leaf's rank is what the
levels say lies before its digits, and its place among the few leaves that share them all.

Tree. Written in base 3, a rank's digits are the path from the root: nodes that share all digits but the last meet in their parent. ``LEVELS`` digits are taken off at a time: leaves
that share the longest prefix, rank div 3**LEVELS, are a run of rows in one task, which hashes them up to one node. So a tree over any number of rows takes a few
rounds, and a source that holds a third of all rows is as many runs as it needs.

Proofs. Going down again, a run learns the siblings above its own node, as one row, and its leaves get their siblings from the run itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, partitions

#: Nodes under a parent (fixed), base-3 digits taken off at a time, hex digits counted at a time, leaves that may share all counted digits.
BASE, LEVELS, DIGITS, ENOUGH = 3, 7, 2, 4096

_PATH = "array<struct<left:string,right:string>>"


def digest(*parts: str) -> str:
    """Lowercase hex sha256 of the parts put together."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values: Column) -> Column:
    """The digest of a row's values: ``-`` for a null, else the length in bytes, ``:``, and the value as text."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text)), 256)


def height(n: int) -> int:
    """Levels above n nodes until one is left."""
    out = 0
    while n > 1:
        n, out = -(-n // BASE), out + 1
    return out


def id_key(row_id: Column) -> Column:
    """A whole number as 16 hex digits in ascending order; null comes first."""
    # the sign is turned, so that negative numbers come before the others
    return F.coalesce(F.lpad(F.hex(row_id.cast("long").bitwiseXOR(F.lit(-(2**63)).cast("long"))), 16, "0"), F.lit(""))


def text_key(text: Column) -> Column:
    """A text as the hex digits of its bytes, behind a 1; null, which comes first, is 0."""
    return F.when(text.isNull(), "0").otherwise(F.concat(F.lit("1"), F.hex(F.encode(text, "UTF-8"))))


def ranked(rows: DataFrame, group: str, key: str, ties: str) -> DataFrame:
    """``rows`` with ``rank`` (long, from 0, unique) in ascending order of ``key`` (a string of hex digits) and ``ties`` within ``group``, and ``n``, the group's rows.

    Read several times, so it should be a written table. Only rows that share the key and the ties are ranked in one task whatever their number; these are equal,
    and which one comes first changes nothing.
    """
    low, high, longest = rows.agg(F.min(key), F.max(key), F.max(F.length(key))).first()
    if low is None:
        return rows.withColumn("rank", F.lit(0).cast("long")).withColumn("n", F.lit(0).cast("long"))
    common = next((i for i, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))
    depth, levels = common // DIGITS, []
    while True:
        depth += 1
        counts = cut(rows.groupBy(group, F.substring(key, 1, depth * DIGITS).alias("prefix")).agg(F.count("*").alias("count")))
        levels.append(counts)
        if depth * DIGITS >= longest or counts.agg(F.max("count")).first()[0] <= ENOUGH:
            break
    before = None
    first = depth - len(levels) + 1
    for i, counts in enumerate(levels):
        parent = F.substring("prefix", 1, (first + i - 1) * DIGITS) if i else F.lit("")
        counts = counts.withColumn("parent", parent)
        window = Window.partitionBy(group, "parent").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("before", F.coalesce(F.sum("count").over(window), F.lit(0)))
        if before is not None:
            counts = counts.join(before.select(F.col(group), F.col("prefix").alias("parent"), F.col("before").alias("above")), [group, "parent"]).withColumn("before", F.col("before") + F.col("above"))
        before = counts.select(group, "prefix", "before")
    sizes = levels[0].groupBy(group).agg(F.sum("count").alias("n"))
    before = cut(before.join(sizes, group))
    place = F.row_number().over(Window.partitionBy(group, "prefix").orderBy(key, ties)) - 1
    out = rows.withColumn("prefix", F.substring(key, 1, depth * DIGITS)).withColumn("place", place).join(before.hint("merge"), [group, "prefix"])
    return out.withColumn("rank", (F.col("before") + F.col("place")).cast("long")).withColumn("n", F.col("n").cast("long")).drop("prefix", "place", "before")


def _runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows that follow each other with equal first columns, across batches."""
    held, key = [], None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:n_keys] != key:
                if held:
                    yield key, held
                held, key = [], row[:n_keys]
            held.append(row[n_keys:])
    if held:
        yield key, held


def grown(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes and the levels above them."""
    out = [nodes]
    for _ in range(levels):
        out.append([digest(*out[-1][i : i + BASE]) for i in range(0, len(out[-1]), BASE)])
    return out


def path(tree: list[list[str]], place: int) -> list[tuple[str, str]]:
    """For each level above a node: the siblings on its left and on its right."""
    out = []
    for level in tree[:-1]:
        start = place - place % BASE
        out.append(("".join(level[start:place]), "".join(level[place + 1 : start + BASE])))
        place //= BASE
    return out


def folded(node: str, steps: list[tuple[str, str]]) -> str:
    """The root that a node leads to with the siblings of its path."""
    for left, right in steps:
        node = digest(left, node, right)
    return node


def proof(steps: list[tuple[str, str]]) -> str:
    return digest(*(x for step in steps for x in step))


def _levels(n: int, round_: int, most: int) -> int:
    """Levels that a round, of ``most`` levels as those before, takes off a tree of n leaves."""
    return max(0, min(most, height(n) - round_ * most))


def _streamed(df: DataFrame, keys: list[str], order: list[str], run: Callable[[tuple, list[tuple]], list[tuple]], schema: str, kinds: list[pa.DataType]) -> DataFrame:
    """Rows of equal keys, in order, through a function that gives rows; no more than a few runs are held."""
    names = [c.strip().split(" ")[0] for c in schema.replace(_PATH, "x").split(",")]
    n_keys = len(keys)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for key, rows in _runs(batches, n_keys):
            out += run(key, rows)
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    return df.repartition(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys, *order).mapInArrow(stream, schema)


def _up(nodes: DataFrame, round_: int) -> DataFrame:
    """``tree, rank, n, node`` one round further up, from ``tree, rank, n, node``; ``rank`` counts the nodes of the level."""
    wide = BASE**LEVELS
    dealt = nodes.select("tree", F.floor(F.col("rank") / wide).alias("run"), "rank", "n", "node")

    def run(key: tuple, rows: list[tuple]) -> list[tuple]:
        n = rows[0][1]
        return [(*key, n, grown([r[2] for r in rows], _levels(n, round_, LEVELS))[-1][0])]

    return _streamed(dealt, ["tree", "run"], ["rank"], run, "tree string, rank long, n long, node string", [pa.string(), pa.int64(), pa.int64(), pa.string()])


_STEPS = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def _with_heads(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """The nodes by run, and in front of each run the row of the node above it: ``top`` (the last node of its tree) and ``steps``."""
    null = lambda c: F.lit(None).cast(nodes.schema[c].dataType).alias(c)
    dealt = nodes.select("tree", F.floor(F.col("rank") / BASE**LEVELS).alias("run"), *nodes.columns[1:], F.lit(None).cast("string").alias("top"), F.lit(None).cast(_PATH).alias("steps"))
    heads = above.select("tree", F.col("rank").alias("run"), F.lit(-1).cast("long").alias("rank"), *map(null, nodes.columns[2:]), "top", "steps")
    return dealt.unionByName(heads)


def _down(nodes: DataFrame, above: DataFrame, round_: int) -> DataFrame:
    """``tree, rank, top, steps`` of the nodes of a round, from those of the nodes one round further up."""

    def run(key: tuple, rows: list[tuple]) -> list[tuple]:
        (*_, top, upper), own = rows[0], rows[1:]
        tree = grown([r[2] for r in own], _levels(own[0][1], round_, LEVELS))
        return [(key[0], r[0], top, [{"left": a, "right": b} for a, b in path(tree, i)] + upper) for i, r in enumerate(own)]

    return _streamed(_with_heads(nodes, above), ["tree", "run"], ["rank"], run, f"tree string, rank long, top string, steps {_PATH}", [pa.string(), pa.int64(), pa.string(), _STEPS])


def _climbed(leaves: DataFrame) -> list[DataFrame]:
    """The nodes of every round, the leaves first; the last ones are the roots of the trees."""
    rounds = [leaves]
    most = height(leaves.agg(F.max("n")).first()[0] or 0)
    for r in range(-(-most // LEVELS)):
        rounds.append(cut(_up(rounds[-1], r)))
    return rounds


def manifest(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tampered: dict[str, Column] | None = None) -> DataFrame:
    """One row for each row: ``id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    A leaf is the digest of the columns. In each source leaves ascend by id, and while several nodes remain every three in a row (the last run may be
    shorter) become their digest: the last one is ``subroot``. Subroots, in order of the source's bytes, likewise give ``root``. ``proof_sha256`` is the digest of all siblings
    from the leaf to the root. ``folded_root`` is what the siblings and the leaf lead to, or the leaf of the columns as ``tampered`` changes them; ``verified`` if it is the root.

    Null sources and ids come first. Rows that repeat an id are in order of their leaves, so any order of the input gives the same tree; equal rows
    are leaves of their own. Texts are hashed whole. An empty table gives no rows and has no root. Columns that are not named are ignored.
    """
    now = {c: F.col(f"`{c}`") for c in columns}
    then = now | (tampered or {})
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_key(F.col(f"`{source_col}`").cast("string")).alias("tree"), leaf(*now.values()).alias("node"), leaf(*then.values()).alias("other"))
    leaves = ranked(cut(plain.withColumn("key", id_key(F.col("id")))), "tree", "key", "node")
    leaves = cut(leaves.select("tree", "rank", "n", "id", "node", "other"))
    rounds = _climbed(leaves.select("tree", "rank", "n", "node"))
    # each tree's top is a leaf of the tree over the sources
    tops = cut(rounds[-1].where("rank = 0").select(F.lit("").alias("all"), F.col("tree").alias("key"), "node"))
    over = cut(ranked(tops, "all", "key", "node").select(F.col("all").alias("tree"), "rank", "n", "node", F.col("key").alias("source")))
    heights = _climbed(over.select("tree", "rank", "n", "node"))
    root = (heights[-1].first() or {"node": None})["node"]
    steps = heights[-1].select("tree", "rank", F.col("node").alias("top"), F.array().cast(_PATH).alias("steps"))
    for r in range(len(heights) - 2, -1, -1):
        steps = cut(_down(heights[r], steps, r))
    steps = over.select(F.col("source").alias("tree"), F.col("node").alias("top"), F.col("rank").alias("place")).join(steps.select(F.col("rank").alias("place"), "steps"), "place")
    steps = steps.select("tree", F.lit(0).cast("long").alias("rank"), "top", "steps")
    for r in range(len(rounds) - 2, 0, -1):
        steps = cut(_down(rounds[r], steps, r))

    def run(key: tuple, rows: list[tuple]) -> list[tuple]:
        (*_, top, upper), own = rows[0], rows[1:]
        tree, out = grown([r[3] for r in own], _levels(own[0][1], 0, LEVELS)), []
        upper = [(s["left"], s["right"]) for s in upper]
        for i, (_, _, row_id, node, other, _, _) in enumerate(own):
            own_steps = path(tree, i) + upper
            back = folded(other, own_steps)
            out.append((row_id, node, top, root, proof(own_steps), back, back == root))
        return out

    schema = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _streamed(_with_heads(leaves, steps), ["tree", "run"], ["rank"], run, schema, [pa.int64(), *[pa.string()] * 5, pa.bool_()])
