"""What a table's data say about it: its minimal keys, and the column lists by which its rows ascend."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.scratch import cut

#: Sketches of 2**14 registers err by 0.8 % (one standard deviation); below SURELY of the rows a set of columns is no key, at ten times that error.
SKETCH, SURELY = 14, 0.92
#: Sets of columns judged in one pass, one in so many hashes that are looked at first, ranges that meet in one group.
TOGETHER, EARLY, FAN = 128, 64, 64


def _values(columns: tuple[str, ...], kinds: dict[str, T.DataType]) -> list[Column]:
    """Columns to hash: a null is told from other values, and -0.0 is 0.0."""
    out = []
    for c in columns:
        value = F.col(f"`{c}`")
        out += [value.isNull(), value + F.lit(0.0) if isinstance(kinds[c], (T.DoubleType, T.FloatType)) else value]
    return out


def _pair(columns: tuple[str, ...], kinds: dict[str, T.DataType]) -> tuple[Column, Column]:
    values = _values(columns, kinds)
    return F.xxhash64(*values), F.xxhash64(F.lit(1), *values)


def _with_duplicates(df: DataFrame, sets: list[tuple[str, ...]], kinds: dict[str, T.DataType], early: bool) -> set[int]:
    """Numbers of the sets that two rows share; ``early``: looks only at one in ``EARLY`` hashes, all rows of which are counted."""
    found: set[int] = set()
    for at in range(0, len(sets), TOGETHER):
        pairs = [F.struct(F.lit(at + i).alias("set"), *(h.alias(n) for h, n in zip(_pair(s, kinds), "ab"))) for i, s in enumerate(sets[at : at + TOGETHER])]
        own = F.array(*pairs)
        own = F.filter(own, lambda x: F.pmod(x["a"], F.lit(EARLY)) == 0) if early else own
        rows = df.select(F.explode(own).alias("x")).select("x.*")
        held = rows.groupBy("set", "a", "b").agg(F.count("*").alias("n")).where("n > 1").select("set").distinct()
        found |= {r["set"] for r in held.collect()}  # one row a set at most
    return found


def minimal_keys(df: DataFrame, columns: list[str] | None = None, most: int = 4) -> DataFrame:
    """``key`` (array of column names), ``n_columns`` (int): the sets of at most ``most`` columns that are unique over all rows and have no smaller unique set in them.

    Sets are tried level by level, and only those without a key inside. One pass counts the distinct values of a level's sets by mergeable sketches; a set whose estimate is far
    below the rows is no key. The others are confirmed exactly, by 128-bit hashes: first on one hash in ``EARLY``, where a single duplicate refutes a set at a fraction of
    the work, then on all rows. Nulls are equal to each other. Columns of maps and variants, which have no order or hash, are left out.
    Of a table of fewer than two rows the empty set is the only minimal key.
    """
    kinds = {f.name: f.dataType for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType)) and (columns is None or f.name in columns)}
    names = [c for c in (columns or df.columns) if c in kinds]
    df = df.select(*(F.col(f"`{c}`") for c in names))
    n = df.count()
    keys: list[tuple[str, ...]] = [()] if n < 2 else []
    widest: dict[str, float] = {}  # distinct values of a column, at most
    level = 0 if n < 2 else 1
    while 0 < level <= min(most, len(names)):
        sets = [s for s in combinations(names, level) if not any(set(k) <= set(s) for k in keys)]
        if level > 1:  # so few values of each column can't tell the rows apart
            room = lambda s: min(float(n), _product(widest[c] for c in s))
            sets = [s for s in sets if room(s) >= n]
        if not sets and level > 1 and all(any(set(k) <= set(s) for k in keys) for s in combinations(names, level)):
            break
        open_ = []
        for at in range(0, len(sets), TOGETHER):
            part = sets[at : at + TOGETHER]
            row = df.agg(*(F.hll_sketch_estimate(F.hll_sketch_agg(F.xxhash64(*_values(s, kinds)), SKETCH)).alias(str(i)) for i, s in enumerate(part))).first()
            open_ += [s for i, s in enumerate(part) if row[i] >= SURELY * n]
            if level == 1:
                widest |= {s[0]: row[i] / SURELY + 1 for i, s in enumerate(part)}
        refuted = _with_duplicates(df, open_, kinds, early=True)
        open_ = [s for i, s in enumerate(open_) if i not in refuted]
        refuted = _with_duplicates(df, open_, kinds, early=False)
        keys += [s for i, s in enumerate(open_) if i not in refuted]
        level += 1
    return df.sparkSession.createDataFrame([(list(k), len(k)) for k in keys], "key array<string>, n_columns int")


def _product(values) -> float:
    out = 1.0
    for v in values:
        out *= v
    return out


def _steps(rows: DataFrame, columns: list[str]) -> DataFrame:
    """How each row's columns stand to those of the row before in its group: -1 higher than there, 0 equal, 1 lower; nulls are lowest."""
    before = F.lag("last").over(Window.partitionBy("group").orderBy("place"))

    def sign(c: str) -> Column:
        a, b = F.col("before")[c], F.col("first")[c]
        return F.when(a.eqNullSafe(b), 0).when(a.isNull(), -1).when(b.isNull(), 1).when(a < b, -1).otherwise(1)

    return rows.withColumn("before", before).where("before is not null").select(F.array(*(sign(c) for c in columns)).alias("signs"))


def _sign_counts(rows: DataFrame, columns: list[str], groups: int) -> dict[tuple[int, ...], int]:
    """How often neighbouring rows stand in each way. Neighbours across ranges meet as the ranges' ends, ``FAN`` ranges in a group, then groups' ends, until one group is left."""
    counts = None
    while True:
        steps = _steps(rows, columns).groupBy("signs").agg(F.count("*").alias("n"))
        counts = steps if counts is None else counts.unionByName(steps)
        if groups == 1:
            break
        rows = cut(rows.groupBy("group").agg(F.min_by("first", "place").alias("first"), F.max_by("last", "place").alias("last")))
        rows = rows.select(F.floor(F.col("group") / FAN).alias("group"), F.col("group").alias("place"), "first", "last")
        groups = -(-groups // FAN)
    # at most 3 to the power of the columns
    return {tuple(r["signs"]): r["n"] for r in counts.groupBy("signs").agg(F.sum("n").alias("n")).collect()}


def _ascending(counts: dict[tuple[int, ...], int], columns: list[str], most: int) -> list[tuple[tuple[str, ...], int]]:
    """Lists of columns along which no neighbours descend, with the number of neighbours that are equal in all of them; a list without such ties is not made longer."""
    at = {c: i for i, c in enumerate(columns)}
    out, level = [], [()]
    while level and len(level[0]) < most:
        longer = []
        for head in level:
            for c in columns:
                if c in head:
                    continue
                own = (*head, c)
                signs = [(next((s[at[x]] for x in own if s[at[x]]), 0), n) for s, n in counts.items()]
                if not any(s > 0 for s, _ in signs):
                    ties = sum(n for s, n in signs if s == 0)
                    out.append((own, ties))
                    longer += [own] if ties else []
        level = longer
    return out


def ascending_lists(df: DataFrame, position: str, columns: list[str], most: int = 4) -> DataFrame:
    """``columns`` (array of names), ``n_ties`` (long): the lists of columns, of at most ``most``, by which the rows ascend in order of ``position``.

    A list is one if no row comes before its predecessor by its columns, compared one after another; nulls come first. ``n_ties`` counts neighbours that are equal in
    all of them, so a list without ties explains the whole order and longer ones are left out.

    Rows are dealt into ranges of the position once. What neighbours say about all lists at once is how each column changes, so one pass over the ranges and
    their ends decides every list. The first range is looked at before: columns that are in no list there need not be read in the others.
    Rows with a null position come first; rows of one position are taken in order of the columns. Tables of fewer than two rows ascend by each column.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.struct(F.col(f"`{position}`").alias("p"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)))
    value = F.struct(*(F.col(f"`{c}`").alias(c) for c in columns))
    rows = df.select(place.alias("place"), value.alias("first"))
    ranged = cut(rows.repartitionByRange(n, "place").withColumn("group", F.spark_partition_id().cast("long")).withColumn("last", F.col("first")))
    kept = list(columns)
    first = ranged.agg(F.min("group")).first()[0]
    early = _sign_counts(ranged.where(F.col("group") == F.lit(first)), kept, 1) if first is not None else {}
    kept = [c for c in kept if any(c in own for own, _ in _ascending(early, kept, most))]
    found = _ascending(_sign_counts(ranged, kept, n), kept, most) if kept else []
    return df.sparkSession.createDataFrame([(list(own), ties) for own, ties in found], "columns array<string>, n_ties long")
