"""Exact quantiles and the best rows of each group, without sorting the groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.rules import as_number
from tessera.sources.scratch import cut

#: Bins of a pass, rows of a bin that are ranked as they are; rows that a task holds, parts in which a group's candidates meet first.
BINS, FEW, HELD, PARTS = 1024, 4096, 100_000, 32


def exact_quantiles(df: DataFrame, groups: list[str], column: str, fractions: list[float]) -> DataFrame:
    """``groups, fraction, value`` (double), ``n`` (long): for each group and fraction the value at place ceil(fraction * n), at least 1, of the group's n values in ascending order.

    Values are numbers, dates or times, as doubles (``rules.as_number``). Nulls and NaN are no values; a group without values gives no row. Null is a group. Values beyond the largest finite
    double count as that.

    Each pass counts a range of each group in bins of equal width and goes on with the bin that holds the place, until the bin is one value or holds few rows. Counts are combined inside tasks, so a
    group that holds most rows costs a few rows a task. Values that lie close together beside far ones take more passes.
    """
    most = F.lit(1.7976931348623157e308)
    key = F.struct(*(F.col(f"`{c}`").alias(f"g{i}") for i, c in enumerate(groups)))
    value = as_number(df, column)
    rows = cut(df.select(key.alias("key"), value.alias("x")).where("x is not null").withColumn("x", F.greatest(F.least("x", most), -most)))
    whole = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    place = F.greatest(F.ceil(F.col("fraction") * F.col("n")), F.lit(1))
    state = whole.withColumn("fraction", F.explode(F.array(*map(F.lit, fractions)).cast("array<double>"))).withColumn("place", place).withColumn("count", F.col("n"))
    state = cut(state)
    while state.where(F.col("low") < F.col("high")).where(F.col("count") > FEW).limit(1).count():
        open_ = state.where((F.col("low") < F.col("high")) & (F.col("count") > FEW))
        inside = rows.join(open_, "key").where(F.col("x").between(F.col("low"), F.col("high")))
        # halves, so that the difference of the largest numbers is a number
        bin_ = F.least(F.floor((F.col("x") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * BINS), F.lit(BINS - 1))
        counts = inside.groupBy("key", "fraction", "n", "place", bin_.alias("bin")).agg(F.count("*").alias("count"), F.min("x").alias("low"), F.max("x").alias("high"))
        until = F.sum("count").over(Window.partitionBy("key", "fraction").orderBy("bin"))  # BINS rows at most
        chosen = counts.withColumn("until", until).where((F.col("until") >= F.col("place")) & (F.col("until") - F.col("count") < F.col("place")))
        chosen = chosen.withColumn("place", F.col("place") - F.col("until") + F.col("count"))
        state = cut(state.where((F.col("low") >= F.col("high")) | (F.col("count") <= FEW)).unionByName(chosen.select(*state.columns)))
    sure = state.where(F.col("low") >= F.col("high")).select("key", "fraction", F.col("low").alias("value"), "n")
    few = rows.join(state.where(F.col("low") < F.col("high")), "key").where(F.col("x").between(F.col("low"), F.col("high")))
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("key", "fraction").orderBy("x"))).where(F.col("rank") == F.col("place"))
    out = sure.unionByName(ranked.select("key", "fraction", F.col("x").alias("value"), "n"))
    return out.select(*(F.col("key")[f"g{i}"].alias(c) for i, c in enumerate(groups)), "fraction", "value", "n")


def top_k(df: DataFrame, groups: list[str], by: str, tie: str, k: int, rank: str = "rank") -> DataFrame:
    """The k rows of each group with the highest ``by``, of equal ones those with the smallest ``tie``, with their ``rank`` (int, from 1).

    Null is a group; rows whose ``by`` is null or NaN are left out; a null ``tie`` comes last. Rows equal in both are ranked one after another, in any order. ``groups`` may be empty.
    A column named ``rank`` is replaced.

    A task holds its groups' best rows only and never sorts its input; the tasks' best are merged, first in parts. A task with more than ``HELD`` rows to hold gives them out and starts again.
    """
    names = [c for c in df.columns if c != rank]
    group = F.to_json(F.struct(*(F.col(f"`{c}`").alias(f"g{i}") for i, c in enumerate(groups)))) if groups else F.lit("")
    value = F.nanvl(F.col(f"`{by}`"), F.lit(None)) if isinstance(df.schema[by].dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{by}`")
    flat = df.select(group.alias("group"), value.alias("by"), F.col(f"`{tie}`").alias("tie"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names))).where("by is not null")

    def best(rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, [("group", "ascending"), ("by", "descending"), ("tie", "ascending")], null_placement="at_end"))
        codes = rows.column("group").combine_chunks().dictionary_encode().indices.to_numpy()
        place = np.arange(len(codes))
        starts = np.maximum.accumulate(np.where(np.append(True, codes[1:] != codes[:-1]), place, 0))
        return rows.take(pa.array(np.flatnonzero(place - starts < k)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = pa.Table.from_batches([batch])
            held = best(own if held is None else pa.concat_tables([held, own]))
            if held.num_rows > max(HELD, 4 * k):
                yield from held.to_batches()
                held = None
        if held is not None:
            yield from held.to_batches()

    found = flat.mapInArrow(run, flat.schema).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
    for keys in (["group", "part"], ["group"]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("by"), F.asc_nulls_last("tie")))
        found = found.withColumn("place", place).where(F.col("place") <= k)
    return found.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), F.col("place").alias(rank))
