"""Connected components by alternating stars, as joins and aggregates over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` (smallest id reachable) for every id of an edge table ``a, b`` (long); empty for no edges.

    Edges that repeat count once; an edge with a null end, or from an id to itself, links nothing and gives no row.

    Each round hangs an id's larger neighbours on its smallest neighbour, then the smaller ones. Neighbours are never
    collected: minima are combined inside tasks and joined back, and the table stays as long as it was. The
    rounds needed grow with the logarithm of the longest path. Each round is cut off in the shared folder.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # minima are written, one row an id: so the join's sides are plain exchanges and the edges of a hub are split over tasks
        least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))).hint("merge")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(large.where("a <> b").distinct())
        least = cut(edges.groupBy("a").agg(F.min("b").alias("m"))).hint("merge")
        small = edges.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = cut(small.where("a <> b").distinct())
        last, state = state, _state(edges)
        if state == last:
            break
    ids = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return ids.union(edges.select(F.col("b").alias("id"), F.col("b").alias("component"))).groupBy("id").agg(F.min("component").alias("component"))
