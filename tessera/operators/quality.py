"""Checks on records: status, key uniqueness, shared values, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import url_is_directory
from tessera.sources.scratch import cut


def _hashable(f: T.StructField) -> Column:
    """A column to hash: maps and variants, at any depth, as their JSON text."""
    return F.to_json(f"`{f.name}`") if '"map"' in f.dataType.json() or '"variant"' in f.dataType.json() else F.col(f"`{f.name}`")


def with_status(records: DataFrame, extra: DataFrame, key: str, status: str = "status") -> DataFrame:
    """Left-join ``extra`` and call a record ``registered`` if it has a partner, else ``skipped``.

    Each record is given once: of partners that repeat a key one counts, the same in each run. A null key has no partner. Columns of ``extra`` named like one of the
    records are left out; a column named ``status`` is replaced.
    """
    rest = [c for c in extra.columns if c != key and c not in records.columns and c != status]
    one = F.min_by(F.struct(F.lit(True).alias("found"), *(F.col(f"`{c}`").alias(f"x{i}") for i, c in enumerate(rest))), F.xxhash64(*map(_hashable, extra.schema)))
    partners = extra.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("k")).agg(one.alias("x"))
    joined = records.select(F.struct(*(F.col(f"`{c}`") for c in records.columns)).alias("r")).join(partners, F.col("r")[key] == F.col("k"), "left")
    own = [F.col("r")[c].alias(c) for c in records.columns if c != status]
    return joined.select(*own, *(F.col("x")[f"x{i}"].alias(c) for i, c in enumerate(rest)), F.when(F.col("x.found"), "registered").otherwise("skipped").alias(status))


def shape_by_status(records: DataFrame, columns: list[str], status: str = "status") -> DataFrame:
    """Per status: rows, and how many have each column. Partial aggregation leaves one row per task and status to shuffle."""
    return records.groupBy(status).agg(F.count("*").alias("n_rows"), *(F.count(c).alias(f"n_{c}") for c in columns))


def duplicate_keys(df: DataFrame, keys: list[str | Column]) -> DataFrame:
    """Keys held by more than one row, and by how many; empty if the key is unique."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def key_order(df: DataFrame, keys: list[str], position: str = "position") -> DataFrame:
    """Rank of each row in ascending order of the keys (nulls first), without pulling the table into one task.

    A window with no partitioning would sort everything in one task. Rows are dealt into ranges and sorted there once, and that table is
    written: its bounds come from a sample, so two plans would draw two sets of ranges. A row's place in its range is then moved by
    the rows in the ranges before, one small row per range. Rows of equal keys are ranked in the order of a hash of their
    columns, which also splits a key that many rows hold. An empty table gives no rows. A column named ``position`` is replaced.
    """
    rest = F.xxhash64(*map(_hashable, df.schema))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # no name of the input can clash with those used here
    nested = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.struct(*(F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)), rest.alias("rest")).alias("order"))
    ranged = cut(nested.repartitionByRange(n, "order").sortWithinPartitions("order").select("row", F.monotonically_increasing_id().alias("place")))
    ranged = ranged.withColumn("range", F.shiftright("place", 33))
    sizes = ranged.groupBy("range").agg(F.count("*").alias("n"))
    before = sizes.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    out = ranged.join(before, "range").withColumn("position", (inside + F.col("before")).cast("long"))
    return out.select(*(F.col("row")[c].alias(c) for c in df.columns if c != position), F.col("position").alias(position))


def anomalies(records: DataFrame, url: str, name: str) -> DataFrame:
    """The records with ``url_is_directory`` (the path ends in ``/``; null for what is not a URL) and ``open_bracket`` (brackets that open and close differ in number; null where the name is)."""
    times = lambda c: F.length(name) - F.length(F.replace(F.col(name), F.lit(c), F.lit("")))
    differ = [times(a) != times(b) for a, b in ("()", "[]", "【】")]
    return records.withColumns({"url_is_directory": url_is_directory(url), "open_bracket": differ[0] | differ[1] | differ[2]})
