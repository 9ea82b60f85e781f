"""What each column of a table holds, by one pass of sketches that can be merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Log of the registers of a distinct sketch (error 0.8 %), items that a sketch of heavy values tracks, heavy values reported.
SKETCH, TRACKED, HEAVY = 14, 10_000, 3


def _blank(c: str, kind: T.DataType) -> Column:
    value = F.col(f"`{c}`")
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return F.trim(value) == ""
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.size(value) == 0
    return F.lit(False)


def profile(df: DataFrame, distinct: bool = True) -> DataFrame:
    """One row a column: ``column, kind, n, n_null, n_blank, placeholder, shortest, longest, low, high, n_distinct, heavy``.

    Exact: ``n`` rows, ``n_null``; ``n_blank`` values that are there but say nothing (strings of spaces or none, empty arrays and maps); ``placeholder`` if every row is null or blank, and
    there are rows; ``shortest`` and ``longest`` string in characters; ``low`` and ``high`` value as text, for types that have an order. Estimates: ``n_distinct`` values that are not null (standard
    error 0.8 %), and ``heavy``, the most frequent values as text with their counts, most frequent first. A value that more than one row in ``TRACKED`` holds is
    among those tracked, and its count is at most that share of all rows off; below ``TRACKED`` distinct values counts are exact. ``distinct`` false leaves the estimates out.

    One pass over the table for all columns; a task sends one row. Of an empty table ``n`` is 0 and no column is a placeholder.
    """
    aggregates, rows = [F.count("*").alias("n")], []
    for i, f in enumerate(df.schema):
        c, value = f.name, F.col(f"`{f.name}`")
        ordered = not isinstance(f.dataType, (T.MapType, T.VariantType, T.BinaryType, T.ArrayType, T.StructType, T.NullType))
        text = isinstance(f.dataType, T.StringType)
        length = F.char_length(value) if text else F.lit(None).cast("int")
        aggregates += [F.count(F.when(value.isNull(), 1)).alias(f"null{i}"), F.count(F.when(_blank(c, f.dataType), 1)).alias(f"blank{i}"), F.min(length).alias(f"short{i}"), F.max(length).alias(f"long{i}")]
        aggregates += [(F.min(value) if ordered else F.lit(None)).cast("string").alias(f"low{i}"), (F.max(value) if ordered else F.lit(None)).cast("string").alias(f"high{i}")]
        fields = [F.lit(c).alias("column"), F.lit(f.dataType.simpleString()).alias("kind"), F.col("n"), F.col(f"null{i}").alias("n_null"), F.col(f"blank{i}").alias("n_blank")]
        fields.append(((F.col("n") > 0) & (F.col(f"null{i}") + F.col(f"blank{i}") == F.col("n"))).alias("placeholder"))
        fields += [F.col(f"short{i}").alias("shortest"), F.col(f"long{i}").alias("longest"), F.col(f"low{i}").alias("low"), F.col(f"high{i}").alias("high")]
        if distinct:
            hashed = F.when(value.isNotNull(), F.xxhash64(value)) if not isinstance(f.dataType, (T.MapType, T.VariantType, T.NullType)) else F.lit(None).cast("long")
            aggregates.append(F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(hashed, SKETCH)), F.lit(0)).alias(f"distinct{i}"))
            aggregates.append((F.call_function("approx_top_k", value.cast("string"), F.lit(HEAVY), F.lit(TRACKED)) if ordered else F.lit(None).cast("array<struct<item:string,count:bigint>>")).alias(f"heavy{i}"))
            fields += [F.col(f"distinct{i}").alias("n_distinct"), F.filter(F.col(f"heavy{i}"), lambda x: x["item"].isNotNull()).alias("heavy")]
        rows.append(F.struct(*fields))
    return df.agg(*aggregates).select(F.explode(F.array(*rows)).alias("row")).select("row.*")
