"""Readers. Schemas are declared, never inferred, where the format does not carry one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One catalogue record. Records without an image lack the four image fields, which are then null.
CATALOGUE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("manufacturer", "brand", "patternName", "color")]
    + [T.StructField("aliases", T.ArrayType(T.StringType()))]
    + [T.StructField(n, T.StringType()) for n in ("status", "imageFile", "imageUrl", "source", "searchQuery")]
    + [T.StructField("updatedAt", T.TimestampType())]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of a data folder; filters and columns reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """A catalogue kept as one pretty-printed JSON array.

    Such a file can't be split, so a large catalogue should be converted to Parquet once (``write_catalogue``).
    Malformed records raise instead of turning into nulls.
    """
    return spark.read.schema(CATALOGUE).option("multiLine", True).option("mode", "FAILFAST").json(path)


def write_catalogue(df: DataFrame, path: str) -> None:
    """Write a catalogue as Parquet, with one folder for each status."""
    df.write.mode("overwrite").partitionBy("status").parquet(path)


def write_arrays(df: DataFrame, path: str, part: str) -> None:
    """Write records as JSON arrays that ``catalogue`` reads, one file in a folder of its own for each value of ``part``; a file's records must fit in a task."""
    record = F.struct(*(c for c in df.columns if c != part))
    arrays = df.groupBy(part).agg(F.to_json(F.collect_list(record)).alias("value"))
    arrays.write.partitionBy(part).text(path)
