"""What the operators share."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.scratch import cut as cut

#: White space between words, as a character class for Java's and DuckDB's regular expressions and as characters.
SPACE_CLASS, SPACE_CHARS = r"[\x20\x09-\x0D]", " \t\n\x0b\x0c\r"
#: Bits of a bitmap of hashes, whatever it holds: 8 MB to send to a task.
BITS = 1 << 26


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z only. ``lower`` also changes other letters, so it serves where every character is one byte."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, even if lambdas inside use it for every element."""
    return F.transform(F.array(value), body)[0]


def remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null ids give -1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % modulus, F.lit(-1))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bitmap(keys: DataFrame, key: str):
    """The keys (long) as ``BITS`` bits, sent to all tasks, and a test for numbers: false only for those that are surely not among them."""
    at = F.pmod(F.col(key), F.lit(BITS))
    rows = keys.select(F.shiftright(at, 15).cast("int").alias("part"), at.bitwiseAND(F.lit(32767)).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    bits = np.zeros(BITS // 8, np.uint8)
    for r in rows:  # BITS / 32768 rows at most, of 4 KB
        bits[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    shared = keys.sparkSession.sparkContext.broadcast(bits)

    def test(x: np.ndarray) -> np.ndarray:
        x = x % BITS
        return (shared.value[x >> 3] >> (x & 7).astype(np.uint8)) & 1 == 1

    return test


def among(rows: DataFrame, keys: DataFrame, key: str, apart: bool = False, of: str | None = None) -> DataFrame:
    """The rows whose key, ``of`` if it is named otherwise there, may be among the keys; ``apart``: the others instead. If the bitmap fills up, more rows may be."""
    test = bitmap(keys.select(F.xxhash64(key).alias("h")), "h")

    @F.pandas_udf("boolean")
    def passes(h: pd.Series) -> pd.Series:
        return pd.Series(test(h.to_numpy(np.int64)))

    passing = passes(F.xxhash64(of or key))
    return rows.where(~passing if apart else passing)
