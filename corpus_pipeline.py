"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and gives the documents that stay, with the columns that came; the last one gives
pieces of sequences. Stages are written as Parquet and read again, so that a lost executor repeats part of one stage at most.

Null texts count as empty ones and an empty table gives an empty table, in every stage; texts of any length are taken whole; other columns stay, whatever
their names. What rows that repeat and ties do is said at each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import language, line_dedup, minhash, packing, suffix_dedup
from tessera.llm.common import cut


def _with_chars(docs: DataFrame) -> DataFrame:
    """Keeps ``n_chars`` true to the text, where there is such a column."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go (null and empty ones too), and those in which no language fills three tenths of the words, beside an unknown source.

    Rows that repeat are judged alike; of languages with equal shares the first name counts.
    """
    found = language.identify(docs, docs, out="_language", unknown=True)
    return found.where(language.accepted(F.col("_language"), 0.3)).drop("_language")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines that five or more documents hold stay in the last of them only. No document goes; null texts become empty.

    Rows that repeat an id are one document and are shortened alike; rows with a null id neither count nor lose lines.
    """
    out = line_dedup.dedup_lines(docs, n_lines="_n_lines", n_dropped="_n_dropped").drop("_n_lines", "_n_dropped")
    return _with_chars(out).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 over five words, the one of the least id stays.

    Documents without words are linked with nothing, and rows with a null id stay. All rows that repeat a kept id stay.
    """
    return minhash.near_dedup(docs, words=5, percent=80)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings of 200 bytes that occur elsewhere too go from the texts: passages of 50 words and more, most of which have 250 bytes at least. No document goes.

    Rows that repeat, with or without the same id, are copies of each other and lose what they share. Characters that a cut would halve go whole.
    """
    out = suffix_dedup.dedup_substrings(docs, length=200, out="_dedup", as_text=True).withColumn("text", F.col("_dedup.kept")).drop("_dedup")
    return _with_chars(out).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens; an empty text is one piece with the end. Rows that repeat are packed each; ties are broken by checksum and place."""
    return packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("language_id", language_id), ("line_dedup", drop_lines), ("near_dedup", drop_near_copies), ("suffix_dedup", drop_passages), ("packing", pack)]

#: Expectation-maximisation, tokenizers and differencing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
