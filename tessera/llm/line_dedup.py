"""Line dedup, with DataFrame functions only.

Hashes of long lines are range-partitioned with the document and sorted by hash, document and position. Streaming each
range gives the first line of every (hash, document), so documents are counted without collecting a key's rows: a key
that a third of all documents hold spans as many ranges as it needs, and its counts are combined inside each task before
they meet. Only positions travel back, as run-length compressed keep bitmaps; texts are moved only where the
bitmaps must be applied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import SPACE_CHARS, ascii_lower, cut, let, partitions

#: Bitmaps are held by id and text, so that repeated ids with different texts don't mix.
_KEY = ["_id", "_text_hash"]


def split_lines(text: Column) -> Column:
    """The lines of a text at \\n; null and empty texts are one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """For each document that loses lines: ``_id, _text_hash, dropped`` and the bitmap of the lines that stay.

    A line's key is the line stripped of white space at both ends, A to Z lower-cased. Keys of at least ``min_chars``
    code points that at least ``min_docs`` documents hold lose all their lines but those in the largest id.
    ``keep_bitmap`` holds (first line, lines) of each run of lines that stay, so a run of any length takes one entry.

    Documents whose id is null are not counted and lose nothing. Rows that repeat an id count as one document. Empty
    tables give no rows. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("_id"), text.alias("_text")).where("_id is not null and char_length(_text) >= %d" % min_chars)
    lines = base.select("_id", F.xxhash64("_text").alias("_text_hash"), F.posexplode(F.split(ascii_lower(F.col("_text")), "\n")).alias("_pos", "_line"))
    key = F.btrim("_line", F.lit(SPACE_CHARS))
    lines = lines.select(*_KEY, "_pos", key.alias("_key")).where(F.char_length("_key") >= min_chars)
    # 128 bits: the seeds differ, so the halves are independent
    lines = cut(lines.select(*_KEY, "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(1), "_key").alias("_h2")))

    ranged = lines.repartitionByRange(partitions(docs.sparkSession), "_h1", "_h2", F.desc("_id"))
    first = F.row_number().over(Window.partitionBy("_h1", "_h2", "_id").orderBy("_pos"))
    holders = ranged.withColumn("_nth", first).where("_nth = 1")
    common = holders.groupBy("_h1", "_h2").agg(F.count("*").alias("_docs"), F.max("_id").alias("_keeper")).where(F.col("_docs") >= min_docs)
    # one row a common line, written: so the join's two sides are plain exchanges and a line that many documents hold is split over tasks
    dropped = lines.join(cut(common).hint("merge"), ["_h1", "_h2"]).where("_id <> _keeper")
    dropped = dropped.groupBy(*_KEY).agg(F.sort_array(F.collect_set("_pos")).alias("dropped"))
    # a run of kept lines lies between one dropped position and the next; the last run has no known end yet (-1)
    starts = F.concat(F.array(F.lit(0)), F.transform("dropped", lambda p: p + 1))
    ends = F.concat(F.col("dropped"), F.array(F.lit(-1)))
    runs = F.arrays_zip(starts.alias("start"), ends.alias("end"))
    runs = F.filter(runs, lambda r: (r["end"] < 0) | (r["end"] > r["start"]))
    return dropped.withColumn("keep_bitmap", F.transform(runs, lambda r: F.struct(r["start"].alias("start"), F.when(r["end"] >= 0, r["end"] - r["start"]).otherwise(-1).alias("lines"))))


def apply_bitmap(lines: Column, bitmap: Column) -> Column:
    """The lines of a keep bitmap, joined by \\n."""

    def piece(kept: Column) -> Column:
        return F.transform(bitmap, lambda r: F.slice(kept, r["start"] + 1, F.when(r["lines"] >= 0, r["lines"]).otherwise(F.size(kept) - r["start"])))

    return let(lines, lambda kept: F.array_join(F.flatten(piece(kept)), "\n"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """The documents with their text shortened, and the counts of lines before and of lines dropped (long).

    Every input column is kept, but for those named like the counts, which are replaced. Null and empty texts are one empty line; repeated rows
    are shortened alike; an empty table gives no rows. See ``keep_bitmaps`` for what is dropped.
    """
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))  # no name of the input can clash with those used here
    own, text = F.col("_row")[id_col], F.coalesce(F.col("_row")[text_col], F.lit(""))
    bitmaps = keep_bitmaps(docs, id_col, text_col, min_chars, min_docs).toDF("_bitmap_id", "_bitmap_hash", "_dropped", "_keep_bitmap")
    joined = row.withColumn("_hash", F.xxhash64(text)).join(bitmaps, (own == F.col("_bitmap_id")) & (F.col("_hash") == F.col("_bitmap_hash")), "left")
    kept = F.when(F.col("_keep_bitmap").isNull(), text).otherwise(apply_bitmap(split_lines(text), F.col("_keep_bitmap")))
    n = (F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    columns = [(kept if c == text_col else F.col("_row")[c]).alias(c) for c in docs.columns if c not in (n_lines, n_dropped)]
    return joined.select(*columns, n.alias(n_lines), F.coalesce(F.size("_dropped"), F.lit(0)).cast("long").alias(n_dropped))
