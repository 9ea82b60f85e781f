"""Words within a few edits of each other, without comparing all pairs.

Two words within d edits become the same string when up to d characters are deleted from each. So short words are filed under
all strings that deletions leave of them. Longer words, which leave too many, are cut into d + 1 pieces, one of which must stand unchanged within d places in
the other word; they are filed under their pieces and looked up by the pieces of each length. Words that share a key are candidates, and the exact
distance decides.

A key may be shared by many words. Its entries and its lookups are dealt into blocks of at most about ``BLOCK``, and each pair of blocks is a key of its own, so
no task meets all of them at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import url_words, words
from tessera.sources.scratch import cut

#: Longest word that is filed by deletions; entries and lookups of a key that meet in one task.
SHORT, BLOCK = 20, 1024


def deletions(word: Column, distance: int) -> Column:
    """Distinct strings that are left of a word without up to ``distance`` of its characters."""
    out = F.array(word)
    last = out
    for _ in range(distance):
        # an empty word has no character to delete: the sequence would count down
        shorter = lambda w: F.when(F.char_length(w) == 0, F.array().cast("array<string>")).otherwise(
            F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(w), F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.char_length(w))))
        )
        last = F.array_distinct(F.flatten(F.transform(last, shorter)))
        out = F.concat(out, last)
    return F.array_distinct(out)


def _pieces(word: Column, length: Column, distance: int, shifts: range) -> Column:
    """Keys of the pieces into which words of ``length`` characters are cut, as they stand in ``word`` moved by each of the shifts."""
    q = distance + 1
    keys = []
    for i in range(q):
        start, end = F.floor(length * i / q), F.floor(length * (i + 1) / q)
        for s in shifts:
            piece = F.substring(word, (start + s + 1).cast("int"), (end - start).cast("int"))
            keys.append(F.when((start + s >= 0) & (end + s <= F.char_length(word)), F.concat_ws(":", F.lit("p"), length.cast("string"), F.lit(str(i)), piece)))
    return F.array(*keys)


def _keys(word: Column, distance: int, lookup: bool) -> Column:
    """What a word is filed under, or looked up by."""
    n = F.char_length(word)
    short = F.when(n <= SHORT, F.transform(deletions(word, distance), lambda x: F.concat(F.lit("d:"), x))).otherwise(F.array().cast("array<string>"))
    if lookup:
        long_ = F.flatten(F.array(*(_pieces(word, n + k, distance, range(-distance, distance + 1)) for k in range(-distance, distance + 1))))
    else:
        long_ = _pieces(word, n, distance, range(1))
    # words of two lengths are both short, or both long enough to be filed by pieces
    long_ = F.when(n > SHORT - distance, long_).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.array_compact(F.concat(short, long_)))


def near_join(left: DataFrame, right: DataFrame, left_col: str, right_col: str, distance: int = 2) -> DataFrame:
    """``left_word, right_word, distance`` (int) for all distinct words of both sides that are at most ``distance`` edits (of characters) apart, equal ones included.

    Null words match nothing; the empty word is a word. Words of any length take part. Words that repeat count once. An empty side gives no rows.
    """
    a = left.select(F.col(left_col).alias("word")).where("word is not null").distinct()
    b = right.select(F.col(right_col).alias("word")).where("word is not null").distinct()
    word = F.col("word")
    lookups = cut(a.select("word", F.explode(_keys(word, distance, True)).alias("key")))
    entries = cut(b.select("word", F.explode(_keys(word, distance, False)).alias("key")))
    counts = lookups.select("key", F.lit(1).alias("l"), F.lit(0).alias("e")).unionByName(entries.select("key", F.lit(0).alias("l"), F.lit(1).alias("e")))
    counts = counts.groupBy("key").agg(F.sum("l").alias("l"), F.sum("e").alias("e")).where("l > 0 and e > 0")
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int").alias(f"n{c}")
    shared = cut(counts.select("key", blocks("l"), blocks("e"))).hint("merge")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("word"), F.col(n)).cast("int")
    one = lookups.join(shared, "key").select("key", own("nl").alias("i"), every("ne").alias("j"), word.alias("left_word"))
    two = entries.join(shared, "key").select("key", every("nl").alias("i"), own("ne").alias("j"), word.alias("right_word"))
    near = F.abs(F.char_length("left_word") - F.char_length("right_word")) <= distance
    pairs = one.join(two.hint("merge"), ["key", "i", "j"]).where(near).select("left_word", "right_word").distinct()
    return pairs.withColumn("distance", F.levenshtein("left_word", "right_word", distance)).where("distance >= 0")


def near_pairs(df: DataFrame, column: str, distance: int = 2) -> DataFrame:
    """``left_word, right_word, distance``: pairs of different words of one column, the smaller first. See ``near_join``."""
    return near_join(df, df, column, column, distance).where("left_word < right_word")


def path_spelling(records: DataFrame, name: str, url: str, distance: int = 2, least: int = 4, out: str = "spelling") -> DataFrame:
    """The records with a struct ``out``: ``name_word, url_word, distance``, the closest words of the name and of the record's own URL that differ by 1 to ``distance`` edits.

    Words are runs of letters, lower-cased, of at least ``least`` characters. A name word that the URL also has is spelled as there and is not compared. Of equally close words the first in
    order count. Null if there are none, or if either field is null. A column named ``out`` is replaced.
    """
    long_ = lambda w: F.array_distinct(F.filter(w, lambda x: F.char_length(x) >= least))
    own, other = long_(words(name)), long_(url_words(url))
    pairs = F.flatten(F.transform(F.array_except(own, other), lambda a: F.transform(other, lambda b: F.struct(F.levenshtein(a, b, distance).alias("distance"), a.alias("name_word"), b.alias("url_word")))))
    best = F.array_min(F.filter(pairs, lambda p: p["distance"] > 0))
    return records.withColumn(out, F.when(best.isNotNull(), F.struct(best["name_word"].alias("name_word"), best["url_word"].alias("url_word"), best["distance"].alias("distance"))))
