"""Quality rules by distribution divergence, with DataFrame functions only.

A document's histogram of character classes and its histogram of common words are compared with those of each language by the
Jensen-Shannon distance, and the nearest language counts. A document that is far from all of them is dropped, and so is one that lacks common words. Short texts
give noisy histograms: below a least length a histogram is not judged.

The references come from all documents with a language: one aggregate of class counts, and one of words, each combined inside
tasks before it is shuffled. They hold ``COMMON`` words a language and are sent as literals, and judging is a map
over rows with neither shuffle nor join. The plan has the same size for any number of languages, and a document's words are
compared with those languages only that have one of them: of all others, the one whose common words are rarest is nearest.

A row whose label has no reference may be prose of a rare language, in letters that no reference has. It is compared with the pool of all documents, on digits, punctuation and
the rest: what any script's prose has little of tells junk from it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import SPACE_CHARS, SPACE_CLASS, cut, let

#: Words of a language's reference; least number of slots for words; a language with this share of all words, or so many words, has a reference, the largest so many languages at most.
COMMON, SLOTS, LEAST_SHARE, ENOUGH_WORDS, LANGUAGES = 64, 1 << 13, 0.001, 100_000, 256
#: Least words and characters to be judged, largest distances of documents that stay.
LEAST_WORDS, LEAST_CHARS, MOST_WORDS_JS, MOST_CHARS_JS = 60, 200, 0.53, 0.27
#: Least part of the common words that the language with the fewest would have in a text, and standard deviations allowed for noise.
LEAST_COMMON, NOISE = 0.5, 3.0

#: Classes of characters besides white space and the rest (mostly lower-case ASCII letters).
CLASSES = {"upper": "[A-Z]+", "digit": "[0-9]+", "punctuation": r"[!-/:-@\[-`{-~]+", "other": r"[^\x00-\x7F]+"}
_HISTOGRAM = ["space", *CLASSES, "rest"]


def with_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``_text`` (null as empty), ``_words`` (runs of what is not white space) and ``_n``, their number."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.btrim(F.col("_text"), F.lit(SPACE_CHARS))
    out = docs.withColumn("_text", text).withColumn("_trimmed", trimmed)
    out = out.withColumn("_words", F.when(F.col("_trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("_trimmed", SPACE_CLASS + "+")))
    return out.withColumn("_n", F.size("_words")).drop("_trimmed")


def removed(text: Column, pattern: str) -> Column:
    """Code points that a pattern matches."""
    return (F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))).cast("long")


def with_classes(docs: DataFrame) -> DataFrame:
    """Counts of the character classes of ``_text`` as ``_c_<class>``, after ``with_words``; ``_rare`` is the text without a to z and white space.

    Nearly all characters go in one pass over long runs, so that the classes are told apart on what little is left.
    """
    out = docs.withColumn("_chars", F.char_length("_text").cast("long")).withColumn("_word_chars", F.char_length(F.array_join("_words", "")).cast("long"))
    out = out.withColumn("_rare", F.regexp_replace("_text", r"[a-z\x20\x09-\x0D]+", ""))
    out = out.withColumns({"_c_space": F.col("_chars") - F.col("_word_chars")} | {f"_c_{k}": removed(F.col("_rare"), v) for k, v in CLASSES.items()})
    return out.withColumn("_c_rest", F.col("_word_chars") - sum(F.col(f"_c_{k}") for k in CLASSES))


@dataclass(frozen=True)
class References:
    """By language: shares of the character classes; and of the words in each slot, with the words that own the slots and their hashes. ``pooled``: shares of the classes over all languages.

    A word's slot is its hash, shifted by the number of bits that ``shifts`` holds for the hash's lowest bits; no two words share a slot.
    """

    classes: dict[str, list[float]]
    words: dict[str, dict[int, float]]
    owners: dict[int, str]
    hashes: dict[int, int]
    shifts: list[int]
    pooled: list[float]


def place(hashes: dict[str, int]) -> tuple[dict[str, int], list[int]]:
    """A slot for every word, none for two, and the shifts that lead to them; the number of slots is that of the shifts, a power of two."""
    size = SLOTS
    while size < 4 * len(hashes):
        size *= 2
    while True:
        shifts, slots, taken = [0] * size, {}, set()
        groups: dict[int, list[str]] = {}
        for word, h in hashes.items():
            groups.setdefault(h & (size - 1), []).append(word)
        for low, group in sorted(groups.items(), key=lambda g: (-len(g[1]), g[0])):
            for shift in range(64):
                own = [((hashes[w] & (2**64 - 1)) >> shift) & (size - 1) for w in group]
                if len(set(own)) == len(own) and taken.isdisjoint(own):
                    break
            else:
                break
            shifts[low] = shift
            taken.update(own)
            slots.update(zip(group, own))
        if len(slots) == len(hashes):
            return slots, shifts
        size *= 2


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> References:
    """Histograms from all rows with a language: of the ``LANGUAGES`` with most words among those that hold ``LEAST_SHARE`` of all words or ``ENOUGH_WORDS`` of them, and of all rows together.

    A language keeps its reference as the corpus grows around it. The driver holds one row and ``COMMON`` words for each of them.
    """
    rows = with_words(docs.select(F.col(lang_col).alias("_lang"), F.col(text_col).alias("_in")).where("_lang is not null"), "_in")
    sums = cut(with_classes(rows).groupBy("_lang").agg(F.sum("_n").alias("n"), *(F.sum(f"_c_{k}").alias(k) for k in _HISTOGRAM)))
    total = sums.agg(F.sum("n").alias("n"), *(F.sum(k).alias(k) for k in _HISTOGRAM)).first()
    if not total["n"]:
        return References({}, {}, {}, {}, [], [])
    pooled = [total[k] / sum(total[k] for k in _HISTOGRAM) for k in _HISTOGRAM]
    held = sums.where(((F.col("n") >= LEAST_SHARE * total["n"]) | (F.col("n") >= ENOUGH_WORDS)) & (F.col("n") > 0)).orderBy(F.desc("n"), "_lang").limit(LANGUAGES)
    found = {r["_lang"]: r for r in sorted(held.collect(), key=lambda r: r["_lang"])}
    if not found:
        return References({}, {}, {}, {}, [], pooled)
    counts = rows.where(F.col("_lang").isin(list(found))).select("_lang", F.explode("_words").alias("_w")).groupBy("_lang", F.col("_w").alias("word")).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy(F.desc("n"), "word"))
    top = counts.withColumn("rank", rank).where(F.col("rank") <= COMMON).select("_lang", "word", "n", F.xxhash64("word").alias("hash")).collect()  # COMMON rows a language
    hashes = {r["word"]: r["hash"] for r in sorted(top, key=lambda r: r["word"])}
    slots, shifts = place(hashes)
    words: dict[str, dict[int, float]] = {lang: {} for lang in found}
    for r in top:
        words[r["_lang"]][slots[r["word"]]] = r["n"] / found[r["_lang"]]["n"]
    classes = {lang: [r[k] / max(1, sum(r[k] for k in _HISTOGRAM)) for k in _HISTOGRAM] for lang, r in found.items()}
    return References(classes, words, {s: w for w, s in slots.items()}, {s: hashes[w] for w, s in slots.items()}, shifts, pooled)


def _literal(values: list, kind: str) -> Column:
    """Numbers as one literal array: the split is folded when the query is planned."""
    return F.split(F.lit(" ".join(map(repr, values))), " ").cast(f"array<{kind}>")


def _term(p: Column, q: Column | float) -> Column:
    """What a class of shares p and q adds to the Jensen-Shannon divergence in bits."""
    q = F.lit(float(q)) if not isinstance(q, Column) else q
    half = lambda x: F.when(x > 0, x * F.log2(2 * x / (p + q)) / 2).otherwise(0.0)
    return half(p) + half(q)


def _distance(divergence: Column) -> Column:
    return F.sqrt(F.least(F.greatest(divergence, F.lit(0.0)), F.lit(1.0)))


def class_distance(refs: References) -> Column:
    """Distance of the class counts to the nearest language; null without references or characters."""
    if not refs.classes:
        return F.lit(None).cast("double")
    shares = F.array(*(F.col(f"_c_{k}") / F.greatest("_chars", F.lit(1)) for k in _HISTOGRAM))
    own = [_literal([c[i] for c in refs.classes.values()], "double") for i in range(len(_HISTOGRAM))]
    to = lambda p, j: sum((_term(p[i], F.get(q, j)) for i, q in enumerate(own)), F.lit(0.0))
    least = let(shares, lambda p: F.array_min(F.transform(F.sequence(F.lit(0), F.lit(len(refs.classes) - 1)), lambda j: to(p, j))))
    return F.when(F.col("_chars") > 0, _distance(least))


def pooled_distance(refs: References) -> Column:
    """Distance of digits, punctuation and all other characters to the pool of all languages; null without references or characters."""
    if not refs.pooled:
        return F.lit(None).cast("double")
    told = ("digit", "punctuation")
    own = [refs.pooled[_HISTOGRAM.index(k)] for k in told]
    shares = [F.col(f"_c_{k}") / F.greatest("_chars", F.lit(1)) for k in told]
    terms = [_term(p, q) for p, q in zip([*shares, 1 - sum(shares)], [*own, 1 - sum(own)])]
    return F.when(F.col("_chars") > 0, _distance(sum(terms, F.lit(0.0))))


def word_distance(refs: References) -> Column:
    """Distance of the common-word histogram ``_runs`` (slot, times) to the nearest language; null without references or words.

    What a text and a language have in common lies at ``begin[slot]`` to ``begin[slot + 1]`` of the lists of languages and shares.
    """
    if not refs.words:
        return F.lit(None).cast("double")
    held: dict[int, list[tuple[int, float]]] = {}
    for i, own in enumerate(refs.words.values()):
        for s, q in own.items():
            held.setdefault(s, []).append((i, q))
    begin, entries = [0], []
    for s in range(len(refs.shifts)):
        entries += held.get(s, [])
        begin.append(len(entries))
    covers = [sum(own.values()) for own in refs.words.values()]
    rarest = covers.index(min(covers))
    at, langs, shares, cover = _literal(begin, "int"), _literal([i for i, _ in entries], "int"), _literal([q for _, q in entries], "double"), _literal(covers, "double")
    part = F.col("_n").cast("double")

    def shared(r: Column) -> Column:
        # a word that only one side has adds half its share, which is counted below; here is what a word of both takes off
        less = lambda k: let(F.get(shares, k), lambda q: _term(r["times"] / part, q) - q / 2 - r["times"] / part / 2)
        return F.transform(F.sequence(F.get(at, r["slot"]), F.get(at, r["slot"] + 1) - 1), lambda k: F.struct(F.get(langs, k).alias("lang"), less(k).alias("less")))

    def nearest(both: Column) -> Column:
        candidates = F.array_union(F.transform(both, lambda b: b["lang"]), F.array(F.lit(rarest)))
        off = lambda j: F.aggregate(both, F.lit(0.0), lambda a, b: a + F.when(b["lang"] == j, b["less"]).otherwise(0.0))
        return F.array_min(F.transform(candidates, lambda j: let(F.get(cover, j), lambda c: c / 2 + _term(other, F.greatest(1 - c, F.lit(0.0)))) + off(j)))

    hits = F.col("_hits") / F.greatest("_n", F.lit(1))
    other = F.greatest(1 - hits, F.lit(0.0))
    return F.when(F.col("_n") > 0, _distance(hits / 2 + let(F.flatten(F.transform("_runs", shared)), nearest)))


def lacks_common_words(refs: References) -> Column:
    """Whether a text's common words, those of all languages together, are surely less than ``LEAST_COMMON`` of what any language has.

    The distance can't tell: without a single common word it is about 0.41 where these are 0.3 of the words.
    """
    if not refs.words:
        return F.lit(False)
    least = min(sum(own.values()) for own in refs.words.values())
    return F.col("_hits") + NOISE * F.sqrt(F.col("_hits") + 1) < F.lit(LEAST_COMMON * least) * F.col("_n")


def with_hashes(docs: DataFrame) -> DataFrame:
    """``_hashes`` of ``_words``, 64 bits each."""
    return docs.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))


def with_runs(docs: DataFrame, refs: References) -> DataFrame:
    """``_runs``: (slot, times) of the common words, known by ``_hashes``; ``_hits``: how many words they are."""
    if not refs.owners:
        return docs.withColumn("_runs", F.array().cast("array<struct<slot:int,times:int>>")).withColumn("_hits", F.lit(0))
    size = len(refs.shifts)
    low = F.lit(size - 1).cast("long")
    shifts, hashes = _literal(refs.shifts, "int"), _literal([refs.hashes.get(i, 0) for i in range(size)], "bigint")
    slot = lambda h: F.call_function("shiftrightunsigned", h, F.get(shifts, h.bitwiseAND(low).cast("int"))).bitwiseAND(low).cast("int")
    hits = F.transform(F.filter("_hashes", lambda h: F.get(hashes, slot(h)) == h), slot)
    ends = lambda s: F.filter(F.transform(s, lambda x, i: F.when(x.eqNullSafe(F.get(s, i + 1)), F.lit(-1)).otherwise(i)), lambda i: i >= 0)
    runs = lambda s: let(ends(s), lambda e: F.transform(e, lambda x, i: F.struct(F.get(s, x).alias("slot"), (x - F.when(i > 0, F.get(e, i - 1)).otherwise(-1)).alias("times"))))
    return docs.withColumn("_slots", F.sort_array(hits)).withColumn("_runs", let(F.col("_slots"), runs)).withColumn("_hits", F.size("_slots")).drop("_slots")


def with_repeats(docs: DataFrame, width: int = 8) -> DataFrame:
    """``_repeat``: words in windows of 8 words that occur twice or more in the text.

    Windows are known by 64-bit hashes, made by doubling: 2, 4, then 8 words. Only texts with a repeat sort their windows.
    """
    assert width == 8, "windows are doubled thrice"
    out = docs.withColumn("_h", F.col("_hashes"))
    for step in (1, 2, 4):
        out = out.withColumn("_h", F.zip_with("_h", F.slice("_h", step + 1, F.greatest("_n", F.lit(1))), lambda a, b: F.xxhash64(a, b)))
    out = out.withColumn("_h", F.slice("_h", 1, F.greatest(F.col("_n") - (width - 1), F.lit(0))))
    ordered = F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    twice = lambda o: F.filter(F.transform(o, lambda p, i: F.when(p["x"].eqNullSafe(F.get(o, i - 1)["x"]) | p["x"].eqNullSafe(F.get(o, i + 1)["x"]), p["i"]).otherwise(-1)), lambda i: i >= 0)
    covered = lambda q: F.aggregate(F.transform(q, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(q, i + 1) - x, F.lit(width)))), F.lit(0), lambda a, x: a + x)
    slow = let(ordered, lambda o: let(F.sort_array(twice(o)), covered))
    return out.withColumn("_repeat", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), slow).otherwise(0).cast("long")).drop("_h")


OUTPUT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "word_js", "class_js", "pooled_js", "base_failed", "kept")


def judge(docs: DataFrame, refs: References, text_col: str = "text", lang_col: str | None = None, least_words: int = LEAST_WORDS, least_chars: int = LEAST_CHARS, most_words_js: float = MOST_WORDS_JS, most_chars_js: float = MOST_CHARS_JS) -> DataFrame:
    """The documents with counts (long), ``base_failed``, ``word_js``, ``class_js``, ``pooled_js`` (0 to 1, null if not measurable) and ``kept``.

    Rows whose ``lang_col`` names a language without a reference are judged by ``pooled_js``, which no script stands out in, and not by words: it may be a rare language.
    Null and empty texts have no words and fail the base rules. Without references (no row has a language) nothing is
    far. Texts of any length are judged whole, each in the memory of its row. Rows that repeat are judged each. Input columns named like an output are replaced.
    """
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(text_col).alias("_in"))  # no name of the input can clash with those used here
    out = with_repeats(with_runs(with_hashes(with_classes(with_words(row, "_in"))), refs))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    out = out.withColumn("_lines", lines)
    out = out.withColumns({
        "n_words": F.col("_n").cast("long"), "word_chars": F.col("_word_chars"), "n_symbols": removed(F.col("_rare"), "[#*$%&|<>]+"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"), "n_repeat_words": F.col("_repeat"),
        "word_js": word_distance(refs), "class_js": class_distance(refs), "pooled_js": pooled_distance(refs),
    })
    far = ((F.col("n_words") >= least_words) & ((F.col("word_js") > most_words_js) | lacks_common_words(refs))) | ((F.col("_chars") >= least_chars) & (F.col("class_js") > most_chars_js))
    if lang_col is not None and refs.pooled:
        known = F.coalesce(F.col("_row")[lang_col].isin(list(refs.classes)), F.lit(True))
        far = F.when(known, far).otherwise((F.col("_chars") >= least_chars) & (F.col("pooled_js") > most_chars_js))
    out = out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    out = out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False)))
    return out.select(*(F.col("_row")[c].alias(c) for c in docs.columns if c not in OUTPUT), *OUTPUT)
