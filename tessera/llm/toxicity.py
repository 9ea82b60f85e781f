"""Toxicity from subword-bag embeddings.

A word is the mean of the vectors of its character n-grams (spaces at both ends), which are hashed to ``BUCKETS`` rows; a
passage of ``PASSAGE`` words is the mean of its distinct words; a linear softmax over the passage gives its class. Vectors and softmax are trained
jointly with numpy. A misspelt word shares n-grams, and so vectors, with words that were seen. Documents have labels and
passages have none, so after a first stage in which random passages take their document's label, training goes on with the
likeliest passages of each document. A document's score is that of its likeliest passage, calibrated on documents kept
back from training. Whole texts are scored, by passages that overlap by half, so that one which straddles is not halved: once trained, an n-gram needs one number, its vector's difference between the classes.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: n-gram sizes, hashed rows, dimensions, words of a passage, words from one passage to the next.
SIZES, BUCKETS, DIMENSIONS, PASSAGE, STRIDE = (3, 4, 5), 1 << 17, 12, 16, 8
#: Training takes at most so many labelled documents of each class (those of the least hashed ids), of at most so many characters each.
MOST_DOCS, MOST_CHARS = 2000, 100_000
#: What each row's sum of squares starts with, so that a rare n-gram does not take a full step at once.
CALM = 1e-2
#: Rounds over random passages and over likeliest ones, passages of a document in a round, learning rate, bytes scored together.
RANDOM, LIKELIEST, DRAWN, RATE, BATCH = 8, 10, 3, 0.3, 1 << 20


def every_word(text: str | None) -> bytes:
    """All words in order, A to Z lower-cased, each between single spaces."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    return b" " + b" ".join(words) + b" " if words else b""


def normal(text: str | None) -> bytes:
    """The distinct words in order: texts of which it is equal are copies."""
    words = dict.fromkeys(every_word(text).split())
    return b" " + b" ".join(words) + b" " if words else b""


def grams(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams inside the words of normal data, and the number of each one's word."""
    b = np.frombuffer(data, np.uint8)
    space = b == 32
    word = np.cumsum(space, dtype=np.int32) - 1
    codes, words = [], []
    h = b.astype(np.uint32)
    inside = ~space  # what lies between the first and the last character has no space
    rolling = h
    for n in range(2, max(SIZES) + 1):
        rolling = rolling[:-1] * np.uint32(0x01000193) ^ h[n - 1 :]
        if n > 2:
            inside = inside[:-1] & ~space[n - 2 : len(b) - 1] if n > 3 else ~space[1:-1]
        if n in SIZES:
            at = np.flatnonzero(inside)
            mixed = (rolling[at] + np.uint32(n)) * np.uint32(0x9E3779B1)
            codes.append((mixed ^ (mixed >> np.uint32(15))) & np.uint32(BUCKETS - 1))
            words.append(word[at + 1])
    return np.concatenate(codes), np.concatenate(words)


def passages(n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Where passages begin and end; the last one ends with the text, and every word is in one at least."""
    starts = np.arange(0, max(n_words - PASSAGE, 0) + STRIDE, STRIDE)
    starts[-1] = max(n_words - PASSAGE, 0)
    return starts, np.minimum(starts + PASSAGE, n_words)


def distinct(words: list[bytes], starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first occurrence of each word in each passage, and how many a passage has: a word that is said over and over counts once."""
    index: dict[bytes, int] = {}
    return first_places(np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words)), starts, ends)


def first_places(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``distinct`` of words by their numbers."""
    order = np.argsort(ids, kind="stable")
    before = np.full(len(ids), -1)  # where the same word stood last
    same = ids[order[1:]] == ids[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    sizes = ends - starts
    places = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes - starts, sizes)
    fresh = before[places] < np.repeat(starts, sizes)
    return places[fresh], np.add.reduceat(fresh, np.cumsum(sizes) - sizes)


def word_values(data: bytes, value: np.ndarray) -> np.ndarray:
    """Mean of a number per bucket over the n-grams of each word."""
    codes, words = grams(data)
    n = data.count(b" ") - 1
    return np.bincount(words, weights=value[codes], minlength=n)[:n] / np.maximum(np.bincount(words, minlength=n)[:n], 1)


def passage_values(data: bytes, value: np.ndarray) -> np.ndarray:
    """Mean of the distinct words' values in each passage; at least one word is needed."""
    out, at = [], 0
    while at < len(data):  # long texts are taken in pieces that end between words
        end = len(data) if len(data) - at <= BATCH else data.rfind(b" ", at, at + BATCH) + 1
        end = end if end > at + 1 else len(data)
        out.append(word_values(data[at:end], value))
        at = end if end == len(data) else end - 1
    values = np.concatenate(out)
    places, sizes = distinct(data.split(), *passages(len(values)))
    return np.add.reduceat(values[places], np.cumsum(sizes) - sizes) / sizes


@dataclass
class Model:
    """Difference of the classes per bucket and in all, and the calibration of the likeliest passage."""

    value: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, text: str | None) -> float:
        """0 to 1; a text without words scores 0."""
        data = every_word(text)
        if not data:
            return 0.0
        top = float(passage_values(data, self.value).max()) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * top + self.shift, -30, 30))))


def train(texts: list[str], labels: np.ndarray, prior: float, seed: int = 0) -> Model:
    """Fit vectors and softmax; ``prior`` is the share of label 1 among all labelled rows, to calibrate for."""
    rng = np.random.default_rng(seed)
    ready = list({d: (every_word(t), y) for t, d, y in zip(texts, map(normal, texts), labels) if d}.values())  # copies would weigh like many documents
    if not ready or len({y for _, y in ready}) < 2:  # nothing to tell apart
        p = float(np.clip(prior, 1e-6, 1 - 1e-6))
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 1.0, float(np.log(p / (1 - p))))
    order = rng.permutation(len(ready))
    data, y = [ready[i][0] for i in order], np.array([ready[i][1] for i in order])
    n_fit = max(2, len(data) * 4 // 5)
    # n-grams of all words, with where each word's n-grams and each document's words begin
    codes, firsts, sizes = [], [], []
    for d in data:
        c, w = grams(d)
        n = d.count(b" ") - 1
        codes.append(c[np.argsort(w, kind="stable")])
        sizes.append(np.bincount(w, minlength=n)[:n])
    lengths = np.concatenate(sizes)
    gram_at = np.concatenate([[0], np.cumsum(lengths)])
    codes = np.concatenate(codes)
    # passages overlap, so each one's distinct words are listed: ``member`` holds their places, ``starts`` where a passage's begin in it
    member, counts, doc, at = [], [], [], 0
    for i, (d, s) in enumerate(zip(data, sizes)):
        places, n = distinct(d.split(), *passages(len(s)))
        member.append(places + at)
        counts.append(n)
        doc.append(np.full(len(n), i))
        at += len(s)
    member, counts, doc = np.concatenate(member), np.concatenate(counts), np.concatenate(doc)
    ends = np.cumsum(counts)
    starts = ends - counts
    doc_at = np.searchsorted(doc, np.arange(len(data)))

    e = ((rng.random((BUCKETS, DIMENSIONS)) - 0.5) / DIMENSIONS).astype(np.float32)
    w, bias = np.zeros(DIMENSIONS, np.float32), 0.0  # softmax of two classes: the difference of their rows
    w += rng.normal(0, 0.1, DIMENSIONS).astype(np.float32)
    seen, seen_w, seen_b = np.full(BUCKETS, CALM, np.float32), np.full(DIMENSIONS, 1e-6), 1e-6

    def logits() -> np.ndarray:
        value = e @ w
        per_word = np.add.reduceat(np.append(value[codes], 0), gram_at[:-1]) / np.maximum(lengths, 1) * (lengths > 0)
        return np.add.reduceat(per_word[member], starts) / counts + bias

    for epoch in range(RANDOM + LIKELIEST):
        z = rng.random(len(starts)) if epoch < RANDOM else logits()
        ranked = np.lexsort((-z, doc))
        place = np.arange(len(ranked)) - doc_at[doc[ranked]]
        # of a toxic document only the likeliest passage is surely meant by the label
        most = np.where((y[doc[ranked]] == 1) & (epoch >= RANDOM), 1, DRAWN)
        drawn = rng.permutation(ranked[(place < most) & (doc[ranked] < n_fit)])
        for k in range(0, len(drawn), 128):
            own = drawn[k : k + 128]
            n_words = ends[own] - starts[own]
            words = member[np.repeat(starts[own] - np.concatenate([[0], np.cumsum(n_words)[:-1]]), n_words) + np.arange(n_words.sum())]
            n_grams = lengths[words]
            at_grams = np.repeat(gram_at[words] - np.concatenate([[0], np.cumsum(n_grams)[:-1]]), n_grams) + np.arange(n_grams.sum())
            ids = codes[at_grams]
            weight = np.repeat(1 / (np.maximum(n_grams, 1) * np.repeat(n_words, n_words)), n_grams).astype(np.float32)
            passage = np.repeat(np.repeat(np.arange(len(own)), n_words), n_grams)
            heads = np.searchsorted(passage, np.arange(len(own)))
            bag = np.add.reduceat(e[ids] * weight[:, None], heads)
            error = (1 / (1 + np.exp(-np.clip(bag @ w + bias, -30, 30))) - y[doc[own]]).astype(np.float32)
            g_w, g_b = error @ bag, float(error.sum())
            # all n-grams of a passage move along the softmax, in proportion to their part of the mean
            push = np.bincount(ids, weights=error[passage] * weight, minlength=0)
            used = np.flatnonzero(push)
            seen[used] += push[used].astype(np.float32) ** 2
            e[used] -= (RATE * push[used] / np.sqrt(seen[used]))[:, None].astype(np.float32) * w
            seen_w, seen_b = seen_w + g_w**2, seen_b + g_b**2
            w -= (RATE * g_w / np.sqrt(seen_w)).astype(np.float32)
            bias -= RATE * g_b / np.sqrt(seen_b)

    top = np.maximum.reduceat(logits(), doc_at)
    held = np.arange(len(data)) >= n_fit
    if len({*y[held]}) < 2:
        held[:] = True
    cost = np.where(y == 1, prior / max(1e-9, y[held].mean()), (1 - prior) / max(1e-9, 1 - y[held].mean()))[held]
    x, t, slope, shift = top[held], y[held], 1.0, 0.0
    scale, middle = x.std() + 1e-9, x.mean()
    x = (x - middle) / scale
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton, with a little shrinkage
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        r, h = cost * (p - t), cost * p * (1 - p) + 1e-9
        g = np.array([(r * x).sum() + 0.01 * a, r.sum()])
        hess = np.array([[(h * x * x).sum() + 0.01, (h * x).sum()], [(h * x).sum(), h.sum()]])
        step = np.linalg.solve(hess, g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
    slope, shift = a / scale, b - a * middle / scale
    return Model((e @ w).astype(np.float32), float(bias), float(slope), float(shift))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_docs: int = MOST_DOCS, most_chars: int = MOST_CHARS) -> Model:
    """Train on a bounded sample of the labelled documents: ``most_docs`` of each class at most, in order of hashed id.

    ``labels`` holds the ids and labels to learn from; null ids and labels are left out, an id that is labelled twice
    counts as 1 if it is once. One task trains; the sample's bound is its bound: labelled texts that are null or of more than ``most_chars`` characters are not learned
    from (all texts are scored whole), equal texts count once, of rows that repeat an id the one whose text comes first in order. Without rows or with one class only, every text
    with words scores the share of label 1. Other columns are ignored.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_id is not null and _y in (0, 1)").groupBy("_id").agg(F.max("_y").alias("_y"))
    sizes = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    chosen = [known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(most_docs) for y in (0, 1)]
    chosen = chosen[0].union(chosen[1])
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.col("_text").isNotNull() & (F.char_length("_text") <= most_chars))
    # of rows that repeat an id the same text counts in every run
    sample = rows.join(F.broadcast(chosen), "_id").groupBy("_id", "_y").agg(F.min("_text").alias("_text"))
    prior = sizes.get(1, 0) / max(1, sum(sizes.values()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = pd.concat([pd.DataFrame({"_id": [], "_y": [], "_text": []}), *batches]).sort_values("_id")
        yield pd.DataFrame({"model": [pickle.dumps(train(got["_text"].tolist(), got["_y"].to_numpy(int), prior))]})

    found = sample.select("_id", "_y", "_text").repartition(1).mapInPandas(run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else train([], np.zeros(0, int), prior)


def scorer(model: Model):
    """A Column function from text to score (0 to 1); null texts and texts without words score 0, equal texts alike, texts of any length by all their passages."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([model.score(t) for t in texts], dtype="float64")

    return F.pandas_udf(run, "double")
