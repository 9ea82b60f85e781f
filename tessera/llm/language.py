"""Language ID by multilingual mixture inference.

Training counts hashed byte trigrams of each language over all training documents; the counts are combined in the JVM and
come to the driver as one bounded table (``BUCKETS`` rows a language). A document is then a mixture: each word was
written in one language, unknown, and expectation-maximisation over the words' n-gram likelihoods estimates the
proportions. The set of languages is the one of highest likelihood after a penalty for each further language. On request
one more component stands for an unknown source, all of whose trigrams are equally likely: it takes the words that no learned language explains.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hashed trigrams, additive smoothing, EM rounds, cost in nats of a further language per log(words), languages at most.
BUCKETS, ALPHA, ROUNDS, PENALTY, MOST_LANGUAGES = 1 << 16, 0.3, 8, 2.0, 100
#: Characters that are taken in at a time; longer texts are taken in pieces that end between words.
PIECE = 1 << 19

_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)
_LETTER = regex.compile(r"\p{L}")

PREDICTION = "lang_pred string, score double, languages array<string>, shares array<double>"


def _pieces(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > PIECE:
        end = text.rfind(" ", at, at + PIECE) + 1 or at + PIECE
        yield text[at:end]
        at = end
    yield text[at:]


def trigrams(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams of all words, and where each word's trigrams begin. A word is a run of letters' bytes, with a space at each end."""
    b = _LETTERS[np.frombuffer(b"  " + data + b" ", np.uint8)]
    space = b == 32
    before = space[1:-1]
    here = np.flatnonzero(~(space[2:] & before))
    one, two = b[1:-1][here], np.where(before[here], 32, b[:-2][here])
    grams = (two.astype(np.uint32) << 16) | (one.astype(np.uint32) << 8) | b[2:][here]
    return (grams * np.uint32(0x9E3779B1)) >> np.uint32(16), np.flatnonzero(before[here])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if lang not in counts and len(counts) >= MOST_LANGUAGES:
                raise ValueError(f"more than {MOST_LANGUAGES} languages; is the label column right?")
            own = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for piece in _pieces(text.lower()):
                own += np.bincount(trigrams(piece.encode("utf-8", "replace"))[0], minlength=BUCKETS)
    for lang, own in counts.items():
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at])], ["lang", "bucket", "n"])


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """The languages in order of name, and log probabilities (bucket x language), from all rows with a text and a label."""
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    sums = rows.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    known = sorted(r[0] for r in sums.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(known) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages; is the label column right?")
    counts = np.full((BUCKETS, len(known)), ALPHA)
    table = sums.toArrow()  # BUCKETS rows a language at most
    np.add.at(counts, (table["bucket"].to_numpy(), np.searchsorted(known, table["lang"].to_pylist()) if known else []), table["n"].to_numpy())
    return known, np.log(counts / counts.sum(axis=0)).astype(np.float32)


def _words(text: str, logp: np.ndarray) -> np.ndarray:
    """Log likelihood of each word under each language."""
    out = []
    for piece in _pieces(text.lower()):
        grams, starts = trigrams(piece.encode("utf-8", "replace"))
        if len(starts):
            out.append(np.add.reduceat(logp[grams], starts, axis=0))
    return np.concatenate(out) if out else np.zeros((0, logp.shape[1]), np.float32)


def mixtures(words: np.ndarray, sizes: np.ndarray, rounds: int = ROUNDS, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """Shares of all languages, and the selected languages (documents x languages), for documents of ``sizes`` words (1 or more)."""
    starts, most = np.concatenate([[0], np.cumsum(sizes)[:-1]]), words.max(axis=1, keepdims=True)
    like = np.exp(words - most)

    def em(like: np.ndarray, starts: np.ndarray, sizes: np.ndarray, shares: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        for _ in range(rounds):
            own = like * np.repeat(shares, sizes, axis=0)
            own /= own.sum(axis=1, keepdims=True) + 1e-30
            shares = np.add.reduceat(own, starts, axis=0) / sizes[:, None]
        fit = np.log((like * np.repeat(shares, sizes, axis=0)).sum(axis=1) + 1e-30)
        return shares, np.add.reduceat(fit, starts)

    n, k = len(sizes), words.shape[1]
    shares, best_possible = em(like, starts, sizes, np.full((n, k), 1 / k, np.float32), rounds)
    order, cost = np.argsort(-shares, axis=1, kind="stable"), penalty * np.log(np.maximum(sizes, 2))
    chosen = np.zeros((n, k), bool)
    chosen[np.arange(n), order[:, 0]] = True
    top = np.repeat(order[:, 0], sizes)
    best = np.add.reduceat((words[np.arange(len(words)), top] - most[:, 0]).astype(np.float64), starts)
    # a larger set can't be likelier than all languages together, so most documents are settled here
    open_ = np.flatnonzero(best_possible - best > cost) if k > 1 else []
    for m in range(2, k + 1):
        open_ = [i for i in open_ if best_possible[i] - (m - 1) * cost[i] > best[i]]
        if not open_:
            break
        rows = np.concatenate([np.arange(starts[i], starts[i] + sizes[i]) for i in open_])
        own, sets = np.asarray(sizes)[open_], np.zeros((len(open_), k), bool)
        sets[np.arange(len(open_))[:, None], order[open_, :m]] = True
        some = np.where(sets, shares[open_] + 1e-6, 0)
        _, fit = em(like[rows], np.concatenate([[0], np.cumsum(own)[:-1]]), own, (some / some.sum(axis=1, keepdims=True)).astype(np.float32), 3)
        for i, f, s in zip(open_, fit, sets):
            if f - (m - 1) * cost[i] > best[i]:
                best[i], chosen[i] = f - (m - 1) * cost[i], s
    return shares, chosen


def with_unknown(logp: np.ndarray) -> np.ndarray:
    """The log probabilities with a last column for an unknown source."""
    return np.column_stack([logp, np.full(len(logp), -np.log(len(logp)), logp.dtype)])


def predictor(known: list[str], logp: np.ndarray, unknown: bool = False):
    """A Column function from text to ``PREDICTION``.

    ``lang_pred`` is the selected language of the largest share, ``score`` its share among all languages, ``languages``
    and ``shares`` the selected set. Null texts and texts without a letter give ``und``, 0 and empty lists, and so does
    every text if nothing was learned. Of equal shares the first name wins. With ``unknown``, shares are taken over an unknown source
    too, and a text for which no language but that source is selected gives ``und``, 0 and empty lists.
    """
    if unknown:
        logp = with_unknown(logp)

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out: list[tuple] = [("und", 0.0, [], [])] * len(texts)
            ready: list[tuple[int, np.ndarray]] = []

            def flush() -> None:
                if ready:
                    shares, chosen = mixtures(np.concatenate([w for _, w in ready]), np.array([len(w) for _, w in ready]))
                    for (i, _), share, sets in zip(ready, shares, chosen):
                        names = sorted(np.flatnonzero(sets[: len(known)]), key=lambda j: -share[j])
                        if names:
                            out[i] = (known[names[0]], float(min(share[names[0]], 1)), [known[j] for j in names], [float(share[j]) for j in names])
                    ready.clear()

            held = 0
            for i, text in enumerate(texts):
                if known and text and _LETTER.search(text) and len(words := _words(text, logp)):
                    ready.append((i, words))
                    held += len(words)
                    if held > 200_000:
                        flush()
                        held = 0
            flush()
            yield pd.DataFrame(out, columns=["lang_pred", "score", "languages", "shares"])

    return F.pandas_udf(predict, PREDICTION)


def identify(docs: DataFrame, train: DataFrame, text_col: str = "text", lang_col: str = "lang", out: str = "language", unknown: bool = False) -> DataFrame:
    """The documents with a column ``out`` (see ``predictor``), by languages learned from ``train``. Only texts go to Python.

    Training rows with a null text or label teach nothing, rows that repeat count each, more than ``MOST_LANGUAGES`` labels raise (a table of ``BUCKETS`` numbers a
    label goes to every task). An empty ``train`` gives ``und`` everywhere, an empty ``docs`` no rows. A column named ``out`` is replaced; all others stay.
    """
    udf = predictor(*fit(train, text_col, lang_col), unknown)
    return docs.withColumn(out, udf(F.col(text_col)))


def accepted(prediction: Column, least: float = 0.5) -> Column:
    """Whether a prediction is a language that fills at least ``least`` of the text."""
    return (prediction["lang_pred"] != "und") & (prediction["score"] >= least)
