"""Ranked search against brute force over all documents and items."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from oracle import assert_same, tables
from tessera.llm import queries, search

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t in docs if i is not None and terms(t)]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    wanted = {}
    for item, text in items:
        if item is not None:
            wanted.setdefault(item, set()).update(terms(text))
    out = []
    for item, own in wanted.items():
        scores = []
        for i, c in held:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in own if c[t])
            if s > 0:
                scores.append((-s, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def rows_of(df):
    return sorted((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())


def test_query_matches_sql(spark):
    assert_same(queries.QUERIES["op12_search"](spark, SF).toPandas(), tables(SF).sql(queries.ORACLE_SQL["op12_search"]).df())


def test_terms():
    text = "Ab-c1 d_é\xa0É·x\x7fZ\t\n9"
    assert [t.decode() for t in search.terms_of(text.encode())] == terms(text)
    every = "".join(map(chr, range(0x250)))
    assert [t.decode() for t in search.terms_of(every.encode())] == terms(every)


@pytest.mark.parametrize("shard, block", [(3, 4), (1 << 14, 1 << 19)])
def test_search_matches_brute_force(spark, monkeypatch, shard, block):
    """Small shards and small blocks of queries give what one shard and one block give; many documents tie."""
    monkeypatch.setattr(search, "SHARD_DOCS", shard)
    monkeypatch.setattr(search, "BLOCK_TERMS", block)
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "é", "x_y"]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 9)))) for i in range(60)]
    docs += [(i + 60, t) for i, t in docs[:20]] + [(100, None), (101, ""), (102, " -- "), (None, "w1 w2"), (5, "w3 w3"), (5, "w3 w3"), (103, "w1 " * 5000)]
    items = [(1, "W1 w1 w2"), (2, "é É"), (3, "none at all"), (4, None), (5, ""), (6, "w3"), (6, "w4 w3"), (None, "w1"), (7, " ".join(vocabulary))]
    index = search.build(spark.createDataFrame(docs, "doc_id long, text string"))
    assert (index.shards.count() > 10) == (shard == 3)
    got = search.search(index, spark.createDataFrame(items, "item_id long, text string"), k=7)
    assert rows_of(got) == brute(docs, items, 7)


def test_best_is_safe_with_ties():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n, k = rng.integers(0, 30), int(rng.integers(1, 12))
        scores, ids = rng.integers(0, 4, n), rng.permutation(100)[:n]
        wanted = sorted((-s, i) for s, i in zip(scores, ids) if s > 0)[:k]
        at = search.best(scores, ids, k)
        assert sorted((-s, i) for s, i in zip(scores[at], ids[at])) == wanted


def test_search_odd_rows(spark, odd, none):
    index = search.build(odd)
    items = [(1, "hello 123"), (2, "the")]
    got = search.search(index, spark.createDataFrame(items, "item_id long, text string"))
    assert rows_of(got) == brute([(r["doc_id"], r["text"]) for r in odd.collect()], items, 50)
    assert search.search(search.build(none), odd, "doc_id").count() == 0
    assert search.search(index, none, "doc_id").columns == ["doc_id", "rank", "doc_id", "score"]
    assert search.search(index, none.withColumnRenamed("doc_id", "item_id")).count() == 0
