"""Exact dedup against brute force, also where fingerprints are made to collide."""

import hashlib
import random
import re

import pytest

from oracle import assert_same, tables
from tessera.llm import exact, queries

SF = "/root/testdata/sf0.001"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(rows):
    held = {}
    for i, t in rows:
        held.setdefault(lower(t), []).append(i)
    out = []
    for i, t in rows:
        ids = held[lower(t)]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), keep == i, hashlib.sha256(lower(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r["id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in df.collect()), key=repr)


def test_query_matches_sql(spark):
    assert_same(queries.QUERIES["op11_exact_dedup"](spark, SF).toPandas(), tables(SF).sql(queries.ORACLE_SQL["op11_exact_dedup"]).df())


def test_fingerprints_combine():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(20_000))
    horner = lambda b, point: __import__("functools").reduce(lambda h, x: (h * point + x + 1) % exact.PRIME, b, 0)
    assert exact.fingerprint(data) == tuple(horner(data, p) for p in exact.POINTS)
    assert exact.fingerprint(b"") == (0, 0) != exact.fingerprint(b"\0")
    for at in (0, 1, 4096, 9999, 20_000):
        assert exact.combined(exact.fingerprint(data[:at]), exact.fingerprint(data[at:]), len(data) - at) == exact.fingerprint(data)


def odd_texts():
    rng = random.Random(2)
    long_ = "".join(rng.choice("abcdÉé \n") for _ in range(900))
    other = long_[:-1] + "z"
    rows = [(i, t) for i, t in enumerate(["A b", "a B", "a  b", None, "", " ", long_, long_.upper().replace("É", "é"), long_, other, other, "é", "É", "one"])]
    return [*rows, (6, long_), (6, long_), (6, "one"), (None, "one"), (None, "alone"), (None, "alone")]


@pytest.mark.parametrize("chunk", [64, 1 << 16])
def test_groups_match_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(exact, "CHUNK", chunk)
    rows = odd_texts()
    got = exact.groups_of(spark.createDataFrame(rows, "doc_id long, text string"))
    assert rows_of(got) == brute(rows)


@pytest.mark.parametrize("chunk", [7, 1 << 16])
def test_colliding_fingerprints_lose_nothing(spark, monkeypatch, chunk):
    """With a fingerprint that tells nothing but the length, the comparison alone finds the groups, in as many rounds as there are texts of a length."""
    monkeypatch.setattr(exact, "CHUNK", chunk)
    monkeypatch.setattr(exact, "fingerprint", lambda data: (len(data), 1))
    rounds, plain = [], exact._differing
    monkeypatch.setattr(exact, "_differing", lambda *a: (rounds.append(1), plain(*a))[1])
    rows = [(i, t) for i, t in enumerate(["abcdefghij", "ABCDEFGHIJ", "abcdefghik", "abcdefghik", "abcdefghil", "x", "y", "Y", None, ""])]
    got = exact.groups_of(spark.createDataFrame(rows, "doc_id long, text string"))
    assert rows_of(got) == brute(rows) and len(rounds) == 3


def test_exact_odd_rows(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert rows_of(exact.groups_of(odd)) == brute(rows)
    out = exact.exact_dedup(odd)
    assert out.columns == odd.columns
    kept = [r["doc_id"] for r in out.collect()]
    assert sorted(kept, key=repr) == sorted((i for i, _, _, stays, _ in brute(rows) if stays), key=repr) and kept.count(6) == 2
    assert exact.groups_of(none).count() == 0 and exact.exact_dedup(none).count() == 0


def test_ids_of_other_types(spark):
    df = spark.createDataFrame([("a", "X"), ("b", "x"), ("c", "y")], "doc_id string, text string")
    assert {r["id"]: r["keep_id"] for r in exact.groups_of(df).collect()} == {"a": "b", "b": "b", "c": "c"}
