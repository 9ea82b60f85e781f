"""The manifest against a plain tree built in memory."""

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from oracle import assert_same, tables
from tessera.llm import manifest, queries

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def part(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree_paths(nodes):
    """Root, and each node's siblings (left, right) level by level."""
    paths, where, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, w in enumerate(where):
            run = level[w // 3 * 3 : w // 3 * 3 + 3]
            paths[i].append((run[: w % 3], run[w % 3 + 1 :]))
        level, where = [h(*level[i : i + 3]) for i in range(0, len(level), 3)], [w // 3 for w in where]
    return level[0], paths


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0], h(*map(part, r)), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = tree_paths([x[1] for x in by[s]])
    root, tops = tree_paths([trees[s][0] for s in sources])
    out = []
    for s, top in zip(sources, tops):
        for (i, own, r), steps in zip(by[s], trees[s][1]):
            steps = steps + top
            text = r[4]
            if i is not None and zlib.crc32(str(i).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            node = h(*map(part, (*r[:4], text)))
            for a, b in steps:
                node = h(*a, node, *b)
            out.append((i, own, trees[s][0], root, h(*(x for a, b in steps for x in a + b)), node, node == root))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r[c] for c in ("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in df.collect()), key=repr)


def tampered():
    return {"text": F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}


def made(df):
    return rows_of(manifest.manifest(df, tampered=tampered()))


def test_query_matches_sql(spark):
    assert_same(queries.QUERIES["op13_manifest"](spark, SF).toPandas(), tables(SF).sql(queries.ORACLE_SQL["op13_manifest"]).df())


def test_query_matches_brute_force(spark):
    got = queries.QUERIES["op13_manifest"](spark, SF)
    rows = [tuple(r[c] for c in COLUMNS) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    wanted = brute(rows)
    assert rows_of(got.withColumnRenamed("doc_id", "id")) == wanted and {r[-1] for r in wanted} == {True, False}


@pytest.mark.parametrize("levels, enough", [(1, 2), (2, 1), (7, 4096)])
def test_many_rounds_match_brute_force(spark, monkeypatch, levels, enough):
    """Few digits at a time make many rounds and deep histograms, and change nothing. One source holds most rows, some one each."""
    monkeypatch.setattr(manifest, "LEVELS", levels)
    monkeypatch.setattr(manifest, "ENOUGH", enough)
    rng = random.Random(levels)
    ids = [*range(-5, 120), 2**62, -(2**63), 2**63 - 1, *(rng.randrange(-(2**63), 2**63) for _ in range(60))]
    sources = ["web"] * 6 + ["w", "wé", "", None, "Web", *(f"s{i}" for i in range(8))]
    rows = [(i, rng.choice(sources), rng.choice(["en", None]), rng.choice([3, None]), rng.choice(["a\nb", "", None, "é\n", "x"])) for i in ids]
    rows += [rows[3], rows[3], (7, "web", None, None, "other"), (None, "web", "en", 1, "a\n"), (None, "web", "en", 1, "b")]
    assert made(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")) == brute(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10])
def test_small_trees(spark, n):
    rows = [(i, None, "en", 1, "a\nb") for i in range(n)]
    assert made(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")) == brute(rows)


def test_ranks(spark, monkeypatch):
    monkeypatch.setattr(manifest, "ENOUGH", 3)
    rng = random.Random(1)
    rows = [(f"g{rng.randrange(3)}", "".join(rng.choice("0AF") for _ in range(rng.randrange(9))), str(rng.randrange(3))) for _ in range(300)]
    got = manifest.ranked(spark.createDataFrame(rows, "g string, k string, t string"), "g", "k", "t").collect()
    for g in {r[0] for r in rows}:
        own = sorted((r for r in got if r["g"] == g), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(len(own))) and {r["n"] for r in own} == {len(own)}
        assert [(r["k"], r["t"]) for r in own] == sorted((k, t) for x, k, t in rows if x == g)


def test_manifest_odd_rows(odd, none):
    rows = [tuple(r[c] for c in COLUMNS) for r in odd.collect()]
    assert made(odd) == brute(rows)
    assert made(none) == []
