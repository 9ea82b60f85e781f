"""Fuzzy joins, key and order discovery, rules, profiles and JSON arrays against brute force."""

import json
import math
import random
from itertools import combinations, permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import discovery, fuzzy, quality, rules
from tessera.operators.profile import profile
from tessera.sources import json_array
from tessera.sources.tables import CATALOGUE, catalogue


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def misspelled(rng, word, n):
    w = list(word)
    for _ in range(n):
        k = rng.randrange(3)
        at = rng.randrange(len(w) + 1)
        if k == 0:
            w.insert(at, rng.choice("abcé"))
        elif w:
            at = min(at, len(w) - 1)
            if k == 1:
                del w[at]
            else:
                w[at] = rng.choice("abcé")
    return "".join(w)


@pytest.mark.parametrize("distance, block", [(0, 1024), (1, 3), (2, 1024), (2, 4), (3, 1024)])
def test_near_words_match_all_pairs(spark, monkeypatch, distance, block):
    """Short words, words on both sides of the longest that is filed by deletions, long ones, and a key that many share."""
    monkeypatch.setattr(fuzzy, "BLOCK", block)
    rng = random.Random(distance)
    bases = ["".join(rng.choice("abcé") for _ in range(n)) for n in (0, 1, 2, 3, 5, 8, 13, 18, 19, 20, 21, 22, 23, 30, 60)]
    left = [misspelled(rng, b, rng.randrange(4)) for b in bases for _ in range(5)] + bases + [None, "aa", "aa"]
    right = [misspelled(rng, b, rng.randrange(4)) for b in bases for _ in range(5)] + bases + [None, ""]
    got = fuzzy.near_join(spark.createDataFrame([(w,) for w in left], "l string"), spark.createDataFrame([(w,) for w in right], "r string"), "l", "r", distance)
    wanted = {(a, b, d) for a in {*left} - {None} for b in {*right} - {None} if (d := edits(a, b)) <= distance}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == wanted and len(rows) == len(wanted)
    if distance == 2:
        pairs = fuzzy.near_pairs(spark.createDataFrame([(w,) for w in left], "l string"), "l", distance)
        assert {tuple(r) for r in pairs.collect()} == {(a, b, d) for a in {*left} - {None} for b in {*left} - {None} if a < b and (d := edits(a, b)) <= distance}


def test_near_words_of_nothing(spark):
    none = spark.createDataFrame([], "w string")
    assert fuzzy.near_pairs(none, "w").count() == 0 and fuzzy.near_join(none, spark.createDataFrame([("a",)], "w string"), "w", "w").count() == 0


def test_hot_keys_meet_in_blocks(spark, monkeypatch):
    """No pair of blocks of a key holds more lookups times entries than its bound, give or take the hash."""
    monkeypatch.setattr(fuzzy, "BLOCK", 16)
    words = spark.range(200).selectExpr("lpad(cast(id as string), 3, '0') as w")
    got = fuzzy.near_join(words, words, "w", "w", 2)
    assert got.count() == sum(edits(f"{a:03}", f"{b:03}") <= 2 for a in range(200) for b in range(200))


def test_path_spelling(spark):
    rows = [("Toprun Wheel", "https://a.example/toprum/wheel.jpg"), ("Wheel", "https://a.example/wheel"), ("abcd", "https://a.example/abce/abcf"), ("No URL", "not a url"), (None, "https://a.example/x"), ("ab", "https://a.example/ac"), ("ÉCLAIR", "HTTP://a.example/éclaire/")]
    got = fuzzy.path_spelling(spark.createDataFrame(rows, "n string, u string"), "n", "u").collect()
    assert [tuple(r["spelling"]) if r["spelling"] else None for r in got] == [("toprun", "toprum", 1), None, ("abcd", "abce", 1), None, None, None, ("éclair", "éclaire", 1)]


def test_urls_of_all_kinds(spark):
    rows = [("https://a.example/x/y.jpg?z=/", "y.jpg", False), ("HTTPS://a.example/x.jpg", "x.jpg", False), ("svn+ssh://a.example/x/", "", True), ("https://b.example", "", False), ("https://b.example/", "", True), ("https://b.example/a/?q#f", "", True), ("not a url", None, None), ("/a/b/", None, None), ("", None, None), (None, None, None), ("http://a b/c/", None, None)]
    df = spark.createDataFrame([(u,) for u, *_ in rows], "u string")
    got = df.select(text.url_leaf("u").alias("l"), text.url_is_directory("u").alias("d")).collect()
    assert [tuple(r) for r in got] == [(leaf, directory) for _, leaf, directory in rows]


def keys_by_brute_force(rows, names, most):
    found = []
    for k in range(min(most, len(names)) + 1):
        for own in combinations(range(len(names)), k):
            if any(set(x) <= set(own) for x in found):
                continue
            if len({tuple(repr(r[i]) for i in own) for r in rows}) == len(rows):
                found.append(own)
    return {tuple(names[i] for i in x) for x in found}


@pytest.mark.parametrize("n", [0, 1, 2, 40, 700])
def test_minimal_keys_match_brute_force(spark, n):
    rng = random.Random(n)
    rows = [(i if rng.random() < 0.999 else None, rng.randrange(30), rng.choice(["a", None, "b", "c"]), rng.randrange(60), float(rng.randrange(40)), rng.randrange(12)) for i in range(n)]
    names = ["a", "b", "c", "d", "e", "f.g"]
    df = spark.createDataFrame(rows, "a long, b int, c string, d int, e double, `f.g` int").withColumn("m", F.create_map(F.lit(1), F.lit(2)))
    got = {tuple(r["key"]) for r in discovery.minimal_keys(df, most=4).collect()}
    assert got == keys_by_brute_force(rows, names, 4)


def test_nulls_and_zeros_in_keys(spark):
    df = spark.createDataFrame([(None, "a", 0.0), ("a", None, -0.0), ("a", "a", 0.0)], "x string, y string, z double")
    assert {tuple(r["key"]) for r in discovery.minimal_keys(df).collect()} == {("x", "y")}


def lists_by_brute_force(rows, names, most):
    rank = lambda v: (v is not None, v if v is not None else 0)
    out = {}
    for k in range(1, most + 1):
        for own in permutations(range(len(names)), k):
            if any(out.get(tuple(names[i] for i in own[:j]), 1) == 0 for j in range(1, k)):
                continue
            seq = [tuple(rank(r[i]) for i in own) for r in rows]
            if all(a <= b for a, b in zip(seq, seq[1:])):
                out[tuple(names[i] for i in own)] = sum(a == b for a, b in zip(seq, seq[1:]))
    return out


@pytest.mark.parametrize("n, fan", [(0, 64), (1, 64), (300, 2), (300, 64)])
def test_ascending_lists_match_brute_force(spark, monkeypatch, n, fan):
    monkeypatch.setattr(discovery, "FAN", fan)
    rng = random.Random(n)
    rows = sorted(((rng.choice([None, 1, 2, 3]), rng.randrange(4), rng.randrange(50)) for _ in range(n)), key=lambda r: ((r[0] is not None, r[0] or 0), r[1], r[2]))
    rows = [(i, *r, i // 7, -i) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "p long, a int, b int, c int, d long, e long").repartition(3)
    got = {tuple(r["columns"]): r["n_ties"] for r in discovery.ascending_lists(df, "p", ["a", "b", "c", "d", "e"], 3).collect()}
    assert got == lists_by_brute_force([r[1:] for r in rows], ["a", "b", "c", "d", "e"], 3)


def test_a_descent_between_ranges_is_seen(spark):
    """Each range ascends by itself; only their ends tell."""
    rows = spark.range(0, 4000).selectExpr("id as p", "id % 1000 as saw", "id div 1000 as step")
    got = {tuple(r["columns"]) for r in discovery.ascending_lists(rows, "p", ["saw", "step"], 2).collect()}
    assert got == {("step",), ("step", "saw")}


def test_stretches_join_in_any_order():
    rng = np.random.default_rng(3)
    for _ in range(100):
        n = int(rng.integers(1, 12))
        values, rows = np.arange(n) * 1.5, rng.integers(1, 4, n)
        flagged = np.minimum(rng.integers(0, 4, n), rows)
        whole = rules.stretch(values, flagged, rows)
        gains = 2 * flagged - rows
        options = [(-gains[i : j + 1].sum(), values[i], values[j], rows[i : j + 1].sum()) for i in range(n) for j in range(i, n)]
        gain, low, high, held = min(options)
        assert whole.best == (-gain, low, high, held)
        cut = sorted(rng.integers(1, n, 2).tolist()) if n > 2 else []
        parts = [rules.stretch(values[a:b], flagged[a:b], rows[a:b]) for a, b in zip([0, *cut], [*cut, n]) if a < b]
        left = parts[0]
        for p in parts[1:]:
            left = rules.joined(left, p)
        right = parts[-1]
        for p in parts[-2::-1]:
            right = rules.joined(p, right)
        assert left == right == whole


def test_rules_find_what_made_the_flag(spark):
    rng = random.Random(6)
    rows = [(rng.choice("abcd"), rng.choice([None, "x", "y"]), float(i) if i % 9 else float("nan"), rng.randrange(5)) for i in range(600)]
    rows = [(*r, True if r[0] == "b" or 100 <= r[2] <= 200 else (None if r[3] == 4 else False)) for r in rows]
    df = spark.createDataFrame(rows, "kind string, other string, `at.x` double, n int, flag boolean")
    found = {r["column"]: r for r in rules.best_rules(df, "flag", ["kind", "other"], ["at.x", "n"]).collect()}
    own = [r for r in rows if r[4] is not None]
    total = sum(r[4] for r in own)
    by_kind = {k: [r[4] for r in own if r[0] == k] for k in "abcd"}
    assert found["kind"]["errors"] == sum(min(sum(v), len(v) - sum(v)) for v in by_kind.values()) and found["kind"]["n_values"] == sum(2 * sum(v) > len(v) for v in by_kind.values())
    held = sorted((r[2], r[4]) for r in own if not math.isnan(r[2]))
    best = max(((sum(1 if f else -1 for _, f in held[i : j + 1])), -held[i][0], -held[j][0]) for i in range(len(held)) for j in range(i, len(held)))
    assert (found["at.x"]["low"], found["at.x"]["high"], found["at.x"]["errors"]) == (-best[1], -best[2], total - best[0])
    steps = rules.decision_list(df, "flag", ["kind", "other"], ["at.x"], steps=4).collect()
    assert [(s["column"], s["value"]) for s in steps[:1]] == [("kind", "b")] and steps[1]["column"] == "at.x" and [s["left"] for s in steps] == sorted((s["left"] for s in steps), reverse=True)
    covered = [r for r in own if r[0] == "b"]
    assert (steps[0]["support"], steps[0]["errors"], steps[0]["left"]) == (len(covered), 0, total - len(covered))
    assert rules.best_rules(df.where("false"), "flag", ["kind"], ["n"]).count() == 0 and rules.decision_list(df.where("false"), "flag", ["kind"], ["n"]).count() == 0


def test_profile(spark):
    rows = [(i, None if i % 5 == 0 else f"v{i}", " " if i % 2 else "", None, [] if i % 2 else [i], "hot" if i % 3 else str(i)) for i in range(30_000)]
    df = spark.createDataFrame(rows, "a long, b string, blank string, none string, items array<long>, skew string").withColumn("m", F.create_map()).withColumn("x.y", F.lit(1.5))
    got = {r["column"]: r for r in profile(df).collect()}
    assert (got["b"]["n_null"], got["b"]["shortest"], got["b"]["longest"]) == (6000, 2, 6) and got["a"]["low"] == "0" and got["a"]["high"] == "29999"
    assert [c for c in got if got[c]["placeholder"]] == ["blank", "none", "m"] and got["items"]["n_blank"] == 15_000
    for c, n in (("a", 30_000), ("b", 24_000), ("skew", 10_001)):
        assert abs(got[c]["n_distinct"] - n) <= 0.04 * n  # five standard errors
    assert got["blank"]["n_distinct"] == 2 and got["none"]["n_distinct"] == 0 and got["x.y"]["n_distinct"] == 1
    hot = got["skew"]["heavy"][0]
    assert hot["item"] == "hot" and abs(hot["count"] - 20_000) <= 30_000 / 10_000 * 2
    assert {r["n"] for r in profile(df.where("false")).collect()} == {0} and not any(r["placeholder"] for r in profile(df.where("false")).collect())


def test_json_arrays_in_parts(spark, tmp_path):
    """Brackets, quotes and backslashes in strings at every place of a part's border, records longer than a part, blank and absent fields."""
    rng = random.Random(8)
    odd = ['{"a": [1]}', "\\", "\\\\", '"', '\\"', "}, {", "]", "é【", "\n", "", "x" * 300]
    records = []
    for i in range(120):
        r = {"manufacturer": "".join(rng.choice(odd) for _ in range(rng.randrange(4))), "brand": f"b{i}", "aliases": [rng.choice(odd) for _ in range(rng.randrange(3))], "updatedAt": "2024-01-02T03:04:05.678Z", "extra": {"deep": [{"x": "}"}, []]}}
        if i % 3:
            r["imageUrl"] = rng.choice(odd)
        records.append(r)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(records, indent=2, ensure_ascii=False))
    (tmp_path / "in" / "b.json").write_text(json.dumps(records[:7], ensure_ascii=True, separators=(",", ":")))
    (tmp_path / "in" / "c.json").write_text("[]")
    (tmp_path / "in" / "d.json").write_text("")
    wanted = sorted(map(repr, catalogue(spark, str(tmp_path / "in" / "[ab].json")).collect()))
    for part in (37, 1000, 1 << 20):
        got = json_array.read_json_array(spark, str(tmp_path / "in"), CATALOGUE, part)
        assert got.columns == CATALOGUE.names and sorted(map(repr, got.collect())) == wanted
    parts = json_array.array_parts(spark, str(tmp_path / "in"), 1000).groupBy("path").count().collect()
    assert max(r["count"] for r in parts) > 10


def test_states_at_every_byte():
    data = json.dumps([{"k": 'a\\"b\\\\', "l": ["[{", "}\\"]}, {"m": "\\\\\\"}]).encode()
    whole = json_array.marks(data, False)
    for at in range(len(data)):
        escaped = (at - len(data[:at].rstrip(b"\\"))) % 2 == 1
        left, right = json_array.marks(data[:at], False), json_array.marks(data[at:], escaped)
        assert np.array_equal(whole[0], np.append(left[0], right[0] + at)) and np.array_equal(whole[1], np.append(left[1], right[1] + at))


def test_json_arrays_that_are_broken(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"brand": "x"}, {"brand": "y}]')
    with pytest.raises(Exception, match="not closed"):
        json_array.read_json_array(spark, str(tmp_path), CATALOGUE).collect()
    (tmp_path / "a.json").write_text('[{"brand": {"x": 1}, "updatedAt": "when"}]')
    with pytest.raises(Exception):
        json_array.read_json_array(spark, str(tmp_path), CATALOGUE).collect()


def test_status_counts_a_record_once(spark):
    records = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, found string")
    extra = spark.createDataFrame([(1, 5, "x"), (1, 6, "y"), (None, 7, "z")], "k int, v int, found string").withColumn("m", F.create_map(F.lit("a"), F.col("v")))
    got = quality.with_status(records, extra, "k")
    assert got.columns == ["k", "found", "v", "m", "status"]
    assert sorted((r["found"], r["status"], r["v"] in (5, 6)) for r in got.collect()) == [("a", "registered", True), ("b", "skipped", False), ("c", "skipped", False)]


def test_key_order_with_odd_columns(spark):
    df = spark.range(200).selectExpr("id % 7 as k", "id as _place", "id as `range`", "id as `a.b`", "named_struct('m', map('x', id)) as s", "id as position")
    got = quality.key_order(df, ["k"])
    assert got.columns == ["k", "_place", "range", "a.b", "s", "position"]
    rows = sorted(got.collect(), key=lambda r: r["position"])
    assert [r["position"] for r in rows] == list(range(1, 201)) and [r["k"] for r in rows] == sorted(r["k"] for r in rows) and all(r["s"]["m"]["x"] == r["a.b"] == r["_place"] for r in rows)
