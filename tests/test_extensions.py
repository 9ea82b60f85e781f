"""Joins on time, quantiles, best rows and sessions against brute force."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.operators import ranking, temporal
from tessera.streaming import sessions


@pytest.mark.parametrize("equal", [True, False])
def test_asof_matches_brute_force(spark, equal):
    """A hot key that spans all ranges, keys on one side only, equal times, nulls in keys and times, right rows long before."""
    rng = random.Random(1)
    key = lambda: rng.choice(["hot"] * 8 + ["a", "b", None])
    left = [(i, key(), rng.choice([None, *range(400)])) for i in range(600)] + [(600, "left only", 3), (601, "far", 399)]
    right = [(key(), t, 1000 + t) for t in rng.sample(range(400), 150)] + [("right only", 3, 3), ("far", 0, 7), ("hot", None, 5)]
    right = list({(k, t): (k, t, v) for k, t, v in right}.values())
    a = spark.createDataFrame(left, "id long, k string, t int")
    b = spark.createDataFrame(right, "k string, t int, v long")
    got = temporal.asof_join(a, b, ["k"], "t", "t", {"v": "v", "t": "right_t"}, equal)
    assert got.columns == ["id", "k", "t", "v", "right_t"]

    def wanted(k, t):
        held = [(rt, v) for rk, rt, v in right if rk == k is not None and rt is not None and t is not None and (rt <= t if equal else rt < t)]
        return max(held)[::-1] if held else (None, None)

    assert {r["id"]: (r["v"], r["right_t"]) for r in got.collect()} == {i: wanted(k, t) for i, k, t in left}
    assert temporal.asof_join(a, b.where("false"), ["k"], "t", "t", {"v": "x"}).where("x is null").count() == len(left)
    assert temporal.asof_join(a.where("false"), b, ["k"], "t", "t", {"v": "x"}).count() == 0


def test_asof_plan_has_no_one_task_window(spark):
    a = spark.range(10).selectExpr("id", "1 as k", "id as t")
    plan = temporal.asof_join(a, a, ["k"], "t", "t", {"id": "x"})._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("seed", [1, 2])
def test_overlaps_match_all_pairs(spark, seed):
    """Lengths over many orders of magnitude, empty and backward intervals, nulls, ends that touch, repeated rows."""
    rng = random.Random(seed)

    def rows(n):
        out = []
        for i in range(n):
            a = rng.choice([None] + [rng.uniform(-1000, 1000) for _ in range(30)])
            out.append((i, rng.choice(["x", "x", "y", None]), a, None if a is None else rng.choice([a, a - 1, a + 1, a + 10 ** rng.uniform(-3, 3), round(a) + 5.0])))
        return out + out[:2] + [(n, "x", 0.0, 5.0), (n + 1, "x", 5.0, 6.0)]

    one, two = rows(60), rows(70)
    schema = "id int, k string, a double, b double"
    meet = lambda p, q: None not in (*p[2:], *q[2:]) and p[2] < p[3] and q[2] < q[3] and p[2] < q[3] and q[2] < p[3]
    for on in (["k"], []):
        got = temporal.overlap_join(spark.createDataFrame(one, schema), spark.createDataFrame(two, schema), on, ("a", "b"), ("a", "b"))
        wanted = sorted((p[0], q[0]) for p in one for q in two if meet(p, q) and (not on or p[1] == q[1] is not None))
        assert sorted((r["left"]["id"], r["right"]["id"]) for r in got.collect()) == wanted
    none = spark.createDataFrame([], schema)
    assert temporal.overlap_join(none, none, ["k"], ("a", "b"), ("a", "b")).count() == 0


@pytest.mark.parametrize("bins, few", [(4, 3), (1024, 4096)])
def test_quantiles_match_sorting(spark, monkeypatch, bins, few):
    monkeypatch.setattr(ranking, "BINS", bins)
    monkeypatch.setattr(ranking, "FEW", few)
    rng = random.Random(bins)
    value = lambda: rng.choice([rng.gauss(0, 1), 7.0, 7.0, rng.uniform(-1e9, 1e9), 1e308, -1e308, float("nan"), None, float("inf"), 1e-300])
    rows = [(rng.choice(["hot"] * 6 + ["a", None]), value()) for _ in range(900)] + [("one", 3.0), ("no value", None)]
    fractions = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = ranking.exact_quantiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", fractions).collect()
    groups = defaultdict(list)
    for g, x in rows:
        if x is not None and not math.isnan(x):
            groups[g].append(min(x, 1.7976931348623157e308))
    wanted = {(g, f): (sorted(v)[max(1, math.ceil(f * len(v))) - 1], len(v)) for g, v in groups.items() for f in fractions}
    assert {(r["g"], r["fraction"]): (r["value"], r["n"]) for r in got} == wanted and len(got) == len(wanted)
    assert ranking.exact_quantiles(spark.createDataFrame([], "g string, x double"), ["g"], "x", [0.5]).count() == 0


@pytest.mark.parametrize("held", [5, 100_000])
def test_best_rows_match_sorting(spark, monkeypatch, held):
    monkeypatch.setattr(ranking, "HELD", held)
    rng = random.Random(held)
    rows = [(rng.choice(["hot"] * 6 + ["a", None]), rng.choice([None, float("nan"), *map(float, range(6))]), rng.choice([i, 2**60 + i, -i]), [i]) for i in range(700)]
    df = spark.createDataFrame(rows, "g string, x double, `id.y` long, items array<int>").repartition(5)
    got = ranking.top_k(df, ["g"], "x", "id.y", 4)
    groups = defaultdict(list)
    for r in rows:
        if r[1] is not None and not math.isnan(r[1]):
            groups[r[0]].append(r)
    wanted = [(*r, k) for v in groups.values() for k, r in enumerate(sorted(v, key=lambda r: (-r[1], r[2]))[:4], 1)]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, wanted))
    assert [r["rank"] for r in ranking.top_k(df, [], "x", "id.y", 3).orderBy("rank").collect()] == [1, 2, 3]
    assert ranking.top_k(df.where("false"), ["g"], "x", "id.y", 4).count() == 0


def test_sessions_and_late_rows(spark):
    """Rows arrive in batches, some behind the watermark: these are counted, the rest gives the sessions that a sort would."""
    rng = random.Random(5)
    rows = [(rng.choice(["u", "v", "w", None]), rng.randrange(0, 4000) * 1000) for _ in range(400)] + [("u", None)]
    arrive = [min(0.999, max(0.0, ((t or 0) / 1000 + rng.uniform(-500, 500)) / 5000)) for _, t in rows]
    df = spark.createDataFrame([(k, t, a) for (k, t), a in zip(rows, arrive)], "k string, ms long, arrival double").selectExpr("k", "timestamp_millis(ms) as ts", "arrival")
    out = sessions.replayed(spark, df, "k", "ts", 60_000, "100 seconds", "arrival", 5).select("k", F.unix_millis("start").alias("a"), F.unix_millis("end").alias("b"), "n_rows").collect()
    kept, late, top = defaultdict(list), defaultdict(int), None
    for i in range(5):
        batch = [(k, t) for (k, t), a in zip(rows, arrive) if t is not None and i / 5 <= a < (i + 1) / 5]
        mark = 0 if top is None else max(0, top - 100_000)
        for k, t in batch:
            if k is not None:
                if t < mark:
                    late[k] += 1
                else:
                    kept[k].append(t)
        top = max([t for _, t in batch] + [top or 0])
    wanted = [(k, *s) for k, times in kept.items() for s in sessions.merged([(t, t, 1) for t in times], 60_000)]
    assert sorted((r["k"], r["a"], r["b"], r["n_rows"]) for r in out if r["a"] is not None) == sorted(wanted)
    assert sum(late.values()) > 5 and {k: n for k in late if (n := sum(r["n_rows"] for r in out if r["a"] is None and r["k"] == k))} == dict(late)


def test_sessions_merge():
    assert sessions.merged([(10, 10, 1), (0, 0, 1), (5, 5, 2), (30, 40, 3), (39, 50, 1)], 5) == [(0, 10, 4), (30, 50, 4)] and sessions.merged([], 5) == []
