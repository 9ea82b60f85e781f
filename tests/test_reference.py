import json

import pytest

import __spark_entry__ as entry
from oracle import assert_same, tables
from tessera.functions import text
from tessera.operators import quality
from tessera import plans
from tessera.sources import scratch
from tessera.sources.tables import catalogue, write_catalogue
from tessera.streaming.status import shape_over_time

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_query_matches_sql(spark, name):
    assert_same(plans.QUERIES[name](spark, SF).toPandas(), tables(SF).sql(plans.ORACLE_SQL[name]).df())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_slug_and_search_text(spark):
    df = spark.createDataFrame([("Acme", "X-1・Z", ""), ("Acme", "球 2", "RED"), (None, "", None)], "brand string, name string, color string")
    got = df.select(text.slug("brand", "name", "color").alias("s"), text.search_text("brand", "name", "color", suffix="spare part").alias("q")).collect()
    assert [r["s"] for r in got] == ["acme_x_1_z.jpg", "acme_球_2_red.jpg", ".jpg"]
    assert [r["q"] for r in got] == ["Acme X-1・Z spare part", "Acme 球 2 RED spare part", "spare part"]


def test_urls(spark):
    df = spark.createDataFrame([("https://a.example/x/y.jpg?z=1",), ("http://a.example/x/",), ("https://b.example",), (None,), ("not a url",)], "u string")
    got = df.select(text.url_host("u").alias("h"), text.url_leaf("u").alias("l")).collect()
    assert [tuple(r) for r in got] == [("a.example", "y.jpg"), ("a.example", ""), ("b.example", ""), (None, None), (None, None)]


def test_catalogue_round_trip(spark, tmp_path):
    records = [
        {"manufacturer": "M", "brand": "B", "patternName": "P 1", "color": "", "aliases": [], "status": "registered", "imageFile": "b_p_1.jpg", "imageUrl": "https://a.example/1.jpg", "source": "", "searchQuery": "M B P 1", "updatedAt": "2024-01-02T03:04:05.678Z"},
        {"manufacturer": "M", "brand": "B", "patternName": "P 2", "color": "", "aliases": [], "status": "skipped", "updatedAt": "2024-01-02T03:04:06.000Z"},
    ]
    (tmp_path / "c.json").write_text(json.dumps(records, indent=2))
    df = catalogue(spark, str(tmp_path / "c.json"))
    shape = {r["status"]: r for r in quality.shape_by_status(df, ["imageFile", "imageUrl"]).collect()}
    assert (shape["registered"]["n_imageFile"], shape["skipped"]["n_imageFile"]) == (1, 0)
    assert df.select(text.iso_stamp("updatedAt").alias("t")).first()["t"] == "2024-01-02T03:04:05.678Z"
    assert quality.duplicate_keys(df, ["manufacturer", "brand", "patternName", "color"]).count() == 0
    write_catalogue(df, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_key_order_of_nothing(spark):
    assert quality.key_order(spark.createDataFrame([], "k int"), ["k"]).count() == 0


def test_stream_counts_by_window(spark, tmp_path):
    spark.range(10).selectExpr("timestamp_seconds(id * 600) as ts", "'registered' as status").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, status string").parquet(str(tmp_path / "in"))
    query = shape_over_time(stream, "ts", "status").writeStream.format("memory").queryName("shape").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r["n_rows"] for r in spark.sql("select * from shape").collect()) == [4, 6]


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_key_order_with_other_columns(spark, tmp_path, adaptive):
    """Ranks are those of a plain window, with columns besides the keys and files in random order, however partitions are joined."""
    spark.range(40_000, numPartitions=6).selectExpr("(id * 7919) % 40000 as k", "id as a", "cast(id as string) as b", "repeat('x', 20) as c").write.parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        rows = quality.key_order(spark.read.parquet(str(tmp_path / "t")), ["k"]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(rows) == 40_000 and all(r["position"] == r["k"] + 1 and r["a"] == int(r["b"]) for r in rows)


def test_key_order_of_equal_keys(spark):
    df = spark.range(1000).selectExpr("if(id % 3 = 0, null, id % 2) as k", "id as other")
    rows = sorted(quality.key_order(df, ["k"]).collect(), key=lambda r: r["position"])
    assert [r["position"] for r in rows] == list(range(1, 1001)) and len({r["other"] for r in rows}) == 1000
    assert [r["k"] for r in rows] == sorted((r["k"] for r in rows), key=lambda k: -1 if k is None else k)


def test_anomalies(spark):
    df = spark.createDataFrame([("https://a.example/x/", "a 【b"), ("https://a.example/x.jpg", "a (b) [c]"), (None, None)], "u string, n string")
    assert [(r["url_is_directory"], r["open_bracket"]) for r in quality.anomalies(df, "u", "n").collect()] == [(True, True), (False, False), (None, None)]


def test_queries_without_the_optional_part(monkeypatch):
    monkeypatch.setattr(entry.importlib, "import_module", lambda name: (_ for _ in ()).throw(ModuleNotFoundError("gone", name=name)))
    assert set(entry.queries()) == set(plans.QUERIES) and set(entry.oracle_sql()) == set(plans.ORACLE_SQL)


def test_tables_are_released(spark, tmp_path):
    import os

    table = scratch.cut(spark.range(5))
    path = table.inputFiles()[0].removeprefix("file:").rpartition("/")[0]
    assert table.count() == 5 and os.path.isdir(path)
    scratch.release()
    assert not os.path.exists(path)
