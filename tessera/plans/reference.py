"""The registered queries on the test tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import quality
from tessera.sources.scratch import new_path
from tessera.sources.json_array import read_json_array
from tessera.sources.tables import CATALOGUE, catalogue, table, write_arrays


def status_shape(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id", "quality", "toxic")
    return quality.shape_by_status(quality.with_status(docs, labels, "doc_id"), ["quality", "toxic"])


def slug(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.slug("p_brand", "p_name", "p_type").alias("image_file"))


def duplicate_key(spark: SparkSession, d: str) -> DataFrame:
    return quality.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


def shared_value(spark: SparkSession, d: str) -> DataFrame:
    return quality.duplicate_keys(table(spark, d, "documents").where("text is not null"), [F.md5("text").alias("text_md5")])


def hosts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").groupBy(text.url_host("url").alias("host")).agg(F.count("*").alias("n_pages"))


def leaf(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.url_leaf("url").alias("leaf"))


def stamp(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", text.iso_stamp("ts").alias("stamp"))


def search_text(spark: SparkSession, d: str) -> DataFrame:
    maker = F.when(F.col("p_type") != "PROMO", F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", text.search_text(maker, "p_name", "p_type", suffix="image search").alias("query"))


def key_order(spark: SparkSession, d: str) -> DataFrame:
    keys = ["p_brand", "p_name", "p_type", "p_partkey"]
    return quality.key_order(table(spark, d, "part").select(*keys, "p_size"), keys).select("p_partkey", "p_size", "position")


def catalogue_records(spark: SparkSession, d: str) -> DataFrame:
    """Parts as catalogue records, with the number of the file that each goes to. Records without an image lack four fields."""
    image = F.when(F.col("p_type") != "PROMO", text.slug("p_brand", "p_name"))
    held = lambda c: F.when(image.isNotNull(), c)
    return table(spark, d, "part").select(
        F.floor(F.col("p_partkey") / 1000).alias("part"), F.col("p_brand").alias("manufacturer"), F.col("p_type").alias("brand"), F.col("p_name").alias("patternName"), F.when(F.col("p_size") > 25, "RED").otherwise("").alias("color"),
        F.array().cast("array<string>").alias("aliases"), F.when(image.isNull(), "skipped").otherwise("registered").alias("status"), image.alias("imageFile"), held(F.concat(F.lit("https://a.example/"), F.col("p_partkey").cast("string"))).alias("imageUrl"),
        held(F.lit("")).alias("source"), held(text.search_text("p_brand", "p_name", suffix="image search")).alias("searchQuery"), F.timestamp_millis(F.lit(1704164645678) + 1000 * F.col("p_partkey")).alias("updatedAt"),
    )


FIELDS = ["manufacturer", "brand", "patternName", "color", "status", "imageFile", "imageUrl", "source", "searchQuery"]


def catalogue_round(spark: SparkSession, d: str) -> DataFrame:
    """Catalogue records written as JSON arrays of at most 1000 and read back: blank fields stay blank, absent ones are null, stamps keep their milliseconds."""
    path = new_path(spark)
    write_arrays(catalogue_records(spark, d), path, "part")
    return catalogue(spark, path).select(*FIELDS, text.iso_stamp("updatedAt").alias("updatedAt"), F.size("aliases").alias("n_aliases"))


def catalogue_parts(spark: SparkSession, d: str) -> DataFrame:
    """The same, each file read in parts by several tasks."""
    path = new_path(spark)
    write_arrays(catalogue_records(spark, d), path, "part")
    return read_json_array(spark, path, CATALOGUE, part=1 << 16).select(*FIELDS, text.iso_stamp("updatedAt").alias("updatedAt"), F.size("aliases").alias("n_aliases"))


def json_strings(spark: SparkSession, d: str) -> DataFrame:
    """Web pages as JSON arrays, read in parts: strings hold quotes, backslashes and brackets."""
    path, pages = new_path(spark), table(spark, d, "pages")
    write_arrays(pages.select(F.floor(F.col("page_id") / 500).alias("part"), "page_id", "url", "html"), path, "part")
    return read_json_array(spark, path, pages.schema, part=1 << 18).select("page_id", "url", F.md5("html").alias("html_md5"))


def anomalies(spark: SparkSession, d: str) -> DataFrame:
    return quality.anomalies(table(spark, d, "pages"), "url", "html").select("page_id", "url_is_directory", "open_bracket")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "ref_status_shape": status_shape, "ref_slug": slug, "ref_duplicate_key": duplicate_key, "ref_shared_value": shared_value, "ref_url_host": hosts,
    "ref_url_leaf": leaf, "ref_iso_stamp": stamp, "ref_search_text": search_text, "ref_key_order": key_order, "ref_catalogue": catalogue_round,
    "ref_catalogue_parts": catalogue_parts, "ref_json_strings": json_strings, "ref_anomalies": anomalies,
}

CATALOGUE_SQL = r"""
    with p as (
        select *, p_type <> 'PROMO' as held from part
    )
    select p_brand as manufacturer, p_type as brand, p_name as "patternName", case when p_size > 25 then 'RED' else '' end as color, case when held then 'registered' else 'skipped' end as status,
        case when held then regexp_replace(lower(concat_ws(' ', nullif(p_brand, ''), nullif(p_name, ''))), '[^\p{L}\p{N}]+', '_', 'g') || '.jpg' end as "imageFile",
        case when held then 'https://a.example/' || p_partkey end as "imageUrl", case when held then '' end as source, case when held then concat_ws(' ', nullif(p_brand, ''), nullif(p_name, ''), 'image search') end as "searchQuery",
        strftime(make_timestamp((1704164645678 + 1000 * p_partkey) * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') as "updatedAt", cast(0 as integer) as n_aliases
    from p"""

ORACLE_SQL: dict[str, str] = {
    "ref_status_shape": """
        select case when l.doc_id is null then 'skipped' else 'registered' end as status, count(*) as n_rows, count(l.quality) as n_quality, count(l.toxic) as n_toxic
        from documents d left join labels l on d.doc_id = l.doc_id group by 1""",
    "ref_slug": r"""
        select p_partkey, regexp_replace(lower(concat_ws(' ', nullif(p_brand, ''), nullif(p_name, ''), nullif(p_type, ''))), '[^\p{L}\p{N}]+', '_', 'g') || '.jpg' as image_file
        from part""",
    "ref_duplicate_key": "select l_orderkey, l_linenumber, count(*) as n_rows from lineitem group by all having count(*) > 1",
    "ref_shared_value": "select md5(text) as text_md5, count(*) as n_rows from documents where text is not null group by 1 having count(*) > 1",
    "ref_url_host": "select regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) as host, count(*) as n_pages from pages group by 1",
    "ref_url_leaf": r"""
        with u as (
            select page_id, case when regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]+([/?#]\S*)?$') then string_split(string_split(string_split(substr(url, strpos(url, '://') + 3), '#')[1], '?')[1], '/') end as p from pages
        )
        select page_id, case when len(p) = 1 then '' else p[len(p)] end as leaf from u""",
    "ref_iso_stamp": "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') as stamp from events",
    "ref_search_text": """
        select p_partkey, concat_ws(' ', case when p_type <> 'PROMO' then nullif(p_brand, '') end, nullif(p_name, ''), nullif(p_type, ''), 'image search') as query
        from part""",
    "ref_key_order": "select p_partkey, p_size, cast(row_number() over (order by p_brand, p_name, p_type, p_partkey) as bigint) as position from part",
    "ref_catalogue": CATALOGUE_SQL,
    "ref_catalogue_parts": CATALOGUE_SQL,
    "ref_json_strings": "select page_id, url, md5(html) as html_md5 from pages",
    "ref_anomalies": r"""
        select page_id, case when regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]+([/?#]\S*)?$') then regexp_matches(url, '^[^:]*://[^/?#]*/([^?#]*/)?([?#].*)?$') end as url_is_directory,
            length(replace(html, '(', '')) <> length(replace(html, ')', '')) or length(replace(html, '[', '')) <> length(replace(html, ']', '')) or length(replace(html, '【', '')) <> length(replace(html, '】', '')) as open_bracket
        from pages""",
}
