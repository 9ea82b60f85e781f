"""Queries on what tables' data say about themselves, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations, permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import discovery, fuzzy, quality, rules
from tessera.operators.profile import profile
from tessera.sources.tables import table

_TITLE = "<title>([^<]*)</title>"


def near_words(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of words within two edits, over all words of part names, URLs and titles."""
    pages = table(spark, d, "pages")
    texts = table(spark, d, "part").select(F.col("p_name").alias("x")).unionByName(pages.select(F.col("url").alias("x"))).unionByName(pages.select(F.regexp_extract("html", _TITLE, 1).alias("x")))
    return fuzzy.near_pairs(texts.select(F.explode(F.regexp_extract_all(F.lower("x"), F.lit("[a-z]{4,}"), F.lit(0))).alias("word")), "word", 2)


def path_spelling(spark: SparkSession, d: str) -> DataFrame:
    """Titles of pages against the pages' own URLs."""
    title = F.regexp_replace(F.regexp_extract("html", _TITLE, 1), "[^a-zA-Z]+", " ")
    out = fuzzy.path_spelling(table(spark, d, "pages").select("page_id", "url", title.alias("title")), "title", "url", least=3)
    return out.where("spelling is not null").select("page_id", "spelling.*")


#: Columns whose sets are tried, by table.
KEY_COLUMNS = {"part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate"]}
MOST = 4


def minimal_keys(spark: SparkSession, d: str) -> DataFrame:
    parts = [discovery.minimal_keys(table(spark, d, t), columns, MOST).select(F.lit(t).alias("table_name"), F.array_join("key", ",").alias("key"), "n_columns") for t, columns in KEY_COLUMNS.items()]
    return reduce(DataFrame.unionByName, parts)


ORDER_COLUMNS, LONGEST = ["p_brand", "p_name", "p_type", "p_size"], 3


def ascending_lists(spark: SparkSession, d: str) -> DataFrame:
    """By which lists parts ascend that were put in order by brand, name, type and number."""
    placed = quality.key_order(table(spark, d, "part").select(*ORDER_COLUMNS, "p_partkey"), ["p_brand", "p_name", "p_type", "p_partkey"])
    return discovery.ascending_lists(placed, "position", ORDER_COLUMNS, LONGEST).select(F.array_join("columns", ",").alias("columns"), "n_ties")


#: Events that a type, users and a stretch of time make up, so that no column explains them alone.
FLAG = "event_type = 'purchase' and user_id < 100 or ts >= timestamp '2024-01-10 00:00:00' and ts < timestamp '2024-01-14 00:00:00'"


def best_rules(spark: SparkSession, d: str) -> DataFrame:
    flagged = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("flag", F.expr(FLAG))
    found = rules.best_rules(flagged, "flag", ["event_type", "user_id"], ["ts", "user_id", "value"])
    return found.fillna({"low": 0.0, "high": 0.0, "n_values": 0})


TABLES = {
    "region": "r_regionkey r_name*", "nation": "n_nationkey n_name* n_regionkey", "customer": "c_custkey c_name* c_nationkey c_acctbal c_mktsegment*", "supplier": "s_suppkey s_name* s_nationkey s_acctbal",
    "part": "p_partkey p_name* p_brand* p_type* p_size p_retailprice", "orders": "o_orderkey o_custkey o_orderstatus* o_totalprice o_orderdate o_orderpriority*",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag* l_linestatus* l_shipdate", "events": "event_id ts user_id event_type* value props*",
    "documents": "doc_id text* lang* source* n_chars", "embeddings": "vec_id embedding label", "pages": "page_id url* html*", "benchmark": "item_id text*", "labels": "doc_id quality toxic", "conversations": "conv_id turn role* text*",
}


def column_profile(spark: SparkSession, d: str) -> DataFrame:
    """The exact part of the profile of every table; texts' bounds too."""
    text = lambda c: F.when(F.col("kind") == "string", F.col(c)).alias(c)
    parts = [profile(table(spark, d, t), distinct=False).select(F.lit(t).alias("table_name"), F.col("column").alias("column_name"), "n", "n_null", "n_blank", "placeholder", *(F.coalesce(c, F.lit(-1)).alias(c) for c in ("shortest", "longest")), text("low"), text("high")) for t in TABLES]
    return reduce(DataFrame.unionByName, parts)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "ref_near_words": near_words, "ref_path_spelling": path_spelling, "ref_minimal_keys": minimal_keys, "ref_ascending_lists": ascending_lists, "ref_best_rules": best_rules, "ref_column_profile": column_profile,
}


def _keys_sql() -> str:
    rows = []
    for t, columns in KEY_COLUMNS.items():
        for k in range(1, MOST + 1):
            for own in combinations(range(len(columns)), k):
                names = ", ".join(columns[i] for i in own)
                rows.append(f"select '{t}' as table_name, '{names.replace(', ', ',')}' as key, {k} as n_columns, {sum(1 << i for i in own)} as m, (select count(*) from (select distinct {names} from {t})) = (select count(*) from {t}) as one")
    return f"with s as materialized ({' union all '.join(rows)}) select table_name, key, n_columns::integer as n_columns from s where one and not exists (select 1 from s x where x.one and x.table_name = s.table_name and x.m <> s.m and (x.m & s.m) = x.m)"


def _lists_sql() -> str:
    """Every list is checked against the row before; lists whose beginning has no ties are left out."""
    before = "p as (select *, row_number() over (order by p_brand, p_name, p_type, p_partkey) as position from part), b as (select " + ", ".join(f"{c}, lag({c}) over (order by position) as b_{c}" for c in ORDER_COLUMNS) + ", position from p)"
    rows = []
    for k in range(1, LONGEST + 1):
        for own in permutations(ORDER_COLUMNS, k):
            lower = reduce(lambda rest, c: f"(b_{c} > {c} or b_{c} = {c} and {rest})", reversed(own[:-1]), f"b_{own[-1]} > {own[-1]}")
            rows.append(f"select '{','.join(own)}' as columns, count(*) filter (where {lower}) as descents, count(*) filter (where {' and '.join(f'b_{c} = {c}' for c in own)}) as n_ties from b where position > 1")
    return f"with {before}, s as materialized ({' union all '.join(rows)}) select columns, n_ties from s where descents = 0 and not exists (select 1 from s x where x.n_ties = 0 and x.descents = 0 and starts_with(s.columns, x.columns || ','))"


def _rules_sql() -> str:
    values = [f"select '{c}' as \"column\", 'values' as kind, 0::double as low, 0::double as high, count(*) filter (where 2 * f > n) as n_values, coalesce(sum(n) filter (where 2 * f > n), 0)::bigint as support, sum(least(f, n - f))::bigint as errors from (select {c}, count(*) as n, count(*) filter (where flag) as f from e group by {c})" for c in ("event_type", "user_id")]
    intervals = []
    for c in ("ts", "user_id", "value"):
        number = "epoch_us(ts)::double" if c == "ts" else f"{c}::double"
        intervals.append(f"""select '{c}', 'interval', low, high, 0::bigint, rows_after - rows_before, ((select count(*) from e where flag) - gain)::bigint from (
            select *, after - least_before as gain from (
                select v as high, after, rows_after, min(before) over w as least_before, first_value(v) over (partition by least order by v) as low, first_value(rows_before) over (partition by least order by v) as rows_before from (
                    select *, min(before) over (order by v rows between unbounded preceding and current row) as least from (
                        select v, sum(g) over (order by v) as after, sum(g) over (order by v) - g as before, sum(n) over (order by v)::bigint as rows_after, (sum(n) over (order by v) - n)::bigint as rows_before from (select {number} as v, count(*) as n, 2 * count(*) filter (where flag) - count(*) as g from e group by 1)
                    )
                ) window w as (order by v rows between unbounded preceding and current row)
            ) order by gain desc, low, high limit 1)""")
    return f"with e as materialized (select *, {FLAG} as flag from events) {' union all '.join(values)} union all " + " union all ".join(f"select * from ({x})" for x in intervals)


def _profile_sql() -> str:
    rows = []
    for t, columns in TABLES.items():
        for c in columns.split():
            name, text = c.rstrip("*"), c.endswith("*")
            blank = f"trim({name}) = ''" if text else (f"len({name}) = 0" if name == "embedding" else "false")
            bounds = f"coalesce(min(length({name})), -1)::integer as shortest, coalesce(max(length({name})), -1)::integer as longest, min({name}) as low, max({name}) as high" if text else "-1 as shortest, -1 as longest, null::varchar as low, null::varchar as high"
            rows.append(f"select '{t}' as table_name, '{name}' as column_name, count(*) as n, count(*) filter (where {name} is null) as n_null, count(*) filter (where {blank}) as n_blank, {bounds} from {t}")
    return f"select table_name, column_name, n, n_null, n_blank, n > 0 and n_null + n_blank = n as placeholder, shortest, longest, low, high from ({' union all '.join(rows)})"


ORACLE_SQL: dict[str, str] = {
    "ref_near_words": rf"""
        with w as materialized (
            select distinct unnest(regexp_extract_all(lower(x), '[a-z]{{4,}}')) as w from (select p_name as x from part union all select url from pages union all select regexp_extract(html, '{_TITLE}', 1) from pages)
        )
        select a.w as left_word, b.w as right_word, levenshtein(a.w, b.w)::integer as distance from w a join w b on a.w < b.w and abs(length(a.w) - length(b.w)) <= 2 where levenshtein(a.w, b.w) <= 2""",
    "ref_path_spelling": rf"""
        with t as (
            select page_id, list_distinct(regexp_extract_all(lower(regexp_extract(html, '{_TITLE}', 1)), '[a-z]+')) as names, list_distinct(regexp_extract_all(lower(regexp_extract(url, '://([^?#]*)', 1)), '[a-z]+')) as words from pages
        ), a as (
            select page_id, words, unnest(names) as name_word from t
        ), b as (
            select page_id, name_word, unnest(words) as url_word from a where length(name_word) >= 3 and not list_contains(words, name_word)
        ), c as (
            select *, levenshtein(name_word, url_word) as distance from b where length(url_word) >= 3
        )
        select page_id, name_word, url_word, distance::integer as distance from c where distance between 1 and 2 qualify row_number() over (partition by page_id order by distance, name_word, url_word) = 1""",
    "ref_minimal_keys": _keys_sql(),
    "ref_ascending_lists": _lists_sql(),
    "ref_best_rules": _rules_sql(),
    "ref_column_profile": _profile_sql(),
}
