"""The registered queries of the operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, divergence, exact, language, line_dedup, manifest, minhash, mixing, packing, parsing, search, suffix_dedup, toxicity
from tessera.llm.common import documents, remainder


def op1_divergence(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).select("doc_id", "text", "lang")
    out = divergence.judge(docs, divergence.references(docs), lang_col="lang")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "word_js", "class_js", "pooled_js")


def op2_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixing.score(documents(spark, d).select("doc_id", "text").withColumn("held_out", remainder("doc_id", 7) == 2))


def op3_bpe(spark: SparkSession, d: str) -> DataFrame:
    files = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bpe.encode(documents(spark, d).select("doc_id", "text"), *files, decoded="decoded", keep_text=False)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_minhash(spark: SparkSession, d: str) -> DataFrame:
    out = minhash.components_of(documents(spark, d).select("doc_id", "text"), words=3, percent=85)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def op5_parsing(spark: SparkSession, d: str) -> DataFrame:
    return parsing.compare_neighbours(documents(spark, d).select("doc_id", "text")).withColumnRenamed("id", "doc_id")


def op6_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    out = line_dedup.dedup_lines(documents(spark, d).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).select("doc_id", "text")
    labels = spark.read.parquet(f"{d}/labels.parquet").where(remainder("doc_id", 4) != 2)
    score = toxicity.scorer(toxicity.fit(docs, labels))
    out = docs.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op8_suffix_dedup(spark: SparkSession, d: str) -> DataFrame:
    out = suffix_dedup.dedup_substrings(documents(spark, d).select("doc_id", "text"))
    return out.select("doc_id", "dedup.n_bytes", "dedup.n_removed", "dedup.n_spans", F.sha2("dedup.kept", 256).alias("kept_sha256"))


def op9_packing(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).select("doc_id", "text")
    out = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op10_language_id(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).select("doc_id", "text", "lang").withColumn("held_out", remainder("doc_id", 4) == 2)
    out = language.identify(docs, docs.where("not held_out"))
    return out.select("doc_id", "held_out", "language.lang_pred", "language.score", "language.languages", "language.shares")


def op11_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return exact.groups_of(documents(spark, d).select("doc_id", "text")).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op12_search(spark: SparkSession, d: str) -> DataFrame:
    return search.search(search.build(documents(spark, d)), spark.read.parquet(f"{d}/benchmark.parquet"))


def op13_manifest(spark: SparkSession, d: str) -> DataFrame:
    tampered = {"text": F.when(remainder("doc_id", 2) == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}
    return manifest.manifest(documents(spark, d), tampered=tampered).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_divergence": op1_divergence, "op2_mixing": op2_mixing, "op3_bpe": op3_bpe, "op4_minhash": op4_minhash, "op5_parsing": op5_parsing, "op6_line_dedup": op6_line_dedup, "op7_toxicity": op7_toxicity, "op8_suffix_dedup": op8_suffix_dedup, "op9_packing": op9_packing, "op10_language_id": op10_language_id,
    "op11_exact_dedup": op11_exact_dedup, "op12_search": op12_search, "op13_manifest": op13_manifest,
}

ORACLE_SQL: dict[str, str] = {
    "op4_minhash": r"""
        with recursive w as materialized (
            select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
            from documents
        ), s as materialized (
            select distinct doc_id, unnest(case when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as g
            from w where len(w) > 0
        ), n as materialized (
            select doc_id, count(*) as n from s group by doc_id
        ), p as materialized (
            select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all
        ), l as materialized (
            select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 85 * (a.n + b.n - c)
        ), r as (
            select doc_id as a, doc_id as b from documents union select r.a, l.y from r join l on r.b = l.x
        ), c as (
            select a as doc_id, min(b) as component_id from r group by a
        )
        select d.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id, d.doc_id = c.component_id as kept
        from documents d join c on c.doc_id = d.doc_id left join n on n.doc_id = d.doc_id""",
    "op8_suffix_dedup": r"""
        with h as materialized (
            select doc_id, hex(encode(coalesce(text, ''))) as x, octet_length(encode(coalesce(text, ''))) as n from documents
        ), w as materialized (
            select doc_id, p, md5(substr(x, 2 * p + 1, 800)) as k from (select doc_id, x, unnest(range(0, n - 399)) as p from h where n >= 400)
        ), d as (
            select doc_id, p from w where k in (select k from w group by k having count(*) > 1)
        ), e as (
            select doc_id, p, case when p <= lag(p) over (partition by doc_id order by p) + 400 then 0 else 1 end as fresh from d
        ), f as (
            select doc_id, p, sum(fresh) over (partition by doc_id order by p) as run from e
        ), r as materialized (
            select doc_id, run, min(p) as a, max(p) + 400 as b from f group by doc_id, run
        ), k as (
            select doc_id, a as place, coalesce(lag(b) over (partition by doc_id order by a), 0) as since, a as until from r
            union all select h.doc_id, h.n, coalesce(m.b, 0), h.n from h left join (select doc_id, max(b) as b from r group by doc_id) m on m.doc_id = h.doc_id
        ), t as (
            select k.doc_id, string_agg(substr(h.x, 2 * since + 1, 2 * (until - since)), '' order by place) as kept from k join h on h.doc_id = k.doc_id group by k.doc_id
        ), s as (
            select doc_id, sum(b - a) as removed, count(*) as spans from r group by doc_id
        )
        select h.doc_id, cast(h.n as bigint) as n_bytes, cast(coalesce(s.removed, 0) as bigint) as n_removed, coalesce(s.spans, 0) as n_spans, sha256(unhex(t.kept)) as kept_sha256
        from h join t on t.doc_id = h.doc_id left join s on s.doc_id = h.doc_id""",
    "op6_line_dedup": r"""
        with l as (
            select doc_id, unnest(range(1, len(a) + 1)) as i, unnest(a) as line
            from (select doc_id, string_split(coalesce(text, ''), chr(10)) as a from documents)
        ), k as (
            select doc_id, i, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
            from l
        ), c as (
            select key, max(doc_id) as keeper from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5
        ), f as (
            select k.doc_id, k.i, k.line, c.keeper is not null and k.doc_id <> c.keeper as gone from k left join c on k.key = c.key
        )
        select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
            sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
        from f group by doc_id""",
    "op11_exact_dedup": """
        with t as materialized (
            select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents
        ), g as (
            select t, max(doc_id) as keep_id, count(*) as group_size from t group by t
        )
        select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept, sha256(t.t) as text_sha256 from t join g on t.t = g.t""",
    "op12_search": r"""
        with t as materialized (
            select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents
        ), p as materialized (
            select doc_id, term, count(*) as tf from t group by doc_id, term
        ), n as (
            select doc_id, sum(tf)::bigint as n from p group by doc_id
        ), a as (
            select count(*) as docs, sum(n)::bigint as terms from n
        ), d as (
            select term, count(*) as df from p group by term
        ), w as (
            select term, floor(1000 * ln((2.0::double * a.docs + 2) / (2 * d.df + 1)))::bigint as w from d, a
        ), m as (
            select doc_id, 100 - 50 + (50 * n.n * a.docs) // a.terms as m from n, a
        ), q as (
            select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark
        ), s as (
            select q.item_id, p.doc_id, sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * m.m)))::bigint as score
            from q join p on p.term = q.term join w on w.term = q.term join m on m.doc_id = p.doc_id group by q.item_id, p.doc_id
        ), r as (
            select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::integer as rank, doc_id, score from s where score > 0
        )
        select item_id, rank, doc_id, score from r where rank <= 50""",
    # crc32 is spelled out, eight steps a byte
    "op13_manifest": """
        with recursive d as materialized (
            select doc_id, source,
                case when doc_id is null then '-' else octet_length(encode(doc_id::varchar)) || ':' || doc_id end
                || case when source is null then '-' else octet_length(encode(source)) || ':' || source end
                || case when lang is null then '-' else octet_length(encode(lang)) || ':' || lang end
                || case when n_chars is null then '-' else octet_length(encode(n_chars::varchar)) || ':' || n_chars end as head,
                text, replace(text, chr(10), '') as bare
            from documents
        ), l as materialized (
            select doc_id, xor(4294967295::bigint, list_reduce([4294967295::bigint] || flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1])), lambda a, x: case when x >= 0 then xor(a, x) else xor(a >> 1, (a & 1) * 3988292384) end)) % 2 as odd, coalesce('1' || hex(encode(source)), '0') as s,
                sha256(head || case when text is null then '-' else octet_length(encode(text)) || ':' || text end) as leaf,
                sha256(head || case when text is null then '-' else octet_length(encode(bare)) || ':' || bare end) as bare
            from d
        ), r as materialized (
            select *, row_number() over (partition by s order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by s) as n from l
        ), up as (
            select s, 0 as level, i, n, leaf as node from r
            union all
            select s, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(node, '' order by i)) from up where n > 1 group by s, level, i // 3, n
        ), tops as materialized (
            select s, node as subroot, row_number() over (order by s) - 1 as i, count(*) over () as n from up where n = 1
        ), over_ as (
            select 0 as level, i, n, subroot as node from tops
            union all
            select level + 1, i // 3, (n + 2) // 3, sha256(string_agg(node, '' order by i)) from over_ where n > 1 group by level, i // 3, n
        ), a as materialized (
            select s, level, i, n, coalesce(string_agg(node, '') over (w rows between unbounded preceding and 1 preceding), '') as lo, coalesce(string_agg(node, '') over (w rows between 1 following and unbounded following), '') as hi
            from up window w as (partition by s, level, i // 3 order by i)
        ), b as materialized (
            select level, i, n, node, coalesce(string_agg(node, '') over (w rows between unbounded preceding and 1 preceding), '') as lo, coalesce(string_agg(node, '') over (w rows between 1 following and unbounded following), '') as hi
            from over_ window w as (partition by level, i // 3 order by i)
        ), f as (
            select doc_id, s, 0 as level, i, n, leaf, case when odd = 0 then bare else leaf end as node, '' as proof from r
            union all
            select f.doc_id, f.s, f.level + 1, f.i // 3, (f.n + 2) // 3, f.leaf, sha256(a.lo || f.node || a.hi), f.proof || a.lo || a.hi from f join a on a.s = f.s and a.level = f.level and a.i = f.i where f.n > 1
        ), g as (
            select f.doc_id, f.leaf, t.subroot, 0 as level, t.i, t.n, f.node, f.proof from f join tops t on t.s = f.s where f.n = 1
            union all
            select g.doc_id, g.leaf, g.subroot, g.level + 1, g.i // 3, (g.n + 2) // 3, sha256(b.lo || g.node || b.hi), g.proof || b.lo || b.hi from g join b on b.level = g.level and b.i = g.i where g.n > 1
        )
        select g.doc_id, g.leaf, g.subroot, o.node as root, sha256(g.proof) as proof_sha256, g.node as folded_root, g.node = o.node as verified from g, over_ o where g.n = 1 and o.n = 1""",
}
