"""Queries of operators beyond the surveyed data, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import ranking, temporal
from tessera.sources.tables import table
from tessera.streaming import sessions


def asof(spark: SparkSession, d: str) -> DataFrame:
    """Each purchase with its user's last click."""
    events = table(spark, d, "events")
    clicks = events.where("event_type = 'click'")
    out = temporal.asof_join(events.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), clicks, ["user_id"], "ts", "ts", {"event_id": "click_id", "value": "click_value"})
    return out.select("event_id", F.coalesce("click_id", F.lit(-1)).alias("click_id"), F.coalesce("click_value", F.lit(-1.0)).alias("click_value"))


def overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Purchases and errors of one user that overlap, if a purchase lasts as many minutes as its value, and an error two hours."""
    events = table(spark, d, "events")
    begin = F.unix_micros(F.col("ts").cast("timestamp"))
    one = events.where("event_type = 'purchase'").select("event_id", "user_id", begin.alias("a"), (begin + F.round(F.col("value") * 60_000_000).cast("long")).alias("b"))
    two = events.where("event_type = 'error'").select("event_id", "user_id", begin.alias("a"), (begin + 7_200_000_000).alias("b"))
    return temporal.overlap_join(one, two, ["user_id"], ("a", "b"), ("a", "b")).select(F.col("left.event_id").alias("purchase_id"), F.col("right.event_id").alias("error_id"))


def quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact quartiles of prices by return flag, and over all rows."""
    lines = table(spark, d, "lineitem").select(F.explode(F.array("l_returnflag", F.lit("all"))).alias("flag"), "l_extendedprice")
    return ranking.exact_quantiles(lines, ["flag"], "l_extendedprice", [0.25, 0.5, 0.75])


def best(spark: SparkSession, d: str) -> DataFrame:
    """The ten dearest orders of each priority."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return ranking.top_k(orders, ["o_orderpriority"], "o_totalprice", "o_orderkey", 10)


def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Users' sessions of events that arrive up to three hours late and out of order; none is later than the watermark."""
    events = table(spark, d, "events")
    at, jitter = F.unix_micros(F.col("ts").cast("timestamp")), 3 * 3600 * 10**6
    low, high = events.agg(F.min(at), F.max(at)).first()
    arrival = (at - (low or 0) + F.pmod(F.xxhash64("event_id"), F.lit(jitter))) / ((high or 0) - (low or 0) + jitter + 1)
    out = sessions.replayed(spark, events.withColumn("arrival", arrival), "user_id", "ts", 3_600_000, "4 hours", "arrival", 4)
    return out.select("user_id", F.unix_millis("start").alias("start_ms"), F.unix_millis("end").alias("end_ms"), "n_rows")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"ext_sessions": user_sessions, "ext_asof_join": asof, "ext_overlap_join": overlaps, "ext_exact_quantiles": quantiles, "ext_top_k": best}

ORACLE_SQL: dict[str, str] = {
    "ext_sessions": """
        with e as (
            select user_id, epoch_us(ts) // 1000 as ms from events
        ), f as (
            select user_id, ms, case when ms - lag(ms) over (partition by user_id order by ms) <= 3600000 then 0 else 1 end as fresh from e
        ), s as (
            select user_id, ms, sum(fresh) over (partition by user_id order by ms rows between unbounded preceding and current row) as s from f
        )
        select user_id, min(ms) as start_ms, max(ms) as end_ms, count(*) as n_rows from s group by user_id, s""",
    "ext_asof_join": """
        with p as (
            select * from events where event_type = 'purchase'
        ), c as (
            select * from events where event_type = 'click'
        ), j as (
            select p.event_id, c.event_id as click_id, c.value as click_value, row_number() over (partition by p.event_id order by c.ts desc) as r from p left join c on c.user_id = p.user_id and c.ts <= p.ts
        )
        select event_id, coalesce(click_id, -1) as click_id, coalesce(click_value, -1.0) as click_value from j where r = 1""",
    "ext_overlap_join": """
        with e as (
            select event_id, user_id, event_type, epoch_us(ts) as a, epoch_us(ts) + case when event_type = 'error' then 7200000000 else round(value * 60000000)::bigint end as b from events
        )
        select p.event_id as purchase_id, x.event_id as error_id from e p join e x on p.user_id = x.user_id and p.a < x.b and x.a < p.b
        where p.event_type = 'purchase' and x.event_type = 'error' and p.a < p.b and x.a < x.b""",
    "ext_exact_quantiles": """
        with l as (
            select l_returnflag as flag, l_extendedprice as x from lineitem union all select 'all', l_extendedprice from lineitem
        ), r as (
            select flag, x, row_number() over (partition by flag order by x) as r, count(*) over (partition by flag) as n from l
        ), f as (
            select unnest([0.25::double, 0.5::double, 0.75::double]) as fraction
        )
        select flag, fraction, x as value, n from r join f on r.r = greatest(ceil(f.fraction * r.n), 1)""",
    "ext_top_k": """
        select o_orderkey, o_orderpriority, o_totalprice, r::integer as rank
        from (select *, row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) as r from orders) where r <= 10""",
}
