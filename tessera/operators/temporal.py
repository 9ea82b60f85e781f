"""Joins on time: the last row before, and intervals that overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.rules import as_number
from tessera.sources.scratch import cut

#: Levels of bucket widths, each twice the last, beyond which intervals share the widest.
MOST_LEVELS = 40


def _packed(df: DataFrame) -> Column:
    return F.struct(*(F.col(f"`{c}`") for c in df.columns))


def asof_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, columns: dict[str, str], equal: bool = True) -> DataFrame:
    """Every left row with columns of the last right row of the same keys that is not later: ``columns`` maps right names to output names. Null if there is none.

    ``equal`` false: only right rows that are strictly earlier. Of right rows of one key and time, the same one counts in every run. Rows with a null key or time have no
    partner. Left rows that repeat are given each. An output named like a left column replaces it. Empty sides are fine.

    Both sides go into one table, dealt into ranges of key and time, so a key that many rows hold spans as many ranges as it needs. Inside a range the last right row is carried along; what a
    key's earlier ranges end with is carried over by one row a range at most.
    """
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(on)))
    carried = F.struct(F.lit(True).alias("found"), *(F.col(f"`{c}`").alias(f"v{i}") for i, c in enumerate(columns)))
    held = right.where(" and ".join(f"`{c}` is not null" for c in [*on, right_time])).select(key.alias("key"), F.col(f"`{right_time}`").alias("time"), F.lit(0 if equal else 2).alias("side"), carried.alias("carried"))
    tie = F.xxhash64(F.to_json("carried"))
    rows = left.select(key.alias("key"), F.col(f"`{left_time}`").alias("time"), F.lit(1).alias("side"), _packed(left).alias("row"))
    both = rows.unionByName(held.withColumn("tie", tie), allowMissingColumns=True)
    ranged = cut(both.repartitionByRange(n, "key", "time", "side", "tie").withColumn("range", F.spark_partition_id()))
    order = ["time", "side", "tie"]
    inside = F.last("carried", ignorenulls=True).over(Window.partitionBy("range", "key").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    ends = ranged.groupBy("key", "range").agg(F.max_by("carried", F.when(F.col("carried").isNotNull(), F.struct(*order))).alias("end"))
    earlier = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # a range begins inside one key at most, so this has no more rows than there are ranges
    over = ends.withColumn("over", F.last("end", ignorenulls=True).over(earlier)).where("over is not null").select("key", "range", "over")
    found = ranged.withColumn("inside", inside).where("row is not null").join(F.broadcast(over), ["key", "range"], "left").withColumn("found", F.coalesce("inside", "over"))
    own = [F.col("row")[c].alias(c) for c in left.columns if c not in columns.values()]
    return found.select(*own, *(F.col("found")[f"v{i}"].alias(c) for i, c in enumerate(columns.values())))


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], left_bounds: tuple[str, str], right_bounds: tuple[str, str]) -> DataFrame:
    """``left, right`` (the rows as structs) of all pairs with equal keys whose intervals, from the first bound up to but not including the second, have a point in common.

    Bounds are numbers, dates or times (as doubles, see ``rules.as_number``). An interval with a null bound, or that ends where or before it begins, has no points. Null keys match nothing.
    Rows that repeat are given each. ``on`` may be empty.

    Time is cut into buckets, whose width is the median length in the data; longer intervals use buckets of twice, four times and so on that width, so none lies in more
    than three buckets. An interval meets those of its own width and the shorter ones, which are also filed under each wider width that occurs; a pair is given in the bucket where the later of the two begins.
    """

    def prepared(df: DataFrame, bounds: tuple[str, str]) -> DataFrame:
        start, end = (as_number(df, c) for c in bounds)
        key = F.struct(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(on)))
        known = df.where(" and ".join(f"`{c}` is not null" for c in on)) if on else df
        return known.select(_packed(df).alias("row"), key.alias("key"), start.alias("start"), end.alias("end")).where("start < end")

    a, b = prepared(left, left_bounds), prepared(right, right_bounds)
    lengths = a.select((F.col("end") - F.col("start")).alias("n")).unionByName(b.select((F.col("end") - F.col("start")).alias("n")))
    width = float(lengths.agg(F.percentile_approx("n", 0.5, 1000)).first()[0] or 1.0)
    level = F.least(F.greatest(F.ceil(F.log2((F.col("end") - F.col("start")) / width)), F.lit(0)), F.lit(MOST_LEVELS)).cast("int")
    a, b = a.withColumn("level", level), b.withColumn("level", level)
    size = lambda lv: F.lit(width) * F.pow(F.lit(2.0), lv)
    bucket = lambda x, lv: F.floor(x / size(lv))

    def filed(df: DataFrame, at: Column) -> DataFrame:
        """Rows under each bucket that they touch, at each of the levels."""
        out = df.withColumn("at", F.explode(at))
        return out.withColumn("bucket", F.explode(F.sequence(bucket(F.col("start"), F.col("at")), bucket(F.col("end"), F.col("at")))))

    def levels(df: DataFrame) -> list[int]:
        return sorted(r["level"] for r in df.select("level").distinct().collect())  # MOST_LEVELS + 1 at most

    def met(wide: DataFrame, other: DataFrame, above: Column) -> DataFrame:
        """Pairs of intervals and those filed under their level."""
        one = filed(wide, F.array("level")).select("key", "at", "bucket", F.col("row").alias("r1"), F.col("start").alias("s1"), F.col("end").alias("e1"))
        two = filed(other, above).select("key", "at", "bucket", F.col("row").alias("r2"), F.col("start").alias("s2"), F.col("end").alias("e2"))
        pairs = one.join(two.hint("merge"), ["key", "at", "bucket"])
        return pairs.where((F.col("s1") < F.col("e2")) & (F.col("s2") < F.col("e1")) & (F.col("bucket") == bucket(F.greatest("s1", "s2"), F.col("at"))))

    given = lambda lv: F.array(*(F.lit(x) for x in lv)).cast("array<int>")
    shorter = met(a, b, F.filter(given(levels(a)), lambda x: x >= F.col("level")))
    longer = met(b, a, F.filter(given(levels(b)), lambda x: x > F.col("level")))
    return shorter.select(F.col("r1").alias("left"), F.col("r2").alias("right")).unionByName(longer.select(F.col("r2").alias("left"), F.col("r1").alias("right")))


