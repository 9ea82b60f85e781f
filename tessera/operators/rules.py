"""Which single column explains a flag: rules learned from mergeable count tables."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.scratch import cut


class Stretch(NamedTuple):
    """What a stretch of neighbouring values comes to: gain (flagged rows less others) and rows of all of it, of its best beginning, end and part.

    Of equal gains the part that begins first, and of these the one that ends first, is the best.
    """

    gain: int
    n: int
    head: tuple[int, float, int]  # gain, last value, rows
    tail: tuple[int, float, int]  # gain, first value, rows
    best: tuple[int, float, float, int]  # gain, first and last value, rows


def joined(a: Stretch, b: Stretch) -> Stretch:
    """Two stretches, one after the other. The order in which many are joined does not matter."""
    across = (a.tail[0] + b.head[0], a.tail[1], b.head[1], a.tail[2] + b.head[2])
    return Stretch(
        a.gain + b.gain,
        a.n + b.n,
        max(a.head, (a.gain + b.head[0], b.head[1], a.n + b.head[2]), key=lambda x: (x[0], -x[1])),
        max((a.tail[0] + b.gain, a.tail[1], a.tail[2] + b.n), b.tail, key=lambda x: (x[0], -x[1])),
        max(a.best, across, b.best, key=lambda x: (x[0], -x[1], -x[2])),
    )


def stretch(values: np.ndarray, flagged: np.ndarray, n: np.ndarray) -> Stretch:
    """The stretch of ascending values, at least one, each with its flagged rows and all its rows."""
    gains = 2 * flagged - n
    after, rows = np.cumsum(gains), np.cumsum(n)
    before, rows_before = after - gains, rows - n
    least = np.minimum.accumulate(before)
    first = np.maximum.accumulate(np.where(np.append(True, before[1:] < least[:-1]), np.arange(len(before)), 0))  # where the least sum so far stood first
    head, tail, best = int(np.argmax(after)), int(np.argmin(before)), int(np.argmax(after - least))
    begin = int(first[best])
    return Stretch(
        int(after[-1]), int(rows[-1]),
        (int(after[head]), float(values[head]), int(rows[head])),
        (int(after[-1] - before[tail]), float(values[tail]), int(rows[-1] - rows_before[tail])),
        (int(after[best] - least[best]), float(values[begin]), float(values[best]), int(rows[best] - rows_before[begin])),
    )


def as_number(df: DataFrame, column: str) -> Column:
    """A column as a double in its own order: microseconds for times, days for dates. Whole numbers beyond 2**53 lose digits. NaN is no number and is null."""
    kind, value = df.schema[column].dataType, F.col(f"`{column}`")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(value.cast("timestamp")).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("double")
    return F.nanvl(value.cast("double"), F.lit(None).cast("double"))


def _counts(df: DataFrame, flag: str, columns: list[Column], kind: str) -> DataFrame:
    """``at, value, n, flagged``: rows by the number of the column and value, in one pass for all columns; one row a task, column and value is moved."""
    held = F.array(*(F.struct(F.lit(i).alias("at"), c.cast(kind).alias("value")) for i, c in enumerate(columns)))
    rows = df.where(F.col(flag).isNotNull()).select(F.col(flag).cast("int").alias("flag"), F.explode(held).alias("x"))
    return rows.groupBy("x.at", "x.value").agg(F.count("*").alias("n"), F.sum("flag").alias("flagged"))


_STRETCH = "at int, part int, gain long, n long, head_gain long, head double, head_n long, tail_gain long, tail double, tail_n long, best_gain long, low double, high double, best_n long"


def _intervals(counts: DataFrame) -> dict[int, Stretch]:
    """By column: the stretch of all its values, from counts that lie sorted in ranges; each task joins its batches, the driver one row a range and column."""

    def flat(at: int, s: Stretch) -> tuple:
        return (at, TaskContext.get().partitionId(), s.gain, s.n, *s.head, *s.tail, *s.best)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Stretch] = {}
        for batch in batches:
            at, values, n, flagged = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            for own in np.unique(at).tolist():
                rows = at == own
                part = stretch(values[rows], flagged[rows], n[rows])
                found[own] = joined(found[own], part) if own in found else part
        columns = list(zip(*(flat(at, s) for at, s in sorted(found.items())))) or [[]] * 14
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], names=schema.names)

    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.strip().split(" ") for c in _STRETCH.split(","))])
    partitions = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(counts.where("value is not null")).select("at", "value", "n", "flagged").repartitionByRange(partitions, "at", "value").sortWithinPartitions("at", "value")
    out: dict[int, Stretch] = {}
    for r in sorted(ranged.mapInArrow(run, _STRETCH).collect(), key=lambda r: (r["at"], r["part"])):
        part = Stretch(r[2], r[3], tuple(r[4:7]), tuple(r[7:10]), tuple(r[10:14]))
        out[r["at"]] = joined(out[r["at"]], part) if r["at"] in out else part
    return out


RULE = "column string, kind string, low double, high double, n_values long, support long, errors long"


def best_rules(df: DataFrame, flag: str, values: list[str] = (), intervals: list[str] = ()) -> DataFrame:
    """One row a column: the rule on it that explains the flag (boolean) with the fewest errors.

    For ``values`` columns (kind ``values``) the rule is: flagged if the value is one of those, ``n_values`` of them, of whose rows more than half are flagged. For ``intervals``
    columns (numbers, dates, times; kind ``interval``): flagged if ``low <= value <= high``, as numbers (see ``as_number``); of equally good intervals the first. ``support`` counts the rows that
    the rule flags, ``errors`` those that it gets wrong. A column that explains the flag by chance shows as well as the true one: several rules without errors mean that the
    data can't tell.

    Null is a value like any other for ``values``, and in no interval. Rows with a null flag are left out. A column without any value in a row has no interval rule.
    """
    rows = []
    total = df.agg(F.coalesce(F.sum(F.col(flag).cast("int")), F.lit(0))).first()[0]
    if values:
        counts = _counts(df, flag, [F.col(f"`{c}`") for c in values], "string")
        says = F.col("flagged") * 2 > F.col("n")
        found = counts.groupBy("at").agg(F.count(F.when(says, 1)).alias("n_values"), F.coalesce(F.sum(F.when(says, F.col("n"))), F.lit(0)).alias("support"), F.sum(F.least(F.col("flagged"), F.col("n") - F.col("flagged"))).alias("errors"))
        rows += [(values[r["at"]], "values", None, None, r["n_values"], r["support"], r["errors"]) for r in sorted(found.collect())]
    if intervals:
        found_in = _intervals(_counts(df, flag, [as_number(df, c) for c in intervals], "double"))
        rows += [(intervals[at], "interval", s.best[1], s.best[2], None, s.best[3], total - s.best[0]) for at, s in sorted(found_in.items())]
    return df.sparkSession.createDataFrame(rows, RULE)


def decision_list(df: DataFrame, flag: str, values: list[str] = (), intervals: list[str] = (), steps: int = 5) -> DataFrame:
    """``step`` (int), ``column, kind, low, high, value, support, errors, left``: rules learned one after another, each on the rows that no rule before covers.

    A rule is one value of a ``values`` column, or an interval of an ``intervals`` column; the one with the most flagged rows less others comes next, of equal ones that of the first column. ``errors``
    counts the covered rows without the flag, ``left`` the flagged rows that no rule so far covers. The list ends after ``steps`` rules, or when no rule gains anything.
    """
    rest = cut(df.where(F.col(flag).isNotNull()).select(F.col(flag), *(F.col(f"`{c}`") for c in dict.fromkeys([*values, *intervals]))))
    out = []
    for step in range(1, steps + 1):
        found = []
        if values:
            counts = _counts(rest, flag, [F.col(f"`{c}`") for c in values], "string").withColumn("gain", 2 * F.col("flagged") - F.col("n"))
            best = counts.groupBy("at").agg(F.min(F.struct((-F.col("gain")).alias("loss"), "value", "n", "flagged")).alias("b")).select("at", "b.*")
            found += [(r["loss"], r["at"], values[r["at"]], "value", None, None, r["value"], r["n"], r["n"] - r["flagged"]) for r in best.collect()]
        if intervals:
            for at, s in _intervals(_counts(rest, flag, [as_number(rest, c) for c in intervals], "double")).items():
                gain, low, high, n = s.best
                found.append((-gain, len(values) + at, intervals[at], "interval", low, high, None, n, (n - gain) // 2))
        if not found or min(found, key=lambda x: x[:2])[0] >= 0:
            break
        _, _, column, kind, low, high, value, n, errors = min(found, key=lambda x: x[:2])
        covers = as_number(rest, column).between(low, high) if kind == "interval" else F.col(f"`{column}`").cast("string").eqNullSafe(F.lit(value))
        rest = rest.where(~F.coalesce(covers, F.lit(False)))
        left = rest.agg(F.coalesce(F.sum(F.col(flag).cast("int")), F.lit(0))).first()[0]
        out.append((step, column, kind, low, high, value, n, errors, left))
    return df.sparkSession.createDataFrame(out, "step int, column string, kind string, low double, high double, value string, support long, errors long, left long")
