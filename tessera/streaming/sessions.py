"""Sessions of a stream whose rows come late and out of order, held in state until the watermark has passed them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.sources.scratch import new_path

_STATE = "starts array<long>, ends array<long>, sizes array<long>"


def merged(sessions: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """Sessions (first and last time, rows) in order, those not more than ``gap`` apart put together."""
    out: list[tuple[int, int, int]] = []
    for start, end, n in sorted(sessions):
        if out and start - out[-1][1] <= gap:
            out[-1] = (out[-1][0], max(out[-1][1], end), out[-1][2] + n)
        else:
            out.append((start, end, n))
    return out


def _schema(key: str, kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(key, kind), T.StructField("start", T.TimestampType()), T.StructField("end", T.TimestampType()), T.StructField("n_rows", T.LongType())])


def sessions(stream: DataFrame, key: str, ts: str, gap_ms: int, lateness: str) -> DataFrame:
    """``key, start, end`` (timestamps), ``n_rows`` of each session: rows of a key with no gap over ``gap_ms`` between neighbours. For output mode ``append``.

    State holds a key's open sessions only, as three numbers each, and merges them as rows come in any order. A timer of event time closes those that no row can reach any more, once
    the watermark, ``lateness`` behind the newest row of the batches before, is past their end and the gap. A row behind the watermark is too late: it is in no session, and is
    counted in a row without ``start`` and ``end``. Times count in whole milliseconds. Rows with a null time are left out; those with a null key only move the watermark. Sessions that
    are still open when the stream ends are not given.
    """
    kind = stream.schema[key].dataType

    def update(who: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, late, now = (list(zip(*state.get)) if state.exists else []), 0, state.getCurrentWatermarkMs()
        for batch in batches:
            times = batch["ms"].to_numpy()
            late += int((times < now).sum())
            held = merged([*held, *((int(t), int(t), 1) for t in times[times >= now])], gap_ms)
        if pd.isna(who[0]):
            return
        done = [s for s in held if s[1] + gap_ms < now]
        open_ = [s for s in held if s[1] + gap_ms >= now]
        if open_:
            state.update(tuple(list(c) for c in zip(*open_)))
            state.setTimeoutTimestamp(max(now, min(s[1] for s in open_) + gap_ms) + 1)
        elif state.exists:
            state.remove()
        rows = [(who[0], pd.Timestamp(a, unit="ms", tz="UTC"), pd.Timestamp(b, unit="ms", tz="UTC"), n) for a, b, n in done] + ([(who[0], pd.NaT, pd.NaT, late)] if late else [])
        if rows:
            out = pd.DataFrame(rows, columns=[key, "start", "end", "n_rows"])
            yield out.assign(start=pd.to_datetime(out["start"], utc=True), end=pd.to_datetime(out["end"], utc=True))

    rows = stream.where(F.col(ts).isNotNull()).withWatermark(ts, lateness)
    rows = rows.select(key, ts, F.unix_millis(F.col(ts).cast("timestamp")).alias("ms"))
    return rows.groupBy(key).applyInPandasWithState(update, _schema(key, kind), _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def replayed(spark: SparkSession, rows: DataFrame, key: str, ts: str, gap_ms: int, lateness: str, arrival: str, slices: int) -> DataFrame:
    """The sessions, and counts of late rows, of a table that is played as a stream: rows arrive in order of the column ``arrival`` (0 up to 1), one of ``slices`` files after another.

    A last row, with a null key, moves the watermark past all sessions, so that none stays open.
    """
    source, sink, check = (new_path(spark) for _ in range(3))
    own = rows.select(key, F.col(ts).cast("timestamp").alias(ts), F.col(arrival).alias("arrival"))
    for i in range(slices):  # one write a slice: the file source plays files in order of their time
        part = own.where((F.col("arrival") >= i / slices) & (F.col("arrival") < (i + 1) / slices)).drop("arrival")
        part.coalesce(1).write.mode("append").parquet(source)
    last = own.agg(F.max(ts).alias(ts)).select(F.lit(None).cast(own.schema[key].dataType).alias(key), (F.col(ts) + F.expr(f"interval {lateness}") + F.expr(f"interval {gap_ms + 60_000} milliseconds")).alias(ts))
    last.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(own.drop("arrival").schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = sessions(stream, key, ts, gap_ms, lateness).writeStream.format("parquet").option("path", sink).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(_schema(key, own.schema[key].dataType)).parquet(sink)
