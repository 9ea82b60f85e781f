"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_tables: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir`` or the one set on the context. Only local mode falls back to a temporary folder; a cluster without one raises."""
    sc = spark.sparkContext
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not (found := sc._jsc.sc().getCheckpointDir()).isDefined():
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-checkpoint-"))
        found = sc._jsc.sc().getCheckpointDir()
    return found.get().rstrip("/")


def new_path(spark: SparkSession) -> str:
    """A path of its own in the shared folder. It is removed by ``release`` or when the program ends."""
    if not _tables:
        atexit.register(release)
    _tables.append((spark, f"{shared_folder(spark)}/tessera-{uuid.uuid4().hex}"))
    return _tables[-1][1]


def cut(df: DataFrame) -> DataFrame:
    """Write the rows as a compressed table in the shared folder and read them back: lineage ends there and lost executors cost nothing."""
    path = new_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """Remove the tables made so far. Call it in a long session when the results of earlier queries have been used."""
    while _tables:
        spark, path = _tables.pop()
        sc = spark.sparkContext
        if sc._jsc is not None:
            hadoop_path = sc._jvm.org.apache.hadoop.fs.Path(path)
            hadoop_path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(hadoop_path, True)
