"""Session settings, table reading and lineage cuts shared by all queries."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_TABLES: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of one data directory."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the one named in ``spark.checkpoint.dir``.

    Only a local master may leave it unset; a folder of this process is used then.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix=f"ckpt-{os.getpid()}-"))
    return sc._jsc.sc().getCheckpointDir().get()


@contextlib.contextmanager
def _shuffles_cleaned(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of each query run inside, as soon as the query has ended."""
    was = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, was)


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` by a compressed table in the shared folder; its shuffle files go once it is written.

    The table is deleted by :func:`discard`, or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    with _shuffles_cleaned(spark):
        df.write.parquet(path)
    if not _TABLES:
        atexit.register(_discard_all, spark)
    _TABLES.add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the tables of stored frames that nothing will read any more."""
    for df in frames:
        path = df.__dict__.get("_table")
        if path in _TABLES:
            _TABLES.discard(path)
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _discard_all(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        for path in _TABLES:
            _delete(spark, path)


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage of ``df`` with a checkpoint in the folder all executors share."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager)


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "20g") -> SparkSession:
    """A one-machine session with the settings the tests and the benchmark use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("rankloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
