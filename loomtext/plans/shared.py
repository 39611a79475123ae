"""What long plans share: tables written to the cluster's shared folder, checked broadcasts, worker paths."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session. Only where that is unset and everything
    runs on this machine (as in tests) a temporary folder is made; elsewhere it is an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = sc._jsc.sc().getCheckpointDir()
        named = held.get() if held.isDefined() else None
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        named = "file://" + tempfile.mkdtemp(prefix="loomtext-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which ``release`` deletes."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there, so a lost executor costs at most
    the stage that reads it. The files go with ``discard``, with ``release``, at the end of ``tables_released`` or when the
    driver ends."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._written_at = path
    return back


def _delete(spark: SparkSession, path: str) -> None:
    _written.remove((spark, path))
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session may be gone already
        pass


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``materialize`` returned and that nothing reads any more."""
    for df in tables:
        if (df.sparkSession, df._written_at) in _written:
            _delete(df.sparkSession, df._written_at)


def release(spark: SparkSession | None = None, keep: int = 0) -> None:
    """Delete what was written to the shared folder, but for the first ``keep`` paths; no DataFrame that reads the rest may
    be used afterwards."""
    for owner, path in _written[keep:]:
        if spark is None or owner is spark:
            _delete(owner, path)


@contextmanager
def tables_released(spark: SparkSession) -> Iterator[None]:
    """What is written to the shared folder within the block is deleted at its end: run a query and save its rows in it."""
    keep = len(_written)
    try:
        yield
    finally:
        release(spark, keep)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What a query of the block shuffles is deleted when the query ends (from Spark 4.1 on), not whenever the driver happens to
    collect its garbage: for loops of queries, each of which shuffles as much again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


atexit.register(release)


#: Rows of a table of classes or clusters that is broadcast, at most.
FEW = 100_000


def small(df: DataFrame, rows: int = FEW) -> DataFrame:
    """``df`` with a broadcast hint when it has at most ``rows`` rows (counted), else as it is, for a shuffled join.
    Meant for narrow, materialised tables."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Partitions of a table that is spread, at most: more of them are parallel enough.
SPREAD = 32


def spread(df: DataFrame) -> DataFrame:
    """``df``, shuffled into as many partitions as there are cores where it has not half as many and ``SPREAD`` at most: a
    small table in one row group would else be worked on by a single task. Larger tables are left as they are."""
    cores, parts = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df.repartition(cores) if 2 * parts <= cores and parts <= SPREAD else df


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it. On clusters whose machines don't share
    that path, pass the package with ``--py-files`` instead."""
    here = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if here not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (here, env.get("PYTHONPATH", "")) if x)
