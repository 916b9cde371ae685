"""Session helpers: table access and the shared folder for checkpoints."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)

#: Spark's setting by which a query's shuffle files go when the query ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Rows of one task, about, where tasks() tells how many there are.
TASK_ROWS = 250_000

#: Tasks of one turn, at most, where a query takes its rows in turns.
TURN_TASKS = 128

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Open one of the Parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(rows: DataFrame) -> int:
    """Tasks to deal the rows of a table to: they grow with the rows, so that the memory of one does not. Parquet files tell their rows without being read."""
    return max(1, -(-rows.count() // TASK_ROWS))


def dealt(rows: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """Rows dealt out by the keys, to ``parts`` tasks if told."""
    return rows.repartition(parts, *keys) if parts else rows.repartition(*keys)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the folder that ``spark.checkpoint.dir`` names.

    A cluster sets it to storage that the driver and all executors share, and gets an error where it is
    unset. In local mode, as in tests, a temporary folder is used then.
    """
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if found is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tallyforge-"))
        found = sc.getCheckpointDir()
    return found


@contextmanager
def tidied(spark: SparkSession):
    """Inside the block a query's shuffle files go when the query ends, as else they stay until the driver
    happens to collect its garbage: a stage of a hundred small queries would hold those of all of them.

    So run no DataFrame twice in it; its shuffles would be made again.
    """
    cleanup = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if cleanup is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, cleanup)


@contextmanager
def scratch(spark: SparkSession):
    """A folder for what written() writes inside the block, tidied(); it goes at the end, so keep results by checkpoint()."""
    top = f"{ensure_checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}"
    before = _scratch.set(top)
    try:
        with tidied(spark):
            yield top
    finally:
        _scratch.reset(before)
        path = spark._jvm.org.apache.hadoop.fs.Path(top)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def turns(parts: int) -> int:
    """Turns in which to take the rows of so many tasks."""
    return max(1, -(-parts // TURN_TASKS))


def in_turns(rows: DataFrame, key: str, n: int) -> list[DataFrame]:
    """The rows in turns by their key, so that the shuffle files of one turn are all that is there at a time."""
    # Another hash than the one that deals rows to tasks: by the same one a turn's rows would leave most tasks idle.
    return [rows.where(F.pmod(F.xxhash64(key), F.lit(n)) == k) for k in range(n)] if n > 1 else [rows]


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts lineage, and a lost executor loses nothing. ``keep`` leaves it there after scratch()."""
    top = (None if keep else _scratch.get()) or ensure_checkpoint_dir(df.sparkSession)
    path = f"{top}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package when it isn't installed on the executors' path."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
