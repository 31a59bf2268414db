"""Cutting lineage: write an intermediate table to the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local-mode session that names none (tests, notebooks) gets a temporary one: on a
    cluster a machine-local folder would be lost with its executor.
    """
    folder = spark.conf.get(_SETTING, None)
    if folder is None:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError(f"set {_SETTING} to a folder that all executors share")
        folder = _own_folder(spark.sparkContext.applicationId)
    return folder


@cache
def _own_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"cadenza-{application}-")


_OPEN_JOBS: list[list[str]] = []


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[list[str]]:
    """A job that owns the tables written below the shared folder meanwhile, and removes them at its end.

    Results are read from such tables, so write or collect them inside::

        with scratch_tables(spark):
            recommend_songs(like, play, user, song).write.parquet(path)
    """
    made: list[str] = []
    _OPEN_JOBS.append(made)
    try:
        yield made
    finally:
        _OPEN_JOBS.remove(made)
        for path in made:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; a ``scratch_tables`` job around it owns what is written there."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _OPEN_JOBS:
        _OPEN_JOBS[-1].append(path)
    return path


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Whatever is written meanwhile leaves no shuffle files behind.

    Without that they stay until the driver happens to collect its garbage, so the disk holds those of
    all tables written so far.
    """
    before = spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(_FREED) if before is None else spark.conf.set(_FREED, before)


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df``, to be joined by a shuffle whatever the size of its files.

    Parquet folds sorted ids to a small part of their size in memory, so a table of a row per user
    can look small enough for a broadcast, which gathers it in the driver. For tables that grow
    with the users or their ratings.
    """
    return df.hint("merge")


def spread(df: DataFrame, rows: int, per_task: int, *keys: str) -> DataFrame:
    """``df`` by ``keys`` in as many partitions as bound the ``rows`` that a task makes of it.

    Spark goes by the bytes it reads, so small rows that a join makes many of would all come to
    few tasks. Few rows are left to Spark.
    """
    if rows <= per_task:
        return df
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(usual, -(-rows // per_task)), *keys)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and go on from the written table; its shuffle files go.

    Against ``checkpoint()`` the Parquet form keeps column pruning, and its known size lets
    Spark decide by itself whether a later join side is small enough to broadcast.
    """
    path = scratch_path(df.sparkSession, name)
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
