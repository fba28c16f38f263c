"""Session set-up and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "feedback-rank", **conf: str) -> SparkSession:
    """A session with the settings the library is written for.

    ``conf`` keys use double underscores for dots, e.g.
    ``spark__sql__shuffle__partitions="8"``.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder and sc.getCheckpointDir():
        # set by the application through SparkContext.setCheckpointDir
        folder = sc.getCheckpointDir()
    if not folder:
        if not _is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="feedback-rank-")
        sc.setCheckpointDir(folder)
    elif folder.startswith("file:") and not _is_local(spark):
        raise ValueError(f"spark.checkpoint.dir is {folder}, which other machines cannot reach")
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """While plans are made: their shuffle files go as soon as they have run, not when the driver collects its garbage. Plans keep this, the session does not."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, "false")
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from there.

    Unlike a cached frame the rows stay the same, and stay available, when an
    executor is lost.
    """
    shared_dir(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder for a table written on the way."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, path: str, mode: str = "error", **options: str) -> None:
    """Write ``df`` as Parquet; the shuffle files that it took are gone afterwards."""
    with shuffles_removed(df.sparkSession):
        df.write.mode(mode).options(**options).parquet(path)


def remove_table(spark: SparkSession, path: str) -> None:
    """Remove the files of a table: writing nothing over a folder does so, in whatever file system they are."""
    spark.range(0, 0, 1, 1).write.mode("overwrite").parquet(path)


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and go on from there: a checkpoint of many rows in less space."""
    path = path or scratch_path(df.sparkSession, name)
    write_table(df, path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that are written on the way and removed again, at the end of a ``with`` block or before."""

    def __init__(self, spark: SparkSession):
        self.spark, self._paths = spark, {}

    def written(self, df: DataFrame) -> DataFrame:
        """As :func:`written`; not to be read after the block."""
        path = scratch_path(self.spark, "scratch")
        self._paths[path] = None
        table = written(df, "scratch", path)
        self._paths[path] = table
        return table

    def folder(self) -> str:
        """A new path that is removed too."""
        path = scratch_path(self.spark, "scratch")
        self._paths[path] = None
        return path

    def discard(self, *tables: DataFrame) -> None:
        """Remove these tables now."""
        for path in [path for path, table in self._paths.items() if any(table is x for x in tables)]:
            self._remove(path)

    def _remove(self, path: str) -> None:
        del self._paths[path]
        remove_table(self.spark, path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *raised) -> None:
        self.close()

    def close(self) -> None:
        """Remove all that is still there."""
        for path in list(self._paths):
            self._remove(path)
