"""Saved runs, their features, accounts and cards, without what was deleted or replaced.

The store is in generations. What is saved goes to the loose files of the open generation;
compacting packs all that is current into few sorted files of a new one, with a manifest of
which runs each file holds. Readers take the newest packed generation and the loose files
since, so they never look at more than a bounded number of files.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedback_rank.functions.names import free_names
from feedback_rank.schemas import DELETED_RUNS, RUN_ACCOUNTS, RUN_CARDS, RUN_FEATURES, RUNS
from feedback_rank.sources.stored import stored_table

RUN_TABLE, FEATURE_TABLE, ACCOUNT_TABLE = "analysis_runs", "analysis_features", "analysis_accounts"
CARD_TABLE, DELETED_TABLE = "analysis_cards", "deleted_runs"
OPENED, PACKED, PURGED = "opened", "packed", "purged"
SENT_SAVES = 100_000  # saves that are sent to every task, at most
SAVE_PARTS = 64       # parts that the rows of a save are dealt to where there are more saves

_SAVE = T.StructField("save_id", T.StringType())
HEADERS = T.StructType([*RUNS.fields, _SAVE])  # a header as it is stored: with the save that it names
STORED = {
    RUN_TABLE: HEADERS,
    FEATURE_TABLE: T.StructType([*RUN_FEATURES.fields, _SAVE]),
    ACCOUNT_TABLE: T.StructType([*RUN_ACCOUNTS.fields, _SAVE]),
    CARD_TABLE: T.StructType([*RUN_CARDS.fields, _SAVE]),
    DELETED_TABLE: DELETED_RUNS,
}
MARKS = T.StructType([
    T.StructField("generation", T.LongType()), T.StructField("state", T.StringType()), T.StructField("last_id", T.LongType()),
])
MANIFEST = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("first_run", T.LongType()), T.StructField("last_run", T.LongType()),
    T.StructField("rows", T.LongType()),
])


class Generations(NamedTuple):
    """The newest packed generation, the one that is open, the last one purged, and the highest id known when one was opened."""

    packed: int
    open: int
    purged: int
    last_id: int


def marks_path(path: str) -> str:
    return f"{path.rstrip('/')}/generations"


def loose_path(path: str, table: str, generation: int) -> str:
    return f"{path.rstrip('/')}/{table}/loose-{generation}"


def packed_path(path: str, table: str, generation: int) -> str:
    return f"{path.rstrip('/')}/{table}/packed-{generation}"


def manifest_path(path: str, table: str, generation: int) -> str:
    return f"{path.rstrip('/')}/{table}/manifest-{generation}"


def generations(spark: SparkSession, path: str) -> Generations:
    state, generation = F.col("state"), F.col("generation")
    row = stored_table(spark, marks_path(path), MARKS).agg(
        F.max(F.when(state == PACKED, generation)).alias("packed"), F.max(F.when(state != PURGED, generation)).alias("open"),
        F.max(F.when(state == PURGED, generation)).alias("purged"), F.max("last_id").alias("last_id"),
    ).first()
    return Generations(row["packed"] or 0, row["open"] or 0, -1 if row["purged"] is None else row["purged"], row["last_id"] or 0)


def stored_rows(spark: SparkSession, path: str, table: str, now: Generations, files: list[str] | None = None) -> DataFrame:
    """All rows of a table that were saved; of the packed ones those in ``files``, if they are given."""
    schema = STORED[table]
    rows = spark.createDataFrame([], schema)
    if now.packed and table != DELETED_TABLE:
        folder = packed_path(path, table, now.packed)
        if files is None:
            rows = stored_table(spark, folder, schema)
        elif files:
            rows = spark.read.schema(schema).parquet(*[f"{folder}/{file}" for file in files])
    for generation in range(now.packed, now.open + 1):
        rows = rows.unionByName(stored_table(spark, loose_path(path, table, generation), schema))
    return rows


def current_saves(spark: SparkSession, path: str, now: Generations | None = None) -> DataFrame:
    """(run_id, save_id, and the rest of the header): of each run its newest save that is not deleted."""
    now = now or generations(spark, path)
    deleted = stored_rows(spark, path, DELETED_TABLE, now).select(F.col("run_id").alias("id"), "save_id")
    saved = stored_rows(spark, path, RUN_TABLE, now).join(deleted, ["id", "save_id"], "left_anti").select(*HEADERS.names)
    newest = saved.groupBy("id").agg(F.max_by(F.struct(*HEADERS.names[1:]), F.struct("save_id", "created_at")).alias("_run"))
    return newest.select(F.col("id").alias("run_id"), "_run.*")


def load_runs(spark: SparkSession, path: str) -> DataFrame:
    """All run headers, newest first; of a run that was saved again the newest one."""
    runs = current_saves(spark, path).withColumnRenamed("run_id", "id")
    return runs.select(*RUNS.names).orderBy(F.desc("created_at"), F.desc("id"))


def under_saves(rows: DataFrame, saves: DataFrame) -> DataFrame:
    """The rows under the given (run_id, save_id), each pair given once.

    One save may hold most of a table, so rows are not brought together by their save: the saves go to every
    task, or, if there are too many, meet the rows part by part of each save.
    """
    keys = ["run_id", "save_id"]
    saves = saves.select(*keys)
    if saves.limit(SENT_SAVES + 1).count() <= SENT_SAVES:
        return rows.join(F.broadcast(saves), keys, "left_semi").select(*rows.columns)
    (part,) = free_names(rows.columns, "part")
    dealt = rows.withColumn(part, F.pmod(F.xxhash64(*rows.columns), F.lit(SAVE_PARTS)).cast("int"))
    parts = saves.withColumn(part, F.explode(F.sequence(F.lit(0), F.lit(SAVE_PARTS - 1))))
    return dealt.join(parts, [*keys, part], "left_semi").select(*rows.columns)


def committed_rows(spark: SparkSession, path: str, table: str, now: Generations) -> DataFrame:
    """The rows of a table under current saves, as they are stored."""
    return under_saves(stored_rows(spark, path, table, now), current_saves(spark, path, now))


def _all(spark: SparkSession, path: str, table: str) -> DataFrame:
    return committed_rows(spark, path, table, generations(spark, path)).drop("save_id")


def _of_run(spark: SparkSession, path: str, table: str, run_id: int) -> DataFrame:
    now, mine = generations(spark, path), F.col("run_id") == run_id
    files = None
    if now.packed:
        manifest = stored_table(spark, manifest_path(path, table, now.packed), MANIFEST)
        # as many as the run itself fills, and one more at most on either side
        files = [row["file"] for row in manifest.where((F.col("first_run") <= run_id) & (F.col("last_run") >= run_id)).collect()]
    # one save at most
    saves = F.broadcast(current_saves(spark, path, now).where(mine).select("run_id", "save_id"))
    rows = stored_rows(spark, path, table, now, files).where(mine)
    return rows.join(saves, ["run_id", "save_id"], "left_semi").select(*STORED[table].names).drop("save_id")


def load_features(spark: SparkSession, path: str) -> DataFrame:
    """The features of all runs."""
    return _all(spark, path, FEATURE_TABLE)


def load_accounts(spark: SparkSession, path: str) -> DataFrame:
    """The accounts behind the features of all runs, one row each."""
    return _all(spark, path, ACCOUNT_TABLE)


def load_card_parts(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, feature_count, top_features) of all runs, as they were counted when the runs were saved."""
    return _all(spark, path, CARD_TABLE)


def load_run_features(spark: SparkSession, path: str, run_id: int) -> DataFrame:
    """The features of one run by rank; of the packed files only those that hold the run are read."""
    return _of_run(spark, path, FEATURE_TABLE, run_id).orderBy("rank")


def load_run_accounts(spark: SparkSession, path: str, run_id: int) -> DataFrame:
    """The accounts behind one run's features; of the packed files only those that hold the run are read."""
    return _of_run(spark, path, ACCOUNT_TABLE, run_id)
