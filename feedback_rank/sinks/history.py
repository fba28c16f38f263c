"""Runs with their features, accounts and cards saved, deleted again, and packed.

Every save has an id of its own. Its features, accounts and card are written first and its header,
which names the save, last. Readers go by headers: of a run the newest one counts, and only
what was written under its save is read. So a run is there once its header is, a repeated
save replaces the one before even if it has no rows, and what a crashed save left is never
seen. A delete names the saves that it deletes, so a run saved again under a deleted id is there.

:func:`compact` may run at any time. It opens a new generation before it reads the old one, and who
saves looks after its header which generation is open: if that changed, it saves once
more, into the new one. Whatever comes to its end is so in the packed files or in loose ones
that are still read.
"""

from __future__ import annotations

import random
import time
import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedback_rank.functions import columns as C
from feedback_rank.plans.history import card_parts
from feedback_rank.schemas import DELETED_RUNS, MONEY, RUN_ACCOUNTS, RUN_CARDS, RUN_FEATURES, RUNS
from feedback_rank.session import checkpointed, write_table
from feedback_rank.sources import history as stored
from feedback_rank.sources.stored import append_rows, claim_number, stored_table
from feedback_rank.spec import RunSpec

COMPACT_SAVES = 200        # loose saves after which a save packs the store
LOOKS = 16                 # times that a save looks for so many, on average, before there are so many
ROWS_PER_FILE = 1_000_000  # of a packed table
SORTED_FILES = 32          # files' worth of rows that are sorted together, or one run of any size


def next_run_id(spark: SparkSession, path: str) -> int:
    """One above the highest id of a saved run."""
    return _known(spark, path)[0] + 1


def _known(spark: SparkSession, path: str) -> tuple[int, int]:
    """(highest id of a run that was ever saved, saves in loose files)."""
    now = stored.generations(spark, path)
    loose = stored.stored_rows(spark, path, stored.RUN_TABLE, now, files=[]).agg(F.max("id").alias("id"), F.countDistinct("save_id").alias("saves")).first()
    return max(loose["id"] or 0, now.last_id), loose["saves"]


def claim_run_id(spark: SparkSession, path: str) -> int:
    """An id that no other writer gets, however many ask at once, from one above the highest known."""
    return claim_number(spark, f"{path.rstrip('/')}/run_ids", next_run_id(spark, path))


def new_save_id() -> str:
    """Ids of later saves sort behind those of earlier ones."""
    return f"{time.time_ns():020d}-{uuid.uuid4().hex}"


def run_header(spec: RunSpec, totals: DataFrame, run_id: int, created_at: datetime | Column | None = None) -> DataFrame:
    """The header row of a run from its totals."""
    if not isinstance(created_at, Column):
        moment = (created_at or datetime.now(timezone.utc)).astimezone(timezone.utc)
        created_at = F.lit(moment.isoformat()).cast("timestamp")

    def day(value) -> Column:
        return F.lit(value.isoformat() if value else None).cast("date")

    return totals.select(
        F.lit(run_id).cast("long").alias("id"),
        created_at.alias("created_at"),
        day(spec.start_date).alias("start_date"),
        day(spec.end_date).alias("end_date"),
        C.filters_json(spec).alias("filters"),
        F.col("total_feedbacks").cast("long").alias("total_feedbacks"),
        F.col("unique_accounts").cast("long").alias("unique_accounts"),
        F.col("total_mrr").cast(MONEY).alias("total_mrr"),
    )


def _of_run(table: DataFrame, run_id: int, texts: tuple[str, ...], schema) -> DataFrame:
    """Rows of a run, without NUL bytes in their texts."""
    clean = {name: C.strip_nul(F.col(name)) for name in texts}
    return table.withColumn("run_id", F.lit(run_id).cast("long")).withColumns(clean).select(*schema.names)


def run_features(ranked: DataFrame, run_id: int) -> DataFrame:
    """The ranked table as rows of a run."""
    return _of_run(ranked, run_id, ("feature", "sample_feedbacks", "ai_insight"), RUN_FEATURES)


def run_accounts(accounts: DataFrame, run_id: int) -> DataFrame:
    """The accounts of the ranked table as rows of a run."""
    return _of_run(accounts, run_id, ("feature", "account_name", "platform_client_id", "label"), RUN_ACCOUNTS)


def _append(table: DataFrame, path: str, name: str, generation: int | None) -> None:
    if generation is None:
        generation = stored.generations(table.sparkSession, path).open
    append_rows(table, stored.loose_path(path, name, generation))


def _save(table: DataFrame, path: str, name: str, save_id: str, schema, generation: int | None) -> None:
    _append(table.select(*schema.names, F.lit(save_id).alias("save_id")), path, name, generation)


def save_features(features: DataFrame, path: str, save_id: str = "0", generation: int | None = None) -> None:
    """Write features of any runs under a save."""
    _save(features, path, stored.FEATURE_TABLE, save_id, RUN_FEATURES, generation)


def save_accounts(accounts: DataFrame, path: str, save_id: str = "0", generation: int | None = None) -> None:
    """Write accounts of any runs under a save."""
    _save(accounts, path, stored.ACCOUNT_TABLE, save_id, RUN_ACCOUNTS, generation)


def save_headers(runs: DataFrame, path: str, save_id: str = "0", generation: int | None = None) -> None:
    """Write headers that name a save; from then on its rows are there."""
    _save(runs, path, stored.RUN_TABLE, save_id, RUNS, generation)


def save_runs(runs: DataFrame, features: DataFrame, path: str, accounts: DataFrame | None = None) -> str:
    """Save any number of runs, with their features, cards and accounts, under one save; returns its id.

    ``runs`` are headers, ``features`` and ``accounts`` rows of these runs. Cards are counted
    from the features as they were written.
    """
    spark, now = features.sparkSession, stored.generations(features.sparkSession, path).open
    while True:
        save_id = new_save_id()
        save_features(features, path, save_id, now)
        written = stored_table(spark, stored.loose_path(path, stored.FEATURE_TABLE, now), stored.STORED[stored.FEATURE_TABLE])
        _save(card_parts(written.where(F.col("save_id") == save_id)), path, stored.CARD_TABLE, save_id, RUN_CARDS, now)
        if accounts is not None:
            save_accounts(accounts, path, save_id, now)
        save_headers(runs, path, save_id, now)
        then, now = now, stored.generations(spark, path).open
        if now == then:
            return save_id


def save_run(
    spec: RunSpec, totals: DataFrame, ranked: DataFrame, path: str, run_id: int | None = None,
    created_at: datetime | None = None, accounts: DataFrame | None = None,
) -> int:
    """Save a run with its features and their accounts; returns the id of the run.

    Without an id the run gets one that no other writer has. Every :data:`COMPACT_SAVES` saves
    or a few more the store is packed; not every save looks for that.
    """
    spark = ranked.sparkSession
    if run_id is None:
        run_id = claim_run_id(spark, path)
    of_run = None if accounts is None else run_accounts(accounts, run_id)
    save_runs(run_header(spec, totals, run_id, created_at), run_features(ranked, run_id), path, of_run)
    if random.random() * COMPACT_SAVES < LOOKS and _known(spark, path)[1] >= COMPACT_SAVES:
        compact(spark, path)
    return run_id


def delete_runs(runs: DataFrame, path: str) -> None:
    """Delete the runs in column ``run_id`` as they are saved now, and with them their features, accounts and cards."""
    spark = runs.sparkSession
    ids = runs.select(F.col("run_id").cast("long").alias("run_id")).distinct()
    now = stored.generations(spark, path)
    while True:
        saves = stored.stored_rows(spark, path, stored.RUN_TABLE, now).select(F.col("id").alias("run_id"), "save_id")
        _append(saves.join(ids, "run_id").select(*DELETED_RUNS.names).distinct(), path, stored.DELETED_TABLE, now.open)
        then, now = now, stored.generations(spark, path)
        if now.open == then.open:
            return


def _mark(spark: SparkSession, path: str, generation: int, state: str, last_id: int | None = None) -> None:
    row = spark.createDataFrame([(generation, state, last_id)], stored.MARKS)
    append_rows(row.coalesce(1), stored.marks_path(path))


def _spans(rows: DataFrame, most: int) -> list[tuple[int, int, int]]:
    """(first run, last run, rows), one after the other, of about ``most`` rows each or of one run; not all rows are sorted at once."""
    of_run = checkpointed(rows.groupBy("run_id").agg(F.count("*").alias("rows")))
    # one row per run
    before = F.coalesce(F.sum("rows").over(Window.orderBy("run_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = of_run.select("run_id", "rows", F.floor(before / most).alias("span")).groupBy("span").agg(
        F.min("run_id").alias("first"), F.max("run_id").alias("last"), F.sum("rows").alias("rows")
    )
    return [(row["first"], row["last"], row["rows"]) for row in spans.orderBy("span").collect()]


def compact(spark: SparkSession, path: str, rows_per_file: int = ROWS_PER_FILE) -> int:
    """Pack all that is current into few files, sorted by run; returns the number of the new generation.

    Readers see the old files until the new ones are all there, and then the new ones: what turns them is one
    row, written last. A run of any size is dealt over as many files as it needs. If this
    crashes, nothing is lost, and the next call packs what this one should have.
    """
    last_id = _known(spark, path)[0]
    target = claim_number(spark, f"{path.rstrip('/')}/generation_ids", stored.generations(spark, path).open + 1)
    _mark(spark, path, target, stored.OPENED, last_id)
    # all generations before, as they are now that nobody ends a save in them any more
    now = stored.generations(spark, path)
    before = now._replace(packed=min(now.packed, target - 1), open=target - 1)
    headers = checkpointed(stored.current_saves(spark, path, before).withColumnRenamed("run_id", "id"))
    headers.select(*stored.HEADERS.names).coalesce(1 + headers.count() // rows_per_file).write.parquet(stored.packed_path(path, stored.RUN_TABLE, target))
    saves = headers.select(F.col("id").alias("run_id"), "save_id")
    for table, order in ((stored.FEATURE_TABLE, ("run_id", "rank")), (stored.ACCOUNT_TABLE, ("run_id", "feature", "account_name")), (stored.CARD_TABLE, ("run_id",))):
        rows = stored.under_saves(stored.stored_rows(spark, path, table, before), saves)
        folder = stored.packed_path(path, table, target)
        for first, last, count in _spans(rows, SORTED_FILES * rows_per_file) or [(0, 0, 0)]:
            some = rows.where(F.col("run_id").between(first, last)).repartitionByRange(1 + count // rows_per_file, *order)
            write_table(some.sortWithinPartitions(*order), folder, "append", compression="zstd")
        held = stored_table(spark, folder, stored.STORED[table]).groupBy(F.col("_metadata.file_name").alias("file")).agg(
            F.min("run_id").alias("first_run"), F.max("run_id").alias("last_run"), F.count("*").alias("rows")
        )
        held.coalesce(1).write.parquet(stored.manifest_path(path, table, target))
    _mark(spark, path, target, stored.PACKED)
    return target


def purge(spark: SparkSession, path: str) -> int:
    """Pack the store and remove all files that are not needed any more; returns the number of generations removed.

    A generation's files go together, table by table, whatever number of runs they hold. Not while
    someone else packs the store; frames that were loaded before cannot be read afterwards.
    """
    keep = compact(spark, path)
    gone = range(stored.generations(spark, path).purged + 1, keep)
    for generation in gone:
        for table, schema in stored.STORED.items():
            # writing nothing over a folder removes its files, in whatever file system they are
            empty = spark.createDataFrame([], schema).coalesce(1)
            empty.write.mode("overwrite").parquet(stored.loose_path(path, table, generation))
            if generation and table != stored.DELETED_TABLE:
                empty.write.mode("overwrite").parquet(stored.packed_path(path, table, generation))
        _mark(spark, path, generation, stored.PURGED)
    return len(gone)
