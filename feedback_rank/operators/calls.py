"""Calls of a paid service, chunk by chunk: none is paid twice, and so many at once as the service allows.

A ledger, a Parquet table in a shared folder, keeps what every call gave, under a hash of the
chunk's text. A run looks up its chunks there and calls only what is missing or has failed so
far. What is called is dealt to lanes. A lane is one task, so there are never more calls at
once than lanes; it makes its calls one after the other and keeps the pause that the service
asked for from chunk to chunk. The chunks go in waves. A job begins with the next wave of each
lane, whose tasks append to the ledger when they end. While TASK_SECONDS have not passed, a task
goes on with its lane's following waves, as many as are in the ledger already, so that quick calls
do not wait for a job each. So a lost executor, or a crash of the whole run, costs the calls of the
tasks that were under way, a wave or those few seconds, and the next run goes on from there.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedback_rank.operators.numbering import number_rows
from feedback_rank.session import Scratch, checkpointed, scratch_path, shuffles_removed
from feedback_rank.sources.stored import stored_table

RETRY_WAITS = (30, 60)  # fixed values: seconds before the second and third try
IN_FLIGHT = 8           # calls at once
LANE_CALLS = 16         # calls of a lane in a wave; a task that is lost costs so many at most, or what it called in TASK_SECONDS
TASK_SECONDS = 2.0      # after these a task ends with the wave it is in
SENT_CHUNKS = 100_000   # chunks whose places in the lanes are sent to every task, at most
JOB_CHUNKS = 1024       # chunks that a job sorts to its lanes at most, beside one wave
OK, FAILED = "ok", "failed"
_LEAST_PAUSE = 1.0      # seconds; a shorter pause is none

LEDGER = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("lane", T.IntegerType()),
    T.StructField("wave", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("payload", T.StringType()),
    T.StructField("started_at", T.TimestampType()),
    T.StructField("ended_at", T.TimestampType()),
])
_TODO = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("lane", T.IntegerType()), T.StructField("wave", T.LongType()), T.StructField("key", T.StringType()), T.StructField("lines", T.StringType()),
])


class Lane:
    """Calls ``fn`` one time after the other; waits and tries again where the error says the rate limit (429) was hit.

    There is one more try per wait. The longest wait that was needed is also waited before the
    lane's next calls, half as long after each that went well.
    """

    def __init__(self, fn: Callable[[str], str], waits=RETRY_WAITS, sleep: Callable[[float], None] = time.sleep):
        self.fn, self.waits, self.sleep, self.pause = fn, tuple(waits), sleep, 0.0

    def __call__(self, data: str) -> str:
        if self.pause:
            self.sleep(self.pause)
        for wait in (*self.waits, None):
            try:
                payload = self.fn(data)
            except Exception as error:
                if wait is None or "429" not in str(error):
                    raise
                self.pause = max(self.pause, wait)
                self.sleep(wait)
            else:
                self.pause = self.pause / 2 if self.pause / 2 >= _LEAST_PAUSE else 0.0
                return payload


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Every call that was made, one row each; no rows where none was."""
    return stored_table(spark, path, LEDGER)


def outcomes(ledger: DataFrame) -> DataFrame:
    """(key, status, error, payload): of each chunk's calls one that went well, else the last."""
    newest = F.struct((F.col("status") == OK).alias("ok"), "ended_at", "payload", "error")
    return ledger.groupBy("key").agg(F.max_by(F.struct("status", "error", "payload"), newest).alias("of")).select("key", "of.*")


def _called(fn: Callable[[str], str], waits, sleep, seconds: float = TASK_SECONDS) -> Callable:
    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        lane, begun, wave, rows = Lane(fn, waits, sleep), time.monotonic(), None, []
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.wave != wave:
                    if rows:
                        yield pd.DataFrame(rows, columns=LEDGER.names)
                    if wave is not None and time.monotonic() - begun >= seconds:
                        return
                    wave, rows = row.wave, []
                started = pd.Timestamp.now(tz="UTC")
                status, error, payload = OK, None, None
                try:
                    payload = lane(row.lines)
                except Exception as failure:
                    status, error = FAILED, str(failure)
                rows.append((row.key, row.lane, row.wave, status, error, payload, started, pd.Timestamp.now(tz="UTC")))
        if rows:
            yield pd.DataFrame(rows, columns=LEDGER.names)

    return run


def _pending(keyed: DataFrame, ledger: DataFrame, in_flight: int, lane_calls: int) -> DataFrame:
    """(n, lane, wave, key, lines): each text that no call went well for, in the order of the chunks.

    Texts are known by their rows in the written table ``keyed`` until they have their places.
    """
    paid = ledger.where(F.col("status") == OK).select("key")
    once = keyed.groupBy("key").agg(F.min(F.struct("chunk_id", "row")).alias("of")).select("key", "of.chunk_id", "of.row")
    open_keys = once.join(paid, "key", "left_anti")
    place = F.col("n") - 1
    numbered = number_rows(open_keys, [F.col("chunk_id"), F.col("key")], name="n").select(
        "row", "key", "n", F.pmod(place, F.lit(in_flight)).cast("int").alias("lane"), F.floor(place / (in_flight * lane_calls)).cast("long").alias("wave")
    )
    sent = F.broadcast(numbered) if numbered.limit(SENT_CHUNKS + 1).count() <= SENT_CHUNKS else numbered
    return keyed.select("row", "lines").join(sent, "row").select("n", "lane", "wave", "key", "lines")


def chunk_keys(chunks: DataFrame, label: str = "") -> DataFrame:
    """(chunk_id, lines, key): the chunks with their keys in a ledger."""
    lines = F.coalesce("lines", F.lit(""))
    key = F.sha2(F.concat(F.lit(f"{len(label)}:{label}:"), lines), 256)
    return chunks.select("chunk_id", lines.alias("lines"), key.alias("key"))


def call_chunks(
    chunks: DataFrame, fn: Callable[[str], str], ledger: str | None = None, label: str = "", in_flight: int = IN_FLIGHT,
    lane_calls: int = LANE_CALLS, waits=RETRY_WAITS, sleep: Callable[[float], None] = time.sleep,
    on_progress: Callable[[float], None] | None = None, once_read: Callable[[], None] = lambda: None,
) -> DataFrame:
    """(chunk_id, status, error, payload) of each of the ``chunks`` (chunk_id, lines). Makes its calls at once.

    ``ledger`` names the folder of the ledger; without one it is a new one, for this run alone.
    ``label`` stands for all that a payload depends on beside the lines, such as the prompt
    and the model: under another label everything is called anew. Chunks of the same lines are
    called once. ``in_flight`` is the number of lanes, ``lane_calls`` what each does in a wave.
    A call that raises makes its chunk 'failed'; a later run with the same ledger calls it again.

    A task that is lost costs a wave of its lane, or what it called in :data:`TASK_SECONDS`, if that is more.

    ``on_progress`` gets the share of texts with a result: first what the ledger already has,
    then after each wave, at last 1. Waves count once their job is done, so repeated tasks do
    not; those of one job are told one after the other. Null lines count as empty; an empty table calls nothing. Speculative copies of tasks
    would call twice at once: with ``spark.speculation`` on this raises an error.

    ``once_read`` is called when the ``chunks`` will not be read any more. Of what is written here only the ledger
    and the chunks' keys are left in the end.
    """
    spark = chunks.sparkSession
    if in_flight < 1 or lane_calls < 1:
        raise ValueError("in_flight and lane_calls must be at least 1")
    if spark.sparkContext.getConf().get("spark.speculation", "false").lower() == "true":
        raise ValueError("spark.speculation makes copies of running calls; turn it off")
    ledger = ledger or scratch_path(spark, "ledger")
    with Scratch(spark) as scratch:
        keyed = scratch.written(chunk_keys(chunks, label).withColumn("row", F.monotonically_increasing_id()))
        once_read()
        ids = checkpointed(keyed.select("chunk_id", "key"))
        path, mine = scratch.folder(), f"{ledger.rstrip('/')}/{uuid.uuid4().hex}"  # each run adds a folder of its own
        wave_chunks = in_flight * lane_calls
        at_once = max(1, JOB_CHUNKS // wave_chunks)  # waves that a job has at hand; a folder each
        pending = _pending(keyed, read_ledger(spark, ledger), in_flight, lane_calls).withColumn("part", F.floor(F.col("wave") / at_once).cast("long"))
        with shuffles_removed(spark):
            pending.repartition("part").write.partitionBy("part").option("compression", "zstd").parquet(path)
        scratch.discard(keyed)
        total, waiting = ids.select("key").distinct().count(), stored_table(spark, path, _TODO).count()
        progress = on_progress or (lambda share: None)
        if total:
            progress((total - waiting) / total)
        done, job, waves = 0, 0, -(-waiting // wave_chunks)
        ahead = [0] * in_flight  # the wave that each lane has next
        while done < waves:
            part = done // at_once
            upto = min(waves, (part + 1) * at_once, done + max(1, done))
            begins = F.get(F.array(*[F.lit(wave).cast("long") for wave in ahead]), F.col("lane"))
            todo = stored_table(spark, f"{path}/part={part}", _TODO).where((F.col("wave") >= begins) & (F.col("wave") < upto))
            # a lane is a partition of its own; a task's rows are there as soon as it ends, not only when all have ended
            lanes = todo.repartitionById(in_flight, F.col("lane")).sortWithinPartitions("n").select("key", "lane", "wave", "lines")
            folder, job = f"{mine}/{job}", job + 1
            with shuffles_removed(spark):
                lanes.mapInPandas(_called(fn, waits, sleep, TASK_SECONDS), LEDGER).write.option(
                    "mapreduce.fileoutputcommitter.algorithm.version", "2"
                ).mode("append").parquet(folder)
            for row in stored_table(spark, folder, LEDGER).groupBy("lane").agg(F.max("wave").alias("wave")).collect():  # a row a lane
                ahead[row["lane"]] = row["wave"] + 1
            # some lanes may have no chunk in the last wave
            now = min(waves if wave == waves - 1 and lane + wave * wave_chunks >= waiting else wave for lane, wave in enumerate(ahead))
            for wave in range(done, now):
                progress((total - max(0, waiting - (wave + 1) * wave_chunks)) / total)
            done = now
    known = read_ledger(spark, ledger).join(ids.select("key").distinct(), "key", "left_semi")
    return ids.join(outcomes(known), "key").select("chunk_id", "status", "error", "payload")
