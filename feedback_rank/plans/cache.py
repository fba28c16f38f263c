"""Scoped tables kept for a while, for all sessions that ask for the same.

A stored table is known by a hash of what was asked and of the input files: their names,
sizes and times of change. Whoever asks for the same while it is young enough reads it;
new, changed or removed input files make a new one. A row in an index, written after the
table, makes it known, so a crashed write is never read, and of two sessions that write at once
either table will do, as both hold the same rows.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
import time
import uuid
from collections.abc import Callable, Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedback_rank.sources.stored import append_rows, stored_table
from feedback_rank.spec import RunSpec

MAX_AGE = 3600  # fixed value: seconds that a table is good for

ENTRIES = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("folder", T.StringType()), T.StructField("created_at", T.TimestampType()),
])


def inputs_digest(spark: SparkSession, paths: Sequence[str]) -> str:
    """A digest of all files under the paths by name, size and time of change, whatever their order."""
    file = F.struct("path", "length", "modificationTime")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)).select(
        *[F.conv(F.substring(F.sha2(F.concat(F.lit(f"{part}"), F.to_json(file)), 256), 1, 15), 16, 10).cast("decimal(38,0)").alias(f"h{part}") for part in range(2)]
    )
    row = files.agg(F.count("*").alias("n"), F.sum("h0").alias("a"), F.sum("h1").alias("b")).first()
    return f"{row['n']}-{row['a']}-{row['b']}"


def scope_key(spec: RunSpec, inputs: str, more: Sequence[str] = ()) -> str:
    """What a stored table is known by: all fields of the run's filter, whatever the order of its lists, and the inputs."""
    fields = {name: sorted(map(str, value)) if isinstance(value, tuple) else str(value) for name, value in dataclasses.asdict(spec).items()}
    return hashlib.sha256(json.dumps([fields, inputs, list(more)], sort_keys=True).encode()).hexdigest()


def cached_scope(
    spark: SparkSession, path: str, spec: RunSpec, inputs: Sequence[str], make: Callable[[], DataFrame], max_age: float = MAX_AGE,
    more: Sequence[str] = (), now: Callable[[], float] = time.time,
) -> DataFrame:
    """The table that ``make`` gives for the run, read from ``path`` if it was stored there less than ``max_age`` seconds ago.

    ``path`` is a shared folder, ``inputs`` are the paths of all files that ``make`` reads, and
    ``more`` stands for whatever else its rows depend on. Otherwise the table is made, stored and read.
    """
    base = path.rstrip("/")
    key, moment = scope_key(spec, inputs_digest(spark, inputs), more), now()
    young = stored_table(spark, f"{base}/entries", ENTRIES).where(
        (F.col("key") == key) & (F.col("created_at") > F.lit(datetime.fromtimestamp(moment - max_age, timezone.utc)))
    )
    found = young.orderBy(F.desc("created_at"), "folder").select("folder").head()
    if found:
        return spark.read.parquet(f"{base}/{found['folder']}")
    folder = f"tables/{key}-{uuid.uuid4().hex}"
    make().write.parquet(f"{base}/{folder}")
    entry = spark.createDataFrame([(key, folder, datetime.fromtimestamp(moment, timezone.utc))], ENTRIES)
    append_rows(entry.coalesce(1), f"{base}/entries")
    return spark.read.parquet(f"{base}/{folder}")
