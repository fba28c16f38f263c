"""Tables in shared folders that several sessions add to.

Each append is a folder of its own under the table's: two jobs that write to one folder would
take away each other's temporary files. Readers look at all of them.
"""

from __future__ import annotations

import random
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from feedback_rank.session import write_table


def stored_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All that was appended to the table, with this schema; without rows where nothing was saved yet."""
    try:
        return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path).select(*schema.names)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_rows(rows: DataFrame, path: str) -> str:
    """Add the rows to the table; returns their folder. They are seen all at once or not at all."""
    folder = f"{path.rstrip('/')}/{uuid.uuid4().hex}"
    write_table(rows, folder, compression="zstd")
    return folder


def claim_number(spark: SparkSession, path: str, first: int) -> int:
    """A number from ``first`` on that no one else gets under this path, however many ask at once.

    Who asks writes a claim to the folder of a number and then reads the folder. The number is its own
    if no other claim is there; of two that ask the one that reads later sees both, so two never
    take the same number. Who sees another goes on to a higher one; so numbers may be left out.
    """
    number, step = first, 1
    while True:
        folder, claim = f"{path.rstrip('/')}/{number}", uuid.uuid4().hex
        append_rows(spark.createDataFrame([(claim,)], "claim string").coalesce(1), folder)
        claims = stored_table(spark, folder, T.StructType([T.StructField("claim", T.StringType())]))
        if claims.where(F.col("claim") != claim).isEmpty():
            return number
        number += random.randint(1, step)
        step = min(16, 2 * step)
