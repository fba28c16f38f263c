"""What is written on the way, and that it goes."""

import json
import time
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from feedback_rank.operators import calls, extract, merge
from feedback_rank.operators.numbering import number_rows
from feedback_rank.session import Scratch, checkpointed, shared_dir, written

SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _shuffle_files(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {str(f) for d in folders for f in Path(d.getPath()).rglob("shuffle_*")}


@pytest.mark.parametrize("write", [checkpointed, lambda df: written(df, "test")])
def test_shuffle_files_go_with_their_plan(spark, write):
    numbers = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    spark.sparkContext._jvm.System.gc()
    time.sleep(1)
    before, setting = _shuffle_files(spark), spark.conf.get(SETTING)
    table = write(numbers)
    until = time.time() + 10  # they are removed behind our back
    while not _shuffle_files(spark) <= before and time.time() < until:
        time.sleep(0.1)
    assert _shuffle_files(spark) <= before
    assert spark.conf.get(SETTING) == setting
    assert table.count() == 7 and numbers.count() == 7


def test_scratch_tables_are_empty_afterwards(spark):
    with Scratch(spark) as scratch:
        one, two = scratch.written(spark.range(5)), scratch.written(spark.range(6))
        paths = list(scratch._paths)
        scratch.discard(one)
        assert two.count() == 6
        assert [spark.read.schema("id long").parquet(path).count() for path in paths] == [0, 6]
    assert [spark.read.schema("id long").parquet(path).count() for path in paths] == [0, 0]


def _scratch_bytes(spark):
    folder = Path(shared_dir(spark).removeprefix("file:"))
    return sum(f.stat().st_size for f in folder.glob("scratch-*/**/part-*"))


def test_columns_of_sorted_rows(spark):
    rows = number_rows(spark.range(20).repartition(4), [F.desc("id")], name="n", then={"twice": F.col("id") * 2}).collect()
    assert sorted((r["n"], r["id"], r["twice"]) for r in rows) == [(i + 1, 19 - i, 38 - 2 * i) for i in range(20)]


def test_calls_leave_their_ledger_alone(spark, tmp_path):
    """The texts of the calls, sorted, cut and dealt to lanes, are not there any more."""
    text = "".join(chr(33 + (i * i + i // 7) % 90) for i in range(20_000))
    rows = [(f"i{i}", datetime(2025, 1, 1), "a", "1", 1.0, f"{i} {text[i:]}") for i in range(40)]
    feedback = spark.createDataFrame(rows, "insight_id string, created_at timestamp, account_name string, platform_client_id string, mrr double, feedback string")
    before = _scratch_bytes(spark)
    found = extract.extract_plugin(feedback, lambda lines: json.dumps({"features": [{"feature": str(len(lines))}]}), ledger=str(tmp_path))
    assert _scratch_bytes(spark) - before < 20_000
    lines = extract.chunked_lines(feedback)
    assert found.count() == lines.count() and {r["status"] for r in found.collect()} == {calls.OK}


def test_merging_leaves_no_scratch(spark):
    features = spark.createDataFrame([("add export to csv", 2), ("csv export to add", 1), ("dark mode", 1)], "feature string, support long")
    rows = {r["feature"]: r["merged_feature"] for r in merge.merged_names(features).collect()}
    assert rows == {"add export to csv": "add export to csv", "csv export to add": "add export to csv", "dark mode": "dark mode"}
    folder = Path(shared_dir(spark).removeprefix("file:"))
    tables = [spark.read.parquet(str(path)) for path in folder.glob("scratch-*")]
    assert tables and not any(table.count() for table in tables)


def test_words_do_not_leave_the_task_of_their_set(spark):
    features = spark.createDataFrame([(f"word{i} and word{i + 1}", 1) for i in range(50)], "feature string, support long")
    sets = merge.word_sets(merge.keyed_features(features))
    plan = merge._with_keys(sets, merge._Likeness(0.8))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(word" not in plan and plan.count("Exchange hashpartitioning(place") == 1
