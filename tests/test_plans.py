"""What the physical plans must and must not hold."""

import pytest

from checks.queries import QUERIES
from checks.tables import Tables
from feedback_rank import session

def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_and_no_python(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](Tables(spark, sf_dir)))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    # the plug-in is called before, and what it gave is read from the ledger
    assert "Python" not in plan and "InPandas" not in plan


def test_only_needed_columns_are_read(spark, sf_dir):
    plan = plan_of(QUERIES["feature_rollup"](Tables(spark, sf_dir)))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in plan
    assert "ReadSchema: struct<p_partkey:bigint,p_name:string>" in plan


def test_samples_are_limited_before_the_shuffle(spark, sf_dir):
    plan = plan_of(QUERIES["feature_samples"](Tables(spark, sf_dir)))
    assert "row_number(), 3, Partial" in plan


def test_top_accounts_are_not_sorted_in_full(spark, sf_dir):
    assert "TakeOrderedAndProject" in plan_of(QUERIES["top_n_accounts"](Tables(spark, sf_dir)))


def test_missing_accounts_are_spread_over_tasks(spark, sf_dir):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(QUERIES["lookup_account"](Tables(spark, sf_dir)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "hashpartitioning(account_id" in plan and "_spread" in plan.split("hashpartitioning(account_id")[1][:40]


def test_minimum_revenue_reaches_the_account_table(spark, sf_dir):
    plan = plan_of(QUERIES["min_mrr"](Tables(spark, sf_dir)))
    assert "LeftOuter" not in plan.split("BroadcastHashJoin")[1][:200]
    assert ">= 1000.00" in plan


def test_checkpoints_go_to_the_folder_of_the_session(spark):
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert session.shared_dir(spark) == folder
    assert session.scratch_path(spark, "x").startswith(folder)


def test_a_local_checkpoint_folder_is_for_local_mode_only(spark, monkeypatch):
    from pyspark import SparkConf

    monkeypatch.setattr(session, "_is_local", lambda spark: False)
    monkeypatch.setattr(type(spark.sparkContext), "getConf", lambda self: SparkConf(loadDefaults=False).set("spark.checkpoint.dir", "file:///tmp/x"))
    with pytest.raises(ValueError):
        session.shared_dir(spark)
