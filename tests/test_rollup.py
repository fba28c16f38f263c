import re
from collections import defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from feedback_rank.operators import rollup
from feedback_rank.operators.numbering import number_rows

MENTION = "feature string, account_name string, platform_client_id string, mrr decimal(18,2), sample string"


@pytest.mark.parametrize("tasks", ["1", "3", "8"])
@pytest.mark.parametrize("groups", [[], ["g"]])
def test_number_rows_equals_row_number(spark, tasks, groups):
    """One group holds most of the rows and spans several tasks; one group is null."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(5000).select(
            F.when(F.col("id") % 10 < 8, F.lit("hot")).when(F.col("id") % 10 == 8, F.lit(None)).otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"),
            (F.xxhash64("id") % 1000).alias("k"), "id",
        )
        window = Window.partitionBy(*(groups or [F.lit(0)])).orderBy(F.desc("k"), "id")
        plain = df.withColumn("n", F.row_number().over(window))
        assert number_rows(df, [F.desc("k"), F.col("id")], groups, "n").exceptAll(plain.withColumn("n", F.col("n").cast("long"))).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.fixture
def mentions(spark):
    rows = [
        ("export", "A", "1", Decimal("10.00"), "s3"), ("export", "A", "1", Decimal("12.00"), "s1"),
        ("export", "A", "2", Decimal("5.00"), "s2"), ("export", "B", "", Decimal("1.50"), "s4"),
        ("export", "B", "", Decimal("1.50"), "s1"), ("login", "C", None, Decimal("18.50"), None),
        ("login", "C", "", Decimal("18.00"), None),
        ("empty", None, None, None, " "), ("long", "D", "4", Decimal("0.00"), "x" * 300),
    ]
    return spark.createDataFrame(rows, MENTION)


def test_rank_features(mentions):
    rows = {r["feature"]: r for r in rollup.rank_features(mentions).collect()}
    labelled = {r["feature"]: r["accounts"] for r in rollup.with_labels(rollup.rank_features(mentions), rollup.feature_accounts(mentions)).collect()}
    assert labelled == {"export": "A (1), A (2), B", "login": "C", "empty": "", "long": "D (4)"}
    assert [r["rank"] for r in sorted(rows.values(), key=lambda r: r["rank"])] == [1, 2, 3, 4]
    export = rows["export"]
    # equal revenue: the smaller text first
    assert (export["rank"], export["total_mrr"], export["account_count"]) == (1, Decimal("18.50"), 3)
    assert rows["export"]["account_count"] == 3
    assert export["sample_feedbacks"] == "s1 | s2 | s3"
    assert export["ai_insight"] == "3 accounts with $18.50 of monthly recurring revenue asked for this. Place 1 by revenue, priority high."
    assert (rows["login"]["rank"], rows["login"]["sample_feedbacks"]) == (2, "")
    assert rows["login"]["ai_insight"].startswith("1 account with $18.50")
    assert (rows["empty"]["total_mrr"], rows["empty"]["account_count"]) == (0, 0)
    assert rows["long"]["sample_feedbacks"] == "x" * 200


def test_one_row_per_feature_and_one_per_account(spark):
    mentions = spark.range(25_000).select(
        F.lit("hot").alias("feature"), F.format_string("a%05d", "id").alias("account_name"), F.lit("").alias("platform_client_id"),
        F.lit(1).cast("decimal(18,2)").alias("mrr"), F.lit("s").alias("sample"),
    )
    ranked, accounts = rollup.rank_features(mentions), rollup.feature_accounts(mentions)
    row = ranked.collect()
    assert len(row) == 1 and (row[0]["rank"], row[0]["account_count"], row[0]["total_mrr"]) == (1, 25_000, Decimal("25000.00"))
    assert accounts.count() == 25_000
    assert rollup.with_labels(ranked, accounts).first()["accounts"].split(", ") == [f"a{i:05d}" for i in range(25_000)]


def test_samples_with_a_common_opening_are_different(spark):
    mentions = spark.createDataFrame([("f", "A", "", Decimal(1), "x" * 250 + str(i % 2)) for i in range(6)], MENTION)
    assert rollup.feature_samples(mentions).first()["samples"] == ["x" * 200] * 2
    keyed = mentions.withColumn("sample_key", F.lit(1)).withColumn("sample", F.substring("sample", 1, 200))
    assert rollup.feature_samples(keyed).first()["samples"] == ["x" * 200]


def test_an_insight_of_its_own_is_kept(spark):
    mentions = spark.createDataFrame(
        [("f", "A", "", Decimal(2), None, None), ("f", "B", "", Decimal(1), None, "sell it"), ("g", "B", "", Decimal(1), None, " ")], MENTION + ", insight string"
    )
    found = {r["feature"]: r["ai_insight"] for r in rollup.rank_features(mentions).collect()}
    assert found["f"] == "sell it" and found["g"].startswith("1 account with $1.00")


def test_rollup_by_hand(spark, sf_dir):
    from checks.tables import Tables

    mentions = Tables(spark, sf_dir).account_mention()
    best = defaultdict(dict)
    for r in mentions.select("feature", "account_name", "platform_client_id", "mrr").distinct().collect():
        key = (r["account_name"], r["platform_client_id"])
        best[r["feature"]][key] = max(r["mrr"], best[r["feature"]].get(key, r["mrr"]))
    want = {f: (sum(v.values()), len(v)) for f, v in best.items()}
    got = {r["feature"]: (r["total_mrr"], r["account_count"]) for r in rollup.feature_rollup(mentions).collect()}
    assert got == want


def test_joined_labels_have_a_bound(spark):
    accounts = spark.createDataFrame([("f", "ab"), ("f", "cde"), ("g", "x")], "feature string, label string")
    assert {r[0]: r[1] for r in rollup.joined_labels(accounts, most_characters=7).collect()} == {"f": "ab, cde", "g": "x"}
    with pytest.raises(ValueError, match=r"'f',.*7 characters, above 6"):
        rollup.joined_labels(accounts, most_characters=6)
    assert rollup.joined_labels(accounts.limit(0), most_characters=0).collect() == []


def test_mentions_cut_once_give_the_same(spark, mentions):
    mentions = mentions.unionByName(spark.createDataFrame([("idle", None, None, None, "s9"), (None, "N", "1", Decimal(2), "s5")], MENTION))
    once = rollup.written_once(mentions)
    every = lambda df: sorted(map(str, df.collect()))
    assert every(rollup.feature_accounts(mentions, once)) == every(rollup.feature_accounts(mentions))
    assert every(rollup.rank_features(mentions, once)) == every(rollup.rank_features(mentions))
    labelled = rollup.with_labels(rollup.rank_features(mentions, once), rollup.feature_accounts(mentions, once))
    assert every(labelled) == every(rollup.with_labels(rollup.rank_features(mentions), rollup.feature_accounts(mentions)))


def test_accounts_cut_once_are_not_shuffled_again(spark, mentions):
    plan = rollup.feature_accounts(mentions, rollup.written_once(mentions))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_samples_of_a_task_are_limited_before_they_are_told_apart(spark):
    """Many rows of few texts, and many texts: distinct ones count, a task sends no more than three of a feature."""
    rows = spark.range(20000, numPartitions=4).select(
        F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.lit(None)).alias("feature"),
        F.when(F.col("id") % 4 < 2, F.concat(F.lit("a"), F.col("id") % 2)).otherwise(F.concat(F.lit("b"), F.lpad(F.col("id").cast("string"), 5, "0"))).alias("sample"),
    )
    found = rollup.feature_samples(rows)
    assert re.search(r"dense_rank\(.*\), 3, Partial", found._jdf.queryExecution().executedPlan().toString())
    assert {r["feature"]: r["samples"] for r in found.collect()} == {"hot": ["a0", "b00002", "b00006"], None: ["a1", "b00003", "b00007"]}
