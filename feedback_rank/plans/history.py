"""Past runs as cards and in detail."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedback_rank.functions import columns as C
from feedback_rank.functions.names import free_names
from feedback_rank.sources.history import load_card_parts, load_runs

TOP_SHOWN = 3  # fixed value: features shown on a card


def top_features(features: DataFrame, n: int = TOP_SHOWN) -> DataFrame:
    """The first n features of each run; the filter is a group limit, applied before the shuffle."""
    by_rank = Window.partitionBy("run_id").orderBy("rank")
    (place,) = free_names(features.columns, "place")
    return features.withColumn(place, F.row_number().over(by_rank)).where(F.col(place) <= n).drop(place)


def card_parts(features: DataFrame) -> DataFrame:
    """(run_id, feature_count, top_features): what a run's card shows of its features."""
    shown = F.struct("rank", "feature", C.money(F.col("total_mrr"), 2).alias("mrr"), "account_count")
    counts = features.groupBy("run_id").agg(F.count("*").alias("feature_count"))
    top = top_features(features).groupBy("run_id").agg(F.array_sort(F.collect_list(shown)).alias("top_features"))
    return counts.join(top, "run_id").select("run_id", "feature_count", "top_features")


def history_cards(runs: DataFrame, features: DataFrame) -> DataFrame:
    """A row per run: date, period, totals, filter tags, feature count, top three, how many more.

    One job for all runs.
    """
    return _cards(runs, card_parts(features))


def saved_cards(spark: SparkSession, path: str) -> DataFrame:
    """The cards of a history, from what each save counted: no feature is read."""
    return _cards(load_runs(spark, path), load_card_parts(spark, path))


def _cards(runs: DataFrame, parts: DataFrame) -> DataFrame:
    filters = C.filters_parse(F.col("filters"))
    number = F.coalesce("feature_count", F.lit(0))
    return (
        runs.join(parts, runs["id"] == parts["run_id"], "left")
        .select(
            "id",
            F.date_format("created_at", "yyyy-MM-dd").alias("run_date"),
            F.concat_ws(" to ", F.col("start_date").cast("string"), F.col("end_date").cast("string")).alias("period"),
            "total_feedbacks",
            F.coalesce(F.col("unique_accounts").cast("string"), F.lit("-")).alias("unique_accounts"),
            F.concat(F.lit("$"), C.money(F.col("total_mrr"), 0)).alias("mrr_in_scope"),
            C.filter_tags(filters).alias("tags"),
            number.alias("feature_count"),
            "top_features",
            F.greatest(number - TOP_SHOWN, F.lit(0)).alias("more_features"),
            "created_at",
        )
        .orderBy(F.desc("created_at"), F.desc("id"))
        .drop("created_at")
    )


def history_detail(runs: DataFrame, features: DataFrame) -> DataFrame:
    """All features of all runs, newest run first, features by rank."""
    header = runs.select(F.col("id").alias("run_id"), "created_at")
    return (
        features.join(header, "run_id")
        .orderBy(F.desc("created_at"), F.desc("run_id"), "rank")
        .select("created_at", *features.columns)
    )
