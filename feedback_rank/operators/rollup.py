"""Mentions to ranked features.

A mention is (feature, account_name, platform_client_id, mrr, sample), and may have a
sample_key, which tells the whole texts of cut samples apart, and an insight of its own. A row
may carry an account, a sample, or both; a null account name counts as no account.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedback_rank.functions import columns as C
from feedback_rank.operators.numbering import number_rows
from feedback_rank.schemas import MONEY
from feedback_rank.session import written


def _once(mentions: DataFrame) -> DataFrame:
    """Each account once per feature, with its highest revenue; a missing id is an empty one."""
    client_id = F.coalesce("platform_client_id", F.lit("")).alias("platform_client_id")
    return mentions.groupBy("feature", "account_name", client_id).agg(F.max("mrr").alias("mrr"))


def written_once(mentions: DataFrame) -> DataFrame:
    """The mentions cut to one row per feature and account, written at once.

    For who needs them several times, as ``once`` of :func:`feature_accounts` and :func:`rank_features`: else each
    makes them from all mentions, and so does each job over what they give.
    """
    return written(_once(mentions), "mentions-once")


def feature_accounts(mentions: DataFrame, once: DataFrame | None = None) -> DataFrame:
    """The accounts of each feature, one row each, with their labels: the child table of the ranked one."""
    label, named = C.account_label(F.col("account_name"), F.col("platform_client_id")), F.col("account_name").isNotNull()
    accounts = _once(mentions.where(named)) if once is None else once.where(named)
    return accounts.withColumn("label", label)


def joined_labels(accounts: DataFrame, keys: Sequence[str] = ("feature",), most_characters: int | None = None) -> DataFrame:
    """The labels of :func:`feature_accounts` as one text for each feature.

    For a page or an export: the text of a feature is as long as the list of its accounts, and one task
    makes it. With ``most_characters`` the texts' lengths are summed first, at once, and a longer one raises an
    error before any is made; the accounts as rows have no such bound (``csv.ACCOUNT_EXPORT``).
    """
    if most_characters is not None:
        size = (F.sum(F.length("label") + len(C.LABEL_SEPARATOR)) - len(C.LABEL_SEPARATOR)).alias("size")
        long = accounts.groupBy(*keys).agg(size).where(F.col("size") > most_characters).orderBy(F.desc("size"), *keys).head()
        if long:
            raise ValueError(f"the accounts of {tuple(long[key] for key in keys)} make a text of {long['size']} characters, above {most_characters}")
    return accounts.groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_list("label")), C.LABEL_SEPARATOR).alias("accounts")
    )


def with_labels(ranked: DataFrame, accounts: DataFrame, keys: Sequence[str] = ("feature",), most_characters: int | None = None) -> DataFrame:
    """The ranked table with the joined labels of its accounts, '' where it has none."""
    joined = ranked.join(joined_labels(accounts, keys, most_characters), list(keys), "left")
    return joined.select(*ranked.columns, F.coalesce("accounts", F.lit("")).alias("accounts"))


def feature_rollup(mentions: DataFrame, once: DataFrame | None = None) -> DataFrame:
    """Revenue and number of accounts per feature, features without accounts included.

    Mentions are first cut to one row per feature and account; what is left of a
    hot feature is summed before it is shuffled.
    """
    return _rolled_up(_once(mentions) if once is None else once, F.col("account_name").isNotNull())


def feature_samples(mentions: DataFrame) -> DataFrame:
    """The first three distinct samples per feature, by text, each cut to 200 characters.

    Samples are distinct by their whole text. The window filters are group limits: of the texts of a feature
    in one task only the first three are told apart from those of other tasks, and then each task sends three rows
    per feature.
    """
    key = F.col("sample_key") if "sample_key" in mentions.columns else F.xxhash64("sample")
    texts = mentions.where(C.nonblank(F.col("sample"))).select(
        "feature", C.truncate(F.col("sample"), C.SAMPLE_LENGTH).alias("sample"), key.alias("_key"), F.spark_partition_id().alias("_task")
    )
    first_here = Window.partitionBy("feature", "_task").orderBy("sample", "_key")
    distinct = (
        texts.withColumn("_n", F.dense_rank().over(first_here))
        .where(F.col("_n") <= C.SAMPLES_KEPT)
        .select("feature", "sample", "_key")
        .distinct()
    )
    first = Window.partitionBy("feature").orderBy("sample", "_key")
    return (
        distinct.withColumn("_n", F.row_number().over(first))
        .where(F.col("_n") <= C.SAMPLES_KEPT)
        .groupBy("feature")
        .agg(F.array_sort(F.collect_list("sample")).alias("samples"))
    )


def _rolled_up(once: DataFrame, named: Column) -> DataFrame:
    return once.groupBy("feature").agg(
        F.coalesce(F.sum(F.when(named, F.col("mrr"))), F.lit(0)).cast(MONEY).alias("total_mrr"),
        F.count(F.when(named, 1)).alias("account_count"),
    )


def rank_rows(features: DataFrame) -> DataFrame:
    """Add the place by revenue, highest first, nulls last, ties by feature text."""
    return number_rows(features, [F.desc_nulls_last("total_mrr"), F.col("feature")], name="rank")


def feature_rank(mentions: DataFrame) -> DataFrame:
    """Rank, feature, revenue and number of accounts."""
    return rank_rows(feature_rollup(mentions)).select("rank", "feature", "total_mrr", "account_count")


def insight_text(total_mrr: Column, account_count: Column, rank: Column) -> Column:
    """A short recommendation that names the revenue behind a feature."""
    noun = F.when(account_count == 1, F.lit(" account with $")).otherwise(F.lit(" accounts with $"))
    priority = F.when(rank <= 3, F.lit("high")).when(rank <= 10, F.lit("medium")).otherwise(F.lit("low"))
    return F.concat(
        account_count.cast("string"), noun, C.money(total_mrr, 2),
        F.lit(" of monthly recurring revenue asked for this. Place "), rank.cast("string"),
        F.lit(" by revenue, priority "), priority, F.lit("."),
    )


def rank_features(mentions: DataFrame, once: DataFrame | None = None) -> DataFrame:
    """The ranked table: a row per feature. Its accounts are :func:`feature_accounts`.

    An insight that comes with the mentions is kept, the first by text; the others get the
    template. Numbers the rows at once, which starts jobs.
    """
    ranked = rank_rows(feature_rollup(mentions, once))
    template = insight_text(F.col("total_mrr"), F.col("account_count"), F.col("rank"))
    insight = template
    if "insight" in mentions.columns:
        own = mentions.where(C.nonblank(F.col("insight"))).groupBy("feature").agg(F.min("insight").alias("_insight"))
        ranked, insight = ranked.join(own, "feature", "left"), F.coalesce(F.col("_insight"), template)
    return ranked.join(feature_samples(mentions), "feature", "left").select(
        "rank", "feature", "total_mrr", "account_count",
        F.coalesce(C.sample_join(F.col("samples")), F.lit("")).alias("sample_feedbacks"),
        insight.alias("ai_insight"),
    )
