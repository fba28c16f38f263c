"""Filters of a run, its totals and its option lists."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedback_rank.functions import columns as C
from feedback_rank.schemas import MONEY
from feedback_rank.spec import MINIMUM_MRR, TOP_N_ACCOUNTS, RunSpec

# Fixed value: the record type of client feedback.
CLIENT_FEEDBACK = "Client_Feedback"


def is_client_feedback() -> Column:
    return F.col("record_type") == CLIENT_FEEDBACK


def created_between(df: DataFrame, spec: RunSpec) -> list[Column]:
    """From the first second of the start day to the last one of the end day, in UTC."""
    zoned = dict(df.dtypes)["created_at"] == "timestamp"

    def moment(day, clock: str) -> Column:
        text = f"{day.isoformat()}T{clock}"
        return F.lit(text + "Z").cast("timestamp") if zoned else F.lit(text).cast("timestamp_ntz")

    conditions = []
    if spec.start_date:
        conditions.append(F.col("created_at") >= moment(spec.start_date, "00:00:00"))
    if spec.end_date:
        conditions.append(F.col("created_at") <= moment(spec.end_date, "23:59:59"))
    return conditions


def source_conditions(spec: RunSpec, df: DataFrame) -> Column:
    """All conditions that are set, joined by AND."""
    conditions = [is_client_feedback(), *created_between(df, spec)]
    if spec.subcategories:
        conditions.append(F.col("subcategory").isin(*spec.subcategories))
    if spec.account_owners:
        conditions.append(F.col("account_owner").isin(*spec.account_owners))
    return reduce(and_, conditions, F.lit(True))


def among(feedback: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """Rows whose ``column`` is in the first column of ``values``: for lists too long for a condition."""
    listed = values.select(F.col(values.columns[0]).alias(column)).distinct()
    return feedback.join(listed, column, "left_semi").select(*feedback.columns)


def at_least_mrr(feedback: DataFrame, minimum: float) -> DataFrame:
    return feedback.where(F.col("mrr") >= F.lit(str(minimum)).cast(MONEY)) if minimum > 0 else feedback


def top_accounts(feedback: DataFrame, n: int) -> DataFrame:
    """The n account names with the highest revenue; ties go to the smaller name."""
    return (
        feedback.where(F.col("account_name").isNotNull())
        .groupBy("account_name")
        .agg(F.max("mrr").alias("top_mrr"))
        .orderBy(F.desc_nulls_last("top_mrr"), "account_name")
        .limit(n)
    )


def keep_top_accounts(feedback: DataFrame, n: int) -> DataFrame:
    """Rows of the top n accounts; the list holds n rows, so the join needs no shuffle of the feedback."""
    if n <= 0:
        return feedback
    return feedback.join(top_accounts(feedback, n).select("account_name"), "account_name", "left_semi")


def has_keyword(feedback: DataFrame, keyword: str) -> DataFrame:
    return feedback.where(C.keyword_match(F.col("feedback"), keyword)) if keyword.strip() else feedback


def scope(feedback: DataFrame, spec: RunSpec) -> DataFrame:
    """Revenue filter first, keyword second: fewer than n accounts may be left."""
    if spec.mrr_filter == MINIMUM_MRR:
        feedback = at_least_mrr(feedback, spec.min_mrr)
    elif spec.mrr_filter == TOP_N_ACCOUNTS:
        feedback = keep_top_accounts(feedback, spec.top_n)
    return has_keyword(feedback, spec.keyword)


def scope_totals(feedback: DataFrame) -> DataFrame:
    """One row: records, distinct account names, and revenue summed per record.

    Rows are first cut to one per account name, so a hot account is a single row
    by the time names are counted.
    """
    per_account = feedback.groupBy("account_name").agg(F.count("*").alias("records"), F.sum("mrr").alias("mrr"))
    return per_account.agg(
        F.coalesce(F.sum("records"), F.lit(0)).cast("long").alias("total_feedbacks"),
        F.count("account_name").alias("unique_accounts"),
        F.coalesce(F.sum("mrr"), F.lit(0)).cast(MONEY).alias("total_mrr"),
    )


def filter_options(feedback: DataFrame) -> DataFrame:
    """Distinct categories and owners of client feedback, in one pass, in order."""
    choices = F.explode(F.array(
        F.struct(F.lit("subcategory").alias("kind"), F.col("subcategory").alias("value")),
        F.struct(F.lit("account_owner").alias("kind"), F.col("account_owner").alias("value")),
    ))
    return (
        feedback.where(is_client_feedback())
        .select(choices.alias("choice"))
        .select("choice.kind", "choice.value")
        # a missing owner reads as '', an empty category is one
        .where(F.col("value").isNotNull() & ((F.col("kind") == "subcategory") | (F.col("value") != "")))
        .distinct()
        .orderBy("kind", "value")
    )
