"""Payload texts of an extraction to features and mentions."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedback_rank.functions import columns as C
from feedback_rank.schemas import MONEY

OK, FAILED = "ok", "failed"
UNNAMED = "Unknown"  # fixed value: the name of a feature without one

_FEATURES = (
    "array<struct<feature:string,accounts:array<struct<name:string,platform_client_id:string,mrr:double>>,"
    "sample_feedbacks:array<string>,total_mrr:double,account_count:bigint,insight:string>>"
)


def _unfence(text: Column) -> Column:
    """Drop a fence of three back quotes, with its language word, around the stripped text."""
    inner = F.regexp_replace(F.regexp_replace(text, r"^```[^\n]*(\n|$)", ""), r"(^|\n)[^\S\n]*```$", "")
    return F.when(text.startswith("```"), C.strip(inner)).otherwise(text)


def _is_object(item: Column) -> Column:
    return F.try_variant_get(item, "$", "map<string,variant>").isNotNull()


def _is_account(account: Column) -> Column:
    """An object, or a text, which is the account's name."""
    return _is_object(account) | F.coalesce(F.schema_of_variant(account) == "STRING", F.lit(False))


def _account(account: Column) -> Column:
    name = F.when(_is_object(account), F.try_variant_get(account, "$.name", "string")).otherwise(F.try_variant_get(account, "$", "string"))
    return F.struct(
        F.coalesce(name, F.lit("")).alias("name"),
        F.coalesce(F.try_variant_get(account, "$.platform_client_id", "string"), F.lit("")).alias("platform_client_id"),
        F.coalesce(F.try_variant_get(account, "$.mrr", "double"), F.lit(0.0)).alias("mrr"),
    )


def _all_accounts(item: Column) -> Column:
    return F.coalesce(F.try_variant_get(item, "$.accounts", "array<variant>"), F.array().cast("array<variant>"))


def _feature(item: Column) -> Column:
    """One feature with every missing or null key filled in."""
    accounts = F.filter(_all_accounts(item), _is_account)
    samples = F.coalesce(
        F.try_variant_get(item, "$.sample_feedbacks", "array<string>"), F.array().cast("array<string>")
    )
    return F.struct(
        F.coalesce(F.try_variant_get(item, "$.feature", "string"), F.lit(UNNAMED)).alias("feature"),
        F.transform(accounts, _account).alias("accounts"),
        samples.alias("sample_feedbacks"),
        F.coalesce(F.try_variant_get(item, "$.total_mrr", "double"), F.lit(0.0)).alias("total_mrr"),
        F.coalesce(F.try_variant_get(item, "$.account_count", "bigint"), F.size(accounts).cast("bigint")).alias("account_count"),
        F.coalesce(F.try_variant_get(item, "$.insight", "string"), F.lit("")).alias("insight"),
    )


def _skipped_accounts(item: Column) -> Column:
    accounts = _all_accounts(item)
    return F.size(accounts) - F.size(F.filter(accounts, _is_account))


# A JSON text, or a number that JSON has not: the texts are matched so that nothing in them is.
_TEXT_OR_NON_NUMBER = r'("(?:[^"\\]++|\\.)*+")|(?:-?\b(?:NaN|Infinity)\b)'
_MARK = "\u0001"


def _with_null_numbers(text: Column) -> Column:
    """NaN and the infinities, where they stand as numbers, as null."""
    marked = F.regexp_replace(text, _TEXT_OR_NON_NUMBER, "$1" + _MARK)
    return F.replace(F.replace(marked, F.lit('"' + _MARK), F.lit('"')), F.lit(_MARK), F.lit("null"))


@contextmanager
def _repeated_keys(spark: SparkSession) -> Iterator[None]:
    """While plans are made: of a key given twice the last one counts. Plans keep this, the session does not."""
    setting = "spark.sql.variant.allowDuplicateKeys"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def parse_payload(payloads: DataFrame) -> DataFrame:
    """(chunk_id, status, error, payload) to (chunk_id, status, error, features, skipped).

    The payload may be bare or fenced; an array of features or an object that
    holds one under ``features``; any other JSON value holds none. Of a key given
    twice the last one counts; NaN and infinite numbers are null. ``skipped`` counts
    the features that are no objects and the accounts that are neither objects nor
    names. Text that is no JSON fails its chunk, the other chunks go on.

    The text is parsed as the one element of an array, since a plain parse stops
    after the first value and ignores what follows. Each step is a column of its
    own, so that nothing is parsed twice.
    """
    text, value = F.col("_text"), F.col("_values")[0]

    def parsed(json: Column) -> Column:
        return F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), json, F.lit("]"))), "$", "array<variant>")

    values = F.coalesce(parsed(text), F.when(text.rlike("NaN|Infinity"), parsed(_with_null_numbers(text))))
    items = (
        F.when(text.startswith("["), F.try_variant_get(value, "$", "array<variant>"))
        .when(text.startswith("{"), F.try_variant_get(value, "$.features", "array<variant>"))
    )
    one_value = F.coalesce(F.size("_values") == 1, F.lit(False))
    unreadable = (F.col("status") == OK) & ~F.col("_readable")
    skipped = F.size("_items") - F.size("_objects") + F.aggregate(
        "_objects", F.lit(0), lambda total, item: total + _skipped_accounts(item)
    )
    with _repeated_keys(payloads.sparkSession):
        return (
            payloads.withColumn("_stripped", C.strip(F.col("payload")))
            .withColumn("_text", _unfence(F.col("_stripped")))
            .withColumn("_values", values)
            .withColumn("_readable", one_value)
            .withColumn("_items", F.when(one_value, F.coalesce(items, F.array().cast("array<variant>"))))
            .withColumn("_objects", F.filter("_items", _is_object))
            .select(
                "chunk_id",
                F.when(unreadable, F.lit(FAILED)).otherwise(F.col("status")).alias("status"),
                F.when(unreadable, F.lit("payload is no JSON")).otherwise(F.col("error")).alias("error"),
                F.coalesce(F.transform("_objects", _feature), F.array().cast(_FEATURES)).alias("features"),
                F.coalesce(skipped, F.lit(0)).cast("long").alias("skipped"),
            )
        )


def payload_features(parsed: DataFrame) -> DataFrame:
    """A row per feature, in all chunks that did not fail; repeats are kept.

    A failed chunk has no features. The outer form, with the empty rows taken off
    afterwards, keeps the optimizer from parsing once more to look for empty lists.
    """
    return parsed.selectExpr("chunk_id", "inline_outer(features)").where(F.col("feature").isNotNull())


def payload_mentions(parsed: DataFrame) -> DataFrame:
    """Features to mentions: a row per account, a row per sample, each with the feature's own insight, if any.

    A feature with neither keeps one row, so that it is ranked too.
    """
    mention = "struct<account_name:string,platform_client_id:string,mrr:double,sample:string>"
    accounts = F.transform("accounts", lambda a: F.struct(
        a["name"].alias("account_name"), a["platform_client_id"].alias("platform_client_id"),
        a["mrr"].alias("mrr"), F.lit(None).cast("string").alias("sample"),
    ).cast(mention))
    samples = F.transform("sample_feedbacks", lambda s: F.struct(
        F.lit(None).cast("string").alias("account_name"), F.lit(None).cast("string").alias("platform_client_id"),
        F.lit(None).cast("double").alias("mrr"), s.alias("sample"),
    ).cast(mention))
    return (
        payload_features(parsed)
        .select("chunk_id", "feature", F.nullif("insight", F.lit("")).alias("insight"), F.explode_outer(F.concat(accounts, samples)).alias("m"))
        .select(
            "chunk_id", "feature", "m.account_name", "m.platform_client_id",
            F.col("m.mrr").try_cast(MONEY).alias("mrr"), "m.sample", "insight",
        )
    )


def chunk_status(chunks: DataFrame) -> DataFrame:
    """Chunks by status, with their share of all chunks in whole percent, and the entries skipped in them."""
    everything = Window.partitionBy(F.lit(0))  # over one row per status
    return (
        chunks.groupBy("status")
        .agg(F.count("*").alias("chunks"), F.sum("skipped").alias("skipped"))
        .withColumn("total_chunks", F.sum("chunks").over(everything))
        .withColumn("percent", F.floor(100 * F.col("chunks") / F.col("total_chunks")).cast("int"))
    )
