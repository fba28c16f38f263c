"""Feedback with its account, owner and creating user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedback_rank.functions import columns as C
from feedback_rank.functions.membership import Bloom, bloom
from feedback_rank.operators.scope import among, source_conditions
from feedback_rank.schemas import FEEDBACK_RAW, MONEY
from feedback_rank.spec import RunSpec


def read_raw(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Landed records with their parents nested in them; the schema is fixed, also when empty."""
    return spark.read.format(fmt).schema(FEEDBACK_RAW).options(**options).load(path)


def flatten(raw: DataFrame) -> DataFrame:
    """Nested records to the flat feedback table.

    A missing parent reads as '' and 0. A parent that is there keeps the nulls
    of its text fields. Numbers that are none become 0, dates null.
    """
    account = F.col("Account__r")

    def text_of(parent: Column, field: str) -> Column:
        return F.when(parent.isNull(), F.lit("")).otherwise(parent[field])

    return raw.select(
        text_of(account["Owner"], "Name").alias("account_owner"),
        text_of(account, "Platform_Client_ID__c").alias("platform_client_id"),
        text_of(account, "Name").alias("account_name"),
        C.to_money(account["MRR_Last_Month__c"]).alias("mrr"),
        C.to_money(account["Last_Invoiced_TPV__c"]).alias("tpv"),
        F.col("Name").alias("insight_id"),
        C.to_ts(F.col("CreatedDate")).alias("created_at"),
        F.col("Subcategory__c").alias("subcategory"),
        F.col("Additional_feedback__c").alias("feedback"),
        text_of(F.col("CreatedBy"), "Name").alias("created_by"),
        F.col("RecordType.DeveloperName").alias("record_type"),
    )


def lookup_account(fact: DataFrame, accounts: DataFrame) -> DataFrame:
    """Add account and owner to each record by ``account_id``; none reads as '' and 0.

    No broadcast hint: the optimizer broadcasts the accounts when their size
    allows it and sorts and merges otherwise, splitting hot accounts at run time.
    Records without an account are many and match nothing, so they are spread
    over the tasks by their insight id instead of meeting in one.
    """
    no_account = F.col("account_id").isNull()
    left = fact.withColumn("_spread", F.when(no_account, F.xxhash64("insight_id")).otherwise(0)).alias("f")
    right = accounts.withColumn("_spread", F.when(no_account, F.xxhash64("account_name")).otherwise(0)).alias("a")
    joined = left.join(
        right,
        (F.col("f.account_id") == F.col("a.account_id")) & (F.col("f._spread") == F.col("a._spread")),
        "left",
    )
    missing = F.col("a.account_id").isNull()

    def text(field: str) -> Column:
        return F.when(missing, F.lit("")).otherwise(F.col(f"a.{field}")).alias(field)

    def number(field: str) -> Column:
        return F.coalesce(F.col(f"a.{field}"), F.lit(0).cast(MONEY)).alias(field)

    kept = [F.col(f"f.{name}") for name in fact.columns]
    return joined.select(
        *kept, text("account_owner"), text("platform_client_id"), text("account_name"), number("mrr"), number("tpv")
    )


def lookup_creator(fact: DataFrame, users: DataFrame) -> DataFrame:
    """Add the name of the creating user by ``creator_id``; none reads as ''.

    Records without a creator match nothing, and are spread as those without an account are.
    """
    spread = F.when(F.col("creator_id").isNull(), F.xxhash64("insight_id")).otherwise(0)
    left, right = fact.withColumn("_spread", spread).alias("f"), users.withColumn("_spread", F.lit(0).cast("long")).alias("u")
    same = (F.col("f.creator_id") == F.col("u.user_id")) & (F.col("f._spread") == F.col("u._spread"))
    joined = left.join(right, same, "left")
    name = F.when(F.col("u.user_id").isNull(), F.lit("")).otherwise(F.col("u.user_name"))
    return joined.select(*[F.col(f"f.{c}") for c in fact.columns], name.alias("created_by"))


def read_feedback(
    fact: DataFrame, accounts: DataFrame, spec: RunSpec, newest_first: bool = True,
    subcategories: DataFrame | None = None, account_owners: DataFrame | None = None,
) -> DataFrame:
    """The feedback a run asks for, with account and owner, newest first.

    The conditions reach the scans: those on the record the fact table, those on
    the owner the account table. Dates before the first day with data are moved to it.

    Lists too long for a condition come as tables, whose first columns are the values, and
    hold beside those of ``spec``. Such a list is a bloom filter at the scan first, which is
    made at once: of the categories for the records; of the owners for the accounts, and of the accounts
    left for the records. The join by the values themselves then comes last, on few rows.
    """
    spec = spec.bounded()
    if subcategories is not None:
        fact = _sifted(fact, "subcategory", bloom(subcategories))
    if account_owners is not None:
        value = F.col(account_owners.columns[0])
        if account_owners.where(value == "").isEmpty():  # records without an account have the owner ''
            accounts = _sifted(accounts, "account_owner", bloom(account_owners))
            fact = _sifted(fact, "account_id", bloom(accounts.select("account_id")))
    joined = lookup_account(fact, accounts)
    found = joined.where(source_conditions(spec, joined)).select(
        "account_owner", "platform_client_id", "account_name", "mrr", "tpv",
        "insight_id", "created_at", "subcategory", "feedback", "created_by",
    )
    for column, values in (("subcategory", subcategories), ("account_owner", account_owners)):
        if values is not None:
            found = among(found, column, values)
    return found.orderBy(F.desc("created_at"), "insight_id") if newest_first else found


def _sifted(df: DataFrame, column: str, values: Bloom | None) -> DataFrame:
    return df if values is None else df.where(values.may_hold(F.col(column)))


def describe(df: DataFrame) -> DataFrame:
    """Name, label and type of each column; the label is the column comment, if any."""
    rows = [
        (field.name, (field.metadata or {}).get("comment") or field.name, field.dataType.simpleString())
        for field in df.schema.fields
    ]
    schema = T.StructType([T.StructField(name, T.StringType(), False) for name in ("name", "label", "type")])
    return df.sparkSession.createDataFrame(rows, schema)
