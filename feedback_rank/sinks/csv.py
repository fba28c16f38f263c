"""CSV exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedback_rank.spec import RunSpec

# Quotes are doubled, blanks kept, nulls and empty texts are empty cells.
_FORMAT = {
    "header": True,
    "encoding": "UTF-8",
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
    "emptyValue": "",
    "timestampFormat": "yyyy-MM-dd HH:mm:ssXXX",
    "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss",
}

# The first words of the two export names.
RAW_EXPORT = "feedback_raw"
FEATURE_EXPORT = "feature_analysis"
ACCOUNT_EXPORT = "feature_accounts"  # our own: the accounts of the features as rows

# The columns of the exports, and their headers.
HEADERS = {
    RAW_EXPORT: {
        "account_owner": "Account Owner", "platform_client_id": "Platform Client ID", "account_name": "Account Name",
        "mrr": "Real MRR Last Month", "tpv": "Last Invoiced TPV", "insight_id": "CS Insight ID", "created_at": "Date",
        "subcategory": "Subcategory", "feedback": "Feedback", "created_by": "Created By",
    },
    FEATURE_EXPORT: {
        "feature": "Feature", "total_mrr": "Total MRR", "account_count": "Account Count", "accounts": "Accounts",
        "sample_feedbacks": "Sample Feedbacks", "ai_insight": "AI Insight",
    },
    ACCOUNT_EXPORT: {
        "feature": "Feature", "account_name": "Account Name", "platform_client_id": "Platform Client ID", "mrr": "Real MRR Last Month",
    },
}


def export_name(kind: str, spec: RunSpec) -> str:
    """Name by kind and date range; Spark writes a folder of that name, a file per task."""
    return f"{kind}_{spec.start_date.isoformat()}_{spec.end_date.isoformat()}.csv"


def export_table(df: DataFrame, kind: str) -> DataFrame:
    """The columns of an export in their order, under the headers its readers know."""
    return df.select(*[F.col(name).alias(header) for name, header in HEADERS[kind].items()])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**_FORMAT).csv(path)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """Read an export back; texts may hold line breaks, so a file is read by one task."""
    return spark.read.options(**_FORMAT, multiLine=True).schema(schema).csv(path)
