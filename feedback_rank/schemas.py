"""Fixed shapes of the tables that are read and written."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

# A record as landed from the source, with its parents nested in it.
FEEDBACK_RAW = T.StructType([
    T.StructField("Name", T.StringType(), metadata={"comment": "Insight ID"}),
    T.StructField("CreatedDate", T.StringType(), metadata={"comment": "Created Date"}),
    T.StructField("Subcategory__c", T.StringType(), metadata={"comment": "Subcategory"}),
    T.StructField("Additional_feedback__c", T.StringType(), metadata={"comment": "Additional feedback"}),
    T.StructField("RecordType", T.StructType([T.StructField("DeveloperName", T.StringType())]),
                  metadata={"comment": "Record Type"}),
    T.StructField("Account__r", T.StructType([
        T.StructField("Name", T.StringType()),
        T.StructField("Platform_Client_ID__c", T.StringType()),
        T.StructField("MRR_Last_Month__c", T.StringType()),
        T.StructField("Last_Invoiced_TPV__c", T.StringType()),
        T.StructField("Owner", T.StructType([T.StructField("Name", T.StringType())])),
    ]), metadata={"comment": "Account"}),
    T.StructField("CreatedBy", T.StructType([T.StructField("Name", T.StringType())]),
                  metadata={"comment": "Created By"}),
])

# The flat table the filters and totals run on, in export order.
FEEDBACK = T.StructType([
    T.StructField("account_owner", T.StringType()),
    T.StructField("platform_client_id", T.StringType()),
    T.StructField("account_name", T.StringType()),
    T.StructField("mrr", MONEY),
    T.StructField("tpv", MONEY),
    T.StructField("insight_id", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("subcategory", T.StringType()),
    T.StructField("feedback", T.StringType()),
    T.StructField("created_by", T.StringType()),
])

FILTERS = T.StructType([
    T.StructField("subcategories", T.ArrayType(T.StringType())),
    T.StructField("account_owners", T.ArrayType(T.StringType())),
    T.StructField("mrr_filter", T.StringType()),
    T.StructField("min_mrr", T.DoubleType()),
    T.StructField("top_n", T.IntegerType()),
    T.StructField("keyword", T.StringType()),
])

RUNS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("start_date", T.DateType()),
    T.StructField("end_date", T.DateType()),
    T.StructField("filters", T.StringType()),
    T.StructField("total_feedbacks", T.LongType()),
    T.StructField("unique_accounts", T.LongType()),
    T.StructField("total_mrr", MONEY),
])

RUN_FEATURES = T.StructType([
    T.StructField("run_id", T.LongType()),
    T.StructField("rank", T.LongType()),
    T.StructField("feature", T.StringType()),
    T.StructField("total_mrr", MONEY),
    T.StructField("account_count", T.LongType()),
    T.StructField("sample_feedbacks", T.StringType()),
    T.StructField("ai_insight", T.StringType()),
])

# The accounts of a run's features, one row each.
RUN_ACCOUNTS = T.StructType([
    T.StructField("run_id", T.LongType()),
    T.StructField("feature", T.StringType()),
    T.StructField("account_name", T.StringType()),
    T.StructField("platform_client_id", T.StringType()),
    T.StructField("mrr", MONEY),
    T.StructField("label", T.StringType()),
])

# What a run's card shows of its features.
RUN_CARDS = T.StructType([
    T.StructField("run_id", T.LongType()),
    T.StructField("feature_count", T.LongType()),
    T.StructField("top_features", T.ArrayType(T.StructType([
        T.StructField("rank", T.LongType()),
        T.StructField("feature", T.StringType()),
        T.StructField("mrr", T.StringType()),
        T.StructField("account_count", T.LongType()),
    ]))),
])

# Saves that were deleted.
DELETED_RUNS = T.StructType([T.StructField("run_id", T.LongType()), T.StructField("save_id", T.StringType())])
