"""The library's input tables, derived by Spark from the driver's parquet files (FIXTURES.md, part B)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedback_rank.schemas import MONEY

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "benchmark": "item_id bigint, text string",
}


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.sf_dir}/{name}.parquet")

    def spread(self, df: DataFrame) -> DataFrame:
        """Rows over all tasks, for heavy work per row: the driver's files are one row group, so one task, each."""
        return df.repartition(self.spark.sparkContext.defaultParallelism)

    def account(self) -> DataFrame:
        nation = self.read("nation").select("n_nationkey", F.col("n_name").alias("account_owner"))
        customer = self.read("customer")
        client_id = F.when(F.col("c_custkey") % 13 == 0, F.lit("")).otherwise(
            F.concat(F.lit("CL-"), F.col("c_custkey").cast("string"))
        )
        return customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"], "left").select(
            F.col("c_custkey").alias("account_id"),
            F.col("c_name").alias("account_name"),
            client_id.alias("platform_client_id"),
            F.col("c_acctbal").cast(MONEY).alias("mrr"),
            (F.col("c_acctbal") * 10).cast(MONEY).alias("tpv"),
            "account_owner",
        )

    def feedback_fact(self) -> DataFrame:
        doc = F.col("doc_id")
        return self.read("documents").select(
            F.concat(F.lit("CSI-"), F.lpad(doc.cast("string"), 8, "0")).alias("insight_id"),
            "doc_id",
            F.when(doc % 17 != 0, doc % 150).alias("account_id"),
            F.when(doc % 7 == 0, F.lit("Other")).otherwise(F.lit("Client_Feedback")).alias("record_type"),
            F.expr("timestampadd(HOUR, CAST(doc_id AS INT), TIMESTAMP_NTZ '2025-10-01 00:00:00')").alias("created_at"),
            F.when(doc % 31 != 0, F.col("source")).alias("subcategory"),
            F.when(doc % 29 == 0, F.lit(None)).when(doc % 23 == 0, F.lit("  ")).otherwise(F.col("text")).alias("feedback"),
            F.concat(F.lit("user"), (doc % 11).cast("string")).alias("created_by"),
        )

    def feedback(self) -> DataFrame:
        from feedback_rank.sources.feedback import lookup_account

        return lookup_account(self.feedback_fact(), self.account()).drop("account_id")

    def feedback_raw(self) -> DataFrame:
        """Records as landed: parents nested, numbers and dates as text, some of them unreadable."""
        f, a = self.feedback_fact().alias("f"), self.account().alias("a")
        doc, found = F.col("f.doc_id"), F.col("a.account_id").isNotNull()
        mrr = F.when(doc % 19 == 0, F.lit("n/a")).otherwise(F.col("a.mrr").cast("string"))
        client_id = F.when(doc % 5 != 0, F.col("a.platform_client_id"))
        owner = F.when(doc % 3 != 0, F.struct(F.col("a.account_owner").alias("Name")))
        created = F.date_format("f.created_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'+0000'")
        return f.join(a, F.col("f.account_id") == F.col("a.account_id"), "left").select(
            F.col("f.insight_id").alias("Name"),
            F.when(doc % 37 == 0, F.lit("bad")).otherwise(created).alias("CreatedDate"),
            F.col("f.subcategory").alias("Subcategory__c"),
            F.col("f.feedback").alias("Additional_feedback__c"),
            F.struct(F.col("f.record_type").alias("DeveloperName")).alias("RecordType"),
            F.when(found, F.struct(
                F.col("a.account_name").alias("Name"),
                client_id.alias("Platform_Client_ID__c"),
                mrr.alias("MRR_Last_Month__c"),
                F.col("a.tpv").cast("string").alias("Last_Invoiced_TPV__c"),
                owner.alias("Owner"),
            )).alias("Account__r"),
            F.when(doc % 11 != 0, F.struct(F.col("f.created_by").alias("Name"))).alias("CreatedBy"),
        )

    def mention(self) -> DataFrame:
        """(feature, account_id, supplier_id, sample) from the order lines."""
        return self._mention(self.read("orders").select("o_orderkey", F.col("o_custkey").alias("account_id")), "account_id")

    def _mention(self, orders: DataFrame, *columns: str) -> DataFrame:
        """The order lines with their feature and the given columns of their orders."""
        lines = self.read("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
        parts = self.read("part").select("p_partkey", F.col("p_name").alias("feature"))
        sample = F.concat(
            F.lit("req "), F.col("l_orderkey").cast("string"), F.lit("-"),
            F.col("l_linenumber").cast("string"), F.lit("-"), F.col("l_partkey").cast("string"),
        )
        return (
            lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(parts, F.col("l_partkey") == F.col("p_partkey"))
            .select("feature", *columns, F.col("l_suppkey").alias("supplier_id"), "l_orderkey", "l_linenumber", sample.alias("sample"))
        )

    def account_mention(self) -> DataFrame:
        """Mentions in the library's shape; orders meet their accounts first, since there are fewer of them than of lines."""
        orders = self.read("orders").select("o_orderkey", F.col("o_custkey").alias("account_id")).join(self.account(), "account_id")
        return self._mention(orders, "account_name", "platform_client_id", "mrr").select(
            "feature", "account_name", "platform_client_id", "mrr", "sample"
        )

    def feedback_mention(self) -> DataFrame:
        """Each text that is not blank as a request of its account."""
        from feedback_rank.functions.columns import nonblank

        return self.spread(self.feedback()).where(nonblank(F.col("feedback"))).select(
            F.col("feedback").alias("feature"), "account_name", "platform_client_id", "mrr",
            F.substring("feedback", 1, 200).alias("sample"),
        )

    def run_feature(self) -> DataFrame:
        """Past runs: one per supplier, the features of its order lines ranked by the revenue of the customers."""
        from pyspark.sql import Window

        account = self.read("customer").select(F.col("c_custkey").alias("account_id"), F.col("c_acctbal").cast(MONEY).alias("mrr"))
        totals = (
            self.mention().join(account, "account_id").select("supplier_id", "feature", "account_id", "mrr").distinct()
            .groupBy((F.col("supplier_id") + 1).alias("run_id"), "feature")
            .agg(F.sum("mrr").cast(MONEY).alias("total_mrr"), F.count("*").alias("account_count"))
        )
        by_mrr = Window.partitionBy("run_id").orderBy(F.desc("total_mrr"), "feature")
        return totals.select(
            "run_id", F.row_number().over(by_mrr).cast("long").alias("rank"), "feature", "total_mrr", "account_count",
            F.concat(F.lit("one "), F.col("feature"), F.lit(" | two")).alias("sample_feedbacks"),
            F.concat(F.lit("about "), F.col("feature")).alias("ai_insight"),
        )

    def run(self) -> DataFrame:
        """Headers: one run per supplier, and one without features, filters and account count per nation."""
        key, name, balance = F.col("id"), F.col("s_name"), F.col("s_acctbal").cast("string")
        kinds = (
            F.concat(F.lit('{"subcategories":["src1","'), name, F.lit('"],"account_owners":[],"mrr_filter":"No filter","min_mrr":0.0,"top_n":0}')),
            F.concat(F.lit('{"subcategories":[],"account_owners":["'), name,
                     F.lit('"],"mrr_filter":"Minimum MRR","min_mrr":'), balance, F.lit(',"top_n":0}')),
            F.concat(F.lit('{"subcategories":null,"account_owners":[],"mrr_filter":"Top N accounts","min_mrr":0.0,"top_n":'),
                     key.cast("string"), F.lit("}")),
        )
        filters = F.when(key % 3 == 0, kinds[0]).when(key % 3 == 1, kinds[1]).otherwise(kinds[2])
        full = self.read("supplier").select((F.col("s_suppkey") + 1).alias("id"), "s_name", "s_acctbal")
        empty = self.read("nation").select((F.col("n_nationkey") + 1000001).cast("long").alias("id"))
        return full.unionByName(empty, allowMissingColumns=True).select(
            "id",
            F.expr("timestampadd(DAY, CAST(id % 1000 AS INT), TIMESTAMP_NTZ '2025-11-01 00:00:00')").cast("timestamp").alias("created_at"),
            F.lit("2025-10-01").cast("date").alias("start_date"),
            F.lit("2025-12-30").cast("date").alias("end_date"),
            F.when(name.isNotNull(), filters).alias("filters"),
            (key * 40).alias("total_feedbacks"),
            F.when(name.isNotNull(), key * 3).alias("unique_accounts"),
            (key * F.lit(1000.5)).cast(MONEY).alias("total_mrr"),
        )

    def phrase(self) -> DataFrame:
        """Benchmark passages, some of which stand in documents, as the phrases of features."""
        return self.read("benchmark").select(
            F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("feature"), F.col("text").alias("phrase")
        )

    def synonym(self) -> DataFrame:
        """Every part name stands for the first name with the same noun."""
        names = self.read("part").select("p_name").distinct().withColumn("noun", F.substring_index("p_name", " ", -1))
        heads = names.groupBy("noun").agg(F.min("p_name").alias("canonical"))
        return names.join(heads, "noun").select(F.upper("p_name").alias("phrase"), "canonical")

    def topic(self) -> DataFrame:
        """Ten benchmark items each are one topic."""
        item = F.col("item_id")
        return self.read("benchmark").select(
            F.concat(F.lit("ITEM, "), item.cast("string")).alias("phrase"), F.concat(F.lit("topic "), F.floor(item / 10).cast("string")).alias("canonical")
        )

    def letter(self) -> DataFrame:
        """Feedback with a request, a support case, one of each, or nothing more at its end."""
        doc = F.col("doc_id")
        end = (
            F.when(doc % 4 == 0, F.lit(". In my case we need ACH payouts.")).when(doc % 4 == 1, F.lit(". I was locked out and need help."))
            .when(doc % 4 == 2, F.lit(". En mi caso, locked out! Queremos exportar")).otherwise(F.lit(""))
        )
        return self.feedback_fact().select("insight_id", F.concat(F.coalesce("feedback", F.lit("")), end).alias("feedback"))

    def window_end(self):
        """The last day of a window over the first three quarters of all feedback."""
        from datetime import date, timedelta

        last = self.read("documents").agg(F.max("doc_id")).first()[0] or 0
        return date(2025, 10, 1) + timedelta(days=last * 3 // 96)

    def payload(self) -> DataFrame:
        """A payload text per order line, in the forms a payload may have."""
        account = self.account().select("account_id", "account_name", "platform_client_id", "mrr")
        feature = F.struct(
            "feature",
            F.array(F.struct(
                F.col("account_name").alias("name"), "platform_client_id", F.col("mrr").cast("double").alias("mrr")
            )).alias("accounts"),
            F.array("sample").alias("sample_feedbacks"),
        )
        one = F.to_json(F.struct(F.array(feature).alias("features")))
        partial = F.to_json(F.struct(F.array(
            F.struct(F.array(F.struct(F.col("account_name").alias("name"))).alias("accounts"))
        ).alias("features")))
        named = F.to_json(F.struct("feature", F.array("account_name").alias("accounts"), F.array("sample").alias("sample_feedbacks")))
        told = F.to_json(F.struct(F.array(feature.withField("insight", F.concat(F.lit("because "), F.col("feature")))).alias("features")))
        kind = F.when(F.col("l_linenumber") == 1, F.col("l_orderkey") % 5)
        forms = (
            F.when(kind == 1, F.concat(F.lit('{"features": [], '), F.substring(one, 2, 1_000_000)))
            .when(kind == 2, F.regexp_replace(one, '"mrr":[-0-9.E]+', '"mrr": NaN'))
            .when(kind == 3, F.concat(F.lit('{"features": [12, '), F.replace(named, F.lit('"accounts":['), F.lit('"accounts":[7,')), F.lit("]}")))
            .when(kind == 4, told)
            .when(F.col("l_linenumber") == 1, one)
            .when(F.col("l_linenumber") == 2, F.concat(F.lit("```json\n"), one, F.lit("\n```")))
            .when(F.col("l_linenumber") == 3, F.to_json(F.array(feature)))
            .when(F.col("l_linenumber") == 4, F.lit('"nothing found"'))
            .when(F.col("l_linenumber") == 5, F.lit("{oops"))
            .when(F.col("l_linenumber") == 6, partial)
            .otherwise(F.concat(one, F.lit(" and more")))
        )
        return self.spread(self.mention().join(account, "account_id")).select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"),
            F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error"), forms.alias("payload"),
        )
