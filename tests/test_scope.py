from datetime import date, datetime
from decimal import Decimal

import pytest

from feedback_rank import RunSpec, describe, filter_options, flatten, read_feedback, read_raw, scope, scope_totals
from feedback_rank.operators.scope import created_between, keep_top_accounts
from feedback_rank.schemas import FEEDBACK_RAW
from feedback_rank.spec import MINIMUM_MRR, TOP_N_ACCOUNTS

FACT = "insight_id string, account_id long, record_type string, created_at timestamp_ntz, subcategory string, feedback string, created_by string"
ACCOUNT = "account_id long, account_name string, platform_client_id string, mrr decimal(18,2), tpv decimal(18,2), account_owner string"


def _raw(**fields):
    base = dict.fromkeys(FEEDBACK_RAW.names)
    return {**base, **fields}


def test_flatten_edges(spark):
    rows = [
        _raw(Name="1"),
        _raw(Name="2", CreatedDate="2025-10-01T12:34:56.000+0000", CreatedBy={"Name": "u"}, Account__r={
            "Name": None, "Platform_Client_ID__c": None, "MRR_Last_Month__c": "12.50", "Last_Invoiced_TPV__c": "x", "Owner": None}),
        _raw(Name="3", CreatedDate="bad", CreatedBy={"Name": None}, Account__r={
            "Name": "A", "Platform_Client_ID__c": "C", "MRR_Last_Month__c": None, "Last_Invoiced_TPV__c": "7", "Owner": {"Name": None}}),
    ]
    flat = {r["insight_id"]: r for r in flatten(spark.createDataFrame(rows, FEEDBACK_RAW)).collect()}
    none, nulls, full = flat["1"], flat["2"], flat["3"]
    assert (none.account_name, none.account_owner, none.platform_client_id, none.created_by) == ("", "", "", "")
    assert (none.mrr, none.tpv) == (0, 0)
    assert (nulls.account_name, nulls.platform_client_id, nulls.account_owner) == (None, None, "")
    assert (nulls.mrr, nulls.tpv, nulls.created_by) == (Decimal("12.50"), 0, "u")
    assert (full.mrr, full.tpv, full.account_owner, full.created_at, full.created_by) == (0, 7, None, None, None)


def test_empty_source_keeps_its_schema(spark, tmp_path):
    path = str(tmp_path / "raw")
    spark.createDataFrame([], FEEDBACK_RAW).write.parquet(path)
    raw = read_raw(spark, path)
    assert flatten(raw).columns[:3] == ["account_owner", "platform_client_id", "account_name"]
    assert flatten(raw).count() == 0
    labels = {r["name"]: (r["label"], r["type"]) for r in describe(raw).collect()}
    assert labels["Name"] == ("Insight ID", "string")
    assert set(labels) == set(FEEDBACK_RAW.names)


def test_describe_without_comment(spark):
    assert [tuple(r) for r in describe(spark.range(1)).collect()] == [("id", "id", "bigint")]


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
def test_last_second_of_the_end_day(spark, kind):
    moments = ["2025-09-30 23:59:59", "2025-10-01 00:00:00", "2025-10-02 23:59:59", "2025-10-02 23:59:59.5", "2025-10-03 00:00:00"]
    df = spark.createDataFrame([(m,) for m in moments], "t string").selectExpr(f"cast(t as {kind}) as created_at", "t")
    for condition in created_between(df, RunSpec(date(2025, 10, 1), date(2025, 10, 2))):
        df = df.where(condition)
    assert sorted(r["t"] for r in df.collect()) == moments[1:3]


@pytest.fixture
def tables(spark):
    at = datetime(2025, 10, 5)
    fact = [
        ("i1", 1, "Client_Feedback", at, "s1", "need ACH now", "u"),
        ("i2", 2, "Client_Feedback", at, "s2", "reach", "u"),
        ("i3", None, "Client_Feedback", at, None, None, "u"),
        ("i4", 9, "Client_Feedback", at, "s1", "no such account", "u"),
        ("i5", 1, "Other", at, "s1", "ACH", "u"),
        ("i6", 1, "Client_Feedback", datetime(2025, 10, 6), "s1", "ach again", "u"),
    ]
    accounts = [(1, "A", "CL-1", Decimal("10"), Decimal("1"), "o1"), (2, "B", "", Decimal("2000"), Decimal("2"), "o2")]
    return spark.createDataFrame(fact, FACT), spark.createDataFrame(accounts, ACCOUNT)


def test_read_feedback(tables):
    rows = read_feedback(*tables, RunSpec()).collect()
    assert [r["insight_id"] for r in rows] == ["i6", "i1", "i2", "i3", "i4"]
    by_id = {r["insight_id"]: r for r in rows}
    assert (by_id["i3"].account_name, by_id["i3"].mrr) == ("", 0)
    assert (by_id["i4"].account_owner, by_id["i4"].tpv) == ("", 0)
    assert by_id["i1"].account_owner == "o1"


@pytest.mark.parametrize("spec, ids", [
    (RunSpec(subcategories=["s1"]), {"i1", "i4", "i6"}),
    (RunSpec(account_owners=["o2"]), {"i2"}),
    (RunSpec(account_owners=[""]), {"i3", "i4"}),
    (RunSpec(start_date=date(2025, 10, 6)), {"i6"}),
    (RunSpec(keyword="ach"), {"i1", "i6"}),
    (RunSpec(mrr_filter=MINIMUM_MRR, min_mrr=1000.0), {"i2"}),
    (RunSpec(mrr_filter=MINIMUM_MRR, min_mrr=0.0), {"i1", "i2", "i3", "i4", "i6"}),
    (RunSpec(mrr_filter=TOP_N_ACCOUNTS, top_n=1), {"i2"}),
    (RunSpec(mrr_filter=TOP_N_ACCOUNTS, top_n=1, keyword="ach"), set()),
    (RunSpec(mrr_filter=TOP_N_ACCOUNTS, top_n=0), {"i1", "i2", "i3", "i4", "i6"}),
])
def test_scope(tables, spec, ids):
    found = read_feedback(*tables, spec, newest_first=False)
    assert {r["insight_id"] for r in scope(found, spec).collect()} == ids


def test_top_n_tie_goes_to_the_smaller_name(spark):
    df = spark.createDataFrame([("z", Decimal(5)), ("b", Decimal(5)), ("a", Decimal(5)), (None, Decimal(9))], "account_name string, mrr decimal(18,2)")
    assert {r["account_name"] for r in keep_top_accounts(df, 2).collect()} == {"a", "b"}


def test_scope_totals(tables, spark):
    total = scope_totals(read_feedback(*tables, RunSpec(), newest_first=False)).first()
    assert tuple(total) == (5, 3, Decimal("2020.00"))
    nothing = scope_totals(read_feedback(*tables, RunSpec(keyword="", start_date=date(2030, 1, 1)), newest_first=False)).first()
    assert tuple(nothing) == (0, 0, 0)
    nulls = spark.createDataFrame([(None, Decimal(1)), ("", Decimal(1))], "account_name string, mrr decimal(18,2)")
    assert tuple(scope_totals(nulls).first()) == (2, 1, Decimal("2.00"))


def test_filter_options(tables):
    from feedback_rank.sources.feedback import lookup_account

    options = [tuple(r) for r in filter_options(lookup_account(*tables)).collect()]
    assert options == [("account_owner", "o1"), ("account_owner", "o2"), ("subcategory", "s1"), ("subcategory", "s2")]
