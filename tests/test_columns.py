"""Edge rows of the column helpers."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from feedback_rank.functions import columns as C
from feedback_rank.functions.text import is_actionable, words
from feedback_rank.spec import MINIMUM_MRR, TOP_N_ACCOUNTS, RunSpec


@pytest.fixture
def value(spark):
    """One value through one helper."""
    def run(helper, text, kind="string"):
        df = spark.createDataFrame([(text,)], f"c {kind}")
        return df.select(helper(F.col("c")).alias("v")).first()["v"]

    return run


@pytest.mark.parametrize("text, expected", [
    ("abc", 0), ("1,000", 0), ("", 0), ("NaN", 0), (None, 0), ("12d", 0), ("1f", 0), ("0x10", 0),
    (" 12 ", 12), ("1e3", 1000), ("-.5", -0.5), ("+7.", 7), ("inf", float("inf")),
])
def test_to_number(value, text, expected):
    assert value(C.to_number, text) == expected


@pytest.mark.parametrize("text, expected", [("inf", 0), ("1e30", 0), ("12.345", Decimal("12.35")), ("-3", -3)])
def test_to_money_that_does_not_fit_is_zero(value, text, expected):
    assert value(C.to_money, text) == expected


@pytest.mark.parametrize("text, expected", [
    ("bad", None), ("", None), (None, None),
    ("2025-10-01T12:34:56.000+0000", datetime(2025, 10, 1, 12, 34, 56)),
    ("2025-10-01T12:34:56Z", datetime(2025, 10, 1, 12, 34, 56)),
])
def test_to_ts(value, text, expected):
    assert value(lambda c: C.to_ts(c).cast("timestamp_ntz"), text) == expected


@pytest.mark.parametrize("text, keyword, expected", [
    ("reach", "ACH", False), ("ACH.", "ACH", True), ("an ach file", " ACH ", True), ("ouè", "ou", False),
    ("C++ api", "C++", False), ("axb", "a.b", False), ("a.b", "a.b", True), (None, "x", False),
    ("pay roll", "pay roll", True), ("ÉCOLE", "école", True), ("a_b", "a", False), ("x\\E y", "E y", True),
])
def test_keyword_match(value, text, keyword, expected):
    assert value(lambda c: C.keyword_match(c, keyword), text) is expected


@pytest.mark.parametrize("text, expected", [
    (None, False), ("", False), (" \t", False), (" ", False), ("\x1c", False), (" a ", True), (" \n", False),
])
def test_nonblank(value, text, expected):
    assert value(C.nonblank, text) is expected
    assert expected == bool((text or "").strip())


def test_strip_nul(value):
    assert value(C.strip_nul, "a\0b\0") == "ab"
    assert value(C.strip_nul, None) is None


def test_truncate_counts_code_points(value):
    assert value(lambda c: C.truncate(c, 3), "é𝄞ab") == "é𝄞a"


@pytest.mark.parametrize("name, client_id, expected", [
    ("Acme", "CL-1", "Acme (CL-1)"), ("Acme", "", "Acme"), ("Acme", None, "Acme"), (None, "CL-1", " (CL-1)"),
])
def test_account_label(spark, name, client_id, expected):
    df = spark.createDataFrame([(name, client_id)], "n string, i string")
    assert df.select(C.account_label(F.col("n"), F.col("i"))).first()[0] == expected


def test_samples(value):
    joined = value(C.sample_join, ["a", "b", "c", "d", "e"], "array<string>")
    assert joined == "a | b | c"
    assert value(C.sample_split, joined) == ["a", "b", "c"]
    assert value(C.sample_split, "a | b") == ["a", "b"]
    assert value(C.sample_split, " |\t| x | y | z | w") == ["x", "y", "z"]
    assert value(C.sample_split, None) == []


@pytest.mark.parametrize("number, expected", [(0.125, "0.12"), (2.675, "2.67"), (1234567.891, "1,234,567.89"), (-12.5, "-12.50")])
def test_money(value, number, expected):
    assert value(C.money, number, "double") == expected == f"{number:,.2f}"


def test_prompt_line(spark):
    df = spark.createDataFrame([("Acme", None, Decimal("1234.50"), "x" * 600)], "n string, i string, m decimal(18,2), t string")
    line = df.select(C.prompt_line(F.col("n"), F.col("i"), F.col("m"), F.col("t"))).first()[0]
    assert line == "Acme |  | $1,234.50 | " + "x" * 600


@pytest.mark.parametrize("spec, tags", [
    (RunSpec(), []),
    (RunSpec(subcategories=["a", "b"], account_owners=["o"]), ["a", "b", "o"]),
    (RunSpec(mrr_filter=MINIMUM_MRR, min_mrr=1234.0, subcategories=["a"]), ["a", "MRR >= $1,234"]),
    (RunSpec(mrr_filter=MINIMUM_MRR), []),
    (RunSpec(mrr_filter=TOP_N_ACCOUNTS, top_n=5), ["Top 5 accounts"]),
    (RunSpec(mrr_filter=TOP_N_ACCOUNTS), []),
])
def test_filters_round_trip(spark, spec, tags):
    row = spark.range(1).select(C.filters_parse(C.filters_json(spec)).alias("f")).select(
        "f", C.filter_tags(F.col("f")).alias("tags")
    ).first()
    assert row["tags"] == tags
    assert tuple(row["f"]["subcategories"]) == spec.subcategories
    assert (row["f"]["mrr_filter"], row["f"]["min_mrr"], row["f"]["top_n"]) == (spec.mrr_filter, spec.min_mrr, spec.top_n)


@pytest.mark.parametrize("text", [None, "{}", '{"subcategories":null,"mrr_filter":null}'])
def test_filters_defaults(value, text):
    parsed = value(C.filters_parse, text)
    assert parsed.asDict() == {
        "subcategories": [], "account_owners": [], "mrr_filter": "No filter", "min_mrr": 0.0, "top_n": 0, "keyword": "",
    }


def test_words(value):
    assert value(words, "Ünïted  we-stand, 2_x!") == ["ünïted", "we", "stand", "2_x"]


@pytest.mark.parametrize("text, expected", [
    ("We would like an export to CSV", True), ("Necesitamos una integración", True), ("Great product!", False),
    ("It is slow", False), ("I need to reset my password", False), ("kneed", False), (None, False),
    ("In my case we need ACH payouts please", True), ("En mi caso necesitamos pagos", True),
    ("I was locked out. We need dark mode.", True), ("I was locked out and need help!\nThanks.", False), ("ticket number 5, I want it", False),
])
def test_is_actionable(value, text, expected):
    assert value(is_actionable, text) is expected


def test_run_spec():
    assert RunSpec.last_days(date(2026, 2, 1)).start_date == date(2025, 11, 3)
    assert RunSpec.last_days(date(2025, 11, 1)).start_date == date(2025, 10, 1)
    assert RunSpec(start_date=date(2024, 1, 1)).bounded().start_date == date(2025, 10, 1)
    with pytest.raises(ValueError):
        RunSpec(mrr_filter="all")
