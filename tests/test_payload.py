import json
from decimal import Decimal

import pytest

from feedback_rank.operators import payload

ONE = {"feature": "x", "accounts": [{"name": "A", "platform_client_id": "CL-1", "mrr": 2.5}], "sample_feedbacks": ["s"]}


@pytest.fixture
def parse(spark):
    def run(*texts):
        rows = [(i, "ok", None, text) for i, text in enumerate(texts)]
        df = spark.createDataFrame(rows, "chunk_id long, status string, error string, payload string")
        return payload.parse_payload(df)

    return run


@pytest.mark.parametrize("text", [
    json.dumps({"features": [ONE]}), json.dumps([ONE]), "```json\n" + json.dumps({"features": [ONE]}) + "\n```",
    "```\n" + json.dumps([ONE], indent=2) + "\n  ```  ", " \n" + json.dumps([ONE]) + "\t", "```json\n" + json.dumps([ONE]),
])
def test_forms_of_a_payload(parse, text):
    row = parse(text).first()
    assert row["status"] == "ok"
    assert [f.asDict(True) for f in row["features"]] == [{**ONE, "total_mrr": 0.0, "account_count": 1, "insight": ""}]


@pytest.mark.parametrize("text", ['"s"', "12", "null", "true", "{}", "[]", '{"features": null}', '{"features": []}', '{"other": [1]}', "[1, null, \"x\"]"])
def test_payloads_without_features(parse, text):
    row = parse(text).first()
    assert (row["status"], row["error"], row["features"]) == ("ok", None, [])


@pytest.mark.parametrize("text", ["{oops", "", "```", "[1,]", "{'a': 1}", '{"features": []} and more', "1, 2", None, '[] []'])
def test_unreadable_payload_fails_its_chunk_only(parse, text):
    rows = sorted(parse(text, json.dumps([ONE])).collect(), key=lambda r: r["chunk_id"])
    assert (rows[0]["status"], rows[0]["error"], rows[0]["features"]) == ("failed", "payload is no JSON", [])
    assert rows[1]["status"] == "ok" and len(rows[1]["features"]) == 1


@pytest.mark.parametrize("text, mrr", [
    ('{"features": [], "features": [{"feature": "x", "accounts": [{"name": "A", "mrr": 2}]}]}', 2.0),
    ('{"feature": 1, "features": [{"feature": "y", "feature": "x", "accounts": [{"name": "A", "mrr": NaN}]}]}', 0.0),
    ('[{"feature": "x", "accounts": [{"name": "A", "mrr": -Infinity}], "total_mrr": Infinity}]', 0.0),
    ('[{"feature": "x", "accounts": ["A"]}]', 0.0),
])
def test_lenient_forms(parse, text, mrr):
    row = parse(text).first()
    assert row["status"] == "ok" and row["skipped"] == 0
    assert [(f["feature"], [(a["name"], a["mrr"]) for a in f["accounts"]], f["total_mrr"]) for f in row["features"]] == [("x", [("A", mrr)], 0.0)]


def test_texts_keep_their_words(parse):
    row = parse('[{"feature": "NaN, \\"Infinity\\": NaN", "total_mrr": NaN}]').first()
    assert row["status"] == "ok" and row["features"][0]["feature"] == 'NaN, "Infinity": NaN'


def test_the_session_keeps_its_setting(parse, spark):
    parse("[]")
    assert spark.conf.get("spark.sql.variant.allowDuplicateKeys") == "false"


def test_skipped_entries_are_counted(parse):
    row = parse(json.dumps([7, "x", None, {"feature": "f", "accounts": ["A", 3, None, {"name": "B"}, ["C"]]}])).first()
    assert row["skipped"] == 6 and [a["name"] for a in row["features"][0]["accounts"]] == ["A", "B"]
    assert row["features"][0]["account_count"] == 2


def test_missing_and_null_keys(parse):
    text = json.dumps({"features": [
        {}, {"feature": None, "accounts": None, "sample_feedbacks": None}, {"feature": "y", "accounts": [{"mrr": "bad"}, {}]},
        {"feature": "z", "total_mrr": 7, "account_count": 9, "insight": "i"},
    ]})
    features = parse(text).first()["features"]
    assert [f["feature"] for f in features] == ["Unknown", "Unknown", "y", "z"]
    assert [f["account_count"] for f in features] == [0, 0, 2, 9]
    assert [f["total_mrr"] for f in features] == [0, 0, 0, 7]
    assert features[2]["accounts"][0].asDict() == {"name": "", "platform_client_id": "", "mrr": 0.0}
    assert features[3]["insight"] == "i"


def test_mentions(parse):
    text = json.dumps([{**ONE, "sample_feedbacks": ["s", "t"]}, {"feature": "alone"}, ONE])
    rows = [tuple(r)[1:] for r in payload.payload_mentions(parse(text, "{oops")).collect()]
    assert sorted(rows, key=str) == sorted([
        ("x", "A", "CL-1", Decimal("2.50"), None, None), ("x", None, None, None, "s", None), ("x", None, None, None, "t", None),
        ("alone", None, None, None, None, None), ("x", "A", "CL-1", Decimal("2.50"), None, None), ("x", None, None, None, "s", None),
    ], key=str)


def test_chunk_status(parse):
    rows = {r["status"]: tuple(r)[1:] for r in payload.chunk_status(parse("[]", "{oops", "[]")).collect()}
    assert rows == {"ok": (2, 0, 3, 66), "failed": (1, 0, 3, 33)}
