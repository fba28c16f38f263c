import random
import re
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from checks.tables import Tables
from feedback_rank.operators import calls, extract, payload
from feedback_rank.plans.analyze import analyze_with

FEEDBACK = (
    "insight_id string, created_at timestamp_ntz, account_name string, platform_client_id string, "
    "mrr decimal(18,2), feedback string"
)


def _feedback(spark, texts):
    rows = [
        (f"i{i:03d}", datetime(2025, 10, 1) + timedelta(hours=i), f"A{i % 3}", "CL", Decimal(i % 3), text)
        for i, text in enumerate(texts)
    ]
    return spark.createDataFrame(rows, FEEDBACK)


def _words(text):
    return [w for w in re.split(r"[^\w]+", text.lower()) if w]


def _by_hand(texts, phrases):
    found = set()
    for i, text in enumerate(texts):
        line = " " + " ".join(_words(text or "")) + " "
        for feature, phrase in phrases:
            if _words(phrase) and " " + " ".join(_words(phrase)) + " " in line:
                found.add((f"i{i:03d}", feature))
    return found


TEXTS = [
    "Please add export to CSV, and soon", "export to csv now please add it", "EXPORT  to\nCSV", None, "  ", "reach ach",
    "we would like to see dark mode and we would like to see ach", "to to to to csv", "would like to see", "a b c d e f g",
]
PHRASES = [
    ("csv", "export to CSV"), ("csv now", "export to csv now please"), ("ach", "ACH"), ("dark", "we would like to see dark mode"),
    ("ach too", "We would like to see ACH"), ("none", "..."), ("repeat", "to to to csv"), ("twice", "ach"),
    ("long", "b c d e f"), ("end", "d e f g"), ("over", "e f g h"),
]


@pytest.fixture(params=["64mb", "-1"])
def joins(spark, request):
    """Both ways of the optimizer: with the phrase table broadcast, and without."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(name)
    spark.conf.set(name, request.param)
    yield
    spark.conf.set(name, old)


def test_mentions_by_hand(spark, joins):
    found = extract.extract_mentions(_feedback(spark, TEXTS), spark.createDataFrame(PHRASES, "feature string, phrase string"))
    rows = found.collect()
    assert {(r["insight_id"], r["feature"]) for r in rows} == _by_hand(TEXTS, PHRASES)
    assert len(rows) == len({(r["insight_id"], r["feature"]) for r in rows})
    assert {r["sample"] for r in rows if r["insight_id"] == "i000"} == {TEXTS[0]}


def test_ids_may_be_null_or_repeated(spark, joins):
    feedback = _feedback(spark, ["reach ach", "no ach", "no ach", None, "dark"]).withColumn(
        "insight_id", F.when(F.col("feedback").isNull() | (F.col("feedback") == "reach ach"), F.lit(None)).otherwise(F.lit("same"))
    ).withColumn("account_name", F.lit(None).cast("string"))
    found = extract.extract_mentions(feedback, spark.createDataFrame([("ach", "ACH"), ("dark", "dark")], "feature string, phrase string"))
    assert sorted((r["insight_id"] or "", r["feature"], r["mrr"]) for r in found.collect()) == [
        ("", "ach", Decimal(0)), ("same", "ach", Decimal(1)), ("same", "ach", Decimal(2)), ("same", "dark", Decimal(1))
    ]


def test_generated_rows_hold_no_words(spark, sf_dir):
    t = Tables(spark, sf_dir)
    plan = extract.extract_mentions(t.feedback(), t.phrase())._jdf.queryExecution().optimizedPlan().toString()
    # of the rows' columns the third, the words, is not handed on
    assert ", [2], false, [at#" in plan


def test_no_phrases_no_mentions(spark):
    none = spark.createDataFrame([], "feature string, phrase string")
    assert extract.extract_mentions(_feedback(spark, TEXTS), none).count() == 0


def test_a_common_opening_is_not_the_key(spark):
    phrases = [(f"f{i}", f"we would like to have thing{i} in it") for i in range(20)]
    keys = extract.phrase_keys(spark.createDataFrame(phrases, "feature string, phrase string")).collect()
    assert len({r["gram"] for r in keys}) == 20


def test_normalize_phrases(spark):
    mentions = spark.createDataFrame([("Exportar, CSV", "A"), ("dark mode", "B"), (None, "C")], "feature string, account_name string")
    synonyms = spark.createDataFrame([("exportar csv", "export to csv"), ("EXPORTAR CSV", "z")], "phrase string, canonical string")
    got = {r["account_name"]: r["feature"] for r in extract.normalize_phrases(mentions, synonyms).collect()}
    assert got == {"A": "export to csv", "B": "dark mode", "C": None}


def test_chunks(spark):
    feedback = _feedback(spark, [f"t{i}" for i in range(23)])
    rows = extract.assign_chunks(feedback, 10).collect()
    newest_first = sorted(rows, key=lambda r: r["insight_id"], reverse=True)
    assert [r["chunk_id"] for r in newest_first] == [i // 10 for i in range(23)]


class TestRetry:
    def _call(self, errors):
        made, waited = [], []

        def fn(data):
            made.append(data)
            if len(made) <= len(errors):
                raise RuntimeError(errors[len(made) - 1])
            return "done"

        try:
            result = calls.Lane(fn, sleep=waited.append)("x")
        except RuntimeError as error:
            result = str(error)
        return result, len(made), waited

    def test_first_try(self):
        assert self._call([]) == ("done", 1, [])

    def test_rate_limit_once(self):
        assert self._call(["429 slow down"]) == ("done", 2, [30])

    def test_rate_limit_three_times(self):
        assert self._call(["429"] * 3) == ("429", 3, [30, 60])

    def test_other_error(self):
        assert self._call(["500"]) == ("500", 1, [])

    def test_other_error_after_a_rate_limit(self):
        assert self._call(["429", "500"]) == ("500", 2, [30])


def test_plugin_chunks(spark):
    """Good, fenced, unreadable and failing chunks; the good ones go on."""
    texts = ["one", None, "two", "three", " ", "four", "five"]

    def fn(lines):
        if "five" in lines:
            raise ValueError("model gone")
        if "three" in lines:
            return "{oops"
        import json

        accounts = [dict(zip(("name", "platform_client_id"), line.split(" | "))) for line in lines.split("\n")]
        return "```json\n" + json.dumps([{"feature": lines.split(" | ")[-1], "accounts": accounts}]) + "\n```"

    ranked, status = analyze_with(_feedback(spark, texts), fn, chunk_size=1)
    assert {r["status"]: r["chunks"] for r in status.collect()} == {"ok": 3, "failed": 2}
    assert {r["feature"] for r in ranked.collect()} == {"one", "two", "four"}


def test_plugin_sees_lines_newest_first(spark):
    seen = extract.extract_plugin(_feedback(spark, ["a", "b", "c"]), lambda lines: lines, chunk_size=2)
    rows = {r["chunk_id"]: r["payload"] for r in seen.collect()}
    assert rows == {0: "A2 | CL | $2.00 | c\nA1 | CL | $1.00 | b", 1: "A0 | CL | $0.00 | a"}


def _texts_of_lines(spark, texts, **options):
    rows = extract.prompt_lines(_feedback(spark, texts), **options).orderBy("insight_id", "part").collect()
    found = {f"i{i:03d}": [] for i in range(len(texts))}
    for r in rows:
        assert r["part"] == len(found[r["insight_id"]]) + 1
        found[r["insight_id"]].append(r["line"].split(" | ", 3)[3])
    return list(found.values())


def _plain_windows(text, length, overlap):
    out, now, at = [], None, 0
    for piece in re.findall(r"(?s).*?(?:[.!?…][ \t\r\n]+|[\r\n]+)|.+", text):
        size = len(piece.rstrip(" \t\r\n"))
        begin, end, at = at, at + size, at + len(piece)
        if not size:
            continue
        if now and end - now[0] <= length:
            now = now[0], end, begin
            continue
        if now:
            out.append(now[:2])
        if size > length:
            while begin + length < end:
                out.append((begin, begin + length))
                begin += length - overlap
            now = begin, end, begin
        else:
            now = (now[2], end, begin) if now and end - now[2] <= length else (begin, end, begin)
    return [text[a:b] for a, b in out + ([now[:2]] if now else [])]


def test_windows_by_hand(spark):
    text = "".join(chr(97 + i % 26) for i in range(1234))  # one long sentence: cut
    assert _texts_of_lines(spark, [text]) == [[text[:500], text[400:900], text[800:1300]]]
    assert _texts_of_lines(spark, [text], first_only=True) == [[text[:500]]]
    assert [len(x) for x in _texts_of_lines(spark, ["x" * n for n in (1, 499, 500, 501, 900, 901)])] == [1, 1, 1, 2, 2, 3]
    three = [c * 200 + "." for c in "abc"]
    assert _texts_of_lines(spark, [" ".join(three)]) == [[" ".join(three[:2]), " ".join(three[1:])]]
    # no room for a sentence of the line before
    assert _texts_of_lines(spark, ["a" * 400 + ". " + "b" * 450 + "!"]) == [["a" * 400 + ".", "b" * 450 + "!"]]
    with pytest.raises(ValueError):
        extract.prompt_lines(_feedback(spark, ["x"]), overlap=500)


@pytest.mark.parametrize("length,overlap", [(20, 5), (30, 0), (7, 6)])
def test_windows_equal_plain_ones(spark, length, overlap):
    rng = random.Random(length)
    texts = ["".join(rng.choice("abc🙂. !\n?… ") for _ in range(rng.randrange(1, 120))) for _ in range(500)] + ["..", "\n\n", ". a. b", "a.\r\n b"]
    assert _texts_of_lines(spark, texts, length=length, overlap=overlap) == [
        _plain_windows(t, length, overlap) if t.strip() else [] for t in texts
    ]


def test_a_sentence_is_whole_in_some_line_wherever_it_stands(spark):
    wish = "We would like to export all payments of the last three years to a file that our accountants can open without your app."
    texts = ["y" * 60 + ". " + "x" * n + ". " + wish + " " + "z" * 700 + "." for n in range(0, 620, 3)]
    assert all(any(wish in line for line in lines) for lines in _texts_of_lines(spark, texts))
    # and every sentence of a text of many
    rng = random.Random(4)
    sentences = ["".join(rng.choice("ab ") for _ in range(rng.randrange(1, 490))).strip() + "w." for _ in range(300)]
    (lines,) = _texts_of_lines(spark, [" ".join(sentences)])
    assert all(any(s in line for line in lines) for s in sentences) and max(map(len, lines)) <= 500


def test_chunks_keep_texts_together(spark):
    rng = random.Random(8)
    # texts of 1 to 9 lines, and some of more than a chunk
    counts = [rng.choice([1, 1, 2, 3, 9, 25]) for _ in range(90)]
    texts = ["\n".join([f"t{i:02d}" + "x" * 400] * n) for i, n in enumerate(counts)]
    found = {r["chunk_id"]: r for r in extract.chunked_lines(_feedback(spark, texts), 10, pack_texts=40).collect()}
    expected, chunk, room = [], [], 10
    for place, i in enumerate(reversed(range(90))):
        lines = [f"t{i:02d}"] * counts[i]
        if chunk and (place % 40 == 0 or len(chunk) + len(lines) > room):
            expected.append(chunk)
            chunk = []
        chunk = chunk + lines
        while len(chunk) > room:
            expected.append(chunk[:room])
            chunk = chunk[room:]
    expected.append(chunk)
    assert sorted(found) == list(range(len(expected)))
    for chunk_id, lines in enumerate(expected):
        assert [line.split(" | ")[3][:3] for line in found[chunk_id]["lines"].split("\n")] == lines
        assert found[chunk_id]["n_lines"] == len(lines)


def test_own_names_beside_the_callers(spark):
    feedback = _feedback(spark, ["a", "b"]).selectExpr(
        "*", "1 AS n", "2 AS _n", "3 AS at", "4 AS task", "5 AS first", "6 AS rows", "7 AS before", "8 AS p", "9 AS o", "10 AS _at", "11 AS chunk_id"
    )
    rows = extract.assign_chunks(feedback, 1, ["feedback"]).collect()
    assert sorted((r["chunk_id"], r["feedback"], r["n"], r["_n"], r["at"], r["task"], r["first"], r["rows"], r["before"], r["p"], r["o"], r["_at"]) for r in rows) == [
        (0, "b", 1, 2, 3, 4, 5, 6, 7, 8, 9, 10), (1, "a", 1, 2, 3, 4, 5, 6, 7, 8, 9, 10)
    ]


def test_late_phrases_of_whole_texts(spark):
    """A phrase behind texts of any length counts once a text: in one window, in two, and after many."""
    from checks.queries import late_phrases

    # 470 to 530, 870 to 930: the phrase crosses a window's end or stands in the overlap of two
    sizes = [1, 620, 1700, 9000, *range(380, 540), *range(860, 940)]
    feedback = _feedback(spark, ["y" * n for n in sizes] + [None, "  "])
    assert [tuple(r) for r in late_phrases(feedback, F.lit(True)).collect()] == [("late", "found", len(sizes) + 2)]
    assert [tuple(r) for r in late_phrases(feedback, F.col("insight_id") < "i004").collect()] == [("late", "found", 4)]
    assert late_phrases(feedback, F.lit(False)).count() == 0


def test_late_phrase_query_keeps_texts_whole(spark, sf_dir, monkeypatch):
    from checks import queries

    t, seen = Tables(spark, sf_dir), []
    real = extract.extract_plugin
    monkeypatch.setattr(extract, "extract_plugin", lambda feedback, fn: seen.append(feedback) or real(feedback, fn))
    queries.QUERIES["extract_late_phrase"](t)
    whole = {r.insight_id: r.feedback for r in t.feedback().collect()}
    read = {r.insight_id: r.feedback for r in seen[0].collect()}
    assert set(read) == set(whole)
    assert all((read[i] or "").startswith(text or "") for i, text in whole.items())


def test_plugin_error_is_kept(spark):
    def fn(lines):
        raise ValueError("model gone")

    row = extract.extract_plugin(_feedback(spark, ["a"]), fn).first()
    assert tuple(row) == (0, "failed", "model gone", None)
    parsed = payload.parse_payload(extract.extract_plugin(_feedback(spark, ["a"]), fn)).first()
    assert (parsed["status"], parsed["error"], parsed["features"]) == ("failed", "model gone", [])
