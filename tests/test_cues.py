"""Scores against plain ones, and held-out accuracy against the listed cues."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from feedback_rank.functions.text import is_actionable
from feedback_rank.operators import cues
from feedback_rank.operators.cues import CueModel, asks, cue_score, run_buckets, sentences_of, train_cues
from feedback_rank.plans.analyze import analyze

THINGS = ["a dark theme", "bulk invoices", "payouts in euro", "an audit log", "single sign on", "a Slack bot", "exportar nóminas", "pagos por lote"]
ASKING = ["Could you build {}?", "It'd be great to have {}.", "Podrían ofrecer {}?", "We are missing {} badly.", "Any plans for {}?"]
TELLING = ["We add rows every day to {}.", "They want nothing but {} as it is.", "Our request for {} was closed.", "Thanks, {} works.", "Gracias por {}.", "The feature {} was slow."]


def _sentences(seed, n):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        asked = rng.random() < 0.3
        filler = " ".join(rng.choice(["today", "maybe", "again", "here", "hoy", "sí"]) for _ in range(rng.randrange(4)))
        rows.append((filler + " " + rng.choice(ASKING if asked else TELLING).format(rng.choice(THINGS)), asked))
    return rows


def _plain_buckets(text, buckets, run_words):
    words = [w for w in re.split(r"[^\w]+", (text or "").lower()) if w]
    runs = [" ".join(words[i:i + n]) for n in range(1, run_words + 1) for i in range(len(words) - n + 1)]
    return {int(hashlib.md5(run.encode()).hexdigest()[:7], 16) % buckets for run in runs}


@pytest.mark.parametrize("buckets,run_words", [(64, 1), (1024, 2), (1024, 3)])
def test_scores_equal_plain_ones(spark, buckets, run_words):
    texts = [t for t, _ in _sentences(1, 50)] + [None, "", "...", "one", "one two", "one one one one"]
    model = CueModel(tuple((i * 7 % 13 - 6) / 8 for i in range(buckets)), -0.5, run_words)
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", cue_score(F.col("t"), model).alias("s"), run_buckets(F.col("t"), buckets, run_words).alias("b"))
    for row in rows.collect():
        expected = _plain_buckets(row["t"], buckets, run_words)
        assert set(row["b"]) == expected and len(row["b"]) == len(expected)
        assert row["s"] == -0.5 + sum(model.weights[b] for b in expected)


def test_held_out_accuracy_is_above_the_lists(spark):
    schema = "sentence string, label boolean"
    model = train_cues(spark.createDataFrame(_sentences(2, 600), schema))
    held_out = spark.createDataFrame(_sentences(3, 400), schema)
    right = held_out.select(
        F.avg((asks(F.col("sentence"), model) == F.col("label")).cast("double")).alias("learned"),
        F.avg((is_actionable(F.col("sentence")) == F.col("label")).cast("double")).alias("listed"),
    ).first()
    assert right["learned"] > 0.97 > 0.8 > right["listed"]


def _plain_training(rows, buckets, rounds=12, rate=0.5, ridge=1e-4):
    """(weights, bias), one sentence after the other."""
    rows = [(_plain_buckets(text, buckets, 2), bool(label)) for text, label in rows]
    count = {kind: sum(label == kind for _, label in rows) for kind in (True, False)}
    weights, seen = [0.0] * (buckets + 1), [0.0] * (buckets + 1)
    for _ in range(rounds):
        slopes = [ridge * w for w in weights[:-1]] + [0.0]
        for found, label in rows:
            total = weights[-1] + sum(weights[b] for b in found)
            error = (1 / (1 + math.exp(-total)) - label) * 0.5 / count[label]
            for b in (*found, buckets):
                slopes[b] += error
        for b, slope in enumerate(slopes):
            seen[b] += slope * slope
            if seen[b]:
                weights[b] -= rate * slope / math.sqrt(seen[b])
    return weights[:-1], weights[-1]


def test_training_equals_plain_training(spark):
    rows = _sentences(5, 200) + _sentences(5, 20)
    weights, bias = _plain_training(rows, 512)
    model = train_cues(spark.createDataFrame(rows, "sentence string, label boolean"), buckets=512)
    assert model.weights == pytest.approx(weights, abs=1e-9) and model.bias == pytest.approx(bias, abs=1e-9)


def test_query_equals_plain_training(spark, sf_dir):
    from checks.queries import QUERIES, labelled_sentences
    from checks.tables import Tables
    from feedback_rank.operators.cues import BUCKETS

    t = Tables(spark, sf_dir)
    weights, bias = _plain_training([tuple(r) for r in labelled_sentences(t).collect()], BUCKETS)
    best = {}
    for row in sentences_of(t.letter()).select("insight_id", "sentence").collect():
        score = bias + sum(weights[b] for b in _plain_buckets(row["sentence"], BUCKETS, 2))
        best[row["insight_id"]] = max(score, best.get(row["insight_id"], -math.inf))
    assert {r[0] for r in QUERIES["learned_requests"](t).collect()} == {i for i, score in best.items() if score > 0}
    asked = {i for i in best if int(i[4:]) % 4 in (0, 2)}
    assert asked <= {i for i, score in best.items() if score > 0} and len({i for i in best if best[i] > 0} - asked) <= 0.02 * len(best)


def test_one_kind_null_rows_and_no_rows(spark):
    def trained(rows):
        return train_cues(spark.createDataFrame(rows, "sentence string, label int"), buckets=16, rounds=2)

    texts = spark.createDataFrame([("please build it",), (None,), ("",), ("...",)], "t string")
    for rows, found in (([("x", 1), ("y", None), (None, 0)], [True, False, False, False]), ([("x", 0)], [False] * 4), ([], [False] * 4)):
        assert [r[0] for r in texts.select(asks(F.col("t"), trained(rows))).collect()] == found


def test_a_rare_kind_and_copies_weigh_the_same(spark):
    rows = [("all is well", 0)] * 5000 + [("all was well", 0)] * 3 + [("build us a log", 1)]
    model = train_cues(spark.createDataFrame(rows, "sentence string, label int"), buckets=256)
    texts = spark.createDataFrame([("All is well. Build us a log!", True), ("All is well. All was well", False)], "t string, a boolean")
    assert texts.where(asks(F.col("t"), model) != F.col("a")).count() == 0


def test_sentences_and_scoring_without_python(spark):
    texts = spark.createDataFrame([(1, "One. Two!  Three\nfour", "x"), (2, None, "y"), (3, " . ", "z")], "id int, feedback string, sentence string")
    assert sorted((r["id"], r["sentence"]) for r in sentences_of(texts).collect()) == [(1, "One."), (1, "Three"), (1, "Two!"), (1, "four")]
    plan = texts.where(asks(F.col("feedback"), CueModel((0.0,) * 32)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "from_json" not in plan


def test_analysis_with_a_model(spark):
    model = train_cues(spark.createDataFrame(_sentences(2, 300), "sentence string, label boolean"))
    rows = [(f"i{i}", t, "A", "CL", 5) for i, t in enumerate(["Could you build a dark theme?", "Thanks, a dark theme works."])]
    feedback = spark.createDataFrame(rows, "insight_id string, feedback string, account_name string, platform_client_id string, mrr int").withColumn("mrr", F.col("mrr").cast("decimal(18,2)"))
    phrases = spark.createDataFrame([("dark", "dark theme")], "feature string, phrase string")
    assert analyze(feedback, phrases).first()["sample_feedbacks"].count("|") == 1
    assert analyze(feedback, phrases, request_cues=model).first()["sample_feedbacks"] == "Could you build a dark theme?"


def test_a_round_scores_a_sentence_once(spark):
    """Below the explode: above it, a sentence would be scored as often as it has buckets, each time over all of them."""
    rows = spark.createDataFrame([(True, 1.0, [1, 2])], "asked boolean, times double, buckets array<int>")
    errors = cues._errors(rows, cues.CueModel((0.5,) * 4), F.col("times"))
    plan = errors._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("Generate") < plan.index("aggregate(")
    assert sorted(r["bucket"] for r in errors.collect()) == [1, 2, 4]
