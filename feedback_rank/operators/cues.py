"""What asks for something, learned from labelled sentences.

A logistic model over hashed runs of one and two words. Every round of training scores the
labelled sentences and sums their errors by bucket in Spark; what reaches the driver is one
number a bucket. The weights are an array in the plan, so scoring is all column work: no
Python worker and no join.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedback_rank.functions.text import SENTENCE_END, words
from feedback_rank.session import checkpointed

BUCKETS = 1 << 12  # weights; what a round brings to the driver, and what a plan holds
RUN_WORDS = 2      # words of the longest run
ROUNDS = 12
RATE = 0.5
RIDGE = 1e-4       # pull of every weight towards 0


@dataclass(frozen=True)
class CueModel:
    """A weight for each bucket of word runs, and what is added to their sum."""

    weights: tuple[float, ...]
    bias: float = 0.0
    run_words: int = RUN_WORDS


def run_buckets(text: Column, buckets: int = BUCKETS, run_words: int = RUN_WORDS) -> Column:
    """The distinct buckets of a text's runs of up to ``run_words`` words: the first 28 bits of their MD5, modulo ``buckets``."""

    def runs(tokens: Column, length: int) -> Column:
        starts = F.when(F.size(tokens) >= length, F.sequence(F.lit(1), F.size(tokens) - (length - 1)))
        return F.coalesce(F.transform(starts, lambda at: F.array_join(F.slice(tokens, at, length), " ")), F.array().cast("array<string>"))

    def hashed(run: Column) -> Column:
        return (F.conv(F.substring(F.md5(run), 1, 7), 16, 10).cast("long") % buckets).cast("int")

    # the words are the element of an array, so that they are split once and not for each run
    split = F.array(words(F.coalesce(text, F.lit(""))))
    found = F.transform(split, lambda tokens: F.transform(F.concat(*[runs(tokens, n) for n in range(1, run_words + 1)]), hashed))
    return F.array_distinct(F.flatten(found))


def _total(buckets: Column, model: CueModel) -> Column:
    weights = F.from_json(F.lit(json.dumps(list(model.weights))), "array<double>")  # folded to a literal by the optimizer
    return F.aggregate(buckets, F.lit(float(model.bias)), lambda total, bucket: total + F.get(weights, bucket))


def cue_score(text: Column, model: CueModel) -> Column:
    """The model's sum for a text as one sentence: above 0 it asks for something. A null text has the bias alone."""
    return _total(run_buckets(text, len(model.weights), model.run_words), model)


def asks(text: Column, model: CueModel) -> Column:
    """True if one of the text's sentences asks for something by the model; false for a null or empty text."""
    sentences = F.filter(F.split(F.coalesce(text, F.lit("")), SENTENCE_END), lambda sentence: F.size(words(sentence)) > 0)
    return F.exists(sentences, lambda sentence: cue_score(sentence, model) > 0)


def sentences_of(texts: DataFrame, column: str = "feedback") -> DataFrame:
    """The texts with a row for each sentence that has a word, in a column ``sentence``."""
    split = F.explode(F.split(F.coalesce(F.col(column), F.lit("")), SENTENCE_END)).alias("sentence")
    return texts.select(*[c for c in texts.columns if c != "sentence"], split).where(F.size(words(F.col("sentence"))) > 0)


def _errors(rows: DataFrame, model: CueModel, share: Column) -> DataFrame:
    """(error, bucket): the error of each sentence, once for every bucket of it and once for the bias."""
    wrong = share * (1 / (1 + F.exp(-_total(F.col("buckets"), model))) - F.col("asked").cast("double"))
    # scored in a select of its own: beside the explode, the row of every bucket would score the whole sentence again
    scored = rows.select(wrong.alias("error"), F.concat("buckets", F.array(F.lit(len(model.weights)))).alias("buckets"))
    return scored.select("error", F.explode("buckets").alias("bucket"))


def train_cues(
    labelled: DataFrame, buckets: int = BUCKETS, run_words: int = RUN_WORDS, rounds: int = ROUNDS, rate: float = RATE, ridge: float = RIDGE
) -> CueModel:
    """A model of ``labelled`` (sentence, label): label 1 or true asks for something, 0 or false does not.

    Rows with a null sentence or label are left out. Both kinds weigh the same in all, however
    rare one of them is; without one of them the model has weights of 0 and decides by the bias.
    Equal sentences are one row with a count before anything is scored, so copies cost nothing,
    and sums are made in tasks first, so no bucket is hot. Runs a job each round.
    """
    asked = F.col("label").cast("double") > 0
    rows = labelled.where("sentence IS NOT NULL AND label IS NOT NULL").groupBy("sentence", asked.alias("asked")).agg(F.count("*").alias("times"))
    rows = checkpointed(rows.select("asked", F.col("times").cast("double").alias("times"), run_buckets(F.col("sentence"), buckets, run_words).alias("buckets")))
    found = {row["asked"]: row["times"] for row in rows.groupBy("asked").agg(F.sum("times").alias("times")).collect()}
    if len(found) < 2:
        return CueModel((0.0,) * buckets, (1.0 if found.get(True) else -1.0), run_words)
    share = F.when(F.col("asked"), 0.5 / found[True]).otherwise(0.5 / found[False]) * F.col("times")
    weights, seen = [0.0] * (buckets + 1), [0.0] * (buckets + 1)  # the last one is the bias
    for _ in range(rounds):
        now = CueModel(tuple(weights[:-1]), weights[-1], run_words)
        errors = _errors(rows, now, share)
        for row in errors.groupBy("bucket").agg(F.sum("error").alias("error")).collect():  # at most one row a bucket
            at = row["bucket"]
            slope = row["error"] + (ridge * weights[at] if at < buckets else 0.0)
            seen[at] += slope * slope
            if seen[at]:
                weights[at] -= rate * slope / math.sqrt(seen[at])
    return CueModel(tuple(weights[:-1]), weights[-1], run_words)
