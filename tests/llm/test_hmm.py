"""Likelihoods against the sum over all paths, expected counts against it, base scores against plain counting."""

from collections import Counter
from itertools import product
from math import log, log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedback_rank.llm import hmm
from feedback_rank.llm.hmm import Hmm, score_documents, train_hmm
from feedback_rank.llm.queries import op9_hmm


def random_model(rng, states, alphabet):
    norm = lambda x, axis=None: x / x.sum(axis=axis, keepdims=axis is not None)
    return Hmm(norm(rng.random(states)), norm(rng.random(states)), norm(rng.random((states, states)), 1), norm(rng.random((alphabet, states)), 0))


def paths(model, sequence, start):
    for path in product(range(len(model.start)), repeat=len(sequence)):
        p = start[path[0]] if path else 1.0
        for t, (state, symbol) in enumerate(zip(path, sequence)):
            p *= model.emit[symbol, state] * (model.move[path[t - 1], state] if t else 1)
        yield path, p


def test_likelihood_and_expected_counts_equal_all_paths():
    rng = np.random.default_rng(4)
    model = random_model(rng, 3, 5)
    lengths = [4, 1, 6, 2]
    symbols = rng.integers(0, 5, sum(lengths))
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    whole = np.array([True, False, True, True])
    starts, moves, emissions, total = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3)), 0.0
    for i in range(len(lengths)):
        mine = symbols[bounds[i]:bounds[i + 1]].tolist()
        everything = list(paths(model, mine, model.start if whole[i] else model.middle))
        likelihood = sum(p for _, p in everything)
        total += log(likelihood)
        for path, p in everything:
            starts[path[0]] += whole[i] * p / likelihood
            for t, state in enumerate(path):
                emissions[mine[t], state] += p / likelihood
                if t:
                    moves[path[t - 1], state] += p / likelihood
        alone = sum(p for _, p in paths(model, mine, model.start))
        assert model.log_likelihoods(symbols, bounds)[i] == pytest.approx(log(alone))
    found = model.expected(symbols, bounds, whole)
    for a, b in zip(found, (starts, moves, emissions, total)):
        assert np.allclose(a, b)


def texts(n=240):
    rng = np.random.default_rng(8)
    words = [[f"{p}{i}" for i in range(60)] for p in ("a", "b", "c")]
    return [(i, " ".join(rng.choice(words[i % 3], rng.integers(1, 60)))) for i in range(n)]


ODD = [(900, None), (901, ""), (902, " \n"), (903, "A0 a0\tÄ never-seen-word"), (903, "A0 a0\tÄ never-seen-word"), (None, "a1 b1")]


@pytest.mark.parametrize("frequent,symbols", [(1 << 19, 4096), (40, 10), (0, 0)])
def test_base_scores_equal_plain_counts(spark, frequent, symbols):
    rows = texts() + ODD
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double").repartition(3)
    found = score_documents(docs, F.col("doc_id") % 5 != 0, states=3, rounds=1, frequent=frequent, symbols=symbols).collect()
    tokens = lambda text: (text or "").encode().lower().split() + [None]
    counts = Counter(w for i, text in rows if i is not None and i % 5 for w in tokens(text))
    n, v = sum(counts.values()), len(counts)
    assert len(found) == len(rows)
    by_id = dict(rows)
    for row in found:
        mine = tokens(by_id[row.doc_id])
        assert (row.n_tokens, row.train_tokens) == (len(mine), n) and row.n_known == sum(w in counts for w in mine)
        assert row.base_score == pytest.approx(sum(log10((counts[w] + 1) / (n + v + 1)) for w in mine))
        assert row.score < 0 and np.isfinite(row.score)


def test_words_have_whole_probability(spark):
    """One-word texts of all known words, of an unseen one for each class, and of none add up to at most 1."""
    docs = spark.createDataFrame(texts(), "doc_id long, text string")
    words = sorted({w for _, t in texts() for w in t.split()})
    asked = spark.createDataFrame([(10_000 + i, w) for i, w in enumerate(words)] + [(20_000, "")], "doc_id long, text string")
    found = score_documents(docs.unionByName(asked), F.col("doc_id") < 10_000, states=3, rounds=2, symbols=20).where("doc_id >= 10000").collect()
    assert 0 < sum(10**r.score for r in found) < 1


def test_rounds_raise_the_likelihood(spark, monkeypatch):
    monkeypatch.setattr(hmm, "SEGMENT", 16)
    sequences = [np.array([ord(c) % 60 for c in text[:80]], "<u2").tobytes() for _, text in texts()]
    encoded = spark.createDataFrame([(bytes(s), True) for s in sequences], "symbols binary, learned boolean")
    _, likelihoods = train_hmm(encoded, 60, states=4, rounds=4, start_segments=3)
    assert len(likelihoods) == 4 and all(b > a - 1e-3 * abs(a) for a, b in zip(likelihoods, likelihoods[1:]))


def test_nothing_learned_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    found = {r.doc_id: r for r in score_documents(docs, F.lit(False)).collect()}
    assert found[1].train_tokens == 0 and found[1].base_score == 0 and found[1].n_known == 0 and found[1].score < 0
    assert score_documents(docs.limit(0), F.lit(True)).count() == 0


def test_held_out_texts_are_likelier_than_by_unigrams(spark):
    rows = op9_hmm(spark, "/root/testdata/sf0.1").where("held_out").collect()
    assert len(rows) > 1000 and sum(r.score for r in rows) > 0.97 * sum(r.base_score for r in rows)
