"""Words, hashes and shingles of whole texts against plain splitting."""

import random

import numpy as np
import pyarrow as pa
import pytest

from feedback_rank.llm import tokens
from feedback_rank.llm.tokens import in_small_batches, ragged, shingles, text_slices, word_slices

TEXTS = ["a B  c", None, "", " \t\n", "Äb x" * 3, "the the", "x" * 2_500_000 + " y", "a b c", "\x0b\x0c one\rtwo\x1cthree\x85", "É é", "z"]


def plain(text):
    return (text or "").encode().lower().split()


@pytest.mark.parametrize("size", [1, 10, 4_000_000])
def test_words_equal_splitting(size):
    column = pa.array(["cut off", *TEXTS, "cut off"]).slice(1, len(TEXTS))
    at = 0
    for first, upto, data, bounds in text_slices(column, size):
        assert first == at and len(bounds) == upto - first + 1
        words = tokens.Words(data, bounds)
        for i in range(first, upto):
            assert [words.word(k) for k in range(words.bounds[i - first], words.bounds[i - first + 1])] == plain(TEXTS[i])
        at = upto
    assert at == len(TEXTS)


def test_hashes_tell_words_apart_wherever_they_stand():
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choices("abé", k=rng.randrange(1, 5))) for _ in range(300)) for _ in range(30)] + TEXTS
    by_word = {}
    for _, _, words in word_slices(pa.array(texts)):
        for i, h in enumerate(words.hashes().tolist()):
            by_word.setdefault(words.word(i), set()).add(h)
    assert all(len(h) == 1 for h in by_word.values())
    assert len({h for x in by_word.values() for h in x}) == len(by_word)


@pytest.mark.parametrize("size", [2, 4])
def test_shingles_equal_runs(size):
    texts = ["a b c d e", "a b", "a b c d", "", None, "b a", "a b c d e f a b c d", "a"]
    (_, _, words), = word_slices(pa.array(texts))
    grams, bounds = shingles(words.hashes(), words.bounds, size)
    by_run = {}
    for i, text in enumerate(texts):
        mine = plain(text)
        runs = [tuple(mine[k:k + size]) for k in range(len(mine) - size + 1)] or ([tuple(mine)] if mine else [])
        found = grams[bounds[i]:bounds[i + 1]].tolist()
        assert len(found) == len(runs)
        for run, gram in zip(runs, found):
            assert by_run.setdefault(run, gram) == gram
    assert len(set(by_run.values())) == len(by_run)


def test_ragged():
    assert ragged(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]
    assert ragged(np.array([], int), np.array([], int)).tolist() == []


def test_batches_only_become_smaller(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    for given, kept in (("10000", "2000"), ("0", "2000"), ("500", "500")):
        spark.conf.set(name, given)
        in_small_batches(spark.range(1))
        assert spark.conf.get(name) == kept
    spark.conf.set(name, before)


def test_a_worker_gives_its_memory_back_before_and_after_a_task(monkeypatch):
    told = []
    monkeypatch.setattr(tokens, "give_back", lambda: told.append("back"))
    task = tokens.lean(lambda batches, more: (told.append(batch) or batch + more for batch in batches), 10)
    assert list(task(iter([1, 2]))) == [11, 12] and told == ["back", 1, 2, "back"]
