"""Components against comparing all pairs of sets, in one block and through the whole join."""

import random

import numpy as np
import pytest

from feedback_rank.llm.jaccard import _signatures, components, deduplicated, hopeful, linked_sets, near_duplicates


def plain_components(sets, num, den):
    """Smallest index connected with each set; an empty set is alone."""
    label = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and label[i] != label[j] and den * len(a & b) >= num * len(a | b):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def text_set(text, words):
    tokens = (text or "").encode().lower().split()
    if len(tokens) < words:
        return {tuple(tokens)} if tokens else set()
    return {tuple(tokens[i:i + words]) for i in range(len(tokens) - words + 1)}


@pytest.mark.parametrize("percent", [60, 85, 100])
def test_forest_connects_what_pairs_connect(percent):
    rng = np.random.default_rng(percent)
    for trial in range(6):
        base = rng.integers(0, 1 << 40, 120)
        sets = []
        for _ in range(150):
            kept = base[rng.random(len(base)) > rng.choice([0.02, 0.1, 0.3])]
            sets.append(np.unique(np.append(kept, rng.integers(0, 1 << 40, rng.integers(0, 30)))).astype(np.uint64))
        keys = rng.permutation(len(sets))
        side = rng.integers(0, 2, len(sets)) if trial % 2 else None
        label = list(range(len(sets)))
        for a, b in linked_sets(sets, keys, side, percent, 100):
            old, new = max(label[a], label[b]), min(label[a], label[b])
            assert old != new and (side is None or side[a] != side[b])
            label = [new if x == old else x for x in label]
        if side is None:
            assert label == plain_components([set(s.tolist()) for s in sets], percent, 100)
        else:
            for a in range(len(sets)):
                for b in range(a):
                    x, y = set(sets[a].tolist()), set(sets[b].tolist())
                    if side[a] != side[b] and 100 * len(x & y) >= percent * len(x | y):
                        assert label[a] == label[b]


@pytest.mark.parametrize("percent", [40, 60, 85])
def test_bitmaps_leave_every_linked_member(percent):
    rng = np.random.default_rng(percent)
    for trial in range(5):
        base, sets = rng.integers(0, 1 << 60, 400).astype(np.uint64), []
        for _ in range(120):
            kept = base[:rng.choice([3, 30, 60, 70, 400])]
            kept = kept[rng.random(len(kept)) > rng.choice([0.0, 0.1, 0.5])]
            sets.append(np.unique(np.append(kept, rng.integers(0, 1 << 60, rng.integers(1, 200)).astype(np.uint64))))
        sizes = np.array([len(s) for s in sets])
        bitmaps = _signatures(np.concatenate(sets), sizes, np.concatenate([[0], np.cumsum(sizes)])).to_pylist()
        assert all(n <= 8 * len(b) for n, b in zip(sizes, bitmaps))
        side = rng.integers(0, 2, len(sets)) if trial % 2 else None
        may = hopeful(sizes, bitmaps, side, percent, 100)
        for a in range(len(sets)):
            for b in range(a):
                x, y = set(sets[a].tolist()), set(sets[b].tolist())
                if (side is None or side[a] != side[b]) and 100 * len(x & y) >= percent * len(x | y):
                    assert may[a] == may[b] >= 0
        assert percent < 80 or not (may >= 0).all()


def corpus(seed=1, n=260):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    line = [word() for _ in range(12)]
    families = [[word() for _ in range(rng.randrange(3, 90))] for _ in range(12)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.6:
            text = list(families[0] if kind < 0.25 else rng.choice(families))
            for _ in range(rng.randrange(0, 6)):
                text[rng.randrange(len(text))] = word()
        else:
            text = [word() for _ in range(rng.randrange(1, 60))]
        if kind < 0.8 and rng.random() < 0.5:
            text = text + line
        rows.append((i, " ".join(text)))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \t"), (n + 3, "One two"), (n + 4, "one  TWO"), (n + 5, "one two three")] + rows[:3]


@pytest.mark.parametrize("words,percent,block_bytes,frequent", [(4, 85, 32_000_000, 1 << 16), (5, 80, 4_000, 0), (4, 50, 20_000, 10)])
def test_components_equal_all_pairs(spark, words, percent, block_bytes, frequent):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, key int, component_id string").repartition(4)
    found = sorted(map(tuple, near_duplicates(docs, words, percent, frequent, block_bytes).collect()))
    sets = [text_set(text, words) for _, text in rows]
    label = plain_components(sets, percent, 100)
    smallest = {}
    for (doc_id, _), x in zip(rows, label):
        smallest[x] = min(smallest.get(x, doc_id), doc_id)
    assert found == sorted((doc_id, len(s), smallest[x]) for (doc_id, _), s, x in zip(rows, sets, label))
    assert len(set(label)) < len(rows) - 20


def test_nulls_ties_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (7, "a b c d e"), (None, "q"), (7, "z"), (7, None)], "doc_id long, text string")
    found = sorted(map(tuple, near_duplicates(docs).collect()), key=str)
    assert found == sorted([(None, 1, 7)] * 2 + [(7, 1, 7), (None, 1, None), (7, 1, 7), (7, 0, 7)], key=str)
    assert near_duplicates(docs.limit(0)).count() == 0
    assert near_duplicates(docs.where("text = 'q'")).count() == 1


def test_long_chains_are_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (5, 5)], "a long, b long")
    found = {r.node: r.component for r in components(edges).collect()}
    assert found == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}


def test_one_of_each_component_stays(spark):
    rows = corpus(3) + [(None, "w1 w2 w3"), (None, "w1 w2 w3"), (4, "other words of this id"), (4, "other words of this id")]
    docs = spark.createDataFrame([(i, *r, "x") for i, r in enumerate(rows)], "component int, doc_id long, text string, key string")
    kept = deduplicated(docs)
    assert kept.columns == docs.columns
    label = plain_components([text_set(text, 5) for _, text in rows], 80, 100)
    groups = {}
    for (doc_id, text), x in zip(rows, label):
        groups.setdefault(x, []).append((doc_id is None, doc_id or 0, text_set(text, 5)))
    found = [(r.doc_id is None, r.doc_id or 0, text_set(r.text, 5)) for r in kept.collect()]
    empty = [f for f in found if not f[2]]
    assert len(empty) == sum(not text_set(t, 5) for _, t in rows)
    expected = [min(g, key=lambda x: x[:2]) for g in groups.values() if g[0][2]]
    assert sorted(f[:2] for f in found if f[2]) == sorted(e[:2] for e in expected)
    assert deduplicated(docs.limit(0)).count() == 0
