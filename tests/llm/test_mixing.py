"""Targets against plain resharing; what is taken against the limits."""

import re
from collections import defaultdict

import pytest

from feedback_rank.llm.mixing import WEIGHTS, _transfer, mixed_documents, mixed_sizes


def plain_targets(sizes):
    """Source sizes to targets, by resharing the excess."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(order)}
    total, full, target = sum(sizes.values()), set(), {}
    while True:
        open_ones = [s for s in order if s not in full]
        left = total - sum(3.0 * sizes[s] for s in full)
        target = {s: left * weight[s] / sum(weight[x] for x in open_ones) for s in open_ones} | {s: 3.0 * sizes[s] for s in full}
        over = {s for s in open_ones if target[s] > 3 * sizes[s]}
        if not over:
            return target
        full |= over


def sources(rows):
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    return dict(sizes)


def held(spark, rows, near, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixed_sizes(docs, **options).collect()
    sizes = sources(rows)
    targets = plain_targets(sizes)
    assert len(found) == len(rows)
    by_id = {doc_id: (text, source) for doc_id, text, source in rows}
    taken = defaultdict(int)
    for row in found:
        text, source = by_id[row.doc_id]
        assert row.size == len((text or "").split()) and row.source_size == sizes[source]
        assert row.target == pytest.approx(targets[source], abs=1e-6)
        assert 0 <= row.taken <= 3 * row.size and (row.size == 0 or row.taken % row.size == 0)
        taken[source] += row.taken
    for source, target in targets.items():
        largest = max((len((t or "").split()) for _, t, s in rows if s == source), default=0)
        assert abs(taken[source] - target) <= max(near * target, largest), source
    return sorted((r.doc_id or -1, r.taken) for r in found)


ROWS = [
    (i, "w " * (1 + i * 7919 % 90), "hot" if i % 3 == 0 else f"s{i % 7}" if i % 5 else None) for i in range(3000)
] + [(5000 + i, "x " * 3, "tiny") for i in range(2)] + [(6000, None, "hot"), (6001, " \t\n", "void"), (6002, "", None)]


def test_targets_and_limits(spark):
    first = held(spark, ROWS, 0.02)
    assert first == held(spark, ROWS[::-1], 0.02)  # reruns agree, whatever the order of rows


def test_reduction_tree_of_several_levels(spark):
    held(spark, ROWS, 0.05, cell_rows=7, fan_in=3)  # cells this small leave a seventh of the documents to the tree


def test_repeated_rows_nulls_and_empty_tables(spark):
    rows = [(1, "a b c", "x")] * 500 + [(2, "d " * 40, "y")] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixed_sizes(docs).collect()
    assert len(found) == 530 and all(r.taken % r.size == 0 and r.taken <= 3 * r.size for r in found)
    for source, target in plain_targets(sources(rows)).items():
        size = 3 if source == "x" else 40
        assert abs(sum(r.taken for r in found if r.size == size) - target) <= size
    assert mixed_sizes(docs.limit(0)).count() == 0
    nothing = spark.createDataFrame([(None, None, None), (1, "", None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mixed_sizes(nothing).collect()] == [(0, 0.0, 0)] * 2


def test_documents_are_repeated_as_taken(spark):
    docs = spark.createDataFrame(
        [(*row, row[0] % 2, "k") for row in ROWS + [ROWS[7]] * 4], "doc_id long, text string, source string, size int, copies string"
    )
    found = mixed_documents(docs)
    assert found.columns == docs.columns
    units = defaultdict(int)
    for row in mixed_sizes(docs).collect():
        units[row.doc_id] += row.taken // max(row["size"], 1)
    counts = defaultdict(int)
    for row in found.collect():
        counts[row.doc_id] += 1
    assert counts == {k: v for k, v in units.items() if v}


def test_transfer_keeps_the_sum():
    for a in (0.1, 0.5, 0.9):
        for b in (0.2, 0.5, 0.8):
            steps = [_transfer(a, b, d / 1000 + 0.0005) for d in range(1000)]
            assert all(abs(x + y - a - b) < 1e-9 and {x, y} & {0.0, 1.0} for x, y in steps)
            assert abs(sum(x for x, _ in steps) / 1000 - a) < 0.01
