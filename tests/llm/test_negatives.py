"""Intervals hold for every pair, and the whole search equals sorting all products."""

import numpy as np
import pytest

from feedback_rank.llm.negatives import Codes, Query, Shard, band, hard_negatives, labelled_vectors, rotated


def plain(rows, every=50, positives=5, negatives=3):
    """``rows``: (id, label, whole numbers)."""
    out = []
    for own, label, x in rows:
        if own % every:
            continue
        scored = sorted((-sum(int(a) * int(b) for a, b in zip(x, y)), i, mark) for i, mark, y in rows if i != own and len(x) == len(y))
        for minus_p, positive, _ in [s for s in scored if s[2] == label][:positives]:
            p = -minus_p
            fit = [s for s in scored if s[2] != label and 50 * p <= 100 * -s[0] <= 95 * p]
            out += [(own, positive, rank + 1, i, p, -s) for rank, (s, i, _) in enumerate(fit[:negatives])]
    return sorted(out)


@pytest.mark.parametrize("width,spread", [(1, 9), (3, 2), (64, 90), (65, 5), (200, 1000)])
def test_rotation_keeps_products_and_intervals_hold(width, spread):
    rng = np.random.default_rng(width)
    points = rng.integers(-spread, spread + 1, (300, width)).astype(float)
    points[:20], points[20:40] = 0, points[50]
    turned = rotated(points)
    assert np.allclose(turned @ turned.T, points @ points.T, atol=1e-6 * max(1, np.abs(points @ points.T).max()))
    codes = Codes.of(points)
    for i in (0, 50, 99):
        query = Query(turned[i])
        estimate = slack = 0
        for level in range(4):
            along = query.along(codes.signs[level], codes.ones[level])
            unit = np.where(np.unpackbits(np.ascontiguousarray(codes.signs[level].T).view(np.uint8), axis=1, bitorder="little"), 1, -1) / np.sqrt(turned.shape[1])
            assert (np.abs(unit @ turned[i] - along) <= query.off + 1e-9 * query.norm).all()
            estimate, slack = estimate + codes.aligned[level] * along, slack + codes.aligned[level] * query.off
            sure = np.maximum(0, np.abs(along) - query.off)
            half = codes.rest[level] * np.sqrt(np.maximum(0, query.norm**2 - sure**2)) + slack
            assert (np.abs(points @ points[i] - estimate) <= half + 1e-9 * codes.norms * query.norm).all()
        # each level leaves less
        assert (np.diff(codes.rest, axis=0) <= 1e-9 * spread * width).all()


def test_rows_are_ruled_out_before_they_are_scored():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(10, 64)) * 60
    points = np.rint(centres[np.arange(4000) % 10] + rng.normal(size=(4000, 64)) * 6)
    shard = Shard.load(Shard.of(np.arange(4000), np.zeros(4000, int), points).dump())
    scored, plain_scores = [], shard.scores
    shard.scores = lambda rows, point: scored.append(len(rows)) or plain_scores(rows, point)
    query = points[0]
    best = shard.best(np.arange(4000), query, Query(rotated(query[None])[0]), [(-np.inf, np.inf)], 5)[0]
    expected = sorted(((int(s), -int(i)) for s, i in zip(shard.points @ query, shard.ids)), reverse=True)[:5]
    assert best == expected and max(scored) < 1000


@pytest.mark.parametrize("p", [-7, -1, 0, 1, 2, 3, 19, 20, 21, 1000, 10**15 + 1])
def test_band(p):
    low, high = band(p)
    for s in {low - 1, low, low + 1, high - 1, high, high + 1}:
        assert (low <= s <= high) == (50 * p <= 100 * s <= 95 * p)


@pytest.mark.parametrize("shard_bytes,block", [(16_000_000, 256), (40_000, 3)])
def test_search_equals_sorting(spark, shard_bytes, block):
    rng = np.random.default_rng(9)
    # few values, so many ties; one label holds a third; one common vector; two widths
    rows = []
    for i in rng.permutation(600).tolist():
        label = 0 if i % 3 == 0 else int(rng.integers(-2, 5))
        width = 4 if i % 11 else 2
        rows.append((i, [1.0, 0.5, -0.25, 0.0][:width] if i % 5 == 0 else (rng.integers(-4, 9, width) / 8).tolist(), label, "x"))
    odd = [(50_000, None, 1, "x"), (50_050, [1.0, None, 0.0, 0.0], 1, "x"), (50_100, [1.0, float("nan"), 0.0, 0.0], 1, "x"),
           (50_150, [float("inf"), 0.0, 0.0, 0.0], 1, "x"), (None, [1.0] * 4, 1, "x"), (50_200, [1.0] * 4, None, "x"), (51_000, [], 1, "x")]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int, block string").repartition(5)
    vectors = labelled_vectors(frame)
    found = hard_negatives(vectors, vectors.where("vec_id % 50 = 0"), shard_bytes=shard_bytes, block_anchors=block)
    mine = sorted(map(tuple, found.collect()))
    assert mine == plain([(i, label, np.floor(256 * np.array(x, np.float32).astype(float)).tolist()) for i, x, label, _ in rows])
    assert len(mine) > 50


def test_no_positive_score_and_whole_numbers_beyond_doubles(spark):
    big = float(1 << 22) + 1  # the square of 256 times it is beyond 53 bits
    rows = [(0, 1, [big, 1.0, 0.0, 3.0]), (1, 1, [big, 1.0, 1.0, 0.0]), (2, 2, [big * 0.75, 0.0, 0.0, 1.0]), (3, 2, [big * 0.75, 0.0, 0.0, 2.0]),
            (50, 3, [0.0, -1.0, 0.0, 0.0]), (51, 3, [0.0, 1.0, 0.0, 0.0]), (100, 4, [0.0, 0.0, 1.0, 0.0]), (101, 4, [0.0, 0.0, 0.0, 0.0])]
    vectors = labelled_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"))
    mine = sorted(map(tuple, hard_negatives(vectors, vectors.where("vec_id % 50 = 0")).collect()))
    assert mine == plain([(i, label, [256 * y for y in x]) for i, label, x in rows])
    assert {r[0] for r in mine} == {0, 100}  # a negative score has no negatives, 0 has those of 0


def test_repeated_rows_and_empty_tables(spark):
    rows = [(0, 1, [1.0, 1.0])] * 2 + [(7, 1, [2.0, 0.0])] * 2 + [(9, 2, [1.0, 0.5])] * 4
    vectors = labelled_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>"))
    found = hard_negatives(vectors, vectors.where("vec_id % 50 = 0"))
    one = [(0, 7, rank, 9, 2 * 65536, 98304) for rank in (1, 2, 3)]
    assert sorted(map(tuple, found.collect())) == sorted(one * 4)  # two anchors, two positives each
    empty = vectors.where("vec_id < 0")
    assert hard_negatives(empty, empty).collect() == [] and hard_negatives(vectors, empty).collect() == []
