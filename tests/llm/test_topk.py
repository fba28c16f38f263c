"""Trees and the whole search against sorting all products."""

import numpy as np
import pytest

from feedback_rank.llm.topk import Tree, top_products, whole_vectors


def plain(ids, points, k, every=50):
    found = []
    for q, x in zip(ids, points):
        if q % every == 0:
            scores = [(-sum(int(a) * int(b) for a, b in zip(x, y)), i) for i, y in zip(ids, points) if i != q and len(x) == len(y)]
            found += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(found)


@pytest.mark.parametrize("n,width,spread", [(1, 3, 5), (700, 4, 3), (1000, 8, 100), (300, 2, 2**40), (200, 0, 1)])
def test_tree_equals_sorting(n, width, spread):
    rng = np.random.default_rng(n)
    ids, points = rng.permutation(n), rng.integers(-spread, spread, (n, width)).astype(np.float64)
    points[: n // 3] = points[0] if n else 0  # one common vector
    tree = Tree.load(Tree.grow(ids, points).dump())
    if width:
        assert (tree.low[0] == points.min(axis=0)).all() and (tree.high[0] == points.max(axis=0)).all()
    asked = ids % 50 == 0
    if spread > 2**30:
        points = np.round(points / 2**12)
        tree = Tree.grow(ids, points)
    found = tree.search(ids[asked], points[asked], 5, [[] for _ in ids[asked]])
    mine = []
    for q, best in zip(ids[asked], found):
        mine += [(q, rank + 1, -i, s) for rank, (s, i) in enumerate(sorted(best, reverse=True))]
    assert sorted(mine) == plain(ids, points, 5)


def test_what_is_known_prunes_and_is_not_returned():
    ids, points = np.arange(500), np.random.default_rng(2).integers(-9, 9, (500, 3)).astype(np.float64)
    tree = Tree.grow(ids, points)
    assert tree.search(np.array([900]), points[:1], 2, [[(10**9, -1), (10**9, -2)]]) == [[]]


@pytest.mark.parametrize("shard_bytes,block", [(16_000_000, 256), (600, 3)])
def test_search_equals_sorting(spark, shard_bytes, block):
    rng = np.random.default_rng(9)
    rows = [(int(i), rng.normal(size=4).astype(float).tolist(), "x", 1) for i in rng.permutation(400)]
    rows = [(i, [0.25, -0.5, 0.125, 1.0] if i % 3 == 0 else e, a, b) for i, e, a, b in rows]
    odd = [(50_000, None, "x", 1), (50_050, [1.0, None, 0.0, 0.0], "x", 1), (50_100, [1.0, float("nan"), 0.0, 0.0], "x", 1),
           (50_150, [float("inf"), 0.0, 0.0, 0.0], "x", 1), (None, [1.0] * 4, "x", 1), (50_200, [1.0, 2.0], "x", 1), (51_000, [], "x", 1)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, score string, rank int").repartition(5)
    vectors = whole_vectors(frame)
    found = sorted(map(tuple, top_products(vectors, vectors.where("vec_id % 50 = 0"), shard_bytes=shard_bytes, block_queries=block).collect()))
    ids = [r[0] for r in rows]
    points = [np.floor(256 * np.array(r[1], np.float32).astype(float)) for r in rows]
    assert found == plain(ids, points, 5)


def test_repeated_rows_and_empty_tables(spark):
    rows = [(0, [1.0, 1.0])] * 2 + [(7, [2.0, 0.0])] * 3
    vectors = whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    found = top_products(vectors, vectors.where("vec_id = 0")).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == sorted([(0, i, 7, 256 * 512) for i in (1, 2, 3)] * 2)
    assert top_products(vectors.limit(0), vectors).count() == 0
    assert top_products(vectors, vectors.limit(0)).count() == 0
