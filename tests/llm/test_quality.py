"""Trees walked node by node, held-out accuracy, and what odd texts and labels give."""

import numpy as np

from feedback_rank.llm.quality import STATISTICS, document_statistics, grow_trees, quality_scores, train_quality
from feedback_rank.llm.queries import op5_quality


def walked(model, row):
    total = model.base
    for feature, threshold, value in zip(model.feature, model.threshold, model.value):
        node = 0
        while node < len(feature):
            node = 2 * node + 1 + int(row[feature[node]] > threshold[node])
        total += value[node - len(feature)]
    return 1 / (1 + np.exp(-total))


def test_scores_equal_plain_walk_and_learn():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 5)).astype(np.float32)
    x[:, 3] = np.round(x[:, 3])
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    model = grow_trees(x[:2000], y[:2000])
    scores = model.scores(x[2000:])
    assert np.allclose(scores, [walked(model, row) for row in x[2000:]])
    assert ((scores > 0.5) == (y[2000:] > 0.5)).mean() > 0.97


def test_no_rows_and_one_label():
    assert grow_trees(np.empty((0, 3), np.float32), np.empty(0)).scores(np.zeros((2, 3), np.float32)).tolist() == [0.5, 0.5]
    assert (grow_trees(np.ones((50, 3), np.float32), np.ones(50)).scores(np.ones((2, 3), np.float32)) > 0.9).all()


def test_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = op5_quality(spark, folder).collect()
    assert len({r.doc_id for r in rows}) == len(rows) == 10_000
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    ones, zeros = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
    auc = np.mean([[(a > b) + 0.5 * (a == b) for b in zeros] for a in ones])
    assert auc > 0.9, auc


def test_odd_texts_and_labels(spark):
    texts = [None, "", " \n\t", "word", "é" * 500, "x" * 3_000_000, "A B! " * 100_000, "plain words here.", "plain words here."]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)] + [(None, "x", 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (7, 1, 0), (None, 1, 0), (6, None, 0), (99, 1, 0)], "doc_id long, quality int, stats int")
    stats = document_statistics(docs)
    found = {r.doc_id: r.stats for r in stats.collect()}
    assert all(len(s) == len(STATISTICS) and np.isfinite(s).all() for s in found.values())
    assert found[0] == found[1] == [0.0] * len(STATISTICS) and found[7] == found[8]
    rows = quality_scores(stats, train_quality(stats, labels)).collect()
    assert len(rows) == len(texts) + 1 and all(0 <= r.score <= 1 for r in rows)
    assert quality_scores(stats, train_quality(stats, labels, train_rows=1)).count() == len(rows)
    nothing = train_quality(stats, labels.limit(0))
    assert {r.score for r in quality_scores(stats, nothing).collect()} == {0.5}
    assert quality_scores(document_statistics(docs.limit(0)), nothing).count() == 0
