"""Paths against all paths, held-out accuracy, mixed texts, and rows that teach or hold nothing."""

from itertools import product

import numpy as np

from feedback_rank.llm.language import LanguageModel, predict_language, train_language_model
from feedback_rank.llm.queries import op10_language


def test_labels_are_the_best_path():
    rng = np.random.default_rng(3)
    model = LanguageModel(["a", "b", "c"], np.ones((3, 8)), np.ones((3, 21)))
    counts = [0, 5, 1, 6, 0, 3]
    scores = rng.normal(size=(sum(counts), 3)).astype(np.float32) * 3
    bounds = np.concatenate([[0], np.cumsum(counts)])
    labels = model.labels(scores, bounds, 1.5)

    def worth(path, mine):
        return sum(mine[i][p] for i, p in enumerate(path)) - 1.5 * sum(x != y for x, y in zip(path, path[1:]))

    for i, n in enumerate(counts):
        mine = scores[bounds[i]:bounds[i + 1]]
        best = max((worth(path, mine) for path in product(range(3), repeat=n)), default=0)
        assert abs(worth(labels[bounds[i]:bounds[i + 1]].tolist(), mine) - best) < 1e-4


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    rows = op10_language(spark, folder).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(langs) and 150 < len(held) < 350
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


TAUGHT = [
    ("en", "the cat and the dog were there with the other thing"), ("de", "der hund und die katze sind nicht hier gewesen"),
    ("ru", "это не тот дом который мы видели"), ("el", "αυτό είναι το σπίτι μας"), (None, "ignored"), ("en", None), ("zz", None),
] * 3


def test_scripts_spans_and_edges(spark):
    model = train_language_model(spark.createDataFrame(TAUGHT, "lang string, text string"))
    assert model.langs == ["de", "el", "en", "ru"]
    texts = [
        "the other dog and the cat " * 3 + "это не тот дом " * 2, "дом", "nicht die katze", None, "", "12 --- 34", "漢字" * 100,
        "the dog " * 5000 + "und die katze sind nicht hier gewesen " * 40,
    ]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "дом", "x", 1)] * 2, "doc_id long, text string, lang string, score int")
    found = {r.doc_id: r for r in predict_language(docs, model).collect()}
    assert [s.lang for s in found[0].spans] == ["en", "ru"] and found[0].lang_pred == "en" and found[0].spans[1].words == 8
    assert [found[i].lang_pred for i in (1, 2, None)] == ["ru", "de", "ru"]
    assert all((found[i].lang_pred, found[i].score, found[i].spans) == ("und", 0.0, []) for i in (3, 4, 5))
    assert found[6].lang_pred in model.langs  # a script nobody taught: still one of the languages
    assert [s.lang for s in found[7].spans] == ["en", "de"] and found[7].lang_pred == "en"


def test_empty_tables(spark):
    none = train_language_model(spark.createDataFrame([], "lang string, text string"))
    docs = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    assert [(r.lang_pred, r.score) for r in predict_language(docs, none).collect()] == [("und", 0.0)]
    model = train_language_model(spark.createDataFrame(TAUGHT, "lang string, text string"))
    assert predict_language(docs.limit(0), model).count() == 0
