"""Each stage over what the one before kept, against a plain version of it."""

from collections import Counter

import pytest

import corpus_pipeline
from tests.llm.test_decontaminate import plain_tiles
from tests.llm.test_jaccard import plain_components, text_set
from tests.llm.test_mixing import plain_targets
from tests.llm.test_token_files import plain

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """What goes into each stage, and what comes out of it."""
    from feedback_rank.session import scratch_path

    docs, found = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    odd = spark.createDataFrame(
        [(9001, "123 ... --", "en", "src1", 10), (9002, None, "en", None, 0), (9003, "", None, "src1", 0), (None, "de la que el nada", "es", None, 9)]
        + [(9004, "a copy of this text with some more words", "en", "src2", 40)] * 2, docs.schema)
    docs = docs.unionByName(odd)
    for name, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        out = spark.read.parquet(path)
        found.append((name, [tuple(r) for r in docs.select(*COLUMNS).collect()], out.columns, [tuple(r) for r in out.collect()]))
        docs = out
    return found


def test_order_and_columns(stages):
    assert [s[0] for s in stages] == ["language", "near duplicates", "decontamination", "mixing", "token files"]
    assert all(columns == COLUMNS for _, _, columns, _ in stages[:-1])
    assert stages[-1][2] == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert corpus_pipeline.ORACLE_SQL is None


def plain_known(text, model, spans):
    """Whether half of the text's letters lie in spans that reach half-way from random letters to the language's own."""
    letters, words = "", []
    for c in (text or "") + " ":
        if c.isalpha():
            letters += c.lower() if len(c.lower()) == 1 else c
        elif letters:
            words += [letters[i:i + 40] for i in range(0, len(letters), 40)] if len(letters) <= 40 else [letters]
            letters = ""
    assert all(len(w) <= 40 for w in words) and sum(s.words for s in spans) == len(words)
    total = sum(map(len, words))
    if not total:
        return False
    sound = at = 0
    for span in spans:
        mine, lang = words[at:at + span.words], model.langs.index(span.lang)
        at += span.words
        reached = 0.0
        for word in mine:
            points = [0, *map(ord, word), 0]
            for before, own, after in zip(points, points[1:], points[2:]):
                mix = ((before * 0x110000 + own) * 0x110000 + after) * 0x9E3779B97F4A7C15 % 2**64
                reached += float(model.logs[(mix >> 48) % len(model.logs), lang])
        n = sum(map(len, mine))
        sound += n * (reached >= model.sound[lang] * n)
    return total < 20 or sound >= 0.5 * total


def test_language(stages, spark):
    """Against the plain version; the texts are of Latin letters, and words of up to 40."""
    from feedback_rank.llm.language import predict_language, train_language_model

    _, rows, _, kept = stages[0]
    docs = spark.createDataFrame([(i, *row[1:]) for i, row in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    model = train_language_model(docs)
    spans = {r.doc_id: r.spans for r in predict_language(docs, model).collect()}
    assert Counter(kept) == Counter(row for i, row in enumerate(rows) if plain_known(row[1], model, spans[i]))
    assert len(kept) < len(rows)


def test_what_is_no_known_language_goes(spark):
    import random

    from feedback_rank.llm.language import in_known_languages, train_language_model

    rng = random.Random(5)
    noise = " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxzaeiouy") for _ in range(rng.randrange(3, 12))) for _ in range(400))
    books = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang IS NOT NULL AND text IS NOT NULL")
    model = train_language_model(books)
    clean = books.orderBy("doc_id").first().text
    texts = [clean, noise, "漢字仮名交じり文" * 50, "digits 1 2 3", "a1 2 3 4 5", clean[:300] + " " + noise, clean + " " + noise[:300], "漢字", "", None, "漢字" * 100_000 + clean]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)] + [(None, clean, 1, 2)] * 2, "id long, text string, sound int, known int").repartition(3)
    found = in_known_languages(docs, model)
    assert found.columns == docs.columns
    assert sorted((r.id for r in found.collect()), key=str) == [0, 3, 4, 6, None, None]


def test_mixed_languages_stay(spark):
    """Three languages at 40/35/25, and two at 49.5 each with a few words of a third."""
    from feedback_rank.llm.language import predict_language, train_language_model
    from feedback_rank.llm.stages import language

    en, ru, el = "the cat and the dog were there ", "это не тот дом который мы видели ", "αυτό είναι το σπίτι μας "
    letters = {x: sum(c.isalpha() for c in x) for x in (en, ru, el)}
    part = lambda x, n: x * (n // letters[x])
    texts = [en * 3, ru * 3, el * 3, part(en, 4000) + part(ru, 3500) + part(el, 2500), part(en, 4950) + part(ru, 4950) + part(el, 100), "12 --- 34", "", None]
    langs = ["en", "ru", "el"] + [None] * 5
    docs = spark.createDataFrame([(i, t, x, "s", len(t or "")) for i, (t, x) in enumerate(zip(texts, langs))], "doc_id long, text string, lang string, source string, n_chars long")
    scores = {r.doc_id: (r.score, [s.lang for s in r.spans]) for r in predict_language(docs, train_language_model(docs)).collect()}
    assert all(score < 0.5 and spans == ["en", "ru", "el"] for score, spans in (scores[3], scores[4]))
    assert sorted(r.doc_id for r in language(spark, docs, "").collect()) == [0, 1, 2, 3, 4]


def test_near_duplicates(stages):
    _, rows, _, kept = stages[1]
    label = plain_components([text_set(r[1], 5) for r in rows], 80, 100)
    first = {}
    for row, x in zip(rows, label):
        first[x] = min(first.get(x, row), row, key=lambda r: (r[0] is None, r[0] or 0))
    assert Counter(kept) == Counter(first.values()) and len(kept) < len(rows)


def test_decontamination(stages, spark, sf_dir):
    _, rows, _, kept = stages[2]
    items = [r.text.encode().lower().split() for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    expected = []
    for row in rows:
        words = row[1].encode().lower().split()
        grams = {tuple(words[i:i + 5]) for i in range(len(words) - 4)}
        leaks = any(
            sum(tuple(item[i:i + 5]) in grams for i in range(len(item) - 4)) >= 5
            and sum(n for n, _, _ in plain_tiles(item, words, 5)) >= 0.5 * len(item)
            for item in items
        )
        expected += [] if leaks else [row]
    assert Counter(kept) == Counter(expected)


def test_mixing(stages):
    _, rows, _, kept = stages[3]
    copies, sizes = Counter(kept), Counter()
    assert not set(copies) - set(rows) and max(copies.values()) <= 3
    for row in rows:
        sizes[row[3]] += len(row[1].split())
    largest = max(len(row[1].split()) for row in rows)
    for source, target in plain_targets(sizes).items():
        taken = sum(n * len(row[1].split()) for row, n in copies.items() if row[3] == source)
        assert abs(taken - target) <= max(largest, 0.1 * target)


def test_token_files(stages):
    _, rows, _, out = stages[4]
    assert sorted(out, key=lambda r: r[1]) == [r[:4] for r in plain([row[:2] for row in rows])]


def test_run_is_the_last_stage(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
