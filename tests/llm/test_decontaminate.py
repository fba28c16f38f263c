"""Tiles against the plain procedure; reordered, partial and repeated passages; edges."""

import random

import pytest
from pyspark.sql import functions as F

from feedback_rank.llm.decontaminate import decontaminated, leaked_items, tiles


def plain_tiles(item, text, least):
    """Mark the longest unmarked common run, first in the item, then in the text, again and again."""
    in_item, in_text, found = set(), set(), []
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while (
                    i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n]
                    and i + n not in in_item and j + n not in in_text
                ):
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < least:
            return found
        n, i, j = best
        found.append(best)
        in_item.update(range(i, i + n))
        in_text.update(range(j, j + n))


def maximal_matches(item, text, least):
    found = []
    for i in range(len(item)):
        for j in range(len(text)):
            if item[i] == text[j] and not (i and j and item[i - 1] == text[j - 1]):
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n]:
                    n += 1
                if n >= least:
                    found.append((n, i, j))
    return found


def test_tiles_equal_plain():
    rng = random.Random(5)
    for _ in range(150):
        item, text = (rng.choices("ab" if rng.random() < 0.5 else "abcd", k=rng.randrange(0, 22)) for _ in range(2))
        assert tiles(maximal_matches(item, text, 2), 2) == plain_tiles(item, text, 2)


def words(seed, n):
    rng = random.Random(seed)
    return [f"w{rng.randrange(400)}" for _ in range(n)]


ITEMS = [(i, " ".join(words(i, 30))) for i in range(6)] + [(6, None), (7, ""), (8, "too few words"), (1, " ".join(words(1, 30)))]


def documents():
    item = words(0, 30)
    reordered = words(90, 40) + item[20:] + words(91, 15) + item[10:20] + ["x"] + item[:10] + words(92, 30)
    half, less = words(93, 20) + item[:15] + words(94, 9), words(95, 20) + item[:14] + words(96, 9)
    return [
        (0, " ".join(words(97, 200))), (1, " ".join(reordered).upper()), (2, " ".join(half)), (3, " ".join(less)), (4, None), (5, ""),
        (6, "\n".join(words(1, 30) * 3)), (6, "\n".join(words(1, 30) * 3)), (7, "the " * 3000), (8, "w1"), (None, " ".join(words(2, 30))),
    ]


@pytest.mark.parametrize("part_bytes", [10_000_000, 200])
def test_leaks_equal_plain(spark, part_bytes):
    docs = spark.createDataFrame([(*d, "x") for d in documents()], "doc_id long, text string, item_id string")
    benchmark = spark.createDataFrame([(*i, 1) for i in ITEMS], "item_id long, text string, tiles int")
    found = sorted((r.doc_id or -1, r.item_id, r.covered_words, r.tiles) for r in leaked_items(docs, benchmark, part_bytes=part_bytes).collect())
    expected = []
    for doc_id, text in documents():
        for item_id, item in ITEMS:
            item = (item or "").split()
            mine = plain_tiles(item, (text or "").lower().split()[:400], 5)
            covered = sum(n for n, _, _ in mine)
            if len(item) >= 5 and covered >= 0.5 * len(item):
                expected.append((doc_id or -1, item_id, covered, len(mine)))
    assert found == sorted(expected) and {1, 2, 6, -1} == {x[0] for x in found}

    kept = decontaminated(docs, benchmark, part_bytes=part_bytes)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3, 4, 5, 7, 8]


def test_empty_tables(spark):
    docs = spark.createDataFrame(documents(), "doc_id long, text string")
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert leaked_items(docs.limit(0), benchmark).count() == 0
    assert leaked_items(docs, benchmark.limit(0)).count() == 0
    assert decontaminated(docs, benchmark.where(F.lit(False))).count() == len(documents())


def test_short_items_and_long_excerpts(spark):
    long, filler = words(50, 1000), words(51, 300)
    items = [(1, "Too few words"), (2, "yes"), (3, " ".join(long)), (4, ""), (5, "too few  words")]
    texts = {
        10: "too FEW\nwords", 11: "too few words here", 12: "Yes", 13: "yes yes", 14: "few words too", 15: "",
        20: " ".join(filler + long[200:250] + filler), 21: " ".join(filler + long[200:249] + filler), 22: " ".join(long[500:950]),
        23: " ".join(long[:30] + filler + long[100:130] + filler[:20] + long[300:330]),  # much of it, but in short tiles
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): (r.item_words, r.covered_words, r.tiles) for r in leaked_items(docs, benchmark).collect()}
    # by chance a run of words may stand twice; at least the excerpt is covered
    assert set(found) == {(10, 1), (10, 5), (12, 2), (20, 3), (22, 3)}
    assert found[10, 1] == (3, 3, 1) and found[12, 2] == (1, 1, 1) and found[20, 3][1] >= 50 and found[22, 3][1] >= 450
    assert sorted(r.doc_id for r in decontaminated(docs, benchmark).collect()) == [11, 13, 14, 15, 21, 23]
    assert leaked_items(docs, benchmark, long_tile=49).where("doc_id = 21").count() == 1


def test_a_very_long_text(spark):
    item = words(60, 40)
    text = " ".join(words(61, 60_000) + item + words(62, 200_000))
    docs = spark.createDataFrame([(1, text), (2, " ".join(words(61, 60_000)))], "doc_id long, text string")
    benchmark = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.covered_words) for r in leaked_items(docs, benchmark).collect()] == [(1, 7, 40)]
