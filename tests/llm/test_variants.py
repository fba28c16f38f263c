"""Words, neighbours, forms and roots against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from feedback_rank.llm.variants import _rotation_hashes, dented_words, spelling_variants


def plain_words(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= 7:
                found[run] += 1
    return found


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(counts, near_of=None):
    words = {w: n for w, n in counts.items() if n >= 2}
    forms, out = {}, {}
    for w, n in words.items():
        others = [v for v in words if near(w, v)] if near_of is None else near_of(w, words)
        best = min(others, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= 10 * n else None
        out[w] = len(others)
    rows = []
    for w, n in words.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        rows.append((w, n, forms[w], words.get(forms[w]), root, out[w]))
    return sorted(rows)


def by_edits(w, words):
    """The same neighbours by trying all edits."""
    letters = {c for v in words for c in v}
    edits = {w[:i] + w[i + 1:] for i in range(len(w))}
    edits |= {w[:i] + c + w[i + 1:] for i in range(len(w)) for c in letters} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
    return [v for v in edits if v in words and v != w]


def rows_of(frame):
    return sorted(tuple(r[c] for c in ("word", "n", "form", "form_n", "root", "n_near")) for r in frame.collect())


def occurrences(spark, counts):
    return spark.createDataFrame([(w, n) for w, n in counts.items()], "word string, n int").selectExpr("word", "explode(array_repeat(n, n)) AS key", "'x' AS id").repartition(4)


@pytest.mark.parametrize("long", [64, 4, 7])
def test_random_words(spark, long):
    rng = random.Random(long)
    # short words of few letters: many runs of equal letters, many neighbours, many ties
    counts = Counter({"".join(rng.choice("aabé") for _ in range(rng.randrange(1, 9))): rng.choice([1, 2, 2, 3, 20, 30, 300, 4000]) for _ in range(400)})
    assert rows_of(spelling_variants(occurrences(spark, counts), long=long)) == plain_variants(counts)


def test_chains_of_forms(spark):
    counts = Counter({"a" * i + "bcdefgh": 2 * 10**i for i in range(5)} | {"unrelated": 2, "once": 1})
    rows = {r[0]: r for r in rows_of(spelling_variants(occurrences(spark, counts)))}
    assert rows["bcdefgh"][2:5] == ("abcdefgh", 20, "aaaabcdefgh") and rows["unrelated"][2:] == (None, None, "unrelated", 0)
    assert rows_of(spelling_variants(occurrences(spark, counts))) == plain_variants(counts)


def test_very_long_words(spark):
    rng = random.Random(1)
    base = "".join(rng.choice("abc") for _ in range(20_000))
    words = [base, base[:9_000] + base[9_001:], base[:50] + "z" + base[51:], base + "q", base[:63], base[:64], base[:65], base[:63] + "z", base[:20] + base[21:65]]
    counts = Counter({w: 2 + 30 * (i == 0) for i, w in enumerate(words)})
    assert rows_of(spelling_variants(occurrences(spark, counts))) == plain_variants(counts)


def test_rotation_hashes_are_those_of_the_rotation():
    points = np.array([ord(c) for c in "abracadabra"], dtype=np.int64)
    from feedback_rank.llm.variants import _PRIMES

    for skipped in (0, 1):
        for at, found in enumerate(_rotation_hashes(points, skipped)):
            rotation = [*points[at + skipped:], ord("$"), *points[:at]]
            assert found.tolist() == [sum(int(c) * pow(b, i, p) for i, c in enumerate(rotation)) % p for p, b in _PRIMES]


def test_words_of_texts(spark):
    rng = random.Random(2)
    letters = "abcXYZÀÿ×é"
    rows = [(i, " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 12))) for _ in range(60)) + " 1xĀy") for i in range(120)]
    rows += [(7, None), (8, ""), (None, "Wonderful wonderful"), (9, "repeated repeated"), (9, "repeated repeated"), (10, "wonderful " * 20_000)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, run int")
    found = Counter(r.word for r in dented_words(docs).collect())
    assert found == plain_words(rows) and sum(found.values()) > 20_000
    assert any(zlib.crc32(f"{i}:{w}".encode()) % 31 == 0 for i, t in rows[:120] for w in t.lower().split())


def test_query_equals_brute_force(spark, sf_dir):
    from feedback_rank.llm.queries import QUERIES

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    expected = plain_variants(plain_words(rows), by_edits)
    assert rows_of(QUERIES["op13_spelling_variants"](spark, sf_dir)) == expected
    assert any(r[2] for r in expected)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling_variants(dented_words(docs)).collect() == []
    assert spelling_variants(spark.createDataFrame([(None,), (None,)], "word string")).collect() == []
