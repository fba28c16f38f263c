"""Ids against the tokenizer library, and the replay against merging word by word."""

import hashlib
import itertools
import random

import numpy as np
import pytest

from feedback_rank.llm.merge_replay import Encoder, Vocabulary, decoded_documents, encoded_documents, encoding_digests, replay
from feedback_rank.llm.queries import tokenizer_path, word_pattern


@pytest.fixture(scope="module")
def path():
    return tokenizer_path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def vocabulary(path):
    with open(path, "rb") as lines:
        return Vocabulary.parse(lines)


@pytest.fixture(scope="module")
def library(vocabulary):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=word_pattern(), mergeable_ranks=vocabulary.ranks, special_tokens={})


def one_by_one(word, ranks):
    """The rule itself: of all neighbours that make a token, the lowest rank, leftmost, until none is left."""
    parts = [bytes([b]) for b in word]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        _, i = min(found)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


def test_replay_with_ranks_in_any_order():
    # tokens whose parts have higher ranks than they: a merge makes a lower rank possible
    for seed in range(60):
        rng = random.Random(seed)
        tokens = ["".join(t) for n in (2, 3, 4) for t in itertools.product("abc", repeat=n)]
        chosen = rng.sample(tokens, 30)
        ranks = {bytes([i]): i for i in range(256)} | {t.encode(): 256 + i for i, t in enumerate(chosen)}
        words = ["".join(rng.choice("abc") for _ in range(rng.randrange(0, 25))).encode() for _ in range(200)]
        vocabulary = Vocabulary(ranks)
        ids = replay(words, vocabulary)
        assert [x.tolist() for x in ids] == [one_by_one(word, ranks) for word in words]
        assert [vocabulary.decode(x) for x in ids] == words


def test_replay_of_nothing(vocabulary):
    assert replay([], vocabulary) == [] and [len(x) for x in replay([b"", b"", b"a"], vocabulary)] == [0, 0, 1]


def test_every_code_point(vocabulary, library):
    encoder = Encoder(vocabulary, word_pattern())
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for first in range(0, len(points), 50_000):
        texts = [f"x{chr(c)}y 1{chr(c)}2 {chr(c)}{chr(c)} \n{chr(c)} '{chr(c)}s'" for c in points[first:first + 50_000:7]]
        assert encoder.encode(texts) == [np.array(library.encode_ordinary(t), "<u4").tobytes() for t in texts]


def test_small_cache_and_long_texts(vocabulary, library, monkeypatch):
    import feedback_rank.llm.merge_replay as module

    monkeypatch.setattr(module, "RUN_WORDS", 50)
    encoder = Encoder(vocabulary, word_pattern(), cached_words=20)
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdest  '\n\t\r1é中🙂   <|endoftext|>") for _ in range(rng.randrange(400))) for _ in range(300)]
    texts += ["a" * 5000, " " * 3000 + "x", "", "<|endoftext|>", "zq" * 100]
    assert encoder.encode(texts) == [np.array(library.encode_ordinary(t), "<u4").tobytes() for t in texts]
    assert len(encoder._ids) <= 20


def test_query_equals_library(spark, sf_dir, path, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mine = {r.doc_id: r for r in encoding_digests(docs, path, word_pattern()).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(mine) == len(rows)
    for row in rows:
        ids = np.array(library.encode_ordinary(row.text or ""), "<u4")
        found = mine[row.doc_id]
        assert found.n_tokens == len(ids) and found.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert found.decoded_sha256 == hashlib.sha256((row.text or "").encode()).hexdigest()


def test_odd_rows_and_round_trip(spark, path, library):
    long = "word and more words, " * 30_000
    rows = [(1, None, "x"), (2, "", "x"), (3, "Ünïcode 🙂 —   text", "x"), (3, "Ünïcode 🙂 —   text", "x"), (None, "no id", None), (4, long, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    encoded = encoded_documents(docs, path, word_pattern())
    back = decoded_documents(encoded, path).collect()
    assert sorted((str(r.doc_id), bytes(r.text).decode()) for r in back) == sorted((str(i), t or "") for i, t, _ in rows)
    ids = {r.doc_id: bytes(r.ids) for r in encoded.collect()}
    assert ids[1] == ids[2] == b"" and ids[4] == np.array(library.encode_ordinary(long), "<u4").tobytes()
    assert encoding_digests(docs.where("doc_id > 9"), path, word_pattern()).collect() == []
    broken = docs.selectExpr("1L AS doc_id", "CAST(unhex('61FF62') AS STRING) AS text").limit(1)
    assert bytes(decoded_documents(encoded_documents(broken, path, word_pattern()), path).collect()[0].text).decode() == "a�b"
