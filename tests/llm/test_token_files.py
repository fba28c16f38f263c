"""Files written and read back against the tokenizer itself; the index against a plain list."""

import random
import zlib

import numpy as np
import pytest

from feedback_rank.llm.queries import tokenizer_path
from feedback_rank.llm.token_files import EliasFano, _encoder, documents_at, read_tokens, write_tokens
from feedback_rank.llm.tokens import text_slices
from feedback_rank.session import scratch_path


def encoded(texts):
    return [e.ids + [1] for e in _encoder(tokenizer_path())[0].tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def plain(rows):
    """(doc_id, start, n_tokens, crc) of rows in order."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    start, out = 0, []
    for (doc_id, _), ids in zip(rows, encoded([t for _, t in rows])):
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    return out


ODD = [
    "<|startoftext|> A", "<|STARTOFTEXT|>", "It's DON'T 'LL we've", "a\xa0b c", "Σας ΣΑΣ", "é É", "\x1c\x07 a\x7fb", "ſK K", "中文 字", "1234 ½²", "İ İ",
    "a_b-c/d", " ", "", None, "ÀÉ ñÑ ß ẞ", "́a b", "x" * 5000, "word " * 3000,
]


def test_word_by_word_equals_whole_texts():
    rng, letters = random.Random(6), "abÀé'<|>Σ 1½_-́\xa0\x1c\tS"
    texts = [t or "" for t in ODD] + ["".join(rng.choices(letters, k=rng.randrange(14))) for _ in range(2000)]
    encoder, _ = _encoder(tokenizer_path())
    assert type(encoder).__name__ == "_WordByWord"
    import pyarrow as pa

    for first, upto, data, bounds in text_slices(pa.array(texts)):
        ids, ends = encoder.encode(data, bounds)
        found = [ids[a:b].tolist() + [1] for a, b in zip(ends[:-1], ends[1:])]
        assert found == encoded(texts[first:upto])


@pytest.mark.parametrize("block_ids", [1 << 20, 40])
def test_files_equal_plain(spark, block_ids):
    rows = [(i * 7919 % 101 - 20, t) for i, t in enumerate(ODD * 3)] + [(None, "no id"), (None, None), (5, "twice"), (5, "twice"), (5, "a")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, ids string, start int").repartition(5)
    path = scratch_path(spark, "tokens")
    write_tokens(docs, path, tokenizer_path(), block_ids=block_ids)
    found = read_tokens(spark, path).collect()
    expected = plain(rows)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.ids) for r in found), key=lambda r: r[1]) == expected
    at = [0, 3, len(rows) // 2, len(rows) - 1]
    some = {r.ordinal: (r.doc_id, r.start, r.ids) for r in documents_at(spark, path, at).collect()}
    assert some == {i: (expected[i][0], expected[i][1], expected[i][4]) for i in at}


def test_no_documents(spark):
    path = scratch_path(spark, "tokens")
    write_tokens(spark.createDataFrame([], "doc_id long, text string"), path, tokenizer_path())
    assert read_tokens(spark, path).count() == 0


def test_other_tokenizers(spark):
    import public_tokenizers

    path, file = scratch_path(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json")
    write_tokens(spark.createDataFrame([(1, " two  words\n"), (2, None)], "doc_id long, text string"), path, file)
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(file).encode(" two  words\n", add_special_tokens=False).ids
    assert {r.doc_id: r.ids for r in read_tokens(spark, path).collect()} == {1: ids + [1], 2: [1]}


def test_select_equals_list():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1), (5, 0), (3000, 10), (3000, 10**9), (513, 600)):
        values = np.sort(rng.integers(0, top + 1, n))
        code = EliasFano.encode(values)
        index = EliasFano(code)
        assert index.values().tolist() == values.tolist()
        assert [index.select(i) for i in range(0, n, 7)] == values[::7].tolist()
        with pytest.raises(IndexError):
            index.select(n)
    # 3000 values up to 10**9 in about 2 + log2(u / n) bits each, not 64
    assert len(EliasFano.encode(np.sort(rng.integers(0, 10**9, 3000)))) * 8 < 3000 * 22
