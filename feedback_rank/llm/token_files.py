"""Token ids of a corpus in files, with Elias-Fano encoded document boundaries.

A dataset is a folder with two Parquet tables. ``blocks`` has a row for each run of
whole documents in ascending doc_id order: their ids one after the other as
little-endian integers (two bytes while the vocabulary fits, else four), the end of
each document in that id array as an Elias-Fano code, and the doc_ids. ``shards`` has a
row for each writing task: how many ids it wrote and how many come before it. Rows go
through Spark's own writer, so the files land wherever Spark can write and a lost task
is written again.

Elias-Fano (Elias 1974, Fano 1971): n non-decreasing ends up to u are split into low
bits, stored plainly, and high parts, stored in unary in n + u / 2**low bits: about
2 + log2(u / n) bits a document. The end of document i is found by a select on the
unary bits. Every 512th one's place is kept as a sample, so a select looks at one
stretch between two samples; no table of 64-bit offsets is written.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedback_rank.llm.tokens import Words, in_small_batches, lean, ragged, text_slices

END_ID = 1
BLOCK_IDS = 1 << 20      # ids after which a block is closed; a longer document has a block of its own
CACHED_WORDS = 1 << 19   # words whose ids a Python worker keeps, in arrays
CACHED_PIECES = 1 << 17  # and parts of words, as objects
_SAMPLE = 512

# fixed values: the splitting of the public word-level tokenizer, as its file has it
_DROPS_SPACE = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"},
    ]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "behavior": "Removed", "invert": True,
         "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
}
_HEAD = np.dtype([("n", "<u8"), ("last", "<u8"), ("low_bits", "<u4"), ("samples", "<u4")])


class EliasFano:
    """A non-decreasing sequence of integers from 0, in near-minimal space."""

    def __init__(self, blob: bytes):
        head = np.frombuffer(blob, _HEAD, 1)[0]
        self.n, self.last, self.low_bits = int(head["n"]), int(head["last"]), int(head["low_bits"])
        at = _HEAD.itemsize
        self._samples = np.frombuffer(blob, "<u4", int(head["samples"]), at)
        at += 4 * int(head["samples"])
        low_bytes = (self.n * self.low_bits + 7) // 8
        self._low = np.frombuffer(blob, np.uint8, low_bytes, at)
        self._high = np.frombuffer(blob, np.uint8, -1, at + low_bytes)

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        values = np.asarray(values, dtype=np.uint64)
        n, last = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (last // n).bit_length() - 1) if n else 0
        low = b""
        if low_bits:
            bits = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
            low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
        high[ones] = 1
        samples = ones[::_SAMPLE].astype("<u4")
        head = np.array([(n, last, low_bits, len(samples))], dtype=_HEAD)
        return head.tobytes() + samples.tobytes() + low + np.packbits(high, bitorder="little").tobytes()

    def _lows(self, first: int, upto: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(upto - first, dtype=np.int64)
        from_bit, to_bit = first * self.low_bits, upto * self.low_bits
        bits = np.unpackbits(self._low[from_bit // 8:(to_bit + 7) // 8], bitorder="little")
        bits = bits[from_bit % 8:from_bit % 8 + to_bit - from_bit].reshape(-1, self.low_bits)
        return bits @ (np.int64(1) << np.arange(self.low_bits, dtype=np.int64))

    def select(self, i: int) -> int:
        """The i-th value, from 0."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        sampled = i // _SAMPLE
        start = int(self._samples[sampled])
        stop = int(self._samples[sampled + 1]) if sampled + 1 < len(self._samples) else 8 * len(self._high)
        bits = np.unpackbits(self._high[start // 8:stop // 8 + 1], bitorder="little")
        one = start // 8 * 8 + int(np.flatnonzero(bits)[np.count_nonzero(bits[:start % 8]) + i % _SAMPLE])
        return (one - i) << self.low_bits | int(self._lows(i, i + 1)[0])

    def values(self) -> np.ndarray:
        """All values."""
        ones = np.flatnonzero(np.unpackbits(self._high, bitorder="little"))[:self.n]
        return ((ones - np.arange(self.n)) << self.low_bits) | self._lows(0, self.n)


class _WholeTexts:
    """Encodes text by text, for any tokenizer."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds of each text's ids) of the texts in ``data``."""
        blob = data.tobytes()
        texts = [blob[a:b].decode() for a, b in zip(bounds[:-1], bounds[1:])]
        lists = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ends = np.cumsum([0, *map(len, lists)])
        return (np.concatenate(lists) if lists else np.empty(0, np.uint32)), ends


class _WordByWord:
    """Encodes each distinct space-separated part once, for tokenizers that drop white space.

    Such a tokenizer gives a text the ids of its parts one after the other, so a part's
    ids are kept, under a 64-bit hash, for as long as CACHED_WORDS allows. ASCII case is
    levelled before hashing, as the tokenizer lower-cases anyway; only its added tokens
    tell case apart, and they hold "<|".
    """

    def __init__(self, tokenizer):
        import regex

        self.tokenizer = tokenizer
        self.pieces = regex.compile(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = (b for b in range(256) if b not in plain)
        self.shown = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.forget()

    def forget(self) -> None:
        self.keys = np.empty(0, dtype=np.uint64)
        self.at = np.empty(0, dtype=np.int64)
        self.sizes = np.empty(0, dtype=np.int64)
        self.ids = np.empty(0, dtype=np.uint32)
        self.known: dict[str, tuple[int, ...]] = {}

    def _piece(self, piece: str) -> tuple[int, ...]:
        """The ids of what the tokenizer's own splitting leaves whole."""
        ids = self.known.get(piece)
        if ids is None:
            shown = piece if piece.isascii() else "".join(map(self.shown.__getitem__, piece.encode()))
            ids = self.known[piece] = tuple([token.id for token in self.tokenizer.model.tokenize(shown)])
        return ids

    def _part(self, part: bytes) -> Sequence[int]:
        text = part.decode()
        if part.isalpha() and text.islower():  # ASCII letters only
            return self._piece(text)
        if "'" not in text and "<|" not in text:  # else there are contractions or added tokens to look for
            text = text.lower()
            # of these characters, composition changes none
            if text.isprintable() and max(text) < "\u0180":
                return [i for piece in self.pieces.findall(text) for i in self._piece(piece)]
        return self.tokenizer.encode(part.decode(), add_special_tokens=False).ids

    def _learn(self, words: Words, places: np.ndarray, keys: np.ndarray) -> None:
        blob = words.data.tobytes()
        lists = [self._part(blob[a:b]) for a, b in zip(words.starts[places].tolist(), words.ends[places].tolist())]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        at = len(self.ids) + np.cumsum(sizes) - sizes
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum()))])
        into = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, into, keys)
        self.at, self.sizes = np.insert(self.at, into, at), np.insert(self.sizes, into, sizes)

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds of each text's ids) of the texts in ``data``."""
        words = Words(data, bounds, lower=b"<|" not in data.tobytes())
        if not len(words.starts):
            return np.empty(0, np.uint32), np.zeros(len(bounds), np.int64)
        if len(self.keys) > CACHED_WORDS:
            self.forget()
        if len(self.known) > CACHED_PIECES:
            self.known.clear()
        keys, places, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), dtype=bool)
        if len(self.keys):
            new = self.keys[np.minimum(at, len(self.keys) - 1)] != keys
        if new.any():
            self._learn(words, places[new], keys[new])
            at = np.searchsorted(self.keys, keys)
        sizes = self.sizes[at][which]
        ids = self.ids[ragged(self.at[at][which], sizes)]
        return ids, np.concatenate([[0], np.cumsum(sizes)])[words.bounds]


@lru_cache(maxsize=1)
def _encoder(path: str):
    """The encoder for a tokenizer file, kept by the Python worker."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    with open(path, encoding="utf-8") as file:
        parts = json.load(file)
    by_word = (
        parts["normalizer"] == _DROPS_SPACE["normalizer"] and parts["pre_tokenizer"] == _DROPS_SPACE["pre_tokenizer"]
        and all("<|" in token["content"] and " " not in token["content"] for token in parts["added_tokens"])
    )
    return (_WordByWord if by_word else _WholeTexts)(tokenizer), tokenizer.get_vocab_size()


def _id_type(vocabulary: int, end_id: int) -> str:
    return "<u2" if max(vocabulary - 1, end_id) < 1 << 16 else "<u4"


_BLOCKS = "shard int, block int, first_id long, n_docs int, n_ids long, id_bytes int, doc_ids array<bigint>, ends binary, ids binary"


def _blocks(batches: Iterator[pa.RecordBatch], path: str, end_id: int, block_ids: int) -> Iterator[pa.RecordBatch]:
    """Batches of (doc_id, text) in order to rows of _BLOCKS."""
    encoder, vocabulary = _encoder(path)
    kind = _id_type(vocabulary, end_id)
    shard, block, written = TaskContext.get().partitionId(), 0, 0
    held_docs: list[pa.Array] = []
    held_ids: list[np.ndarray] = []
    held_ends: list[np.ndarray] = []
    held = 0

    def closed() -> pa.RecordBatch:
        nonlocal block, written, held
        docs = pa.concat_arrays(held_docs)
        ends = np.concatenate(held_ends)
        row = {
            "shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int32()),
            "first_id": pa.array([written], pa.int64()), "n_docs": pa.array([len(docs)], pa.int32()),
            "n_ids": pa.array([held], pa.int64()), "id_bytes": pa.array([int(kind[-1])], pa.int32()),
            "doc_ids": pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs),
            "ends": pa.array([EliasFano.encode(ends)], pa.binary()),
            "ids": pa.array([b"".join(x.tobytes() for x in held_ids)], pa.binary()),
        }
        block, written, held = block + 1, written + held, 0
        held_docs.clear(), held_ids.clear(), held_ends.clear()
        return pa.RecordBatch.from_pydict(row)

    for batch in batches:
        docs = batch.column(0).cast(pa.int64())
        for first, upto, data, bounds in text_slices(batch.column(1)):
            ids, ends = encoder.encode(data, bounds)
            out = np.insert(ids, ends[1:], end_id).astype(kind)  # the end id after each text
            ends = ends[1:] + np.arange(1, upto - first + 1)
            done = 0
            while done < len(ends):
                start = int(ends[done - 1]) if done else 0
                stop = int(np.searchsorted(ends, start + block_ids - held, side="right"))
                if stop <= done and held:  # the next document opens a block
                    yield closed()
                    continue
                stop = max(stop, done + 1)
                held_docs.append(docs.slice(first + done, stop - done))
                held_ids.append(out[start:ends[stop - 1]])
                held_ends.append(ends[done:stop] - start + held)
                held += int(ends[stop - 1]) - start
                done = stop
                if held >= block_ids:
                    yield closed()
    if held:
        yield closed()


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS
) -> None:
    """Encode ``docs`` (doc_id, text) and write the dataset to the folder ``path``.

    ``tokenizer`` is a tokenizer file that every executor can read; no special tokens are
    added, but ``end_id`` ends each document. Documents are in ascending doc_id order, nulls
    first, those with the same id ordered by text; a null text is an empty one. No documents
    give no blocks. Texts are sorted by range over all tasks and encoded after it, so that
    they are encoded once. Other columns are not read. Runs its jobs at once.
    """
    spark = docs.sparkSession
    placed = in_small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    placed = placed.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    placed.mapInArrow(lean(_blocks, tokenizer, end_id, block_ids), _BLOCKS).write.parquet(f"{path}/blocks")

    # a row for each task of the sort, whatever the number of documents
    shards = _read_blocks(spark, path).groupBy("shard").agg(
        F.sum("n_ids").alias("n_ids"), F.sum("n_docs").alias("n_docs")
    ).orderBy("shard").collect()
    rows, ids, docs_before = [], 0, 0
    for row in shards:
        rows.append((row["shard"], ids, docs_before))
        ids, docs_before = ids + row["n_ids"], docs_before + row["n_docs"]
    spark.createDataFrame(rows, "shard int, ids_before long, docs_before long").coalesce(1).write.parquet(f"{path}/shards")


def _read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")


def _placed_blocks(spark: SparkSession, path: str) -> DataFrame:
    shards = spark.read.schema("shard int, ids_before long, docs_before long").parquet(f"{path}/shards")
    return _read_blocks(spark, path).join(F.broadcast(shards), "shard").withColumn("start", F.col("first_id") + F.col("ids_before"))


def _documents(batches: Iterator[pa.RecordBatch], with_ids: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(len(batch)):
            value = {name: batch.column(name)[row] for name in batch.schema.names}
            ends = EliasFano(value["ends"].as_py()).values()
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            ids = np.frombuffer(value["ids"].as_buffer(), f"<u{value['id_bytes'].as_py()}").astype("<u4")
            blob = memoryview(ids).cast("B")
            sums = [zlib.crc32(blob[4 * a:4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
            out = {
                "doc_id": value["doc_ids"].values, "start": pa.array(starts + value["start"].as_py()),
                "n_tokens": pa.array(ends - starts), "ids_crc32": pa.array(sums, pa.int64()),
            }
            if with_ids:
                bounds = pa.array(np.concatenate([[0], ends]), pa.int32())
                out["ids"] = pa.ListArray.from_arrays(bounds, pa.array(ids.astype(np.int64)))
            yield pa.RecordBatch.from_pydict(out)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) and, unless left out, ids: each document of the dataset.

    ``start`` counts the ids of all documents before it; ``ids_crc32`` is over the ids as
    little-endian 32-bit integers. Both end ids and repeated doc_ids are in.
    """
    blocks = _placed_blocks(spark, path).select("start", "id_bytes", "doc_ids", "ends", "ids")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<bigint>" if with_ids else "")
    return blocks.mapInArrow(lean(_documents, with_ids), schema)


def _selected(batches: Iterator[pa.RecordBatch], ordinals: list[int]) -> Iterator[pa.RecordBatch]:
    wanted = np.array(sorted(set(ordinals)))
    for batch in batches:
        for row in batch.to_pylist():
            ends, at = EliasFano(row["ends"]), row["docs_at"]
            ids = np.frombuffer(row["ids"], f"<u{row['id_bytes']}")
            found = wanted[(wanted >= at) & (wanted < at + row["n_docs"])]
            spans = [(ends.select(i - 1) if i else 0, ends.select(i)) for i in (found - at).tolist()]
            yield pa.RecordBatch.from_pydict({
                "ordinal": pa.array(found, pa.int64()),
                "doc_id": pa.array([row["doc_ids"][i] for i in (found - at).tolist()], pa.int64()),
                "start": pa.array([row["start"] + a for a, _ in spans], pa.int64()),
                "ids": pa.array([ids[a:b].tolist() for a, b in spans], pa.list_(pa.int64())),
            })


def documents_at(spark: SparkSession, path: str, ordinals: list[int]) -> DataFrame:
    """(ordinal, doc_id, start, ids) of the documents at these places of the order, from 0.

    Reads the blocks that hold them and selects their bounds in the index.
    """
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = _placed_blocks(spark, path).select("shard", "block", "n_docs", "docs_before")
    placed = placed.withColumn("docs_at", F.col("docs_before") + F.coalesce(F.sum("n_docs").over(before), F.lit(0)))
    wanted = F.lit(False)
    for i in set(ordinals):
        wanted = wanted | ((F.col("docs_at") <= i) & (F.col("docs_at") + F.col("n_docs") > i))
    blocks = _placed_blocks(spark, path).join(placed.where(wanted).select("shard", "block", "docs_at"), ["shard", "block"])
    return blocks.select("docs_at", "start", "n_docs", "id_bytes", "doc_ids", "ends", "ids").mapInArrow(
        lambda batches: _selected(batches, ordinals), "ordinal long, doc_id long, start long, ids array<bigint>"
    )
