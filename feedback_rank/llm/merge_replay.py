"""Byte-level BPE by merge replay, and back.

The texts of a task are one corpus: it is parted into words by the tokenizer's pattern, and
all its distinct words are laid out one after the other in one array of symbols, a symbol
being the rank of a token. An index holds for each token the places where two neighbours
make it. Tokens are then taken in rank order, each one's places from left to right; a merge
changes only its two neighbours' entries. Every word is merged once for as long as a Python
worker keeps it, which is over many batches and tasks, however often it occurs.

Merging two symbols is allowed whenever their bytes together are a token, as the rank files
mean it. Where a merge makes a token of lower rank possible than the one at work, that one
goes first, and so each word sees just the steps it would see alone: lowest rank, leftmost.

Nothing moves between tasks; a text's ids do not depend on the words merged beside it.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedback_rank.llm.tokens import in_small_batches

CACHED_WORDS = 1 << 20  # words whose ids a Python worker keeps; half of them go, oldest first, when there are more
CACHED_BYTES = 64       # longer words are merged anew in each batch
RUN_WORDS = 1 << 18     # words of texts that are parted before they are merged
_DEAD = -1


class Vocabulary:
    """Tokens by rank: ``tokens[rank]`` are the bytes. Every single byte must be a token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        self._pairs: dict[tuple[int, int], int] = {}

    @staticmethod
    def parse(lines: Iterable[bytes]) -> Vocabulary:
        return Vocabulary({base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())})

    def pair(self, left: int, right: int) -> int:
        """The rank of the token of both symbols' bytes; -1 if they make none."""
        found = self._pairs.get((left, right))
        if found is None:
            found = self.ranks.get(self.tokens[left] + self.tokens[right], _DEAD)
            if len(self._pairs) >= 1 << 20:
                self._pairs.clear()
            self._pairs[left, right] = found
        return found

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def replay(words: list[bytes], vocabulary: Vocabulary) -> list[np.ndarray]:
    """The ids of each word, all words merged side by side."""
    lengths = np.array([len(word) for word in words], dtype=np.int64)
    ends = np.cumsum(lengths + 1)  # a dead symbol after each word
    size = int(ends[-1]) if len(ends) else 0
    data = np.frombuffer(b"\0".join(words) + b"\0", dtype=np.uint8)[:size]
    first = vocabulary.bytes[data]
    first[ends - 1] = _DEAD
    # the token that each place makes with its right neighbour, by distinct pairs of bytes
    both = np.where((first[:-1] == _DEAD) | (first[1:] == _DEAD), -1, (first[:-1] << 32) | first[1:])
    pairs, which = np.unique(both, return_inverse=True)
    known = [vocabulary.pair(x >> 32, x & 0xFFFFFFFF) if x >= 0 else _DEAD for x in pairs.tolist()]
    makes_at = np.array(known, dtype=np.int64)[which] if size > 1 else np.empty(0, np.int64)

    index: dict[int, list[int]] = {}
    order = np.argsort(makes_at, kind="stable")
    tokens, starts = np.unique(makes_at[order], return_index=True)
    for token, places in zip(tokens.tolist(), np.split(order, starts[1:])):
        if token != _DEAD:
            index[token] = places.tolist()

    symbols, makes = first.tolist(), [*makes_at.tolist(), _DEAD]
    after, before = list(range(1, size + 1)), list(range(-1, size - 1))
    front = list(index)
    heapq.heapify(front)
    pair = vocabulary.pair
    while front:
        token = heapq.heappop(front)
        places = index.pop(token, None)
        if places is None:
            continue
        places.sort()
        for done, at in enumerate(places):
            if makes[at] != token:  # an earlier merge took this place or its neighbour
                continue
            gone = after[at]
            right, left = after[gone], before[at]
            symbols[at], symbols[gone], makes[gone] = token, _DEAD, _DEAD
            after[at] = right
            before[right] = at
            lower = False
            now = makes[at] = pair(token, symbols[right]) if symbols[right] != _DEAD else _DEAD
            if now != _DEAD:
                if now in index:
                    index[now].append(at)
                else:
                    index[now] = [at]
                    heapq.heappush(front, now)
                lower = now < token
            if left >= 0 and symbols[left] != _DEAD:
                now = makes[left] = pair(symbols[left], token)
                if now != _DEAD:
                    if now in index:
                        index[now].append(left)
                    else:
                        index[now] = [left]
                        heapq.heappush(front, now)
                    lower = lower or now < token
            if lower:  # that one first, then the rest of these places
                rest = [x for x in places[done + 1:] if makes[x] == token]
                if token in index:
                    index[token] += rest
                elif rest:
                    index[token] = rest
                heapq.heappush(front, token)
                break
    merged = np.array(symbols, dtype=np.int64)
    alive = merged != _DEAD
    bounds = np.concatenate([[0], np.cumsum(alive)])[np.concatenate([[0], ends])] if size else np.zeros(len(words) + 1, np.int64)
    ids = merged[alive].astype("<u4")
    return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def _listed(kind: str) -> str:
    """The characters below U+10000 that ``kind`` matches, as the inside of a set."""
    points = [ord(c) for c in regex.findall(kind, "".join(chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000))]
    runs: list[list[int]] = []
    for point in points:
        if runs and runs[-1][1] == point - 1:
            runs[-1][1] = point
        else:
            runs.append([point, point])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in runs)


class Parting:
    """Texts to words. The standard library's engine is about twice as fast, but knows no ``\\p``: for texts
    below U+10000 it gets the pattern with its kinds of characters listed, if the pattern has but these kinds."""

    _KINDS = r"\\p\{L\}|\\p\{N\}|\\s|\\S"

    def __init__(self, pattern: str):
        self.any = regex.compile(pattern)
        self.low = None
        if "\\" not in re.sub(self._KINDS, "", pattern) and not re.search(r"\[[^\]]*\\S", pattern):
            sets, out, inside = {kind: _listed(kind) for kind in (r"\p{L}", r"\p{N}", r"\s")}, "", False
            for part in re.split(f"({self._KINDS}|[][])", pattern):
                if part in sets:
                    part = sets[part] if inside else f"[{sets[part]}]"
                elif part == r"\S":
                    part = "[^" + sets[r"\s"] + "]"
                elif part in ("[", "]"):
                    inside = part == "["
                out += part
            self.low = re.compile(out)

    def findall(self, text: str) -> list[str]:
        return self._engine(text).findall(text)

    def runs(self, text: str, size: int) -> Iterator[list[str]]:
        """The words, ``size`` at a time."""
        words = (found.group() for found in self._engine(text).finditer(text))
        while some := list(islice(words, size)):
            yield some

    def _engine(self, text: str):
        low = self.low is not None and (text.isascii() or len(text.encode("utf-16-le")) == 2 * len(text))
        return self.low if low else self.any


class Encoder:
    """Texts to ids; keeps the words it has merged."""

    def __init__(self, vocabulary: Vocabulary, pattern: str, cached_words: int = CACHED_WORDS):
        self.vocabulary, self.parting, self.cached_words = vocabulary, Parting(pattern), cached_words
        self._ids: dict[str, bytes] = {}

    def _merged(self, words: set[str]) -> dict[str, bytes]:
        """The ids of these words, as little-endian unsigned 32-bit integers."""
        new = [word for word in words if word not in self._ids]
        ids = replay([word.encode() for word in new], self.vocabulary) if new else []
        fresh = {word: found.tobytes() for word, found in zip(new, ids)}
        kept = {word: found for word, found in fresh.items() if len(word) <= CACHED_BYTES}
        known = self._ids
        if len(known) + len(kept) > self.cached_words:
            self._ids = dict(islice(known.items(), len(known) // 2, None))
        if len(self._ids) + len(kept) <= self.cached_words:
            self._ids.update(kept)
        if known is self._ids and len(kept) == len(fresh):
            return known
        return {word: fresh[word] if word in fresh else known[word] for word in words}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        run: list[list[str]] = []
        for text in texts:
            if len(text) > RUN_WORDS:
                out += self._joined(run)
                out.append(self._long(text))
                run = []
                continue
            run.append(self.parting.findall(text))
            if sum(map(len, run)) >= RUN_WORDS:
                out += self._joined(run)
                run = []
        return out + self._joined(run)

    def _joined(self, run: list[list[str]]) -> list[bytes]:
        ids = self._merged(set().union(*run)) if run else {}
        return [b"".join(map(ids.__getitem__, words)) for words in run]

    def _long(self, text: str) -> bytes:
        return b"".join(part for some in self.parting.runs(text, RUN_WORDS) for part in self._joined([some]))


@lru_cache(maxsize=2)
def _encoder(name: str, pattern: str) -> Encoder:
    with open(SparkFiles.get(name), "rb") as lines:
        return Encoder(Vocabulary.parse(lines), pattern)


def _shipped(spark: SparkSession, path: str) -> str:
    """The file, sent to every executor with the session's files; its name there."""
    spark.sparkContext.addFile(path)
    return path.rstrip("/").rsplit("/", 1)[-1]


def _texts(column: pa.Array) -> list[str]:
    return ["" if text is None else text.decode("utf-8", "replace") for text in column.to_pylist()]


def _slices(texts: list[str], size: int = 4_000_000) -> Iterator[tuple[int, list[str]]]:
    first = 0
    while first < len(texts):
        upto, held = first, 0
        while upto < len(texts) and (held == 0 or held + len(texts[upto]) <= size):
            held += len(texts[upto])
            upto += 1
        yield first, texts[first:upto]
        first = upto


def encoded_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): the tokens of each whole text, as little-endian unsigned 32-bit integers.

    ``path`` names a rank file (a base64 token and its rank on each line) that the driver can
    read; it is sent to the executors. Special tokens are ordinary text. A null or empty text
    has no ids; bytes that are no UTF-8 count as U+FFFD; a very long text is parted into words
    run by run; repeated rows are encoded one by one; other columns are not read, and an empty
    table gives no rows.
    """
    name = _shipped(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(name, pattern)
        for batch in batches:
            for first, texts in _slices(_texts(batch.column(1))):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), pa.array(encoder.encode(texts), pa.binary())], ["doc_id", "ids"]
                )

    return in_small_batches(docs.select("doc_id", F.col("text").cast("binary").alias("text"))).mapInArrow(run, _schema(docs, "ids binary"))


def decoded_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text): the bytes that each row's ids stand for; null ids give null."""
    name = _shipped(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _encoder(name, "").vocabulary
        for batch in batches:
            for row in range(len(batch)):
                ids = batch.column(1)[row].as_py()
                text = None if ids is None else vocabulary.decode(np.frombuffer(ids, "<u4"))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), pa.array([text], pa.binary())], ["doc_id", "text"])

    return in_small_batches(encoded.select("doc_id", "ids")).mapInArrow(run, _schema(encoded, "text binary"))


def encoding_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each whole text, encoded and decoded again.

    The digests are in lowercase hex, of the ids as :func:`encoded_documents` gives them and of
    the bytes they decode to. Odd rows are treated as there. One pass, no shuffle.
    """
    name = _shipped(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(name, pattern)
        for batch in batches:
            for first, texts in _slices(_texts(batch.column(1))):
                encoded = encoder.encode(texts)
                decoded = [hashlib.sha256(encoder.vocabulary.decode(np.frombuffer(ids, "<u4"))).hexdigest() for ids in encoded]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, len(texts)), pa.array([len(ids) // 4 for ids in encoded], pa.int64()),
                    pa.array([hashlib.sha256(ids).hexdigest() for ids in encoded]), pa.array(decoded),
                ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return in_small_batches(docs.select("doc_id", F.col("text").cast("binary").alias("text"))).mapInArrow(
        run, _schema(docs, "n_tokens long, ids_sha256 string, decoded_sha256 string")
    )


def _schema(docs: DataFrame, rest: str) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {rest}"
