"""Benchmark passages in documents, found by greedy string tiling.

Runs of SEED_WORDS words of the benchmark items, as rolling hashes (Karp and Rabin 1987),
are looked up at every position of every document. Seeds of one document and item that
follow each other are joined to matches. Then, as in running Karp-Rabin greedy string
tiling (Wise 1993), the longest match free of marked words is marked in both, what is
left of the others is shortened, and so on down to the shortest length. The share of the
item's words that is tiled in the end tells how much of the item the document holds, in
whatever order its parts come; one long tile tells as much, however long the item is. An
item of fewer words than a seed is one run of all its words, and so is a document of
fewer words: such an item is found where it is the whole document.

Documents are not shuffled. The benchmark goes to the tasks in parts of bounded size, one
pass over the documents for each part.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from feedback_rank.llm.tokens import in_small_batches, ragged, shingles, word_slices

SEED_WORDS = 5
COVERAGE = 0.5
LONG_TILE = 50             # words in one tile that are a leak whatever the coverage
PART_BYTES = 8_000_000     # of benchmark text in one pass; a longer item has a pass of its own
MATCHES_AT_ONCE = 2_000_000
_TABLE_BITS = 22


def tiles(matches: list[tuple[int, int, int]], least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles of (length, place in the item, place in the text) matches, longest first.

    Of equally long ones the first in the item, then in the text, is marked.
    """
    heap = [(-length, i, j) for length, i, j in matches]
    heapq.heapify(heap)
    in_item: set[int] = set()
    in_text: set[int] = set()
    found = []
    while heap:
        length, i, j = heapq.heappop(heap)
        free, start = [], 0
        for k in range(-length):
            if i + k in in_item or j + k in in_text:
                if k - start >= least:
                    free.append((start, k))
                start = k + 1
        if start == 0:
            found.append((-length, i, j))
            in_item.update(range(i, i - length))
            in_text.update(range(j, j - length))
            continue
        if -length - start >= least:
            free.append((start, -length))
        for a, b in free:
            heapq.heappush(heap, (a - b, i + a, j + a))
    return found


class BenchmarkPart:
    """Some benchmark items' seeds, sorted for lookup."""

    def __init__(self, item_ids: list, texts: list[str | None], size: int, long_tile: int = LONG_TILE):
        hashes, counts = [], []
        for first, upto, words in word_slices(pa.array(texts, pa.string())):
            hashes.append(words.hashes())
            counts.append(words.counts)
        self.item_ids, self.size, self.long_tile = item_ids, size, long_tile
        self.words = np.concatenate(counts) if counts else np.empty(0, np.int64)
        bounds = np.concatenate([[0], np.cumsum(self.words)]).astype(np.int64)
        grams, gram_bounds = shingles(np.concatenate(hashes) if hashes else np.empty(0, np.uint64), bounds, size)
        gram_counts = np.diff(gram_bounds)
        item = np.repeat(np.arange(len(self.words)), gram_counts)
        place = np.arange(len(grams)) - np.repeat(gram_bounds[:-1], gram_counts)
        order = np.argsort(grams, kind="stable")
        grams, self.item, self.place = (x[order] for x in (grams, item, place))
        self.seeds, self.first, self.repeats = np.unique(grams, return_index=True, return_counts=True)
        self.table = np.zeros(1 << _TABLE_BITS, dtype=bool)
        self.table[self.seeds >> np.uint64(64 - _TABLE_BITS)] = True

    def covered(self, hashes: np.ndarray, bounds: np.ndarray, coverage: float) -> list[tuple[int, int, int, int]]:
        """(text, item, words covered, tiles) of all texts and items that reach the coverage."""
        grams, gram_bounds = shingles(hashes, bounds, self.size)
        likely = np.flatnonzero(self.table[grams >> np.uint64(64 - _TABLE_BITS)])
        if not len(likely) or not len(self.seeds):
            return []
        at = np.minimum(np.searchsorted(self.seeds, grams[likely]), len(self.seeds) - 1)
        hit = self.seeds[at] == grams[likely]
        places, at = likely[hit], at[hit]
        text = np.searchsorted(gram_bounds, places, side="right") - 1
        # whole texts at a time, up to so many matches
        found, ends, begin = [], np.cumsum(self.repeats[at]), 0
        while begin < len(places):
            limit = (ends[begin - 1] if begin else 0) + MATCHES_AT_ONCE
            stop = max(int(np.searchsorted(ends, limit, side="right")), begin + 1)
            last = text[stop - 1]
            if stop < len(places) and text[stop] == last:  # not in the middle of a text, unless it is alone
                head = int(np.searchsorted(text, last))
                stop = head if head > begin else int(np.searchsorted(text, last, side="right"))
            part = slice(begin, stop)
            found += self._tiled(places[part] - gram_bounds[text[part]], text[part], at[part], coverage)
            begin = stop
        return found

    def _tiled(self, places: np.ndarray, text: np.ndarray, at: np.ndarray, coverage: float) -> list[tuple[int, int, int, int]]:
        each = np.repeat(np.arange(len(at)), self.repeats[at])
        seed = ragged(self.first[at], self.repeats[at])
        i, j, item, text = self.place[seed], places[each], self.item[seed], text[each]
        # seeds that follow each other on one diagonal of a text and an item are one match
        order = np.lexsort((i, j - i, item, text))
        i, j, item, text = i[order], j[order], item[order], text[order]
        new = np.ones(len(i), dtype=bool)
        new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (j[1:] - i[1:] != j[:-1] - i[:-1]) | (i[1:] != i[:-1] + 1)
        heads = np.flatnonzero(new)
        lengths = np.diff(np.append(heads, len(i))) + self.size - 1
        i, j, item, text = i[heads], j[heads], item[heads], text[heads]
        lengths = np.minimum(lengths, self.words[item])  # of an item shorter than a seed
        pair = np.ones(len(heads), dtype=bool)
        pair[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1])
        pairs = np.append(np.flatnonzero(pair), len(heads))
        # the matches together cannot tile more words than they have, nor make a longer tile
        enough = np.add.reduceat(lengths, pairs[:-1]) >= coverage * self.words[item[pairs[:-1]]]
        enough |= np.maximum.reduceat(lengths, pairs[:-1]) >= self.long_tile
        found = []
        for a, b in zip(pairs[:-1][enough].tolist(), pairs[1:][enough].tolist()):
            mine = tiles(list(zip(lengths[a:b].tolist(), i[a:b].tolist(), j[a:b].tolist())), self.size)
            words = sum(length for length, _, _ in mine)
            if words >= coverage * self.words[item[a]] or mine[0][0] >= self.long_tile:  # the first is the longest
                found.append((int(text[a]), int(item[a]), words, len(mine)))
        return found


def _parts(benchmark: DataFrame, size: int, part_bytes: int, long_tile: int) -> Iterator[BenchmarkPart]:
    """The benchmark in parts that each hold about ``part_bytes`` of text at most."""
    rows = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-total // part_bytes))
    for part in range(parts):
        mine = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text").collect()
        yield BenchmarkPart([r.item_id for r in mine], [r.text for r in mine], size, long_tile)


def _matched(batches: Iterator[pa.RecordBatch], part: BenchmarkPart, coverage: float, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, items, words, counts = [], [], [], []
        for first, _, found in word_slices(batch.column(1)):
            for text, item, covered, n in part.covered(found.hashes(), found.bounds, coverage):
                texts.append(first + text)
                items.append(item)
                words.append(covered)
                counts.append(n)
        if texts:
            of_item = part.words[items].astype(np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(texts)), pa.array([part.item_ids[i] for i in items], schema.field(1).type),
                pa.array(of_item), pa.array(words, pa.int64()), pa.array(np.array(words) / of_item), pa.array(counts, pa.int64()),
            ], schema=schema)


def leaked_items(
    docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, seed_words: int = SEED_WORDS, part_bytes: int = PART_BYTES,
    long_tile: int = LONG_TILE,
) -> DataFrame:
    """(doc_id, item_id, item_words, covered_words, coverage, tiles): what documents hold of the benchmark.

    One row for each row of ``docs`` and of ``benchmark`` (item_id, text) whose words are
    tiled to ``coverage`` or more, by matches of ``seed_words`` words or more, or that has a tile of ``long_tile``
    words or more. An item of fewer words than ``seed_words`` is found in documents that have just its
    words and no others. Items without a word are found nowhere, and null or empty documents hold
    nothing; very long texts count whole; repeated rows are each reported; other columns are not read. Empty tables give no rows.
    The benchmark's size is measured at once.
    """
    narrow = in_small_batches(docs).select("doc_id", F.col("text").cast("string").alias("text"))
    schema = StructType(
        [narrow.schema["doc_id"], benchmark.schema["item_id"], StructField("item_words", LongType()),
         StructField("covered_words", LongType()), StructField("coverage", DoubleType()), StructField("tiles", LongType())]
    )
    arrow, found = to_arrow_schema(schema), None
    for part in _parts(benchmark, seed_words, part_bytes, long_tile):
        shared = docs.sparkSession.sparkContext.broadcast(part)
        rows = narrow.mapInArrow(lambda batches, shared=shared: _matched(batches, shared.value, coverage, arrow), schema)
        found = rows if found is None else found.unionByName(rows)
    return found


def _kept(batches: Iterator[pa.RecordBatch], text_at: int, part: BenchmarkPart, coverage: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        clean = np.ones(len(batch), dtype=bool)
        for first, _, found in word_slices(batch.column(text_at)):
            for text, *_ in part.covered(found.hashes(), found.bounds, coverage):
                clean[first + text] = False
        yield batch.filter(pa.array(clean))


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, seed_words: int = SEED_WORDS, part_bytes: int = PART_BYTES,
    long_tile: int = LONG_TILE,
) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; see :func:`leaked_items`. The columns stay as they are."""
    text_at = docs.columns.index("text")
    for part in _parts(benchmark, seed_words, part_bytes, long_tile):
        shared = docs.sparkSession.sparkContext.broadcast(part)
        docs = in_small_batches(docs).mapInArrow(lambda batches, shared=shared: _kept(batches, text_at, shared.value, coverage), docs.schema)
    return docs
