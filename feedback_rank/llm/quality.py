"""Quality of whole texts: gradient-boosted trees over document statistics.

The statistics of all documents are taken in one pass and written once. Trees are grown on
histograms of binned statistics, level by level, for the logistic loss (Friedman 2001; bins
as in Ke et al. 2017), from labelled rows: all of them, or a share chosen by a hash where
there are more than TRAIN_ROWS. The trees are complete and lie in flat arrays, so numpy
walks all trees for all rows of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from feedback_rank.llm.tokens import Words, in_small_batches, shingles, text_slices
from feedback_rank.session import checkpointed

TRAIN_ROWS = 50_000  # about so many labelled rows at most are learned from
TREES = 60
DEPTH = 4
BINS = 64
RATE = 0.15
LEAST_ROWS = 10      # in a leaf, each counted as the loss's curvature times four
SHRINK = 1.0         # added to the curvature of a leaf
THRESHOLD = 0.3
SEED = 17

#: classes of bytes whose share of a text is counted
_CLASSES = ("space", "newline", "upper", "lower", "digit", "stop", "comma", "quote", "bracket", "mark", "symbol", "high")
STATISTICS = (
    "bytes", "words", *(f"share_{c}" for c in _CLASSES), "word_length", "word_length_spread", "longest_word", "distinct_words",
    "distinct_runs", "line_words", "shouted_words", "marked_words",
)


def _byte_classes() -> np.ndarray:
    kind = np.full(256, _CLASSES.index("symbol"), dtype=np.int64)
    for name, chars in (
        ("space", " \t\r\v\f"), ("newline", "\n"), ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("lower", "abcdefghijklmnopqrstuvwxyz"),
        ("digit", "0123456789"), ("stop", "."), ("comma", ",;:"), ("quote", "'\"`"), ("bracket", "()[]{}<>"), ("mark", "!?"),
    ):
        kind[list(chars.encode())] = _CLASSES.index(name)
    kind[128:] = _CLASSES.index("high")
    return kind


_KIND = _byte_classes()
_UPPER, _LOWER = _CLASSES.index("upper"), _CLASSES.index("lower")
_MARKED = np.isin(_KIND, [_CLASSES.index(c) for c in ("symbol", "mark", "bracket")])


def statistics(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The STATISTICS of each text, all of them numbers; an empty text has zeros."""
    texts = len(bounds) - 1
    sizes = np.diff(bounds)
    of_byte = np.repeat(np.arange(texts) * len(_CLASSES), sizes)
    kinds = _KIND[data]
    shares = np.bincount(of_byte + kinds, minlength=texts * len(_CLASSES)).reshape(texts, len(_CLASSES))

    words = Words(data, bounds)
    counts = words.counts
    of_word = np.repeat(np.arange(texts), counts)
    lengths = (words.ends - words.starts).astype(np.float64)
    per_word = 1 / np.maximum(counts, 1)
    mean = np.bincount(of_word, lengths, texts) * per_word
    spread = np.sqrt(np.maximum(np.bincount(of_word, lengths**2, texts) * per_word - mean**2, 0))
    longest = np.zeros(texts)
    np.maximum.at(longest, of_word, lengths)

    def distinct(hashes: np.ndarray, of: np.ndarray) -> np.ndarray:
        order = np.lexsort((hashes, of))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (of[order][1:] != of[order][:-1])
        return np.bincount(of[order][new], minlength=texts)

    hashes = words.hashes()
    runs, run_bounds = shingles(hashes, words.bounds, 3)
    run_counts = np.diff(run_bounds)
    upper = np.concatenate([[0], np.cumsum(kinds == _UPPER)])
    lower = np.concatenate([[0], np.cumsum(kinds == _LOWER)])
    marked = np.concatenate([[0], np.cumsum(_MARKED[data])])
    ups, lows = upper[words.ends] - upper[words.starts], lower[words.ends] - lower[words.starts]
    marks = marked[words.ends] - marked[words.starts]
    return np.column_stack([
        sizes, counts, shares / np.maximum(sizes, 1)[:, None], mean, spread, longest, distinct(hashes, of_word) * per_word,
        distinct(runs, np.repeat(np.arange(texts), run_counts)) / np.maximum(run_counts, 1), counts / (shares[:, 1] + 1),
        np.bincount(of_word, (ups > 1) & (lows == 0), texts) * per_word, np.bincount(of_word, marks > 0, texts) * per_word,
    ]).astype(np.float32)


def _measured(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(data, bounds) for _, _, data, bounds in text_slices(batch.column(1))]
        flat = np.concatenate(rows).ravel() if rows else np.empty(0, np.float32)
        ends = np.arange(len(batch) + 1, dtype=np.int32) * len(STATISTICS)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], schema=schema)


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats): the STATISTICS of every document's whole text, zeros for a null or empty one."""
    narrow = in_small_batches(docs).select("doc_id", F.col("text").cast("string").alias("text"))
    schema = StructType([narrow.schema["doc_id"], StructField("stats", ArrayType(FloatType()))])
    arrow = pa.schema([to_arrow_schema(schema).field(0), pa.field("stats", pa.list_(pa.field("item", pa.float32())))])
    return narrow.mapInArrow(lambda batches: _measured(batches, arrow), schema)


@dataclass
class BoostedTrees:
    """Complete trees in flat arrays: by tree and node the statistic, its threshold, and each leaf's value."""

    feature: np.ndarray    # trees by inner nodes
    threshold: np.ndarray  # go right above it
    value: np.ndarray      # trees by leaves
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 of each row."""
        trees, inner = self.feature.shape
        total = np.full(len(x), self.base)
        if trees:
            flat_feature, flat_threshold = self.feature.ravel(), self.threshold.ravel()
            for start in range(0, len(x), 4096):
                part = x[start:start + 4096]
                node = np.zeros((len(part), trees), dtype=np.int64)
                row, tree = np.arange(len(part))[:, None], np.arange(trees) * inner
                while node[0, 0] < inner:  # all leaves lie equally deep
                    at = tree + node
                    node = 2 * node + 1 + (part[row, flat_feature[at]] > flat_threshold[at])
                total[start:start + 4096] += self.value.ravel()[np.arange(trees) * self.value.shape[1] + node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def grow_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> BoostedTrees:
    """Trees for the logistic loss from rows ``x`` and labels ``y`` between 0 and 1."""
    features, inner = x.shape[1], 2**depth - 1
    empty = BoostedTrees(np.zeros((0, inner), np.int64), np.zeros((0, inner), np.float32), np.zeros((0, inner + 1)), 0.0)
    if not len(y):
        return empty
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    empty.base = float(np.log(mean / (1 - mean)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(features)]
    binned = np.column_stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(features)])
    limits = np.full((features, bins), np.inf, dtype=np.float32)  # the largest value of each bin
    for f in range(features):
        limits[f, :len(edges[f])] = edges[f]

    score, grown = np.full(len(y), empty.base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        slope, bend = p - y, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            cell = (node - first) * bins
            best = np.full(width, 1e-9)
            cut = np.full(width, bins - 1)
            chosen = np.zeros(width, dtype=np.int64)
            for f in range(features):
                g = np.bincount(cell + binned[:, f], slope, width * bins).reshape(width, bins).cumsum(axis=1)
                h = np.bincount(cell + binned[:, f], bend, width * bins).reshape(width, bins).cumsum(axis=1)
                all_g, all_h = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + SHRINK) + (all_g - g) ** 2 / (all_h - h + SHRINK) - all_g**2 / (all_h + SHRINK)
                gain[(h * 4 < LEAST_ROWS) | ((all_h - h) * 4 < LEAST_ROWS)] = 0
                at = gain.argmax(axis=1)
                better = gain[np.arange(width), at] > best
                best = np.where(better, gain[np.arange(width), at], best)
                chosen, cut = np.where(better, f, chosen), np.where(better, at, cut)
            feature[first:first + width], threshold[first:first + width] = chosen, limits[chosen, cut]
            mine = node - first
            node = 2 * node + 1 + (binned[np.arange(len(y)), chosen[mine]] > cut[mine])
        leaf = node - inner
        value = -rate * np.bincount(leaf, slope, inner + 1) / (np.bincount(leaf, bend, inner + 1) + SHRINK)
        score += value[leaf]
        grown.append((feature, threshold, value))
    return BoostedTrees(*(np.array(part) for part in zip(*grown)), empty.base)


def train_quality(stats: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, seed: int = SEED) -> BoostedTrees:
    """Trees from the statistics of documents and (doc_id, quality).

    Labels of one document are averaged; null ids and labels teach nothing. Of more than
    ``train_rows`` labelled rows a share is taken, by a hash of the id. Runs its jobs at once
    and grows the trees from the rows taken, which are bounded. No labelled row gives no trees
    and a score of 0.5.
    """
    once = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(
        F.avg(F.col("quality").cast("double")).alias("_quality")
    )
    rows = checkpointed(stats.join(once, "doc_id").select("doc_id", "stats", "_quality"))
    count = rows.count()
    if count > train_rows:
        share = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000))
        rows = rows.where(share < int(1_000_000 * train_rows / count))
    taken = rows.select("stats", "_quality").toArrow().combine_chunks()
    flat = taken["stats"].combine_chunks() if taken.num_rows else None
    x = flat.flatten().to_numpy().reshape(-1, len(STATISTICS)) if flat is not None else np.empty((0, len(STATISTICS)), np.float32)
    return grow_trees(x, taken["_quality"].to_numpy())


def quality_scores(stats: DataFrame, model: BoostedTrees, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of every row of :func:`document_statistics`; nothing is shuffled."""
    schema = StructType([stats.schema["doc_id"], *stats.select(F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema.fields])
    arrow = to_arrow_schema(schema)
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, len(STATISTICS))
            p = shared.value.scores(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], schema=arrow)

    return stats.select("doc_id", "stats").mapInArrow(scored, schema)
