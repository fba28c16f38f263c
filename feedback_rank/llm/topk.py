"""Exact top-k inner products by KD-trees, one for each shard of the vectors.

A task cuts its rows into shards of bounded size and grows a tree on each: median splits
of the widest side (Bentley 1975), every node with the tight box of its points and its
smallest id. A query walks a tree best first: the node whose box allows the highest
product next, until no box left can beat the k-th product known. That k-th product is
carried on: a first round searches one shard for each block of queries, and all other
shards begin with what it found.

Queries go to the shards in blocks, never the vectors to the queries.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedback_rank.operators.numbering import number_rows
from feedback_rank.session import checkpointed

SHARD_BYTES = 16_000_000  # of the points of a shard
LEAF_ROWS = 64
BLOCK_QUERIES = 256
_EXACT = float(1 << 53)  # products of whole numbers up to here are exact in doubles


class Tree:
    """A KD-tree in flat arrays; node i has the children 2i + 1 and 2i + 2, leaves the same depth."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, low: np.ndarray, high: np.ndarray, least: np.ndarray):
        self.ids, self.points, self.low, self.high, self.least = ids, points, low, high, least
        self.inner = len(low) // 2
        self.cuts = np.linspace(0, len(ids), self.inner + 2).astype(np.int64)

    @staticmethod
    def grow(ids: np.ndarray, points: np.ndarray, leaf_rows: int = LEAF_ROWS) -> Tree:
        n = len(ids)
        depth = max(0, int(np.ceil(np.log2(max(1, n / leaf_rows)))))
        order, leaves = np.arange(n), 2**depth
        cuts = np.linspace(0, n, leaves + 1).astype(np.int64)
        for level in range(depth):  # halves of halves; the cuts of all levels are among the leaves' own
            step = leaves >> level
            for first in range(0, leaves, step):
                a, mid, b = cuts[first], cuts[first + step // 2], cuts[first + step]
                if not points.shape[1]:
                    continue
                mine = points[order[a:b]]
                side = int((mine.max(axis=0) - mine.min(axis=0)).argmax())
                order[a:b] = order[a:b][np.argpartition(mine[:, side], mid - a)]
        ids, points = ids[order], points[order]
        nodes = 2 * leaves - 1
        low, high = np.empty((nodes, points.shape[1])), np.empty((nodes, points.shape[1]))
        least = np.empty(nodes, dtype=np.int64)
        for leaf in range(leaves):
            mine, node = slice(cuts[leaf], cuts[leaf + 1]), leaves - 1 + leaf
            low[node], high[node], least[node] = points[mine].min(axis=0), points[mine].max(axis=0), ids[mine].min()
        for node in range(leaves - 2, -1, -1):
            a, b = 2 * node + 1, 2 * node + 2
            low[node], high[node] = np.minimum(low[a], low[b]), np.maximum(high[a], high[b])
            least[node] = min(least[a], least[b])
        return Tree(ids, points, low, high, least)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, known: list[list[tuple[int, int]]]) -> list[list[tuple[int, int]]]:
        """Of the k best (score, -id) of each query, among this tree's rows and those ``known`` before, the tree's own.

        Rows with the query's id are left out. Scores are whole numbers.
        """
        most = max(np.abs(self.points).max(initial=0), 1) * max(np.abs(queries).max(initial=0), 1) * self.points.shape[1]
        if most < _EXACT:
            points, low, high = self.points, self.low, self.high
        else:  # beyond doubles: Python's own integers
            whole = np.vectorize(int, otypes=[object])
            points, low, high, queries = whole(self.points), whole(self.low), whole(self.high), whole(queries)
        # by query and node: no point of the node's box has a higher product
        zero = queries * 0
        bounds = np.maximum(queries, zero) @ high.T + np.minimum(queries, zero) @ low.T
        return [
            self._walk(int(own), query, bound.tolist(), k, points, before)
            for own, query, bound, before in zip(query_ids, queries, bounds, known)
        ]

    def _walk(self, own: int, query: np.ndarray, bound: list, k: int, points: np.ndarray, known: list[tuple[int, int]]) -> list[tuple[int, int]]:
        best = [(score, minus_id, 0) for score, minus_id in known]
        heapq.heapify(best)
        least = self.least
        front = [(-bound[0], int(least[0]), 0)]
        while front:
            top, smallest, node = heapq.heappop(front)
            # a tie can still be won, by a smaller id; of equal tops the smallest ids come first
            if len(best) == k and (-top, -smallest) <= best[0][:2]:
                break
            if node < self.inner:
                for child in (2 * node + 1, 2 * node + 2):
                    heapq.heappush(front, (-bound[child], int(least[child]), child))
                continue
            leaf = slice(self.cuts[node - self.inner], self.cuts[node - self.inner + 1])
            scores, ids = points[leaf] @ query, self.ids[leaf]
            hopeful = np.flatnonzero(scores >= best[0][0]) if len(best) == k else np.arange(len(ids))
            for i in hopeful.tolist():
                entry = (int(scores[i]), -int(ids[i]), 1)
                if entry[1] == -own:
                    continue
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry[:2] > best[0][:2]:
                    heapq.heapreplace(best, entry)
        return [entry[:2] for entry in best if entry[2]]

    def dump(self) -> bytes:
        head = np.array([len(self.ids), self.points.shape[1], len(self.low)], np.int64)
        return b"".join(x.tobytes() for x in (head, self.ids, self.points, self.low, self.high, self.least))

    @staticmethod
    def load(blob: bytes) -> Tree:
        n, width, nodes = np.frombuffer(blob, np.int64, 3).tolist()
        at, parts = 24, []
        for kind, shape in ((np.int64, (n,)), (np.float64, (n, width)), (np.float64, (nodes, width)), (np.float64, (nodes, width)), (np.int64, (nodes,))):
            size = int(np.prod(shape))
            parts.append(np.frombuffer(blob, kind, size, at).reshape(shape))
            at += 8 * size
        return Tree(*parts)


def whole_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, point) with each component as floor(scale * x) in doubles.

    Rows with a null id, a null vector, or a component that is null or not finite are left out.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    point = F.transform("embedding", lambda x: _floor(scale * x.cast("double")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite).select(
        F.col("vec_id").cast("long").alias("vec_id"), point.alias("point")
    )


def _floor(x: Column) -> Column:
    # floor() of Spark gives a long, which a large double does not fit
    return F.when(F.abs(x) >= float(1 << 53), x).otherwise(F.floor(x).cast("double"))


def _rows_by_width(batches: Iterator[pa.RecordBatch], most: int | None, size: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, ids, points) in runs of one width, of up to ``most`` rows, or as many as ``size`` bytes hold."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        ids, points = batch.column(0).to_numpy(), batch.column(1)
        widths = points.value_lengths().to_numpy()
        for width in np.unique(widths).tolist():
            mine = np.flatnonzero(widths == width)
            flat = points.take(pa.array(mine)).flatten().to_numpy().reshape(len(mine), width)
            held.setdefault(width, []).append((ids[mine], flat))
            rows = most or max(1, size // (8 * max(1, width)))
            while sum(len(x) for x, _ in held[width]) >= rows:
                all_ids, all_points = (np.concatenate(x) for x in zip(*held[width]))
                yield width, all_ids[:rows], all_points[:rows]
                held[width] = [(all_ids[rows:], all_points[rows:])]
    for width, parts in held.items():
        all_ids, all_points = (np.concatenate(x) for x in zip(*parts))
        if len(all_ids):
            yield width, all_ids, all_points


def _trees(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId()
    for number, (width, ids, points) in enumerate(_rows_by_width(batches, None, size)):
        tree = Tree.grow(ids, points.astype(np.float64))
        yield pa.RecordBatch.from_pydict({
            "task": pa.array([task], pa.int32()), "number": pa.array([number], pa.int32()), "width": pa.array([width], pa.int32()),
            "tree": pa.array([tree.dump()], pa.binary()),
        })


def _query_blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId()
    for number, (width, ids, points) in enumerate(_rows_by_width(batches, rows)):
        yield pa.RecordBatch.from_pydict({
            "task": pa.array([task], pa.int32()), "number": pa.array([number], pa.int32()), "width": pa.array([width], pa.int32()),
            "ids": pa.array([ids.astype(np.int64).tobytes()], pa.binary()), "points": pa.array([points.astype(np.float64).tobytes()], pa.binary()),
        })


def _searched(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Each shard's tree, followed by the blocks that ask it, to (width, block, what the queries found)."""
    tree, shard = None, None
    for batch in batches:
        for row in range(len(batch)):
            value = {name: batch.column(name)[row].as_py() for name in batch.schema.names}
            if value["tree"] is not None:
                tree, shard = Tree.load(value["tree"]), (value["width"], value["shard"])
                continue
            assert shard == (value["width"], value["shard"])
            ids = np.frombuffer(value["ids"], np.int64)
            points = np.frombuffer(value["points"], np.float64).reshape(len(ids), value["width"])
            before = _unpacked(value["known"], len(ids)) if value["known"] else [[] for _ in ids]
            yield pa.RecordBatch.from_pydict({
                "width": pa.array([value["width"]], pa.int32()), "block": pa.array([value["block"]], pa.int64()),
                "found": pa.array([_packed(tree.search(ids, points, k, before))], pa.binary()),
            })


def _packed(found: list[list[tuple[int, int]]]) -> bytes:
    counts = np.array([len(x) for x in found], np.int64)
    pairs = np.array([entry for best in found for entry in best], np.int64).reshape(-1, 2)
    return counts.tobytes() + pairs.tobytes()


def _unpacked(blob: bytes, n: int) -> list[list[tuple[int, int]]]:
    counts = np.frombuffer(blob, np.int64, n)
    pairs = list(map(tuple, np.frombuffer(blob, np.int64, offset=8 * n).reshape(-1, 2).tolist()))
    ends = np.cumsum(counts).tolist()
    return [pairs[b - c:b] for b, c in zip(ends, counts.tolist())]


def _as_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, ids, found) to a row for each query and partner."""
    for batch in batches:
        for row in range(len(batch)):
            ids = np.frombuffer(batch.column("ids")[row].as_py(), np.int64)
            found = _unpacked(batch.column("found")[row].as_py(), len(ids))
            counts = [len(x) for x in found]
            pairs = np.array([entry for best in found for entry in best], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_pydict({
                "block": pa.array(np.full(len(pairs), batch.column("block")[row].as_py())),
                "at": pa.array(np.repeat(np.arange(len(ids)), counts)), "query_id": pa.array(np.repeat(ids, counts)),
                "vec_id": pa.array(-pairs[:, 1]), "score": pa.array(pairs[:, 0]),
            })


def top_products(
    vectors: DataFrame, queries: DataFrame, k: int = 5, shard_bytes: int = SHARD_BYTES, block_queries: int = BLOCK_QUERIES
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` highest inner products, ties to smaller ids.

    ``vectors`` and ``queries`` are (vec_id, point) of whole numbers, as :func:`whole_vectors`
    gives them. Rows with a query's own id are no partners of it. Each row of a repeated query
    finds its partners, and a repeated partner can take several ranks. Vectors of another
    length than the query's are no partners. Products beyond 64 bits raise an error; empty
    tables give no rows. Vectors stay in their tasks' shards: what moves is each tree once a
    round, and each block of queries once to each shard. Runs its jobs at once.
    """
    trees = checkpointed(
        vectors.mapInArrow(lambda batches: _trees(batches, shard_bytes), "task int, number int, width int, tree binary")
    )
    blocks = checkpointed(
        queries.mapInArrow(lambda batches: _query_blocks(batches, block_queries), "task int, number int, width int, ids binary, points binary")
        .select("width", "ids", "points", F.monotonically_increasing_id().alias("block"))
    )
    shards = number_rows(trees.select("task", "number", "width"), [F.col("task"), F.col("number")], ["width"], "shard")
    numbered = trees.join(shards, ["task", "number", "width"]).select("width", (F.col("shard") - 1).alias("shard"), "tree")
    counts = shards.groupBy("width").agg(F.count("*").alias("shards"))
    blocks = blocks.join(counts, "width").withColumn("first", F.pmod(F.xxhash64("block"), F.col("shards")))
    blocks = checkpointed(blocks)

    def searched(asked: DataFrame) -> DataFrame:
        empty = {c: F.lit(None).cast("binary").alias(c) for c in ("tree", "ids", "points", "known")}
        rows = asked.withColumn("tree", empty["tree"]).select("width", "shard", "block", "tree", "ids", "points", "known").unionByName(
            numbered.select("width", "shard", F.lit(-1).cast("long").alias("block"), "tree", empty["ids"], empty["points"], empty["known"])
        )
        # block -1, the tree itself, comes first
        placed = rows.repartition("width", "shard").sortWithinPartitions("width", "shard", "block")
        return placed.mapInArrow(lambda batches: _searched(batches, k), "width int, block long, found binary")

    first = checkpointed(searched(blocks.withColumn("shard", F.col("first")).withColumn("known", F.lit(None).cast("binary"))))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1), lambda shard: shard != F.col("first"))
    rest = blocks.join(first.withColumnRenamed("found", "known"), ["width", "block"]).withColumn("shard", F.explode(others))
    found = first.unionByName(searched(rest)).join(blocks.select("width", "block", "ids"), ["width", "block"])
    pairs = found.select("block", "ids", "found").mapInArrow(_as_rows, "block long, at long, query_id long, vec_id long, score long")
    place = Window.partitionBy("block", "at").orderBy(F.desc("score"), "vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
