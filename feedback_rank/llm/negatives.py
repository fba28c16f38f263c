"""Hard negatives by rotated one-bit codes with residual intervals.

Every vector is turned by a fixed random rotation (signs and Hadamard transforms) and kept
as the signs of its sides, one bit each, with its alignment: the length of its projection on
the unit vector of these signs. What the projection leaves is coded again, a few times over,
and the length of what is left after each level is kept too. Against a query whose turned
sides are cut to six bit planes, a level's product is a popcount of code and planes, and
the part not coded is orthogonal to the code, so by Cauchy and Schwarz

    |product - estimate| <= |rest of the vector| * sqrt(|query|**2 - <query, code>**2),

plus what the planes leave out, which is known too. The bound is no likelihood: it holds for
every pair. Rows whose interval cannot reach the wanted scores go, the next level looks at
those that stay, and what stays after the last level is scored in whole numbers.

Vectors lie in shards of bounded size, ordered by label; anchors go to them in blocks. The
search for positives visits only shards that hold a label of the block.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedback_rank.llm.tokens import ragged
from feedback_rank.operators.numbering import number_rows
from feedback_rank.session import checkpointed

SHARD_BYTES = 16_000_000  # of the vectors of a shard, as doubles
BLOCK_ANCHORS = 256
LEVELS = 4                # codes of each vector, one of the rest of the other
PLANES = 6                # bits of each side of a query
SEEDS = 32                # rows scored at each level to learn what score is needed
_EXACT = float(1 << 53)   # products of whole numbers up to here are exact in doubles
_SLACK = 1e-9             # of |vector| * |query|, far above what rounding in doubles can add
_NONE = float("inf")


@lru_cache(maxsize=8)
def _signs(width: int) -> np.ndarray:
    return np.random.default_rng(width).choice([-1.0, 1.0], (3, width))


def rotated(points: np.ndarray) -> np.ndarray:
    """The points turned; their products stay. Sides are filled up to a power of two, 64 at least."""
    width = max(64, 1 << max(0, points.shape[1] - 1).bit_length())
    out = np.zeros((len(points), width))
    out[:, :points.shape[1]] = points
    for signs in _signs(width):
        out *= signs
        half = 1
        while half < width:
            pairs = out.reshape(len(out), -1, 2, half)
            out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(out), width)
            half *= 2
        out /= np.sqrt(width)
    return out


class Codes:
    """One-bit codes of some vectors: for each level the signs (words of 64 bits by row), the alignment, and the length of the rest."""

    def __init__(self, signs: np.ndarray, aligned: np.ndarray, rest: np.ndarray, norms: np.ndarray):
        self.signs, self.aligned, self.rest, self.norms = signs, aligned, rest, norms
        self.ones = np.bitwise_count(signs).sum(axis=1, dtype=np.int32)  # signs are by level, word of 64, and row

    @staticmethod
    def of(points: np.ndarray, levels: int = LEVELS) -> Codes:
        left = rotated(points)
        norms = np.linalg.norm(left, axis=1)
        width = left.shape[1]
        signs, aligned, rest = [], [], []
        for _ in range(levels):
            up = left >= 0
            unit = np.where(up, 1.0, -1.0) / np.sqrt(width)
            along = (left * unit).sum(axis=1)
            left = left - along[:, None] * unit
            signs.append(np.packbits(up, axis=1, bitorder="little").view(np.uint64).T)
            aligned.append(along)
            rest.append(np.linalg.norm(left, axis=1))
        return Codes(np.stack(signs), np.stack(aligned), np.stack(rest), norms)


class Query:
    """A turned query as bit planes."""

    def __init__(self, turned: np.ndarray, planes: int = PLANES):
        self.width, self.norm = len(turned), float(np.linalg.norm(turned))
        low, high = float(turned.min()), float(turned.max())
        step = (high - low) / (2**planes - 1) or 1.0
        counts = np.rint((turned - low) / step).astype(np.int64)
        self.low, self.step, self.total = low, step, int(counts.sum())
        bits = (counts[None, :] >> np.arange(planes)[:, None]) & 1
        self.planes = np.packbits(bits.astype(np.uint8), axis=1, bitorder="little").view(np.uint64)
        # no code's product is further off than this
        self.off = float(np.abs(turned - (low + step * counts)).sum()) / np.sqrt(self.width)

    def along(self, signs: np.ndarray, ones: np.ndarray) -> np.ndarray:
        """The products with the unit vectors of these signs, each at most ``off`` wrong."""
        inside = np.zeros(signs.shape[1], dtype=np.int32)
        for word, part in enumerate(signs):
            for bit, plane in enumerate(self.planes[:, word]):
                inside += np.left_shift(np.bitwise_count(part & plane), bit, dtype=np.int32)
        root = np.sqrt(self.width)
        fixed = (self.step * self.total + self.low * self.width) / root
        return inside * (2 * self.step / root) + (ones * (2 * self.low / root) - fixed)


class Shard:
    """Some vectors in order of their labels, with their codes."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, points: np.ndarray, codes: Codes):
        self.ids, self.labels, self.points, self.codes = ids, labels, points, codes
        self.most = float(np.abs(points).max(initial=0))

    @staticmethod
    def of(ids: np.ndarray, labels: np.ndarray, points: np.ndarray, levels: int = LEVELS) -> Shard:
        order = np.lexsort((ids, labels))
        return Shard(ids[order], labels[order], points[order], Codes.of(points[order], levels))

    def dump(self) -> bytes:
        small = np.abs(self.points).max(initial=0) < 2**31
        out = io.BytesIO()
        np.savez(
            out, ids=self.ids, labels=self.labels, points=self.points.astype(np.int32) if small else self.points, signs=self.codes.signs,
            aligned=self.codes.aligned, rest=self.codes.rest, norms=self.codes.norms,
        )
        return out.getvalue()

    @staticmethod
    def load(blob: bytes) -> Shard:
        x = np.load(io.BytesIO(blob))
        return Shard(x["ids"], x["labels"], x["points"], Codes(x["signs"], x["aligned"], x["rest"], x["norms"]))

    def same(self, label: int) -> tuple[int, int]:
        return int(np.searchsorted(self.labels, label)), int(np.searchsorted(self.labels, label, side="right"))

    def scores(self, rows: np.ndarray, point: np.ndarray) -> np.ndarray:
        """Products in whole numbers."""
        if self.most * max(1.0, float(np.abs(point).max(initial=0))) * len(point) < _EXACT:
            return self.points[rows].astype(np.float64) @ point
        whole = np.vectorize(int, otypes=[object])
        mine = self.points[rows]
        return (whole(mine) if mine.size else mine.astype(object)) @ whole(point)

    def best(
        self, rows: np.ndarray, point: np.ndarray, query: Query, bands: list[tuple[float, float]], k: int, seeds: int = SEEDS
    ) -> list[list[tuple[int, int]]]:
        """For each band the ``k`` highest (score, -id) in it, among these rows."""
        codes, needed = self.codes, [low for low, _ in bands]
        top, scored, found = max(high for _, high in bands), np.empty(0, np.int64), []
        estimate, slack = np.zeros(len(rows)), np.zeros(len(rows))
        for level in range(len(codes.signs)):
            aligned = codes.aligned[level][rows]
            along = query.along(codes.signs[level][:, rows], codes.ones[level][rows])
            estimate += aligned * along
            slack += aligned * query.off
            sure = np.maximum(0.0, np.abs(along) - query.off)
            half = codes.rest[level][rows] * np.sqrt(np.maximum(0.0, query.norm**2 - sure * sure))
            half += slack + (_SLACK * query.norm) * codes.norms[rows]
            if len(rows) > seeds:  # the best estimates not above the bands tell what scores there are
                hopeful = np.where(estimate <= top, estimate, -_NONE)
                first = rows[np.argpartition(-hopeful, seeds)[:seeds]]
                scored = np.union1d(scored, first)
                found = self.scores(scored, point)
                for i, (low, high) in enumerate(bands):
                    inside = np.sort(found[(found >= low) & (found <= high)].astype(object))
                    if len(inside) >= k:
                        needed[i] = max(needed[i], inside[-k])
            # bands of one query overlap, so one test of all of them together loses little
            stays = (estimate + half >= float(min(needed))) & (estimate - half <= float(top))
            rows, estimate, slack = rows[stays], estimate[stays], slack[stays]
        found = self.scores(rows, point)
        out = []
        for need, (_, high) in zip(needed, bands):
            inside = np.flatnonzero((found >= need) & (found <= high))
            if len(inside) > k:  # all that tie with the k-th
                inside = inside[found[inside] >= np.sort(found[inside])[-k]]
            out.append(sorted(((int(found[i]), -int(self.ids[rows[i]])) for i in inside), reverse=True)[:k])
        return out


def band(positive: int) -> tuple[int, int]:
    """The scores a negative of this positive may have: half of its own to 95 percent, both included."""
    return -(-50 * positive // 100), 95 * positive // 100


def labelled_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, point) with each component as floor(scale * x) in doubles.

    Rows with a null id, label or vector, or a component that is null or not finite, are left out.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != _NONE))
    # floor() gives a long, which a large double does not fit; it is whole as it is
    side = F.transform("embedding", lambda x: scale * x.cast("double"))
    point = F.transform(side, lambda x: F.when(F.abs(x) >= _EXACT, x).otherwise(F.floor(x).cast("double")))
    there = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    return vectors.where(there & finite).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), point.alias("point"))


def _runs(batches: Iterator[pa.RecordBatch], rows_of: Callable[[int], int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(width, ids, labels, points) in runs of one width of ``rows_of(width)`` rows at most."""
    held: dict[int, list[tuple[np.ndarray, ...]]] = {}
    for batch in batches:
        ids, labels, points = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
        widths = points.value_lengths().to_numpy()
        for width in np.unique(widths).tolist():
            mine, most = np.flatnonzero(widths == width), rows_of(width)
            flat = points.take(pa.array(mine)).flatten().to_numpy().reshape(len(mine), width)
            held.setdefault(width, []).append((ids[mine], labels[mine], flat))
            while sum(len(x[0]) for x in held[width]) >= most:
                whole = [np.concatenate(x) for x in zip(*held[width])]
                yield width, *(x[:most] for x in whole)
                held[width] = [tuple(x[most:] for x in whole)]
    for width, parts in held.items():
        whole = [np.concatenate(x) for x in zip(*parts)]
        if len(whole[0]):
            yield width, *whole


def _shards(batches: Iterator[pa.RecordBatch], size: int, levels: int) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId()
    for number, (width, ids, labels, points) in enumerate(_runs(batches, lambda width: max(1, size // (8 * max(8, width))))):
        yield pa.RecordBatch.from_pydict({
            "width": pa.array([width], pa.int32()), "shard": pa.array([task << 32 | number], pa.int64()),
            "labels": pa.array([np.unique(labels).tolist()], pa.list_(pa.int64())),
            "vectors": pa.array([Shard.of(ids, labels, points, levels).dump()], pa.binary()),
        })


def _blocks(batches: Iterator[pa.RecordBatch], anchors: int) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId()
    for number, (width, ids, labels, points) in enumerate(_runs(batches, lambda width: anchors)):
        yield pa.RecordBatch.from_pydict({
            "width": pa.array([width], pa.int32()), "block": pa.array([task << 32 | number], pa.int64()),
            "labels": pa.array([np.unique(labels).tolist()], pa.list_(pa.int64())),
            "ids": pa.array([ids.astype(np.int64).tobytes()], pa.binary()), "marks": pa.array([labels.astype(np.int64).tobytes()], pa.binary()),
            "points": pa.array([points.astype(np.float64).tobytes()], pa.binary()),
        })


_FOUND = "block long, at int, positive int, vec_id long, score long"
_POSITIVES = "array<struct<at:int,positive:int,score:long>>"


def _searched(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Each shard, followed by the blocks that ask it; a block without scores asks for positives, one with them for negatives."""
    shard, name = None, None
    for batch in batches:
        for row in range(len(batch)):
            value = {column: batch.column(column)[row] for column in batch.schema.names}
            place = value["width"].as_py(), value["shard"].as_py()
            if value["vectors"].is_valid:
                shard, name = Shard.load(value["vectors"].as_py()), place
                continue
            assert name == place
            ids, marks = (np.frombuffer(value[x].as_py(), np.int64) for x in ("ids", "marks"))
            points = np.frombuffer(value["points"].as_py(), np.float64).reshape(len(ids), place[0])
            scores = None
            if value["scores"].is_valid:
                scores = [[] for _ in ids]
                for x in value["scores"].as_py():
                    scores[x["at"]].append((x["positive"], x["score"]))
            yield _answers(shard, value["block"].as_py(), ids, marks, points, scores, k)


def _answers(shard: Shard, block: int, ids: np.ndarray, marks: np.ndarray, points: np.ndarray, scores: list | None, k: int) -> pa.RecordBatch:
    out: list[tuple[int, int, int, int]] = []
    turned = rotated(points)
    for at, own in enumerate(ids.tolist()):
        first, stop = shard.same(int(marks[at]))
        if scores is None:
            rows, asked, bands = np.arange(first, stop), [0], [(-_NONE, _NONE)]
        else:
            rows = ragged(np.array([0, stop]), np.array([first, len(shard.ids) - stop]))
            asked = [positive for positive, _ in scores[at]]
            bands = [band(score) for _, score in scores[at]]
        rows = rows[shard.ids[rows] != own]
        if not len(rows) or not any(low <= high for low, high in bands):
            continue
        for positive, best in zip(asked, shard.best(rows, points[at], Query(turned[at]), bands, k)):
            out += [(at, positive, -minus_id, score) for score, minus_id in best]
    at, positive, vec_id, score = zip(*out) if out else ([], [], [], [])
    return pa.RecordBatch.from_pydict({
        "block": pa.array([block] * len(out), pa.int64()), "at": pa.array(at, pa.int32()), "positive": pa.array(positive, pa.int32()),
        "vec_id": pa.array(vec_id, pa.int64()), "score": pa.array(score, pa.int64()),
    })


def hard_negatives(
    vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, shard_bytes: int = SHARD_BYTES,
    block_anchors: int = BLOCK_ANCHORS, levels: int = LEVELS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), rank from 1.

    ``vectors`` and ``anchors`` are (vec_id, label, point) of whole numbers, as
    :func:`labelled_vectors` gives them. An anchor's positives are its ``positives`` highest
    products among rows of its label, ties to smaller ids; the negatives of each are the
    ``negatives`` highest products, ties to smaller ids, among rows of other labels whose product
    is 50 to 95 percent of the positive's. So a positive of a negative score has none, and one
    of score 0 those of 0.

    Rows with an anchor's own id are no partners of it, whatever their label. Each row of a
    repeated anchor finds its partners, and each row of a repeated partner counts by itself.
    Vectors of another length than the anchor's are no partners. Products beyond 64 bits raise
    an error; empty tables give no rows; further columns are not looked at. Vectors are dealt by
    range of label, a hot label over several shards; what moves is each shard twice, and each
    block of anchors to the shards. Runs its jobs at once.
    """
    near = [F.col("label"), F.xxhash64("vec_id", "point")]
    shards = checkpointed(
        vectors.select("vec_id", "label", "point").repartitionByRange(*near)
        .mapInArrow(lambda batches: _shards(batches, shard_bytes, levels), "width int, shard long, labels array<long>, vectors binary")
    )
    blocks = checkpointed(
        anchors.select("vec_id", "label", "point").repartitionByRange(*near).sortWithinPartitions("label", "vec_id")
        .mapInArrow(lambda batches: _blocks(batches, block_anchors), "width int, block long, labels array<long>, ids binary, marks binary, points binary")
    )
    names = shards.select("width", "shard", F.explode("labels").alias("label"))

    def searched(pairs: DataFrame, asking: DataFrame, k: int) -> DataFrame:
        empty = [F.lit(None).cast(kind).alias(c) for c, kind in (("ids", "binary"), ("marks", "binary"), ("points", "binary"), ("scores", _POSITIVES))]
        rows = pairs.join(asking, ["width", "block"]).select("width", "shard", "block", F.lit(None).cast("binary").alias("vectors"), "ids", "marks", "points", "scores")
        # a block of -1, the shard itself, comes first
        rows = rows.unionByName(shards.select("width", "shard", F.lit(-1).cast("long").alias("block"), "vectors", *empty))
        placed = rows.repartition("width", "shard").sortWithinPartitions("width", "shard", "block")
        best = Window.partitionBy("block", "at", "positive").orderBy(F.desc("score"), "vec_id")
        found = placed.mapInArrow(lambda batches: _searched(batches, k), _FOUND)
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    asking = blocks.drop("labels").withColumn("scores", F.lit(None).cast(_POSITIVES))
    alike = blocks.select("width", "block", F.explode("labels").alias("label")).join(names, ["width", "label"]).select("width", "block", "shard").distinct()
    # of equal scores and ids, repeated rows, each keeps a place of its own
    chosen = checkpointed(searched(alike, asking, positives))
    packed = chosen.groupBy("block").agg(F.collect_list(F.struct("at", F.col("rank").alias("positive"), "score")).alias("scores"))
    asking = blocks.drop("labels").join(packed, "block")
    numbers = number_rows(shards.select("width", "shard"), [F.col("shard")], ["width"], "number")
    every = F.explode(F.sequence(F.lit(1).cast("long"), F.col("shards"))).alias("number")
    counts = numbers.groupBy("width").agg(F.count("*").alias("shards"))
    everywhere = blocks.select("width", "block").join(counts, "width").select("width", "block", every).join(numbers, ["width", "number"])
    hard = searched(everywhere.select("width", "block", "shard"), asking, negatives)

    own = blocks.select("block", "ids").mapInArrow(_own_ids, "block long, at int, anchor_id long")
    pairs = chosen.select("block", "at", F.col("rank").alias("positive"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return hard.join(pairs, ["block", "at", "positive"]).join(own, ["block", "at"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def _own_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(len(batch)):
            ids = np.frombuffer(batch.column("ids")[row].as_py(), np.int64)
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([batch.column("block")[row].as_py()] * len(ids), pa.int64()),
                "at": pa.array(np.arange(len(ids), dtype=np.int32)), "anchor_id": pa.array(ids),
            })
