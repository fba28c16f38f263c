"""Documents of like shingle sets, linked by exact Jaccard similarity, by signature trees.

Texts with the same set of shingles are one class. Under an order of all shingles that puts
frequent ones last, two sets that are similar enough share one of their first shingles
(Chaudhuri et al. 2006), so the classes that share such a shingle form a block. Blocks with
the same first member are one, which spares a family of near copies most of its repetitions.

In a block the sets hang in a signature tree: every node holds its members' token bitmaps
combined by OR and the range of their sizes. Two nodes are only opened if their bitmaps and
sizes allow an overlap that is large enough for any two of their members (Mamoulis et al.
2003). A first traversal, on bitmaps of a few bits a shingle, parts a block into what may be
connected and leaves out members without any link. Only the others' sets are fetched, for a
second traversal that compares sets at the leaves, but never two that the block has already
linked through others: a block gives the edges of a spanning forest, not its pairs. Connected
components follow from these by alternating stars (Kiveris et al. 2014).

A block too large for one task is cut into slices that meet each other in pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from feedback_rank.llm.tokens import in_small_batches, lean, mixed, ragged, shingles, word_slices
from feedback_rank.session import checkpointed

FREQUENT = 1 << 16         # shingles at most that are known to be frequent and put last
FREQUENT_IN_TASK = 3       # times a task must meet a shingle, among some _RUN others, to report it
BLOCK_BYTES = 32_000_000   # of sets in one task at once, half of it from each of two slices
LEAF = 16
FAN_OUT = 8
_RUN = 1 << 20             # shingles counted at once
_FILTER_BITS = 24          # of the bitmap that keeps rows without a partner from being shuffled
_SET_BYTES = 6             # kept of a shingle's hash where sets are compared


def _set_slices(column: pa.Array, words: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, hashes, bounds): the distinct shingles of each text, in order of hash."""
    for first, upto, found in word_slices(column):
        grams, bounds = shingles(found.hashes(), found.bounds, words)
        of = np.repeat(np.arange(upto - first), np.diff(bounds))
        order = np.lexsort((grams, of))
        grams, of = grams[order], of[order]
        new = np.ones(len(grams), dtype=bool)
        new[1:] = (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])
        yield first, upto, grams[new], np.searchsorted(of[new], np.arange(upto - first + 1))


def _keys(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each text's set, whatever the order."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5)))])
    return mixed(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64))


def _met_often(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []

    def often() -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        keys, n = keys[n >= FREQUENT_IN_TASK], n[n >= FREQUENT_IN_TASK]
        return pa.RecordBatch.from_pydict({"token": pa.array(keys.view(np.int64)), "n": pa.array(n.astype(np.int64))})

    for batch in batches:
        for _, _, grams, _ in _set_slices(batch.column(0), words):
            held.append(grams)
            if sum(map(len, held)) > _RUN:
                yield often()
    if held:
        yield often()


def frequent_shingles(docs: DataFrame, words: int, most: int = FREQUENT) -> np.ndarray:
    """Hashes of the shingles that most documents share, ``most`` at most, sorted.

    They only settle the order in which shingles are looked at, so it does no harm that a
    task leaves out what it meets less than FREQUENT_IN_TASK times.
    """
    met = docs.select(F.col("text").cast("string")).mapInArrow(lambda batches: _met_often(batches, words), "token long, n long")
    counts = checkpointed(met.groupBy("token").agg(F.sum("n").alias("n")))
    octave = F.floor(F.log2("n") * 4)
    least, many = None, 0
    for row in sorted(counts.groupBy(octave.alias("octave")).agg(F.count("*").alias("tokens")).collect(), reverse=True):
        many += row.tokens
        if many > most:
            break
        least = row.octave
    if least is None:
        return np.empty(0, np.uint64)
    return np.sort(counts.where(octave >= least).select("token").toArrow()["token"].to_numpy().view(np.uint64))


def _needed(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Shingles that a set of n shares with any set it is linked with, at least."""
    return -(-num * n // den)


def _marked(batches: Iterator[pa.RecordBatch], words: int, num: int, den: int, frequent: np.ndarray, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, n, key, first, signature): the set's size, its hash, its first shingles, its bitmap."""
    for batch in batches:
        for begin, upto, grams, bounds in _set_slices(batch.column(1), words):
            n = np.diff(bounds)
            of = np.repeat(np.arange(len(n)), n)
            keys = _keys(grams, bounds)
            often = np.zeros(len(grams), dtype=bool)
            if len(frequent):
                often = frequent[np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)] == grams
            order = np.lexsort((grams, often, of))
            prefix = np.where(n > 0, n - _needed(n, num, den) + 1, 0)
            taken = grams[order][ragged(bounds[:-1], prefix)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(begin, upto - begin), pa.array(n.astype(np.int64)), pa.array(keys.view(np.int64)),
                pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(prefix)]), pa.int32()), pa.array(taken.view(np.int64))),
                _signatures(grams, n, bounds),
            ], schema=schema)


def _signatures(grams: np.ndarray, n: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A bitmap of each set, of one to two bits a shingle: a power of two, and 64 bits at least."""
    words = 1 << np.ceil(np.log2(np.maximum(n, 1) / 64)).clip(0).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(words)])
    at = (mixed(grams) & (np.repeat(64 * words, n) - 1).astype(np.uint64)).astype(np.int64)
    bits = np.zeros(ends[-1], dtype=np.uint64)
    np.bitwise_or.at(bits, np.repeat(ends[:-1], n) + at // 64, np.uint64(1) << (at % 64).astype(np.uint64))
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((8 * ends).astype(np.int32)), pa.py_buffer(bits)])


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Texts to (key, members): the set's shingles, sorted, _SET_BYTES of each."""
    for batch in batches:
        for _, _, grams, bounds in _set_slices(batch.column(0), words):
            n = np.diff(bounds)
            keys = _keys(grams, bounds)
            # the high bytes, so that the order of the hashes stays
            short = grams.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :_SET_BYTES]
            yield pa.RecordBatch.from_pydict({
                "key": pa.array(keys.view(np.int64)),
                "members": pa.Array.from_buffers(
                    pa.binary(), len(n), [None, pa.py_buffer((bounds * _SET_BYTES).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(short))]
                ),
            })


def _unpacked(members: bytes) -> np.ndarray:
    wide = np.zeros((len(members) // _SET_BYTES, 8), dtype=np.uint8)
    wide[:, 8 - _SET_BYTES:] = np.frombuffer(members, np.uint8).reshape(-1, _SET_BYTES)
    return wide.view(">u8").ravel().astype(np.uint64)


class SignatureTree:
    """Sets under nodes of OR-combined bitmaps and size ranges; nodes of a level lie in one array.

    ``sizes`` and ``signatures`` are in the order of the leaves, LEAF members each.
    """

    def __init__(self, sizes: np.ndarray, signatures: np.ndarray):
        self.sizes, self.signatures = sizes, signatures
        # shingles that share their bit with another of the same set
        self.slack = sizes - np.bitwise_count(signatures).sum(axis=1).astype(np.int64)
        self.levels = []
        low, high, slack, width = sizes, sizes, self.slack, LEAF
        while True:
            starts = np.arange(0, len(low), width)
            signatures = np.bitwise_or.reduceat(signatures, starts, axis=0)
            low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            slack = np.maximum.reduceat(slack, starts)
            self.levels.append((signatures, low, high, slack))
            if len(low) == 1:
                break
            width = FAN_OUT

    @staticmethod
    def of_sets(sets: list[np.ndarray], bits: int) -> SignatureTree:
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        of = np.repeat(np.arange(len(sets)), sizes)
        at = (mixed(np.concatenate(sets)) % np.uint64(bits)).astype(np.int64)
        signatures = np.zeros((len(sets), bits // 64), dtype=np.uint64)
        np.bitwise_or.at(signatures, (of, at // 64), np.uint64(1) << (at % 64).astype(np.uint64))
        return SignatureTree(sizes, signatures)

    @staticmethod
    def bits_for(sets: list[np.ndarray]) -> int:
        mean = sum(map(len, sets)) / len(sets)
        return int(min(1 << 15, max(256, 1 << int(np.ceil(np.log2(8 * mean + 1))))))

    def members(self, leaf: int) -> np.ndarray:
        return np.arange(leaf * LEAF, min((leaf + 1) * LEAF, len(self.sizes)))


def _may_link(common: np.ndarray, slack: np.ndarray, most: np.ndarray, sizes: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether so many common bits, shingles that share bits, and sizes allow the overlap of a link."""
    return np.minimum(common + slack, most) * (den + num) >= num * sizes


def _pairs_may_link(a: SignatureTree, b: SignatureTree, x: np.ndarray, y: np.ndarray, num: int, den: int) -> np.ndarray:
    """The same for members x of one tree and y of the other."""
    common = np.bitwise_count(a.signatures[x] & b.signatures[y]).sum(axis=1).astype(np.int64)
    n_a, n_b = a.sizes[x], b.sizes[y]
    return _may_link(common, np.minimum(a.slack[x], b.slack[y]), np.minimum(n_a, n_b), n_a + n_b, num, den)


def traverse(a: SignatureTree, b: SignatureTree, num: int, den: int, visit: Callable[[int, int], None]) -> None:
    """Call ``visit`` with each pair of leaves that may hold a link; pairs of one tree with itself once."""
    same = a is b

    def open_pairs(level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        (sig_a, low_a, high_a, slack_a), (sig_b, low_b, high_b, slack_b) = a.levels[min(level, len(a.levels) - 1)], b.levels[min(level, len(b.levels) - 1)]
        out = np.flatnonzero((high_a[i] * den >= low_b[j] * num) & (high_b[j] * den >= low_a[i] * num))
        i, j = i[out], j[out]
        common = np.zeros(len(i), dtype=np.int64)
        for start in range(0, len(i), 4096):
            part = slice(start, start + 4096)
            common[part] = np.bitwise_count(sig_a[i[part]] & sig_b[j[part]]).sum(axis=1)
        return out[_may_link(common, np.minimum(slack_a[i], slack_b[j]), np.minimum(high_a[i], high_b[j]), low_a[i] + low_b[j], num, den)]

    def children(node: np.ndarray, tree: SignatureTree, level: int) -> tuple[np.ndarray, np.ndarray]:
        if level > len(tree.levels) - 1:  # the lower tree stays at its root
            return node, np.ones(len(node), dtype=np.int64)
        below = len(tree.levels[level - 1][1])
        return node * FAN_OUT, np.minimum((node + 1) * FAN_OUT, below) - node * FAN_OUT

    root = np.zeros(1, dtype=np.int64)
    stack = [(max(len(a.levels), len(b.levels)) - 1, root, root)]
    while stack:
        level, i, j = stack.pop()
        kept = open_pairs(level, i, j)
        i, j = i[kept], j[kept]
        if level == 0:
            # leaves near the diagonal first: they are likelier to be alike
            for p in np.argsort(np.abs(i - j), kind="stable").tolist():
                visit(int(i[p]), int(j[p]))
            continue
        (first_i, n_i), (first_j, n_j) = children(i, a, level), children(j, b, level)
        pairs = n_i * n_j
        which = np.repeat(np.arange(len(i)), pairs)
        number = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        next_i, next_j = first_i[which] + number // n_j[which], first_j[which] + number % n_j[which]
        if same:
            upper = next_i <= next_j
            next_i, next_j = next_i[upper], next_j[upper]
        for start in range(0, len(next_i), 1 << 16):
            stack.append((level - 1, next_i[start:start + (1 << 16)], next_j[start:start + (1 << 16)]))


def hopeful(sizes: np.ndarray, signatures: list[bytes], side: np.ndarray | None, num: int, den: int) -> np.ndarray:
    """A number for each member: the same for those that bitmaps allow to be connected, -1 for one without any link.

    With ``side``, links are those between members of different sides.
    """
    group, linked = np.arange(len(sizes)), np.zeros(len(sizes), dtype=bool)
    lengths = np.array([len(s) for s in signatures])

    def tree(members: np.ndarray, length: int) -> tuple[SignatureTree, np.ndarray]:
        rows = np.frombuffer(b"".join(signatures[i] for i in members), np.uint64).reshape(len(members), -1)
        while rows.shape[1] * 8 > length:  # halves are laid over each other
            rows = rows[:, :rows.shape[1] // 2] | rows[:, rows.shape[1] // 2:]
        order = np.lexsort((rows[:, -1], sizes[members], rows[:, 0]))
        return SignatureTree(sizes[members][order], rows[order]), members[order]

    def meet(mine: np.ndarray, others: np.ndarray | None, length: int) -> None:
        if not len(mine) or others is not None and not len(others):
            return
        a, of_a = tree(mine, length)
        b, of_b = (a, of_a) if others is None else tree(others, length)

        def visit(i: int, j: int) -> None:
            leaf_a, leaf_b = a.members(i), b.members(j)
            x, y = np.nonzero(group[of_a[leaf_a]][:, None] != group[of_b[leaf_b]][None, :])
            x, y = leaf_a[x], leaf_b[y]
            may = _pairs_may_link(a, b, x, y, num, den)
            for s, t in zip(of_a[x[may]].tolist(), of_b[y[may]].tolist()):
                if group[s] != group[t]:
                    group[group == group[t]] = group[s]
                    linked[s] = linked[t] = True

        traverse(a, b, num, den, visit)

    of = np.zeros(len(sizes), dtype=np.int64) if side is None else side
    for length in np.unique(lengths).tolist():
        # sizes of a link's sets differ by less than den / num, so their bitmaps' by so many doublings at most
        other = length
        while other <= length * 2 * den // num:
            for first, second in ((0, 0),) if side is None else ((0, 1), (1, 0)):
                if other == length and (first, second) == (1, 0):
                    continue
                mine, others = np.flatnonzero((lengths == length) & (of == first)), np.flatnonzero((lengths == other) & (of == second))
                meet(mine, None if other == length and side is None else others, length)
            other *= 2
    return np.where(linked, group, -1)


def _order(sets: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Sets that are alike close to each other: by their first shingles, then by size."""
    first = np.array([s[:3].tolist() + [0] * (3 - len(s[:3])) for s in sets], dtype=np.uint64)
    return np.lexsort((keys, [len(s) for s in sets], first[:, 2], first[:, 1], first[:, 0]))


def linked_sets(sets: list[np.ndarray], keys: np.ndarray, side: np.ndarray | None, num: int, den: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among sorted ``sets``; with ``side``, only of those between 0 and 1.

    Sets a and b are linked if den * |a & b| >= num * |a | b|.
    """
    if len(sets) < 2:
        return []
    order = _order(sets, keys)
    parts = [order] if side is None else [order[side[order] == s] for s in (0, 1)]
    if not all(len(part) for part in parts):
        return []
    bits = SignatureTree.bits_for(sets)
    trees = [SignatureTree.of_sets([sets[i] for i in part], bits) for part in parts]
    (a, of_a), (b, of_b) = (trees[0], parts[0]), (trees[-1], parts[-1])
    group = np.arange(len(sets))
    edges: list[tuple[int, int]] = []

    def visit(i: int, j: int) -> None:
        mine, other = a.members(i), b.members(j)
        apart = group[of_a[mine]][:, None] != group[of_b[other]][None, :]
        if a is b and i == j:
            apart &= mine[:, None] < other[None, :]
        x, y = np.nonzero(apart)
        x, y = mine[x], other[y]
        may = _pairs_may_link(a, b, x, y, num, den)
        for s, t in zip(of_a[x[may]].tolist(), of_b[y[may]].tolist()):
            if group[s] == group[t]:  # linked through others
                continue
            shared = np.intersect1d(sets[s], sets[t], assume_unique=True).size
            if den * shared >= num * (len(sets[s]) + len(sets[t]) - shared):
                edges.append((s, t))
                group[group == group[t]] = group[s]

    traverse(a, b, num, den, visit)
    return edges


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each (block, one, two), which come in order: all that one task holds of a block at once."""
    block, rows = None, []
    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns)):
            if row[:3] != block:
                if len(rows) > 1:
                    yield rows
                block, rows = row[:3], []
            rows.append(row)
    if len(rows) > 1:
        yield rows


def _sides(rows: list[tuple]) -> np.ndarray | None:
    sides = np.array([row[3] for row in rows])
    return sides if sides.max() > 0 else None


def _hopeful_rows(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Rows (block, one, two, side, key, n, signature) to (block, key) of those that may have a link in the block.

    What may be connected is a block of its own now, under its first key: a family of near
    copies that met in many blocks meets in few.
    """
    for rows in _by_block(batches):
        group = hopeful(np.array([row[5] for row in rows], np.int64), [row[6] for row in rows], _sides(rows), num, den)
        keys = np.array([row[4] for row in rows], np.int64)
        keys, group = keys[group >= 0], group[group >= 0]
        if len(keys):
            _, which = np.unique(group, return_inverse=True)
            first = np.full(which.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(first, which, keys)
            yield pa.RecordBatch.from_pydict({"block": pa.array(first[which]), "key": pa.array(keys)})


def _block_edges(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Rows (block, one, two, side, key, members) to the edges (a, b) of each block."""
    for rows in _by_block(batches):
        keys = np.array([row[4] for row in rows], dtype=np.int64)
        found = linked_sets([_unpacked(row[5]) for row in rows], keys, _sides(rows), num, den)
        if found:
            yield pa.RecordBatch.from_pydict({"a": pa.array(keys[[x for x, _ in found]]), "b": pa.array(keys[[y for _, y in found]])})


def _marked_in(rows: DataFrame, column: str, values: DataFrame, of: str, name: str) -> DataFrame:
    """Rows with ``name``: whether ``column`` may be among ``values``; true for all that are, and for few others.

    The values' hashes are 2**_FILTER_BITS bits, whatever their number, and only these are sent to the tasks.
    """
    def place(name: str) -> Column:
        return F.shiftrightunsigned(F.xxhash64(name), 64 - _FILTER_BITS)

    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place(of), F.lit(64)).cast("int"))
    bits = values.groupBy(F.shiftright(place(of), 6).alias("_part")).agg(F.bit_or(one).alias("_bits"))
    found = F.call_function("shiftrightunsigned", F.col("_bits"), F.pmod(place(column), F.lit(64)).cast("int")).bitwiseAND(1) == 1
    return rows.join(F.broadcast(bits), F.shiftright(place(column), 6) == F.col("_part"), "left").select(
        *rows.columns, F.coalesce(found, F.lit(False)).alias(name)
    )


def _possibly_in(rows: DataFrame, column: str, values: DataFrame, of: str) -> DataFrame:
    """The rows that :func:`_marked_in` marks."""
    return _marked_in(rows, column, values, of, "_likely").where("_likely").drop("_likely")


def _blocks(marked: DataFrame, num: int, den: int) -> DataFrame:
    """(block, key): the classes under each block that have another one of a fitting size there."""
    rows = marked.select("key", "n", F.explode("first").alias("token"))
    shared = rows.groupBy("token").agg(F.min("key").alias("block"), F.max("key").alias("last")).where("block < last").select("token", "block")
    shared = checkpointed(shared)
    members = _possibly_in(rows, "token", shared, "token").join(shared, "token").groupBy("block", "key").agg(F.first("n").alias("n"))
    # whose neighbours in order of size do not fit, has none that does
    by_size = Window.partitionBy("block").orderBy("n", "key")
    smaller, larger = F.lag("n").over(by_size), F.lead("n").over(by_size)
    fit = F.coalesce(smaller * den >= F.col("n") * num, F.lit(False)) | F.coalesce(F.col("n") * den >= larger * num, F.lit(False))
    return checkpointed(members.withColumn("_fit", fit).where("_fit").select("block", "key"))


def _sliced(blocks: DataFrame, classes: DataFrame, columns: list[str], block_bytes: int) -> DataFrame:
    """(block, one, two, side, key, *columns), placed by (block, one, two): the rows of a block, or of two slices of one.

    ``columns`` of ``classes`` end in the one whose bytes count.
    """
    sized = blocks.join(classes.select("key", F.octet_length(columns[-1]).alias("bytes")), "key")
    many = F.sum("bytes") > block_bytes
    slices = F.when(many, F.ceil(2 * F.sum("bytes") / block_bytes)).otherwise(1).alias("slices")
    sizes = sized.groupBy("block").agg(F.count("*").alias("classes"), slices).where("classes > 1").select("block", "slices")
    rows = blocks.join(sizes, "block").withColumn("mine", F.pmod(F.xxhash64("key"), F.col("slices")))
    pair = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("slices") - 1),
        lambda other: F.struct(
            F.least("mine", other).alias("one"), F.greatest("mine", other).alias("two"), F.when(F.col("mine") > other, 1).otherwise(0).alias("side")
        ),
    )
    placed = rows.select("block", "key", F.explode(pair).alias("pair")).select("block", "pair.one", "pair.two", "pair.side", "key")
    found = placed.join(classes.select("key", *columns), "key").select("block", "one", "two", "side", "key", *columns)
    return found.repartition("block", "one", "two").sortWithinPartitions("block", "one", "two", "side", "key")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b): the smallest node it is connected with.

    Alternates large stars and small stars until nothing changes; every round is written.
    A node's neighbours are never gathered, only the smallest of them.
    """
    def directed(rows: DataFrame) -> DataFrame:
        return rows.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()

    def state(rows: DataFrame) -> tuple:
        return tuple(rows.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = checkpointed(directed(edges))
    before = state(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = checkpointed(directed(large))
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(joined.select("a", F.col("least").alias("b")))
        now = checkpointed(directed(small))
        after = state(now)
        if after == before:
            break
        before = after
    tops = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(tops)


def _similarity(percent: int) -> tuple[int, int]:
    if not 0 < percent <= 100:
        raise ValueError("similarity must be above 0 and at most 100 percent")
    return percent, 100


def marked_documents(docs: DataFrame, words: int, percent: int, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n, key, first, signature) of every document; written, as two passes over the texts lead to it."""
    num, den = _similarity(percent)
    often = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, words, frequent))
    narrow = in_small_batches(docs).select("doc_id", F.col("text").cast("string").alias("text"))
    schema = narrow.select("doc_id", *[F.lit(0).cast("long").alias(c) for c in ("n", "key")], F.lit(None).cast("array<bigint>").alias("first"), F.lit(None).cast("binary").alias("signature")).schema
    arrow = to_arrow_schema(schema)
    return checkpointed(narrow.mapInArrow(lean(lambda batches: _marked(batches, words, num, den, often.value, arrow)), schema))


def class_links(docs: DataFrame, marked: DataFrame, words: int, percent: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(a, b): links between classes, by key, enough of them to connect all that are connected."""
    num, den = _similarity(percent)
    blocks = _blocks(marked, num, den)
    # one row of each class in a block, with the smallest of its ids
    members = marked.where("n > 0").join(blocks.select("key").distinct(), "key", "left_semi").groupBy("key").agg(
        F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("signature").alias("signature")
    )
    members = checkpointed(members)
    by_bitmap = _sliced(blocks, members, ["n", "signature"], block_bytes)
    blocks = checkpointed(by_bitmap.mapInArrow(lambda batches: _hopeful_rows(batches, num, den), "block long, key long").distinct())

    chosen = members.select("key", "doc_id").join(blocks.select("key").distinct(), "key", "left_semi")
    chosen = checkpointed(chosen)
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    texts = docs.select(name("doc_id").alias("_id"), F.col("text").cast("string").alias("text"))
    texts = _possibly_in(texts, "_id", chosen.select(name("doc_id").alias("_id")), "_id")
    sets = texts.select("text").mapInArrow(lambda batches: _sets(batches, words), "key long, members binary")
    sets = checkpointed(sets.join(chosen.select("key"), "key", "left_semi").dropDuplicates(["key"]))
    return _sliced(blocks, sets, ["members"], block_bytes).mapInArrow(lambda batches: _block_edges(batches, num, den), "a long, b long")


def _component_ids(docs: DataFrame, marked: DataFrame, words: int, percent: int, block_bytes: int) -> DataFrame:
    """(key, component, component_id) of all classes: the smallest key and the smallest doc_id of their component."""
    edges = checkpointed(class_links(docs, marked, words, percent, block_bytes).distinct())
    of = components(edges)
    classes = marked.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("least"))
    joined = classes.join(of, classes["key"] == of["node"], "left").select(
        "key", F.coalesce("component", "key").alias("component"), F.col("component").isNotNull().alias("linked"), "least"
    )
    joined = checkpointed(joined)
    # a class without links has its own smallest id
    tops = joined.where("linked").groupBy("component").agg(F.min("least").alias("component_id"))
    linked = joined.where("linked").join(tops, "component").select("key", "component", "component_id")
    return linked.unionByName(joined.where("NOT linked").select("key", "component", F.col("least").alias("component_id")))


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, frequent: int = FREQUENT, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(doc_id, n_shingles, component_id): every document with the smallest doc_id it is connected with.

    A document's set are its distinct runs of ``words`` words, lower-cased in A to Z; all words
    as one run if they are fewer. Two sets are linked if they share ``percent`` of their union
    or more, counted in whole numbers. A document without words is linked with nothing and is
    its own component. Documents of one id keep their rows; a component has a null id only if
    all its documents do. Shingles and sets are told apart by 64-bit hashes. Other columns are
    not read; an empty table gives no rows. Runs its jobs at once.
    """
    marked = marked_documents(docs, words, percent, frequent)
    ids = _component_ids(docs, marked, words, percent, block_bytes).drop("component")
    return marked.where("n > 0").select("doc_id", "n", "key").join(ids, "key").select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id"
    ).unionByName(marked.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def _keyed(batches: Iterator[pa.RecordBatch], text_at: int, words: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, sizes = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for _, _, grams, bounds in _set_slices(batch.column(text_at), words):
            keys.append(_keys(grams, bounds))
            sizes.append(np.diff(bounds))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(sizes).astype(np.int64))], schema=schema
        )


def deduplicated(
    docs: DataFrame, words: int = 5, percent: int = 80, frequent: int = FREQUENT, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The rows of ``docs``, one of each component of :func:`near_duplicates`: that of the smallest doc_id.

    Of rows of this id, the one whose set has the smallest hash stays, and one of those alike.
    Documents without words all stay. The columns stay as they are. Only rows that may have to
    go are shuffled.
    """
    marked = marked_documents(docs, words, percent, frequent)
    ids = _component_ids(docs, marked, words, percent, block_bytes).select("key", "component")
    units = marked.where("n > 0").groupBy("doc_id", "key").agg(F.count("*").alias("rows"))
    units = checkpointed(units.join(ids, "key"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "key")).alias("first")
    placed = units.join(units.groupBy("component").agg(first), "component")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))
    placed = checkpointed(placed.select("doc_id", "key", "rows", stays.alias("stays")))

    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    open_ids = placed.where("NOT stays OR rows > 1").select(name("doc_id").alias("_open")).distinct()
    named = docs.withColumn("_name", name("doc_id"))
    likely = _marked_in(named, "_name", open_ids, "_open", "_likely")
    settled = likely.where("NOT _likely").select(*docs.columns)
    doubtful = likely.where("_likely").select(*docs.columns)
    schema = StructType([*doubtful.schema.fields, StructField("_key", LongType()), StructField("_n", LongType())])
    arrow, text_at = to_arrow_schema(schema), docs.columns.index("text")
    keyed = doubtful.mapInArrow(lean(_keyed, text_at, words, arrow), schema)
    kept = placed.where("stays").select(F.col("doc_id").alias("_kept_id"), F.col("key").alias("_kept_key"))
    chosen = keyed.where("_n > 0").join(
        kept, (F.col("_key") == F.col("_kept_key")) & F.col("doc_id").eqNullSafe(F.col("_kept_id")), "left_semi"
    ).dropDuplicates(["doc_id", "_key"])
    return settled.unionByName(chosen.select(*docs.columns)).unionByName(keyed.where("_n = 0").select(*docs.columns))
