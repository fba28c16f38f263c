"""Sources mixed to target weights by pivotal dependent rounding.

Each source has a target size in words. A document should be taken target / source
size times; the whole part of that is certain, the rest is a probability. Documents
are then paired: of two probabilities one is moved onto the other until one of them is
0 or 1, with the odds that keep both expectations (Deville and Tille 1998). Pairs are
met in order of size, so what one document gains another of about the same size loses,
and the words taken stay close to the target, not only the number of documents.

The pairing runs in cells of a source's documents, cut by a hash, so a source of any
share of the rows spreads over many tasks. A cell leaves at most one document with a
probability between 0 and 1; these go on, FAN_IN cells to one, level by level, until
one is left for each source, which a last draw decides. All draws are hashes of the
documents and the seed, so a rerun or a lost task makes the same choices.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from feedback_rank.operators.numbering import number_rows
from feedback_rank.session import checkpointed

WEIGHTS = (5.0, 2.0, 1.0)  # of the sources in order of code points, repeated
MOST_COPIES = 3
CELL_ROWS = 2_000          # documents in a cell of the first level, on average
FAN_IN = 64                # cells whose remainders meet in one cell of the next level
SEED = 20_240_601
BROADCAST_SOURCES = 100_000  # up to as many sources their table is broadcast
# below this a probability counts as 0, and above 1 less this as 1
_TINY = 1e-12


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, docs, target) from (source, size).

    Sources in order of their code points, null last, have the weights in turn and share
    the size of all sources. No target is above ``most`` times its source's size: what is
    over is shared again by weight among the sources still below, until none is above.
    Starts a job for each of those rounds, each over one row a source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    # strings are compared by their UTF-8 bytes, which is the order of code points
    placed = number_rows(totals, [F.col("source").asc_nulls_last()], name="place")
    chosen = F.array(*[F.lit(float(w)) for w in weights])
    placed = checkpointed(
        placed.withColumn("weight", F.element_at(chosen, ((F.col("place") - 1) % len(weights) + 1).cast("int")))
        .withColumn("most", most * F.col("source_size").cast("double")).drop("place")
    )
    everything, all_weights = placed.agg(F.sum("source_size"), F.sum("weight")).first()
    left, open_weights = float(everything or 0), float(all_weights or 0)
    share = left / open_weights if open_weights else 0.0
    while True:
        # a source at its limit stays there, as the share of the others only grows
        held = F.col("most") <= F.lit(share) * F.col("weight")
        full, open_weights = placed.agg(
            F.coalesce(F.sum(F.when(held, F.col("most"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~held, F.col("weight"))), F.lit(0.0)),
        ).first()
        raised = (left - full) / open_weights if open_weights else share
        if raised <= share:
            break
        share = raised
    target = F.when(F.col("most") <= F.lit(share) * F.col("weight"), F.col("most")).otherwise(F.lit(share) * F.col("weight"))
    return placed.select("source", "source_size", "docs", target.alias("target"))


def _transfer(a: float, b: float, draw: float) -> tuple[float, float]:
    """Two probabilities after one is moved onto the other; one of them is 0 or 1 then."""
    both = a + b
    if both < 1:
        a, b = (both, 0.0) if draw * both < a else (0.0, both)
    else:
        a, b = (1.0, both - 1) if draw * (2 - both) < 1 - b else (both - 1, 1.0)
    return _settled(a), _settled(b)


def _settled(x: float) -> float:
    return 0.0 if x <= _TINY else 1.0 if x >= 1 - _TINY else x


def _paired(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows ordered by source and node to the same rows with ``chance`` 0 or 1, one open row a node at most.

    Holds a batch and the row that waits for a partner.
    """
    source, node, chance, draw = (schema.get_field_index(c) for c in ("source", "node", "chance", "draw"))

    def batch_of(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    held: list | None = None
    for batch in batches:
        out = []
        for values in zip(*(column.to_pylist() for column in batch.columns)):
            row = list(values)
            if held is None:
                held = row
            elif (held[source], held[node]) != (row[source], row[node]):
                out.append(held)
                held = row
            else:
                held[chance], row[chance] = _transfer(held[chance], row[chance], row[draw])
                out += [x for x in (held, row) if x[chance] in (0.0, 1.0)]
                held = next((x for x in (held, row) if x[chance] not in (0.0, 1.0)), None)
        if out:
            yield batch_of(out)
    if held is not None:
        yield batch_of([held])


def _level(rows: DataFrame, level: int, seed: int) -> DataFrame:
    """One level of the reduction tree."""
    draw = F.pmod(F.xxhash64("key", F.lit(seed), F.lit(level)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    ordered = rows.withColumn("draw", draw).repartition("source", "node").sortWithinPartitions("source", "node", "size", "key", "doc_id")
    arrow = to_arrow_schema(ordered.schema)
    return checkpointed(ordered.mapInArrow(lambda batches: _paired(batches, arrow), ordered.schema).drop("draw"))


def _units(docs: DataFrame) -> DataFrame:
    """(doc_id, key, source, size, repeats): rows alike in all columns as one."""
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return docs.select("doc_id", _key(docs), "source", size.alias("size")).groupBy("doc_id", "key", "source", "size").agg(
        F.count("*").alias("repeats")
    )


def _key(docs: DataFrame) -> Column:
    hashed = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    return F.xxhash64(*[docs[c] for c in sorted(hashed)]).alias("key")


def mixed_units(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = SEED,
    cell_rows: int = CELL_ROWS, fan_in: int = FAN_IN,
) -> DataFrame:
    """(doc_id, key, source, size, repeats, source_size, target, copies) from (doc_id, text, source).

    One row for all rows of ``docs`` that are alike in every column; ``copies`` is how often
    they are taken together. ``size`` counts words, 0 for a null or empty text; ``target`` is
    that of the source. Null ids and sources are values like others. Runs its jobs at once.
    """
    units = checkpointed(_units(docs))
    targets = source_targets(units.select("source", (F.col("size") * F.col("repeats")).alias("size")), weights, most)
    targets = checkpointed(targets.withColumn("nodes", F.ceil(F.col("docs") / cell_rows)).drop("docs"))
    sources, nodes = targets.agg(F.count("*"), F.coalesce(F.max("nodes"), F.lit(0))).first()
    if sources <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)

    placed = units.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    wanted = F.when(F.col("source_size") > 0, F.col("repeats") * F.col("target") / F.col("source_size")).otherwise(0.0)
    placed = placed.withColumn("whole", F.floor(wanted + _TINY)).withColumn(
        "chance", F.greatest(wanted - F.col("whole"), F.lit(0.0))
    ).withColumn("node", F.pmod(F.xxhash64("key", F.lit(seed)), F.col("nodes"))).drop("nodes")
    certain = (F.col("chance") <= _TINY) | (F.col("size") == 0)
    decided = [placed.where(certain).withColumn("chance", F.lit(0.0))]
    rows, level = placed.where(~certain), 0
    while True:
        done = _level(rows, level, seed)
        settled = F.col("chance").isin(0.0, 1.0)
        decided.append(done.where(settled))
        rows, level = done.where(~settled), level + 1
        if nodes <= 1:
            break
        rows, nodes = rows.withColumn("node", F.floor(F.col("node") / fan_in)), -(-nodes // fan_in)
    # one document of each source at most is left
    last = F.pmod(F.xxhash64("key", F.lit(seed), F.lit(-1)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    decided.append(rows.withColumn("chance", F.when(last < F.col("chance"), 1.0).otherwise(0.0)))
    union = decided[0]
    for more in decided[1:]:
        union = union.unionByName(more)
    copies = (F.col("whole") + F.col("chance")).cast("long").alias("copies")
    return union.select("doc_id", "key", "source", "size", "repeats", "source_size", "target", copies)


def mixed_sizes(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken): every row of ``docs`` with the words the mix takes of it.

    See :func:`mixed_units` for the options and for nulls. No row of size 0 is taken; of
    rows alike in every column each is taken as often as the others, or once more. No rows
    give no rows; other columns may be there, and only tell rows apart.
    """
    units = mixed_units(docs, **options).withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), "repeats")))
    each = F.floor(F.col("copies") / F.col("repeats")) + (F.col("_nth") <= F.col("copies") % F.col("repeats")).cast("long")
    return units.select("doc_id", "size", "source_size", "target", (F.col("size") * each).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it is taken; the columns stay.

    Empty documents weigh nothing and are left out, like all that is not taken.
    """
    taken = mixed_units(docs, **options).where("copies > 0").select(
        F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.col("repeats").alias("_repeats"), F.col("copies").alias("_copies")
    )
    keyed = docs.withColumn("_row_key", _key(docs))
    joined = keyed.join(taken, (F.col("_row_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    once = joined.where("_repeats = 1").unionByName(joined.where("_repeats > 1").dropDuplicates(["doc_id", "_row_key"]))
    return once.withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(*docs.columns)
