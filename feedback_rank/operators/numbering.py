"""Row numbers over a whole table, or over groups of any size, without one big task."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedback_rank.functions.names import free_names
from feedback_rank.session import checkpointed

_ROW_BITS = 33  # monotonically_increasing_id keeps the row in its lower 33 bits


def number_rows(
    df: DataFrame, order: Sequence[Column], groups: Sequence[str] = (), name: str = "row_number",
    keep: Callable[[DataFrame], DataFrame] | None = None, then: Mapping[str, Column] | None = None,
) -> DataFrame:
    """``row_number()`` over ``order`` within ``groups``, from 1.

    The rows are sorted by range over all tasks, so a group may span many of
    them; each task numbers its own rows, and the count of rows in the tasks
    before is added. ``order`` must end in a key that has no ties. The sorted
    rows are checkpointed: range bounds are sampled, and both passes must see
    the same ones; ``keep`` writes them in place of :func:`checkpointed`.
    Columns ``then`` are added to the sorted rows, so they are made once and not for the sample too. Select only the columns you need before the call. A column that
    is named like the number is replaced; all other names are kept apart from ours.
    """
    at, task, first, rows, so_far = free_names([*df.columns, name], "at", "task", "first", "rows", "before")
    keys = [F.col(group) for group in groups]
    placed = (keep or checkpointed)(
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn(at, F.monotonically_increasing_id())
        .withColumn(task, F.shiftright(at, _ROW_BITS))
        .withColumns(dict(then or {}))
    )
    runs = placed.groupBy(task, *groups).agg(F.min(at).alias(first), F.count("*").alias(rows))
    before = Window.partitionBy(*(groups or [F.lit(0)])).orderBy(task).rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = runs.select(task, *groups, first, F.coalesce(F.sum(rows).over(before), F.lit(0)).alias(so_far))
    same = F.col(f"p.{task}") == F.col(f"o.{task}")
    if groups:
        for group in groups:
            same = same & F.col(f"p.{group}").eqNullSafe(F.col(f"o.{group}"))
    else:
        # one row per task of the sort, however many rows there are
        offsets = F.broadcast(offsets)
    number = F.col(f"p.{at}") - F.col(f"o.{first}") + F.col(f"o.{so_far}") + 1
    kept = [F.col(f"p.{c}") for c in (*df.columns, *(then or {})) if c != name]
    return placed.alias("p").join(offsets.alias("o"), same).select(*kept, number.alias(name))
