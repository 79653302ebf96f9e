"""Row numbers that do not pull a table, or a hot group of it, through one task.

The rows are range-sorted over all tasks and written to the scratch folder together with their
place in the sort. The sort is thereby frozen, so that a retried task cannot change a number.
A number is then the place in the task's own range plus the rows of the ranges before it; the
table of range sizes has one row per task of the sort, which bounds both the window over it
and its broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopy.operators.skew import HEAVY_ROWS, heavy_keys, salted_join
from canopy.session import materialize

_PLACE_BITS = 33  # monotonically_increasing_id: partition number above, place in it below


def number_rows(
    df: DataFrame,
    order: Sequence[str | Column],
    partition: Sequence[str] = (),
    name: str = "number",
    heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """``df`` with a 1-based row number by ``order``, for the whole table or within groups.

    Rows equal in ``order`` are numbered by a hash of the whole row, which also keeps many
    rows of one value from being sorted by one task. Nulls come first. Group columns must not
    be null.
    """
    partition = list(partition)
    sortable = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    tied = df.withColumn("_tie", F.xxhash64(*sortable)).orderBy(*partition, *order, "_tie").drop("_tie")
    placed, rows = materialize(tied.withColumn("_place", F.monotonically_increasing_id()), "numbering")
    task = F.shiftright("_place", _PLACE_BITS)
    sizes = placed.groupBy(task.alias("_task")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(F.lit(0)).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_task", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    numbered = (
        placed.withColumn("_task", task)
        .join(F.broadcast(starts), "_task")
        .withColumn("_n", F.col("_start") + F.col("_place").bitwiseAND((1 << _PLACE_BITS) - 1) + 1)
    )
    if not partition:
        return numbered.select(*df.columns, F.col("_n").alias(name))
    first = numbered.groupBy(*partition).agg(F.min("_n").alias("_first"))
    crowded = heavy_keys(placed, partition, rows, heavy_rows)
    return salted_join(numbered, first, partition, left_heavy=crowded).select(
        *df.columns, (F.col("_n") - F.col("_first") + 1).alias(name)
    )
