"""Equi-joins that stay balanced when one key holds a large share of the rows.

A key is *heavy* when it holds more than ``max(HEAVY_ROWS, rows / MAX_HEAVY)`` rows, so there
are never more than ``MAX_HEAVY`` heavy keys: that is the proven bound behind every broadcast
of a heavy-key list here, and behind bringing that list to the driver. A heavy key is cut into
as many slices as it takes to bring each below that number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAVY_ROWS = 1_000_000
MAX_HEAVY = 100_000


def heavy_keys(
    df: DataFrame, on: Sequence[str], rows: int | None = None, heavy_rows: int = HEAVY_ROWS
) -> DataFrame | None:
    """The heavy values of the key columns and their ``_slices``, or None when there are none.

    ``rows`` is the known row count of ``df``; a table too small to hold a heavy key is not
    looked at. Counting aggregates inside each task first, so it is itself safe from skew.
    """
    on = list(on)
    if rows is None:
        rows = df.count()
    if rows <= heavy_rows:
        return None
    counts = df.dropna(subset=on).groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
    return heavy_counts(counts, on, "_rows", rows, heavy_rows)


def heavy_counts(
    counts: DataFrame, on: Sequence[str], counted: str, rows: int, heavy_rows: int = HEAVY_ROWS
) -> DataFrame | None:
    """``heavy_keys`` of a table of ``rows`` rows, whose rows per key are known as the column ``counted``."""
    if rows <= heavy_rows:
        return None
    limit = max(heavy_rows, rows // MAX_HEAVY)
    slices = F.ceil(F.col(counted) / limit).cast("int").alias("_slices")
    heavy = counts.where(F.col(counted) > limit).select(*on, slices)
    found = heavy.collect()  # at most MAX_HEAVY rows
    return counts.sparkSession.createDataFrame(found, heavy.schema) if found else None


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    left_heavy: DataFrame | None = None,
    right_heavy: DataFrame | None = None,
) -> DataFrame:
    """``left.join(right, on, how)`` with the rows of heavy keys cut into slices.

    Rows of a key that is heavy on one side are spread by a hash of the whole row; the rows
    of the other side are repeated for each slice, for that key only. Right rows are never
    spread in a left, semi or anti join, since each left row has to see all its partners.
    """
    on = list(on)
    if right_heavy is not None and how != "inner":
        raise ValueError("a heavy right side can only be spread in an inner join")
    keys = list(on)
    for heavy, spread_left, part in ((left_heavy, True, "_lpart"), (right_heavy, False, "_rpart")):
        if heavy is None:
            continue
        spread, repeat = (left, right) if spread_left else (right, left)
        mark = F.broadcast(heavy)
        slices = F.coalesce("_slices", F.lit(1))
        own = F.pmod(F.xxhash64(*spread.columns), slices).cast("int")
        spread = spread.join(mark, on, "left").withColumn(part, own).drop("_slices")
        every = F.explode(F.sequence(F.lit(0), slices - 1))
        repeat = repeat.join(mark, on, "left").withColumn(part, every).drop("_slices")
        left, right = (spread, repeat) if spread_left else (repeat, spread)
        keys.append(part)
    return left.join(right, keys, how).drop("_lpart", "_rpart")
