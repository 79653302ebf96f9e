"""Digests of key ranges, so that equal parts of two snapshots are told without reading them.

The hash of a row's keys puts it into one of a fixed number of leaves, the same in every snapshot,
and neighbouring leaves make a folder of files. For each snapshot every leaf, folder and the whole have
a digest: the number of rows and the sums of the four halves of two 64-bit hashes of the row. Sums
do not depend on the order of rows, count repeated rows, and add up from leaves to folders. Two
snapshots are compared from the top down; the comparison costs what the differing ranges hold.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.operators.tables import TableDef

RANGE = "_range"
SUMS = ("sum_a", "sum_b", "sum_c", "sum_d")


@dataclass(frozen=True)
class Ranges:
    """2 ** ``folder_bits`` folders a snapshot and 2 ** ``leaf_bits`` leaves.

    Folders bound the files of a snapshot and the list of folders a driver sees (at most 65,536); a
    table of a few million rows is well served by 16, one of 100 TB by 4,096 and a million leaves.
    """

    folder_bits: int = 4
    leaf_bits: int = 12

    def __post_init__(self) -> None:
        if not 1 <= self.folder_bits <= min(self.leaf_bits, 16) or self.leaf_bits > 40:
            raise ValueError("1 <= folder_bits <= 16 and folder_bits <= leaf_bits <= 40")

    def folder(self, keys: Sequence[str]) -> Column:
        return self._top(keys, self.folder_bits).cast("int")

    def leaf(self, keys: Sequence[str]) -> Column:
        return self._top(keys, self.leaf_bits)

    @staticmethod
    def _top(keys: Sequence[str], bits: int) -> Column:
        return F.shiftrightunsigned(_hash("range", keys), 64 - bits)


def _hash(seed: str, columns: Sequence[str]) -> Column:
    """64-bit hash; nulls, which the built-in leaves out, are told apart by their place."""
    return F.xxhash64(F.lit(seed), *[F.col(c) for c in columns], *[F.col(c).isNull() for c in columns])


def digest_table(name: str) -> TableDef:
    """Where the digests of a table are kept: one row per tag, level (0 whole, 1 folder, 2 leaf) and node."""
    return TableDef.of(f"{name}_digests", "tag:INTEGER", "level:INTEGER", "node:INTEGER", "n_rows:INTEGER", *[f"{s}:INTEGER" for s in SUMS])


def digests(rows: DataFrame, tags: Sequence[int], ranges: Ranges, keys: Sequence[str]) -> DataFrame:
    """Digests of tagged rows, in the form of ``digest_table``; a tag without rows has its whole only.

    Sums of halves stay within a long for 2 ** 31 rows of a node; beyond that they are null in leaves
    that large, which compares like any other value and relies on the count.
    """
    columns = [c for c in rows.columns if c != "tag"]
    a, b = (_hash(seed, columns) for seed in ("first", "second"))
    low = F.lit(0xFFFFFFFF).cast("long")
    halves = [a.bitwiseAND(low), F.shiftrightunsigned(a, 32), b.bitwiseAND(low), F.shiftrightunsigned(b, 32)]
    each = rows.select("tag", ranges.leaf(keys).alias("node"), *[h.alias(s) for h, s in zip(halves, SUMS)])
    leaves = each.groupBy("tag", "node").agg(F.count(F.lit(1)).alias("n_rows"), *[F.try_sum(s).alias(s) for s in SUMS])
    none = rows.sparkSession.createDataFrame([(t,) for t in tags], "tag long")
    none = none.select("tag", F.lit(0).cast("long").alias("level"), F.lit(0).cast("long").alias("node"), *[F.lit(0).cast("long").alias(c) for c in ("n_rows", *SUMS)])
    place = [(0, F.lit(0).cast("long")), (1, F.shiftright("node", ranges.leaf_bits - ranges.folder_bits)), (2, F.col("node"))]
    at = F.explode(F.array(*[F.struct(F.lit(level).cast("long").alias("level"), node.alias("node")) for level, node in place]))
    nodes = leaves.select("tag", at.alias("_at"), "n_rows", *SUMS).select("tag", "_at.level", "_at.node", "n_rows", *SUMS)
    summed = [F.sum("n_rows").alias("n_rows"), *[F.try_sum(s).alias(s) for s in SUMS]]
    return nodes.unionByName(none).groupBy("tag", "level", "node").agg(*summed)


def _unequal(nodes: DataFrame) -> DataFrame:
    """Nodes that only one of two snapshots has, or that have two digests."""
    seen = F.struct("n_rows", *SUMS)
    both = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min(seen).alias("low"), F.max(seen).alias("high"))
    return both.where((F.col("n") == 1) | ~F.col("low").eqNullSafe(F.col("high"))).select("node")


def differing(stored: DataFrame, tags: Sequence[int], ranges: Ranges) -> tuple[list[int], DataFrame] | None:
    """Folders (numbers) and leaves (``_leaf``) in which two tags differ; None where a tag has no digests."""
    if tags[0] == tags[1]:
        return [], stored.select(F.col("node").alias("_leaf")).limit(0)
    stored = stored.where(F.col("tag").isin(list(tags)))
    whole = stored.where("level = 0").groupBy("tag").agg(F.count(F.lit(1))).count()
    if whole != 2:
        return None
    # At most 2 ** folder_bits rows, whatever the size of the snapshots.
    folders = [r["node"] for r in _unequal(stored.where("level = 1")).collect()]
    above = F.shiftright("node", ranges.leaf_bits - ranges.folder_bits)
    leaves = _unequal(stored.where((F.col("level") == 2) & above.isin(folders)))
    return folders, leaves.select(F.col("node").alias("_leaf"))
