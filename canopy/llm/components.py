"""Connected components of links, and group work cut into blocks.

Components by contraction: each task first reduces its links to a forest; then every vertex
points to its smallest neighbour, chains of pointers are shortened, links are renamed to the
roots, and links inside a root go. Each round leaves at most half of the vertices of every
component, tables of a round are written to the shared scratch folder, and the driver sees
their row counts only.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import map_rows
from canopy.session import materialize


class Forest:
    """Union-find over integers; a root is the smallest member."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while (up := parent[x]) != root:
            parent[x], x = root, up
        return root

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True

    def links(self) -> tuple[list[int], list[int]]:
        """Every member that is no root, with its root."""
        pairs = [(x, r) for x in list(self.parent) if (r := self.find(x)) != x]
        return [x for x, _ in pairs], [r for _, r in pairs]


def local_forest(links: DataFrame) -> DataFrame:
    """Links (a, b) that connect what the links of the same task connect, one per vertex at most."""

    def task(batches: Iterator[dict]) -> Iterator[dict]:
        forest = Forest()
        for batch in batches:
            for a, b in zip(batch["a"], batch["b"]):
                forest.union(a, b)
        left, right = forest.links()
        for i in range(0, len(left), 50_000):
            yield {"a": left[i : i + 50_000], "b": right[i : i + 50_000]}

    return map_rows(links.select("a", "b").dropna(), "a long, b long", task)


def _rooted(point: DataFrame) -> DataFrame:
    """Pointers (id, to) that end at roots, from pointers to smaller ids; roots point to themselves."""
    point, n = materialize(point, "point")
    while True:
        up = point.select(F.col("id").alias("to"), F.col("to").alias("_up"))
        point, _ = materialize(point.join(up, "to").select("id", F.col("_up").alias("to")), "point")
        roots = point.where(F.col("id") == F.col("to")).select(F.col("id").alias("to"))
        if point.join(roots, "to", "left_anti").isEmpty():
            return point


def components(links: DataFrame) -> DataFrame:
    """(id, component_id) of every vertex of links (a, b); component_id is the smallest id reachable."""
    rest, n = materialize(local_forest(links).distinct(), "links")
    levels: list[DataFrame] = []
    while n:
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("to"))
        point = _rooted(point.select("id", F.least("id", "to").alias("to")))
        levels.append(point)
        for end in ("a", "b"):
            rest = rest.join(point.select(F.col("id").alias(end), F.col("to").alias(f"_{end}")), end)
        rest = rest.select(F.col("_a").alias("a"), F.col("_b").alias("b")).where("a <> b")
        rest, n = materialize(local_forest(rest).distinct(), "links")
    if not levels:
        return rest.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
    label = levels[0]
    for level in levels[1:]:
        up = level.select(F.col("id").alias("to"), F.col("to").alias("_up"))
        label = label.join(up, "to", "left").select("id", F.coalesce("_up", "to").alias("to"))
    return materialize(label.withColumnRenamed("to", "component_id"), "components")[0]


def in_blocks(rows: DataFrame, group: str, size: Column, key: str, block: int) -> DataFrame:
    """``rows`` repeated so that every two rows of a group meet in one cell (group, _i, _j), _i <= _j.

    A group of ``size`` rows is dealt into ceil(size / block) blocks by a hash of ``key``; each
    row goes to the cells of its block (``_own``) with every block. No cell holds more than about two blocks,
    however large the group.
    """
    blocks = F.ceil(size / F.lit(block)).cast("int")
    rows = rows.withColumn("_blocks", F.greatest(blocks, F.lit(1)))
    rows = rows.withColumn("_own", F.pmod(F.xxhash64(key), F.col("_blocks")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    cells = rows.withColumn("_i", F.least("_own", "_other")).withColumn("_j", F.greatest("_own", "_other"))
    return cells.drop("_other", "_blocks")


def own_ids(classes: DataFrame, tie: str) -> DataFrame:
    """``classes`` with an ``id`` of its own for each: of several with one id, those with the least
    ``tie`` keeps it, the others get numbers above all ids. Written down, so the numbers stay."""
    least = classes.groupBy("id").agg(F.count(F.lit(1)).alias("_n"), F.min(tie).alias("_least")).where("_n > 1").drop("_n")
    top = classes.agg(F.max("id")).first()[0]
    keeps = F.col("_least").isNull() | (F.col("_least") == F.col(tie))
    number = F.when(keeps, F.col("id")).otherwise(F.lit(top) + 1 + F.monotonically_increasing_id())
    return materialize(classes.join(least, "id", "left").withColumn("id", number).drop("_least"), "classes")[0]


def same_owner(rows: DataFrame, owner: str) -> DataFrame:
    """Links (a, b) between the ``id`` values that rows of one owner have."""
    least = rows.groupBy(owner).agg(F.min("id").alias("a"), F.max("id").alias("_last")).where("a < _last").drop("_last")
    return rows.join(least, owner).where("id > a").select("a", F.col("id").alias("b")).distinct()
