"""Visit-order numbers of a forest, and subtrees as ranges of them.

A tour enters a node, goes through its children in order and leaves it again. Each step of the tour
points to the step before it, and pointers are replaced by the pointers of what they point to
until all end at the root, adding up on the way how many nodes were entered and left: rounds grow
with the logarithm of the tree's size, not with its depth, and a node with any number of children
is no more work than the same nodes elsewhere. Trees of few levels are numbered level by level
instead, which looks at every node once. With the numbers kept beside the nodes, everything
below a node is a range, a report in visit order is a sort, and neither needs a walk.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopy.operators.numbering import number_rows
from canopy.operators.skew import HEAVY_ROWS, heavy_keys, salted_join
from canopy.session import materialize

#: Numbers per block of a range lookup.
BLOCK = 1_024
#: Trees with up to so many levels below their roots are numbered level by level.
LEVELS = 12


def tour(nodes: DataFrame, links: DataFrame, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """(root, id, pre, post, depth, size) of every node; numbers count from 1 within a tree.

    ``links`` are link rows (id, label, link_number, link_id); single children, which have no
    number, come first in the order of their labels. ``size`` counts the node and all below it, so
    these have the numbers ``pre`` to ``pre + size - 1``. A node with two parents or on a
    cycle makes the call fail.
    """
    linked = links.where(F.col("link_id").isNotNull()).select("id", "label", "link_number", "link_id")
    kids = number_rows(linked, ["link_number", "label"], partition=["id"], name="_n", heavy_rows=heavy_rows)
    kids, n_kids = materialize(kids.select(F.col("id").alias("parent"), F.col("link_id").alias("id"), "_n"), "children")
    if kids.select("id").distinct().count() < n_kids:
        raise ValueError("a node has more than one parent: the links are no forest")
    numbered = _by_levels(nodes, kids, n_kids, heavy_rows)
    if numbered is not None:
        return materialize(numbered, "visit")[0]
    inner, _ = materialize(kids.groupBy(F.col("parent").alias("id")).agg(F.max_by("id", "_n").alias("_last")), "inner")
    is_inner = inner.select("id", F.lit(True).alias("_inner"))

    # A step is (id, side): 0 enters a node, 1 leaves it; a node without children is one step that does
    # both. Leaving the child before, or the last child, is side 1 if that child has children.
    before = kids.join(
        kids.select("parent", (F.col("_n") + 1).alias("_n"), F.col("id").alias("_to")), ["parent", "_n"], "left"
    ).select("id", F.coalesce("_to", "parent").alias("_to"), F.col("_to").isNotNull().alias("_left"))
    after = inner.select("id", F.col("_last").alias("_to"), F.lit(True).alias("_left"))
    steps = before.withColumn("side", F.lit(0)).unionByName(after.withColumn("side", F.lit(1)))
    # No node is pointed to by more than two steps, so nothing is crowded yet.
    steps = steps.join(is_inner.withColumnRenamed("id", "_to"), "_to", "left")
    to_side = (F.col("_left") & F.col("_inner").isNotNull()).cast("int")
    entered = (~F.col("_left") | F.col("_inner").isNull()).cast("long")
    moving = steps.select(
        "id", "side", F.col("_to").alias("to"), to_side.alias("to_side"), entered.alias("entered"), F.col("_left").cast("long").alias("left"), F.lit(False).alias("done")
    )
    none = F.lit(0).cast("long")
    roots = nodes.select("id").join(kids.select("id"), "id", "left_anti").select(
        "id", F.lit(0).alias("side"), F.col("id").alias("to"), F.lit(0).alias("to_side"), none.alias("entered"), none.alias("left"), F.lit(True).alias("done")
    )
    table, _ = materialize(moving.unionByName(roots), "tour")
    finished, moving = [table.where("done")], table.where("NOT done")
    behind = None
    while rest := moving.count():
        if rest == behind:
            raise RuntimeError(f"links hold a cycle: {rest} steps lead to no root")
        behind = rest
        target = reduce(DataFrame.unionByName, finished, moving).select(
            F.col("id").alias("to"), F.col("side").alias("to_side"), F.col("to").alias("_to"), F.col("to_side").alias("_to_side"),
            F.col("entered").alias("_entered"), F.col("left").alias("_left"), F.col("done").alias("_done"),
        )
        keys = ["to", "to_side"]
        jumped = salted_join(moving, target, keys, left_heavy=heavy_keys(moving, keys, rest, heavy_rows)).select(
            "id", "side", F.col("_to").alias("to"), F.col("_to_side").alias("to_side"),
            (F.col("entered") + F.col("_entered")).alias("entered"), (F.col("left") + F.col("_left")).alias("left"), F.col("_done").alias("done"),
        )
        table, _ = materialize(jumped, "tour")
        finished.append(table.where("done"))
        moving = table.where("NOT done")
    ends = reduce(DataFrame.unionByName, finished)
    enter = ends.where("side = 0").select("id", F.col("to").alias("root"), "entered", "left")
    leave = ends.where("side = 1").select("id", F.col("entered").alias("_inside"), F.col("left").alias("_closed"))
    numbered = enter.join(leave, "id", "left").select(
        "root",
        "id",
        (F.col("entered") + 1).alias("pre"),
        (F.coalesce("_closed", "left") + 1).alias("post"),
        (F.col("entered") - F.col("left")).alias("depth"),
        F.coalesce(F.col("_inside") - F.col("entered"), F.lit(1).cast("long")).alias("size"),
    )
    return materialize(numbered, "visit")[0]


def _by_levels(nodes: DataFrame, kids: DataFrame, n_kids: int, heavy_rows: int) -> DataFrame | None:
    """The numbers of a forest of few levels, or None where the tour has to be followed.

    Sizes are summed from the lowest level up, numbers are told from the roots down, and each node is
    looked at once on either way. Deeper trees, crowded parents, roots given twice and links that hang
    on no root are left to the tour.
    """
    if heavy_keys(kids, ["parent"], n_kids, heavy_rows) is not None:
        return None
    top = nodes.select("id").join(kids.select("id"), "id", "left_anti")
    none = F.lit(None).cast("long")
    top = top.select(F.col("id").alias("root"), F.col("id").alias("parent"), "id", none.alias("_n"))
    top, n_top = materialize(top, "level")
    if top.select("id").distinct().count() < n_top:
        return None
    levels, placed = [top], 0
    while placed < n_kids:
        if len(levels) > LEVELS:
            return None
        above = levels[-1].select("root", F.col("id").alias("parent"))
        level, found = materialize(kids.join(above, "parent").select("root", "parent", "id", "_n"), "level")
        if not found:
            return None
        levels.append(level)
        placed += found
    sized = [levels[-1].withColumn("size", F.lit(1).cast("long"))]
    for level in reversed(levels[:-1]):
        inside = sized[0].groupBy(F.col("parent").alias("id")).agg(F.sum("size").alias("_inside"))
        size = (1 + F.coalesce("_inside", F.lit(0))).cast("long").alias("size")
        sized.insert(0, materialize(level.join(inside, "id", "left").select(*level.columns, size), "sizes")[0])
    out = [sized[0].select("root", "id", F.lit(1).cast("long").alias("pre"), "size")]
    earlier = Window.partitionBy("parent").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
    for level in sized[1:]:
        rows = level.withColumn("_before", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
        above = out[-1].select(F.col("id").alias("parent"), F.col("pre").alias("_pre"))
        pre = (F.col("_pre") + 1 + F.col("_before")).alias("pre")
        out.append(materialize(rows.join(above, "parent").select("root", "id", pre, "size"), "numbers")[0])
    whole = reduce(DataFrame.unionByName, [rows.withColumn("depth", F.lit(d).cast("long")) for d, rows in enumerate(out)])
    post = (F.col("pre") + F.col("size") - 1 - F.col("depth")).alias("post")
    return whole.select("root", "id", "pre", post, "depth", "size")


def below(numbers: DataFrame, tops: DataFrame, block: int = BLOCK) -> DataFrame:
    """(top, root, id, pre, depth): every top with itself and all nodes below it, by range.

    ``numbers`` are the rows of ``tour``, ``tops`` has one column of ids. Ranges are looked up by
    blocks of numbers, so that the join is one of equal blocks.
    """
    chosen = numbers.join(tops.toDF("id").dropna().distinct(), "id")
    first, last = F.col("pre"), F.col("pre") + F.col("size") - 1
    spans = chosen.select(
        "root", F.col("id").alias("top"), first.alias("_first"), last.alias("_last"),
        F.explode(F.sequence(F.floor(first / block), F.floor(last / block))).alias("_block"),
    )
    placed = numbers.select("root", "id", "pre", "depth", F.floor(F.col("pre") / block).alias("_block"))
    met = placed.join(spans, ["root", "_block"]).where(F.col("pre").between(F.col("_first"), F.col("_last")))
    return met.select("top", "root", "id", "pre", "depth")


def ancestors(numbers: DataFrame, ids: DataFrame, block: int = BLOCK) -> DataFrame:
    """(id, top, depth): every given node with the nodes it lies below, itself included, by the same ranges."""
    wanted = numbers.join(ids.toDF("id").dropna().distinct(), "id").select("root", "id", "pre", F.floor(F.col("pre") / block).alias("_block"))
    first, last = F.col("pre"), F.col("pre") + F.col("size") - 1
    spans = numbers.select(
        "root", F.col("id").alias("top"), "depth", first.alias("_first"), last.alias("_last"),
        F.explode(F.sequence(F.floor(first / block), F.floor(last / block))).alias("_block"),
    )
    met = wanted.join(spans, ["root", "_block"]).where(F.col("pre").between(F.col("_first"), F.col("_last")))
    return met.select("id", "top", "depth")


def in_visit_order(rows: DataFrame, name: str = "line_number") -> DataFrame:
    """``rows`` (with root and pre) numbered from 1 as a walk through all trees meets them, trees by root."""
    return number_rows(rows, ["root", "pre"], name=name)
