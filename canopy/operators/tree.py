"""Operators over node rows (id, kind, data, ...) and link rows (id, label, link_number, link_id)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.operators.closure import closure

CHUNK = 1_000


def children(nodes: DataFrame, links: DataFrame, keep_leaves: bool = True) -> DataFrame:
    """Nodes with their children, one row per child in ``link_number`` order of the parent.

    Leaves stay with null child columns; ``keep_leaves=False`` drops them. Children are rows,
    not lists, so a node with any number of children is no more work than the same links
    elsewhere.
    """
    child = nodes.select(F.col("id").alias("link_id"), F.col("kind").alias("child_kind"), F.col("data").alias("child_data"))
    linked = links.join(child, "link_id", "left")
    # Inner join plus anti join, not one left join: a parent holding a large share of the
    # links can then be split at run time.
    parents = linked.join(nodes, "id").select(*nodes.columns, *[c for c in linked.columns if c != "id"])
    if not keep_leaves:
        return parents
    leaves = nodes.join(links.select("id").distinct(), "id", "left_anti")
    return parents.unionByName(leaves, allowMissingColumns=True)


def reassemble(nodes: DataFrame, links: DataFrame, keep_leaves: bool = True, chunk: int = CHUNK) -> DataFrame:
    """Nodes holding their children in order, as lists of at most ``chunk`` children.

    A node with more children has several rows, numbered by ``part`` from 0; read in ``part``
    order they give all children. No list grows with the data. Single children, which have no
    number, come first in the order of their labels.
    """
    part = F.coalesce(F.expr(f"(link_number - 1) div {int(chunk)}"), F.lit(0)).alias("part")
    lists = links.groupBy("id", part).agg(
        F.array_sort(F.collect_list(F.struct("link_number", "label", "link_id"))).alias("children")
    )
    ordered = F.transform(
        F.concat(
            F.filter("children", lambda c: c["link_number"].isNull()),
            F.filter("children", lambda c: c["link_number"].isNotNull()),
        ),
        lambda c: F.struct(c["label"].alias("label"), c["link_id"].alias("link_id")),
    )
    lists = lists.select("id", "part", ordered.alias("children"))
    joined = nodes.join(lists, "id", "left" if keep_leaves else "inner")
    return joined.withColumn("part", F.coalesce("part", F.lit(0)))


def function_rows(functions: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Function declarations in the shape of node rows, and of link rows to their body entries.

    The two go into ``unionByName`` with the other nodes and links; the block between a
    function and its entries is left out.
    """
    nodes = functions.select(
        "tag", "id", F.lit("FuncDecl").alias("kind"), F.col("name").alias("data"), "location", "end_location", "type"
    )
    entries_of = links.select("tag", F.col("id").alias("block_id"), "link_number", "link_id")
    body = functions.select("tag", "id", "block_id").join(entries_of, ["tag", "block_id"])
    return nodes, body.select("tag", "id", F.lit("block").alias("label"), "link_number", "link_id")


def function_subtree(
    functions: DataFrame, nodes: DataFrame, links: DataFrame, which: Column, keep_leaves: bool = True
) -> DataFrame:
    """Everything below the wanted functions: (tag, name, kind, location, end_location, data, depth).

    ``which`` chooses the functions before the walk begins. The function itself has depth 0,
    its body entries depth 1. ``keep_leaves=False`` lists only nodes that have links.
    """
    wanted = functions.where(which).select("tag", "name", "location", "end_location", F.col("block_id").alias("id"))
    wanted = wanted.withColumn("root", F.struct("tag", "id"))
    steps = links.where(F.col("link_id").isNotNull()).select(
        F.struct("tag", "id").alias("src"), F.struct("tag", F.col("link_id").alias("id")).alias("dst")
    )
    reached = closure(steps, wanted.select("root")).where(F.col("depth") > 0)
    if not keep_leaves:
        reached = reached.join(steps.select(F.col("src").alias("node")).distinct(), "node", "left_semi")
    found = nodes.select(F.struct("tag", "id").alias("node"), "kind", "location", "end_location", "data")
    below = (
        reached.join(wanted.select("root", "tag", "name"), "root")
        .join(found, "node")
        .select("tag", "name", "kind", "location", "end_location", "data", "depth")
    )
    itself = wanted.select(
        "tag", "name", F.lit("FuncDecl").alias("kind"), "location", "end_location", F.lit(None).cast("string").alias("data"), F.lit(0).alias("depth")
    )
    return itself.unionByName(below).distinct()


def child_summary(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Per node: number of children, first and last child by ``link_number``. Leaves count 0."""
    summary = links.groupBy("id").agg(
        F.count(F.lit(1)).alias("n_children"),
        F.min_by("link_id", "link_number").alias("first_child"),
        F.max_by("link_id", "link_number").alias("last_child"),
    )
    return nodes.join(summary, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))


def entries(links: DataFrame, label: str) -> DataFrame:
    """Ordered entries of one list member: (id, entry_num, entry_id)."""
    return links.where(F.col("label") == label).select(
        "id", F.col("link_number").alias("entry_num"), F.col("link_id").alias("entry_id")
    )


def member(nodes: DataFrame, links: DataFrame, path: Sequence[str], start: DataFrame | None = None) -> DataFrame:
    """The node reached over single links from each node: (id, member_id, member_kind, member_data).

    Null where a step is missing: every step is a left join. ``start`` limits the nodes to
    start from.
    """
    step = links.where(F.col("link_number").isNull())
    reached = (nodes if start is None else start).select("id", F.col("id").alias("member_id"))
    for label in path:
        hop = step.where(F.col("label") == label).select(F.col("id").alias("member_id"), F.col("link_id").alias("_to"))
        reached = reached.join(hop, "member_id", "left").select("id", F.col("_to").alias("member_id"))
    found = nodes.select(
        F.col("id").alias("member_id"), F.col("kind").alias("member_kind"), F.col("data").alias("member_data")
    )
    return reached.join(found, "member_id", "left").select("id", "member_id", "member_kind", "member_data")


def root_decls(nodes: DataFrame, links: DataFrame, root_kind: str, group_kind: str) -> DataFrame:
    """Declarations below each root: children with data, and those of grouping children.

    Gives (root, id, kind, data). A child of the grouping kind is opened instead of listed.
    """
    roots = nodes.where(F.col("kind") == root_kind).select(F.col("id").alias("root"))
    linked = links.where(F.col("link_id").isNotNull())
    info = nodes.select("id", "kind", "data")
    first = (
        linked.select(F.col("id").alias("root"), F.col("link_id").alias("id")).join(roots, "root", "left_semi").join(info, "id")
    )
    groups = first.where(F.col("kind") == group_kind).select("root", F.col("id").alias("group"))
    second = (
        linked.select(F.col("id").alias("group"), F.col("link_id").alias("id")).join(groups, "group").join(info, "id")
    )
    columns = ["root", "id", "kind", "data"]
    direct = first.where(F.col("kind") != group_kind).select(*columns)
    return direct.unionByName(second.select(*columns)).where(F.col("data").isNotNull())


def wide(links: DataFrame, keys: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """One row per node with a ``<label>_id`` column per single child, null where there is none.

    The labels are given, so no job is needed to find them. Of several children under one
    label the least id is taken.
    """
    picked = [F.min(F.when(F.col("label") == lab, F.col("link_id"))).alias(f"{lab}_id") for lab in labels]
    return links.groupBy(*keys).agg(*picked)


def kind_census(nodes: DataFrame) -> DataFrame:
    """Number of nodes per kind."""
    return nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def outline(depth: Column, text: Column, indent: str = "  ") -> Column:
    """Report line of a node, indented by its depth."""
    return F.format_string("%s%s", F.repeat(F.lit(indent), depth), text)
