"""Transitive closure over possibly cyclic edges, and walks from given roots.

A recursive query with ``UNION`` (which drops rows seen before, and so ends on cycles) is not
available in Spark SQL. The closure is computed in rounds instead: each round joins only the
pairs found in the round before with the edges, and keeps the pairs not seen yet. A round is
one step and one Spark job, written below the checkpoint folder; the driver holds its row
counts. Pairs are unique after every step, so no step makes more than pairs times edges, and a
walk ends when nothing new is found, however long the chains or cycles are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopy.operators.skew import HEAVY_ROWS, heavy_keys, salted_join
from canopy.session import materialize, scratch_path, write_observed

#: Rows of a last round of which the roots are sent to every executor.
_FEW = 500_000


def closure(
    edges: DataFrame,
    roots: DataFrame | None = None,
    reflexive: bool = True,
    heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """All (root, node) pairs connected by edges, with the least number of hops as ``depth``.

    ``edges`` has columns (src, dst); ``roots`` one column of start nodes, by default every
    ``src``. ``reflexive`` adds (root, root, 0). Cycles and self loops end the walk since a
    pair is kept only once.
    """
    return counted_closure(edges, roots, reflexive, heavy_rows)[0]


def counted_closure(
    edges: DataFrame,
    roots: DataFrame | None = None,
    reflexive: bool = True,
    heavy_rows: int = HEAVY_ROWS,
) -> tuple[DataFrame, int]:
    """The closure and its number of pairs, which is known from its rounds."""
    spark = edges.sparkSession
    steps, n_steps = materialize(edges.select("src", "dst").dropna().distinct(), "edges")
    hubs = heavy_keys(steps.select(F.col("src").alias("node")), ["node"], n_steps, heavy_rows)
    steps = steps.select(F.col("src").alias("node"), F.col("dst").alias("_next"))
    starts = steps.select(F.col("node").alias("root")) if roots is None else roots.toDF("root")

    # The depth of a row is the round that found it, kept in the folder name: without changing
    # literals in them, the plans of all rounds share their generated code.
    base = scratch_path(spark, "closure")
    starts = starts.dropna().distinct()
    starts = starts.select("root", F.col("root").cast(steps.schema["_next"].dataType).alias("node"))
    schema = starts.schema

    def save(rows: DataFrame, depth: int) -> tuple[DataFrame, int]:
        path = f"{base}/depth={depth}"
        seen = write_observed(rows, path, rows=F.count(F.lit(1)))
        return spark.read.schema(schema).parquet(path), seen["rows"]

    frontier, found = save(starts, 0)
    depth, total, known = 0, found if reflexive else 0, [0] if reflexive else []
    while found:
        crowded = heavy_keys(frontier, ["node"], found, heavy_rows)
        level = salted_join(frontier, steps, ["node"], left_heavy=crowded, right_heavy=hubs).select(
            "root", F.col("_next").alias("node"), F.lit(True).alias("new")
        )
        if known:
            seen = spark.read.schema(schema).parquet(*[f"{base}/depth={d}" for d in known])
            if found <= _FEW:  # only roots that still move can meet a known pair
                seen = seen.join(F.broadcast(frontier.select("root").distinct()), "root", "left_semi")
            level = level.unionByName(seen.withColumn("new", F.lit(False)))
        # One shuffle drops both repeats and known pairs: a known pair has a row that is not new.
        fresh = level.groupBy("root", "node").agg(F.bool_and("new").alias("new")).where("new")
        depth += 1
        frontier, found = save(fresh.select("root", "node"), depth)
        known.append(depth)
        total += found
    with_depth = T.StructType([*schema.fields, T.StructField("depth", T.IntegerType())])
    whole = spark.read.schema(with_depth).option("basePath", base).parquet(base)
    whole = whole.select("root", "node", "depth")
    return (whole if reflexive else whole.where(F.col("depth") > 0)), total


def subtree(links: DataFrame, roots: DataFrame, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Every node below the given roots as (root, id, depth), the roots themselves included.

    ``links`` are link rows (id, link_id, ...). The root filter is applied at the start of the
    walk, so nothing outside the wanted trees is visited.
    """
    pairs = closure(
        links.select(F.col("id").alias("src"), F.col("link_id").alias("dst")), roots, heavy_rows=heavy_rows
    )
    return pairs.withColumnRenamed("node", "id")


def parents(links: DataFrame) -> DataFrame:
    """The parent relation (id, parent) of a forest given by link rows."""
    return links.where(F.col("link_id").isNotNull()).select(
        F.col("link_id").alias("id"), F.col("id").alias("parent")
    )


def ancestor(nodes: DataFrame, links: DataFrame, n: int = 1) -> DataFrame:
    """The n-th ancestor of each node as (id, ancestor), clamped at the root.

    Jumps double, and the table of jumps is written down after each doubling: about
    ``2 log2(n)`` joins instead of n, in plans of two joins each.
    """
    if n < 0:
        raise ValueError("n must not be negative")
    ids = nodes.select("id")
    jump = ids.join(parents(links), "id", "left").select("id", F.coalesce("parent", "id").alias("to"))
    current = ids.select("id", F.col("id").alias("ancestor"))
    while n:
        if n & 1:
            hop = jump.select(F.col("id").alias("ancestor"), F.col("to").alias("_to"))
            current = current.join(hop, "ancestor", "left").select("id", F.col("_to").alias("ancestor"))
        n >>= 1
        if n:
            again = jump.select(F.col("id").alias("to"), F.col("to").alias("_to"))
            jump, _ = materialize(jump.join(again, "to").select("id", F.col("_to").alias("to")), "jump")
            current, _ = materialize(current, "ancestors")
    return current


def node_depth(nodes: DataFrame, links: DataFrame, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Root and depth of each node as (id, root, depth); a root has depth 0.

    Pointer jumping: every unfinished node points to an ancestor and replaces that pointer by
    the ancestor's own pointer, so the distance doubles and the rounds grow with the logarithm
    of the tree depth. Finished nodes leave the probing side. Nodes on a cycle have no root
    and make the call fail: in a forest every round finishes a node, at least the highest one
    that was left.
    """
    spark = nodes.sparkSession
    start = (
        nodes.select("id")
        .join(parents(links), "id", "left")
        .select(
            "id",
            F.coalesce("parent", "id").alias("to"),
            F.col("parent").isNotNull().cast("int").alias("depth"),
            F.col("parent").isNull().alias("done"),
        )
    )
    table, _ = materialize(start, "depth")
    finished, moving = [table.where("done")], table.where("NOT done")
    before = None
    while left := moving.count():
        if left == before:
            raise RuntimeError(f"links hold a cycle: {left} nodes have no root")
        before = left
        target = reduce(DataFrame.unionByName, finished, moving).select(
            F.col("id").alias("to"), F.col("to").alias("_to"), F.col("depth").alias("_depth"), F.col("done").alias("_done")
        )
        jumped = salted_join(moving, target, ["to"], left_heavy=heavy_keys(moving, ["to"], left, heavy_rows)).select(
            "id", F.col("_to").alias("to"), (F.col("depth") + F.col("_depth")).alias("depth"), F.col("_done").alias("done")
        )
        table, _ = materialize(jumped, "depth")
        finished.append(table.where("done"))
        moving = table.where("NOT done")
    done = reduce(DataFrame.unionByName, finished)
    return done.select("id", F.col("to").alias("root"), "depth")
