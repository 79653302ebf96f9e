"""Near-duplicate vectors by sorted projection passes.

Each pass gives every vector a word of random sign bits (on which side of random planes it
lies), sorts all vectors by that word, and compares each with a bounded window of followers.
Vectors with a small angle agree in many leading bits and so come close in some pass; pairs that
reach the threshold are united across passes. The windows find what is connected; inside a
component all pairs are then counted exactly, in blocks, without writing pairs down.

The number of passes follows from the table: with n distinct vectors a pair at the threshold
shares the ``log2(n / window)`` leading bits that bring it into one window with probability
``(1 - angle/pi) ** bits``, and passes are added until one of them does so with the wanted recall.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import map_rows
from canopy.llm.components import Forest, components, in_blocks, own_ids, same_owner
from canopy.session import materialize

THRESHOLD = 0.9
WINDOW = 32
RECALL = 0.97
BITS = 48
SEED = 20_240_501
#: Rows of a sorted pass that one task takes, and of a block of a large component.
TASK_ROWS = 40_000
BLOCK = 512


def usable(vector: str | Column) -> Column:
    """Not null, not zero, all components finite."""
    v = F.col(vector) if isinstance(vector, str) else vector
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    good = F.forall(v, finite) & F.exists(v, lambda x: x != 0)
    return F.coalesce(good, F.lit(False))


def passes_needed(n: int, threshold: float, window: int, recall: float) -> int:
    same_bit = 1 - math.acos(threshold) / math.pi
    together = same_bit ** max(1.0, math.log2(max(2.0, n / window)))
    return max(4, math.ceil(math.log(1 - recall) / math.log(1 - together)))


def unit(vectors: list, size: int) -> np.ndarray:
    """Vectors of equal length as rows of norm 1, in double precision."""
    x = np.array(vectors, np.float64).reshape(-1, size)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow, no underflow to 0
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _sorted_passes(vectors: DataFrame, passes: int, kind: str) -> DataFrame:
    """(size, turn, word, id, v): each vector once per pass, with its sign bits as a number."""

    def task(batches: Iterator[dict]) -> Iterator[dict]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        weight = 2.0 ** np.arange(BITS - 1, -1, -1)
        for batch in batches:
            ids, rows = np.array(batch["id"], np.int64), batch["v"]
            sizes = np.array([len(v) for v in rows])
            for size in np.unique(sizes).tolist():
                some = np.flatnonzero(sizes == size)
                x = unit([rows[i] for i in some], size)
                kept = [rows[i] for i in some]
                for turn in range(passes):
                    if (size, turn) not in planes:
                        planes[size, turn] = np.random.default_rng([SEED, size, turn]).standard_normal((size, BITS))
                    word = ((x @ planes[size, turn] > 0) @ weight).astype(np.int64)
                    n = len(some)
                    yield {"size": [size] * n, "turn": [turn] * n, "word": word.tolist(), "id": ids[some].tolist(), "v": kept}

    return map_rows(vectors.select("id", "v"), f"size int, turn int, word long, id long, v array<{kind}>", task)


def _window_links(ordered: DataFrame, window: int, threshold: float) -> DataFrame:
    """(a, b) that connect the pairs found among neighbours of the sort, one per vector and task.

    A window ends with its task's range. That costs ``window`` of some ten thousand rows per
    pass, and other passes sort otherwise.
    """

    def task(batches: Iterator[dict]) -> Iterator[dict]:
        forest = Forest()
        before, ids_before, sort_before = None, None, None
        for batch in batches:
            ids = np.array(batch["id"], np.int64)
            sort = np.array(batch["size"], np.int64) << 32 | np.array(batch["turn"], np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(sort)) + 1).tolist(), len(ids)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                x = unit(batch["v"][lo:hi], batch["size"][lo])
                own = ids[lo:hi]
                if sort_before == sort[lo]:
                    x, own = np.concatenate([before, x]), np.concatenate([ids_before, own])
                for step in range(1, min(window, len(own) - 1) + 1):
                    cosine = np.einsum("ij,ij->i", x[:-step], x[step:])
                    for i in np.flatnonzero(cosine >= threshold).tolist():
                        forest.union(int(own[i]), int(own[i + step]))
                before, ids_before, sort_before = x[-window:], own[-window:], sort[lo]
        left, right = forest.links()
        yield {"a": left, "b": right}

    return map_rows(ordered, "a long, b long", task)


def _count_links(members: DataFrame, n: int, threshold: float) -> DataFrame:
    """(id, n_links) over members (component_id, size, id, weight, v): linked rows of the own component."""
    cells = in_blocks(members, "component_id", F.col("size"), "id", BLOCK)
    # Small components share a group; a cell of a large one has a group of its own.
    shared = F.pmod(F.xxhash64("component_id"), F.lit(max(1, n // BLOCK)))
    group = F.when(F.col("size") <= BLOCK, shared).otherwise(F.xxhash64("component_id", "_i", "_j"))

    def count(table: pa.Table) -> pa.Table:
        part = {k: table[k].to_numpy() for k in ("component_id", "_i", "_j", "_own", "id", "weight")}
        rows = table["v"].to_pylist()
        order = np.lexsort((part["id"], part["_j"], part["_i"], part["component_id"]))
        keys = np.stack([part[k][order] for k in ("component_id", "_i", "_j")])
        cuts = [0, *(np.flatnonzero((np.diff(keys) != 0).any(0)) + 1).tolist(), len(order)]
        ids, found = [], []
        for lo, hi in zip(cuts, cuts[1:]):
            at = order[lo:hi]
            x = unit([rows[i] for i in at], len(rows[at[0]]))
            linked = x @ x.T >= threshold
            np.fill_diagonal(linked, False)
            i, j = keys[1, lo], keys[2, lo]
            if i != j:
                linked &= part["_own"][at][:, None] != part["_own"][at][None, :]
            ids.append(part["id"][at])
            found.append(linked @ part["weight"][at])
        return pa.table({"id": pa.array(np.concatenate(ids), pa.int64()), "n": pa.array(np.concatenate(found), pa.int64())})

    counted = cells.withColumn("_group", group).groupBy("_group").applyInArrow(count, "id long, n long")
    return counted.groupBy("id").agg(F.sum("n").alias("n_links"))


def near_vectors(
    rows: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    threshold: float = THRESHOLD,
    window: int = WINDOW,
    recall: float = RECALL,
) -> DataFrame:
    """``key``, n_links, component_id and kept for every row.

    A row counts as many links as other rows have a cosine of at least ``threshold`` with it,
    equal vectors included; component_id is the smallest key reachable. Null, zero and
    non-finite vectors link with nothing, nor do vectors of different lengths. A row without key
    links with nothing, has no component and is kept. A key that comes with several vectors is one
    vertex with the links of all of them; its rows count their own links.
    """
    kind = "float" if rows.schema[vector].dataType.simpleString() == "array<float>" else "double"
    wide = rows.select(F.col(key).cast("long").alias("key"), F.col(vector).cast(f"array<{kind}>").alias("v"))
    wide = wide.withColumn("ok", F.col("key").isNotNull() & usable("v"))
    same = F.transform("v", lambda x: x + F.lit(0.0).cast(kind))
    # The same vector is one class; -0.0 and 0.0 are equal.
    classes, n = materialize(
        wide.where("ok").groupBy(same.alias("v")).agg(F.min("key").alias("id"), F.count(F.lit(1)).alias("weight")),
        "vectors",
    )
    several = wide.where("ok").groupBy("key").agg(F.min(F.xxhash64(same)).alias("_low"), F.max(F.xxhash64(same)).alias("_high"))
    _, n_several = materialize(several.where("_low < _high").select("key"), "several-vectors")
    if n_several:
        classes = own_ids(classes, "v")
    linked = wide.join(
        classes.select(F.col("id").alias("_rep"), F.col("weight").alias("_weight"), F.col("v").alias("_v")),
        F.col("ok") & (same == F.col("_v")), "left",
    ).select("key", "_rep", "_weight")
    passes = passes_needed(n, threshold, window, recall)
    tasks = max(1, math.ceil(n * passes / TASK_ROWS))
    spread = _sorted_passes(classes, passes, kind)
    ordered = spread.repartitionByRange(tasks, "size", "turn", "word", "id").sortWithinPartitions("size", "turn", "word", "id")
    links = _window_links(ordered, window, threshold)
    if n_several:
        links = links.unionByName(same_owner(linked.where("_rep IS NOT NULL").select("key", F.col("_rep").alias("id")), "key"))
    label = components(links)
    sizes = label.groupBy("component_id").agg(F.count(F.lit(1)).alias("size"))
    members, n_members = materialize(label.join(sizes, "component_id").join(classes, "id"), "members")
    counts = _count_links(members, n_members, threshold).join(label, "id").select(F.col("id").alias("_rep"), "n_links", "component_id")
    out = linked.join(counts, "_rep", "left")
    own = F.coalesce("component_id", "_rep", "key")
    return out.select(
        F.col("key").alias(key),
        (F.coalesce("n_links", F.lit(0)) + F.coalesce(F.col("_weight") - 1, F.lit(0))).cast("long").alias("n_links"),
        F.when(F.col("key").isNotNull(), own).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
