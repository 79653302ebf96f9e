"""Reachability and strong components in long and cyclic graphs.

``closure`` takes a step per hop, which suits shallow graphs and gives the number of hops. Here
distances double instead: level ``k`` of ``Jumps`` holds the pairs that a walk of exactly ``2 ** k``
edges connects, so a chain of n edges takes about ``log2(n)`` rounds. Where edges meet in hubs the
next level could outgrow the graph; how large it would get is summed from the degrees before it
is made, and levels that are too large are left out: the work then goes over the levels there
are again and again until nothing changes. The result is the same either way.

Cycles are taken out first: nodes that reach each other become one component, found by
colouring forward from random centres and walking back from each centre inside its colour, and
the graph of components is walked.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.operators.numbering import number_rows
from canopy.operators.skew import HEAVY_ROWS, heavy_keys, salted_join
from canopy.session import materialize, scratch_path, write_observed

#: A level of jumps may hold so many times the edges.
GROWTH = 4


class Jumps:
    """Edges (src, dst) and, level by level, the pairs connected by walks of 1, 2, 4, 8 ... edges."""

    def __init__(self, edges: DataFrame, rows: int, heavy_rows: int = HEAVY_ROWS):
        self.levels, self.rows, self.heavy_rows = [edges], [rows], heavy_rows
        self.ended = rows == 0  # no walk is longer than those of the levels there are
        self.full = False  # the next level would be too large
        self._single: bool | None = None  # no node has two ways out, or none has two ways in

    def crowded(self, level: int, end: str) -> DataFrame | None:
        return heavy_keys(self.levels[level], [end], self.rows[level], self.heavy_rows)

    def grow(self) -> bool:
        """Add a level; False if there is none or it would be too large."""
        if self.ended or self.full:
            return False
        last = self.levels[-1]
        if self.single():
            return self._compose(unique=True)
        into = last.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("_in"))
        out = last.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("_out"))
        most = into.join(out, "node").agg(F.sum(F.col("_in").cast("double") * F.col("_out"))).first()[0] or 0
        self.ended, self.full = most == 0, most > GROWTH * self.rows[0]
        if self.ended or self.full:
            return False
        return self._compose(unique=False)

    def single(self) -> bool:
        """Whether no node has two ways out, or none has two ways in: all levels are so then, and none is
        larger than the one before."""
        if self._single is None:
            self._single = any(
                (self.levels[0].groupBy(end).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0) <= 1
                for end in ("src", "dst")
            )
        return self._single

    def acyclic(self) -> bool:
        """Whether all walks end, looked at only where levels cannot grow."""
        if not self.ended and self.single():
            # While all walks end, each level is smaller than the one before: a longest walk has parts of
            # exactly the length that is doubled.
            while self.grow() and self.rows[-1] < self.rows[-2]:
                pass
        return self.ended

    def _compose(self, unique: bool) -> bool:
        last, on = self.levels[-1], len(self.levels) - 1
        first = last.select("src", F.col("dst").alias("_mid"))
        second = last.select(F.col("src").alias("_mid"), "dst")
        pairs = salted_join(first, second, ["_mid"], left_heavy=_renamed(self.crowded(on, "dst"), "dst"), right_heavy=_renamed(self.crowded(on, "src"), "src"))
        pairs = pairs.select("src", "dst")
        table, rows = materialize(pairs if unique else pairs.distinct(), "jumps")
        self.ended = rows == 0
        if self.ended:
            return False
        self.levels.append(table)
        self.rows.append(rows)
        return True


def _renamed(heavy: DataFrame | None, end: str) -> DataFrame | None:
    return None if heavy is None else heavy.withColumnRenamed(end, "_mid")


def _until_quiet(jumps: Jumps, apply: Callable[[int], int]) -> None:
    """Apply the levels, shortest jumps first, until ``apply`` (which tells how much changed) is done.

    Once jumps of all shorter lengths are in, a level that changes nothing is the last that could.
    Without all levels, the end is where single edges change nothing.
    """
    level, rising = 0, True
    while True:
        changed = apply(level)
        if not changed and (rising or level == 0):
            return
        if level + 1 < len(jumps.levels) or (rising and jumps.grow()):
            level += 1
        elif jumps.ended:
            return
        else:
            level, rising = 0, False


def _labels(jumps: Jumps, numbers: DataFrame) -> DataFrame:
    """(id, n, up): the least number of a node that reaches each node, its own ``n`` among them."""
    labels = _ids(jumps.levels[0]).join(numbers.select("id", "n"), "id").select("id", "n", F.col("n").alias("up"))
    state = [materialize(labels, "labels")[0]]
    none = F.lit(None).cast("long")

    def apply(level: int) -> int:
        labels, step = state[0], jumps.levels[level]
        ups = salted_join(step, labels.select(F.col("id").alias("src"), "up"), ["src"], left_heavy=jumps.crowded(level, "src"))
        told = labels.select("id", "n", "up", F.col("up").alias("_before")).unionByName(
            ups.select(F.col("dst").alias("id"), none.alias("n"), "up", none.alias("_before"))
        )
        new = told.groupBy("id").agg(F.max("n").alias("n"), F.min("up").alias("up"), F.max("_before").alias("_before"))
        path = scratch_path(step.sparkSession, "labels")
        seen = write_observed(new, path, moved=F.sum((F.col("up") != F.col("_before")).cast("long")))
        state[0] = step.sparkSession.read.schema(new.schema).parquet(path).select("id", "n", "up")
        return seen["moved"] or 0

    _until_quiet(jumps, apply)
    return state[0]


def _ids(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()


def strong_components(edges: DataFrame, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """(id, component) for every node of edges (src, dst); component is the least node that reaches it and is reached.

    Nodes are numbered at random, and the least number that reaches a node is its colour. A node with
    its own number for a colour is a centre; the nodes of its colour from which it is reached lie on a cycle with it. Each round
    settles those; edges that join differently coloured nodes lie on no cycle and go, as do
    edges that no long walk leads to or leads on from. The next round colours the other way. Null ends are no nodes.
    """
    return _components(edges, heavy_rows)[0]


def _components(edges: DataFrame, heavy_rows: int) -> tuple[DataFrame, Jumps | None]:
    """The components, and the jumps over all edges between different nodes where no walk over them comes back."""
    whole, _ = materialize(edges.select("src", "dst").dropna().distinct(), "edges")
    ids = _ids(whole)
    work, n = materialize(whole.where("src <> dst"), "edges")
    settled: list[DataFrame] = []
    labels: DataFrame | None = None
    straight = None if n else Jumps(work, n, heavy_rows)
    while n:
        jumps = Jumps(work, n, heavy_rows)
        if not jumps.acyclic():  # without a look at any label, if so
            # Any order of the nodes left will do again: which of them come first has not been used.
            numbers = number_rows(_ids(work), [F.xxhash64("id")], name="n") if labels is None else labels
            labels = _labels(jumps, numbers)
        if jumps.ended:  # all walks end: there is no cycle
            straight = None if settled else jumps
            break
        last, colours = jumps.levels[-1], labels.select("id", "up")
        inside = (
            work.join(colours.toDF("src", "_colour"), "src")
            .join(colours.toDF("dst", "_other"), "dst")
            .where("_colour = _other")
            .join(last.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
            .join(last.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        )
        back, n = materialize(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")), "edges")
        centres = labels.where("up = n").select(F.col("id").alias("root"), F.col("id").alias("node"))
        found, _ = _walk(centres, Jumps(back, n, heavy_rows))
        settled.append(found)
        done = found.select("node")
        left = back.join(done.toDF("src"), "src", "left_anti").join(done.toDF("dst"), "dst", "left_anti")
        work, n = materialize(left.select("src", "dst"), "edges")
    if not settled:
        return ids.select("id", F.col("id").alias("component")), straight
    found = settled[0]
    for more in settled[1:]:
        found = found.unionByName(more)
    least = found.groupBy("root").agg(F.min("node").alias("component"))
    found = found.join(least, "root").select(F.col("node").alias("id"), "component")
    return ids.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component")), None


def reach(edges: DataFrame, roots: DataFrame | None = None, reflexive: bool = True, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """All (root, node) pairs connected by edges (src, dst), however long the way.

    ``roots`` has one column of start nodes, by default every ``src``. With ``reflexive`` every root
    reaches itself, otherwise only one that lies on a cycle or has an edge to itself.
    """
    edges, _ = materialize(edges.select("src", "dst").dropna().distinct(), "edges")
    starts = edges.select(F.col("src").alias("root")) if roots is None else roots.toDF("root")
    starts = starts.dropna().distinct()
    starts = starts.select(F.col("root").cast(edges.schema["src"].dataType).alias("root"))
    member, straight = _components(edges, heavy_rows)
    if straight is not None:  # every node is its own component
        pairs, _ = _walk(starts.select("root", F.col("root").alias("node")), straight)
        if reflexive:
            return pairs.select("root", "node")
        loops = edges.where("src = dst").select(F.col("src").alias("root"))
        itself = starts.join(loops, "root", "left_semi").select("root", F.col("root").alias("node"))
        return pairs.where("root <> node").select("root", "node").unionByName(itself)
    member, _ = materialize(member, "component")
    ends = edges
    for end in ("src", "dst"):
        ends = ends.join(member.select(F.col("id").alias(end), F.col("component").alias(f"_{end}")), end)
    between, n = materialize(ends.where("_src <> _dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst")).distinct(), "between")
    placed = starts.join(member.withColumnRenamed("id", "root"), "root", "left").select("root", F.coalesce("component", "root").alias("_from"))
    pairs, rows = _walk(placed.select(F.col("_from").alias("root"), F.col("_from").alias("node")).distinct(), Jumps(between, n, heavy_rows))
    # Back from components to nodes, on either side.
    inside = member.select(F.col("component").alias("node"), F.col("id").alias("_to"))
    alone = placed.join(member.select(F.col("id").alias("root")), "root", "left_anti")
    reached = salted_join(pairs, inside, ["node"], left_heavy=heavy_keys(pairs, ["node"], rows, heavy_rows))
    reached = reached.select(F.col("root").alias("_from"), F.col("_to").alias("node"))
    whole = salted_join(reached, placed, ["_from"], left_heavy=heavy_keys(reached, ["_from"], None, heavy_rows)).select("root", "node")
    if reflexive:
        return whole.unionByName(alone.select("root", F.col("root").alias("node")))
    loops = edges.where("src = dst").select(F.col("src").alias("root"))
    larger = member.groupBy("component").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("component")
    cyclic = member.join(larger, "component").select(F.col("id").alias("root")).unionByName(loops).distinct()
    itself = starts.join(cyclic, "root", "left_semi").select("root", F.col("root").alias("node"))
    return whole.where("root <> node").unionByName(itself)


def _walk(starts: DataFrame, jumps: Jumps) -> tuple[DataFrame, int]:
    """All pairs (root, node) that the jumps lead to from the pairs given, and how many."""
    state = list(materialize(starts, "reach"))

    def apply(level: int) -> int:
        found, before = state
        step = jumps.levels[level].select(F.col("src").alias("node"), F.col("dst").alias("_next"))
        crowded = heavy_keys(found, ["node"], before, jumps.heavy_rows)
        hubs = jumps.crowded(level, "src")
        hubs = None if hubs is None else hubs.withColumnRenamed("src", "node")
        further = salted_join(found, step, ["node"], left_heavy=crowded, right_heavy=hubs)
        state[:] = materialize(found.unionByName(further.select("root", F.col("_next").alias("node"))).distinct(), "reach")
        return state[1] - before

    if jumps.rows[0]:
        _until_quiet(jumps, apply)
    return state[0], state[1]
