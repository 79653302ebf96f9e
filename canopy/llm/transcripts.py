"""Chat transcripts: roles recovered by a hidden Markov model, then canonical turns.

Every line of a transcript is emitted by a state (role, first line of a turn or a further one).
Emissions look at the speaker marker in front of the line and at simple features of the line;
all probabilities are counted on labelled conversations. Roles are the best path (Viterbi).

Long conversations. A conversation is cut into blocks by position. Each block is first reduced
to the best score from every state before it to every state at its end, the blocks of a
conversation are chained, and then each block finds its own path between its two known ends.
The result is the best path of the whole conversation, though no task ever holds all of it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.session import materialize

ROLES = ("system", "user", "assistant")
#: States: first lines of each role, then further lines of each role.
STATES = tuple((role, first) for first in (True, False) for role in ROLES)
#: Positions of one block of a conversation, and rows that one task takes.
SPAN = 512 << 20
TASK_ROWS = 20_000

# Names that speakers are marked with (fixed values); others count as one class.
MARKERS = (
    "system", "sys", "instructions", "user", "human", "q", "question", "customer", "prompter", "you", "me",
    "assistant", "ai", "a", "answer", "bot", "agent", "model", "gpt", "chatbot",
)
_MARKED = r"^\s*(?:[*#\[(<|]+\s*)?([A-Za-z]{1,16})(?:\s*[*\])>|]+)?\s*(?::|\]|\|>|>)(?:\*\*)?\s*"

FEATURES = ("marker", "question", "size", "opening")


def marker(line: Column) -> Column:
    """The class of a line's speaker marker: its name, ``other`` or ``none``."""
    name = F.lower(F.regexp_extract(line, _MARKED, 1))
    return F.when(name == "", F.lit("none")).when(name.isin(*MARKERS), name).otherwise(F.lit("other"))


def body(line: Column) -> Column:
    """A line without its speaker marker, if the marker is a known name."""
    known = ~marker(line).isin("none", "other")
    return F.when(known, F.regexp_replace(line, _MARKED, "")).otherwise(line)


def featured(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines with one column per feature; null lines are empty."""
    text = F.coalesce(F.col(line), F.lit(""))
    rest = body(text)
    size = F.when(F.length(rest) == 0, "empty").when(F.length(rest) < 80, "short").when(F.length(rest) < 300, "middle").otherwise("long")
    opening = F.when(rest.rlike(r"^\s*\p{Lu}"), "upper").when(rest.rlike(r"^\s*\p{Ll}"), "lower").otherwise("sign")
    return (
        lines.withColumn("marker", marker(text))
        .withColumn("question", F.when(F.rtrim(rest).endswith("?"), "yes").otherwise("no"))
        .withColumn("size", size)
        .withColumn("opening", opening)
        .withColumn("body", rest)
    )


@dataclass
class Model:
    """Log probabilities: ``start[state]``, ``step[from, to]``, ``emit[feature][value][state]``."""

    start: np.ndarray
    step: np.ndarray
    emit: dict[str, dict[str, np.ndarray]]

    def emissions(self, table: pa.Table) -> np.ndarray:
        out = np.zeros((table.num_rows, len(STATES)))
        unseen = np.zeros(len(STATES))
        for name in FEATURES:
            known = self.emit[name]
            out += np.stack([known.get(v, unseen) for v in table[name].to_pylist()]) if table.num_rows else 0
        return out


def train(turns: DataFrame) -> Model:
    """Counts over labelled turns (conv_id, turn, role, first, further).

    ``first`` and ``further`` are the features of a turn's first line and of its others, as structs.
    Turns with another role, or none, are left out. The driver sees one row per (state, value).
    """
    some = turns.where(F.col("role").isin(*ROLES))
    lines = some.select("role", F.lit(True).alias("is_first"), F.col("first").alias("f")).unionByName(
        some.select("role", F.lit(False).alias("is_first"), F.explode("further").alias("f"))
    )
    value = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"f.{n}").alias("value")) for n in FEATURES]))
    counted = lines.select("role", "is_first", value.alias("v")).groupBy("role", "is_first", "v.name", "v.value").count().collect()
    emit: dict[str, dict[str, np.ndarray]] = {name: {} for name in FEATURES}
    for row in counted:
        at = STATES.index((row["role"], row["is_first"]))
        emit[row["name"]].setdefault(row["value"], np.zeros(len(STATES)))[at] += row["count"]
    for values in emit.values():
        total = sum(values.values(), np.zeros(len(STATES)))
        for v, n in values.items():
            values[v] = np.log((n + 0.5) / (total + 0.5 * (len(values) + 1)))
    before = some.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("before"))
    pairs = some.select("conv_id", "turn", "role").join(before, ["conv_id", "turn"], "left")
    follow = np.full((len(ROLES) + 1, len(ROLES)), 0.5)
    for row in pairs.groupBy("before", "role").count().collect():
        follow[ROLES.index(row["before"]) if row["before"] else len(ROLES), ROLES.index(row["role"])] += row["count"]
    follow /= follow.sum(1, keepdims=True)
    sums = {r["role"]: (r["n"], r["m"]) for r in some.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("further")).alias("m")).collect()}
    start, step = np.full(len(STATES), -np.inf), np.full((len(STATES), len(STATES)), -np.inf)
    start[: len(ROLES)] = np.log(follow[-1])
    for k, (role, _) in enumerate(STATES):
        r = ROLES.index(role)
        n, m = sums.get(role, (0, 0))
        stay = (m + 0.5) / (n + m + 1)
        step[k, : len(ROLES)] = np.log(1 - stay) + np.log(follow[r])
        step[k, len(ROLES) + r] = np.log(stay)
    return Model(start, step, emit)


def transfer(model: Model, emissions: np.ndarray, opening: bool) -> np.ndarray:
    """Best score from every state before a block to every state at its last line.

    For the block that opens a conversation the state before does not matter.
    """
    score = np.tile(model.start, (len(STATES), 1)) if opening else model.step.copy()
    score = score + emissions[0]
    for e in emissions[1:]:
        score = (score[:, :, None] + model.step[None]).max(1) + e
    return score


def path(model: Model, emissions: np.ndarray, before: int | None, last: int) -> list[int]:
    """The best states of a block, given the state before it (None at the start) and that of its last line."""
    score = (model.start if before is None else model.step[before]) + emissions[0]
    back = []
    for e in emissions[1:]:
        options = score[:, None] + model.step
        back.append(options.argmax(0))
        score = options.max(0) + e
    states = [last]
    for choice in reversed(back):
        states.append(int(choice[states[-1]]))
    return states[::-1]


def _groups(table: pa.Table, keys: tuple[str, ...], order: tuple[str, ...]) -> Iterator[pa.Table]:
    """Runs of equal keys of a table, each in order; nulls come first and are equal."""
    table = table.sort_by([(k, "ascending") for k in (*keys, *order)])
    columns = [table[k].to_pylist() for k in keys]
    at = 0
    for end in range(1, table.num_rows + 1):
        if end == table.num_rows or any(c[end] != c[at] for c in columns):
            yield table.slice(at, end - at)
            at = end


def _by_bucket(rows: DataFrame, keys: tuple[str, ...], n: int, schema: str, of: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """``of`` over groups of whole keys; several small ones share a task's group, none is split."""
    buckets = max(1, math.ceil(n / TASK_ROWS))
    return rows.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets))).groupBy("_bucket").applyInArrow(of, schema)


def parse(lines: DataFrame, model: Model, span: int = SPAN) -> DataFrame:
    """``conv_id, pos, body`` with ``role`` and ``starts`` of every line of (conv_id, pos, line).

    ``block`` and ``at`` give a line's place in its conversation, ``opened`` the turns that began in its
    block up to it.
    Lines are read in the order of ``pos``; rows with equal or null positions are ordered by their
    text, null positions first. A null conv_id is a conversation of its own.
    """
    block = F.coalesce(F.floor(F.col("pos") / span), F.lit(0)).cast("long")
    rows, n = materialize(featured(lines.select("conv_id", "pos", "line")).withColumn("block", block).drop("line"), "lines")
    order = ("pos", "body", *FEATURES)
    opening = rows.groupBy("conv_id").agg(F.min("block").alias("_opening"))
    conv_type = lines.schema["conv_id"].dataType.simpleString()

    def reduce_block(table: pa.Table) -> pa.Table:
        out = {"conv_id": [], "block": [], "matrix": []}
        for group in _groups(table, ("conv_id", "block"), order):
            first = group["block"][0].as_py() == group["_opening"][0].as_py()
            out["conv_id"].append(group["conv_id"][0].as_py())
            out["block"].append(group["block"][0].as_py())
            out["matrix"].append(transfer(model, model.emissions(group), first).ravel().tolist())
        return pa.table({"conv_id": pa.array(out["conv_id"], table.schema.field("conv_id").type), "block": pa.array(out["block"], pa.int64()), "matrix": pa.array(out["matrix"], pa.list_(pa.float64()))})

    def chain(table: pa.Table) -> pa.Table:
        out = {"conv_id": [], "block": [], "before": [], "last": []}
        for group in _groups(table, ("conv_id",), ("block",)):
            matrices = [np.array(m).reshape(len(STATES), -1) for m in group["matrix"].to_pylist()]
            score, back = matrices[0].max(0), []
            for m in matrices[1:]:
                options = score[:, None] + m
                back.append(options.argmax(0))
                score = options.max(0)
            ends = [int(score.argmax())]
            for choice in reversed(back):
                ends.append(int(choice[ends[-1]]))
            ends.reverse()
            out["conv_id"] += group["conv_id"].to_pylist()
            out["block"] += group["block"].to_pylist()
            out["before"] += [None, *ends[:-1]]
            out["last"] += ends
        return pa.table({"conv_id": pa.array(out["conv_id"], table.schema.field("conv_id").type), "block": pa.array(out["block"], pa.int64()), "before": pa.array(out["before"], pa.int32()), "last": pa.array(out["last"], pa.int32())})

    def decode(table: pa.Table) -> pa.Table:
        parts = []
        for group in _groups(table, ("conv_id", "block"), order):
            states = path(model, model.emissions(group), group["before"][0].as_py(), group["last"][0].as_py())
            found = group.select(["conv_id", "pos", "body"])
            found = found.append_column("role", pa.array([STATES[s][0] for s in states], pa.string()))
            starts = np.array([STATES[s][1] for s in states], bool)
            found = found.append_column("starts", pa.array(starts, pa.bool_())).append_column("block", group["block"])
            found = found.append_column("at", pa.array(np.arange(len(starts)), pa.int64()))
            parts.append(found.append_column("opened", pa.array(np.cumsum(starts), pa.int64())))
        return pa.concat_tables(parts)

    same = lambda a, b: a["conv_id"].eqNullSafe(b["_conv"])
    opening = opening.withColumnRenamed("conv_id", "_conv")
    opened = rows.join(opening, same(rows, opening)).drop("_conv")
    matrices, n_blocks = materialize(
        _by_bucket(opened, ("conv_id", "block"), n, f"conv_id {conv_type}, block long, matrix array<double>", reduce_block), "blocks"
    )
    ends = _by_bucket(matrices, ("conv_id",), n_blocks, f"conv_id {conv_type}, block long, before int, last int", chain)
    ends = ends.withColumnRenamed("conv_id", "_conv").withColumnRenamed("block", "_block")
    known = rows.join(ends, same(rows, ends) & (rows["block"] == ends["_block"])).drop("_conv", "_block")
    schema = f"conv_id {conv_type}, pos long, body string, role string, starts boolean, block long, at long, opened long"
    return _by_bucket(known, ("conv_id", "block"), n, schema, decode)


def recovered(lines: DataFrame) -> DataFrame:
    """The turns of parsed lines: (conv_id, turn, role, first_pos, n_lines, text).

    A turn goes from a line that starts one to the next such line; turns of a conversation are numbered
    from 0. Only the blocks of a conversation are numbered in one place, not its lines.
    """
    lines, _ = materialize(lines, "path")
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("conv_id", "block").agg(F.max("opened").alias("_n"))
    blocks = blocks.select(
        F.col("conv_id").alias("_conv"), F.col("block").alias("_block"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    placed = lines.join(blocks, lines["conv_id"].eqNullSafe(blocks["_conv"]) & (lines["block"] == blocks["_block"]))
    place = F.struct("block", "at")
    return (
        placed.withColumn("turn", F.col("_before") + F.col("opened") - 1)
        .groupBy("conv_id", "turn")
        .agg(
            F.min_by("role", place).alias("role"),
            F.min_by("pos", place).alias("first_pos"),
            F.count(F.lit(1)).alias("n_lines"),
            F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "body"))), lambda x: x["body"]).alias("_lines"),
        )
        .withColumn("text", F.array_join("_lines", "\n"))
        .drop("_lines")
    )


def rendered(role: Column, text: Column) -> Column:
    """One turn in canonical form."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("\n<|end|>"))


def labelled_turns(turns: DataFrame, lines: DataFrame) -> DataFrame:
    """What ``train`` counts, from (conv_id, turn, role) and featured lines with (conv_id, turn, k)."""
    f = F.struct(*FEATURES)
    per_turn = lines.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct("k", f.alias("f")))).alias("_l"))
    per_turn = per_turn.select("conv_id", "turn", F.transform("_l", lambda x: x["f"]).alias("_l"))
    return turns.select("conv_id", "turn", "role").join(per_turn, ["conv_id", "turn"]).select(
        "conv_id", "turn", "role", F.element_at("_l", 1).alias("first"), F.slice("_l", 2, F.size("_l")).alias("further")
    )


# The ways in which a transcript marks speakers (fixed values), by style.
STYLES = (
    {"system": "System: ", "user": "User: ", "assistant": "Assistant: "},
    {"system": "### Instructions: ", "user": "Human: ", "assistant": "AI: "},
    {"system": "[system] ", "user": "**You:** ", "assistant": "**Bot:** "},
    {"system": "<|system|> ", "user": "Q: ", "assistant": "A: "},
)


def transcripts(turns: DataFrame, missing: float = 0.25) -> DataFrame:
    """Raw transcript lines (conv_id, turn, k, line) of role-tagged turns (conv_id, turn, role, text).

    A conversation uses one style of markers, chosen by a hash; the marker of a ``missing`` share
    of the turns, chosen by a hash, is left out, as is that of a turn without a known role.
    """
    style = F.pmod(F.xxhash64(F.lit("style"), "conv_id"), F.lit(len(STYLES)))
    mark = F.lit("")
    for k, names in enumerate(STYLES):
        for role, name in names.items():
            mark = F.when((style == k) & (F.col("role") == role), F.lit(name)).otherwise(mark)
    left_out = F.pmod(F.xxhash64(F.lit("marker"), "conv_id", "turn"), F.lit(1000)) < int(1000 * missing)
    text = F.concat(F.when(left_out, F.lit("")).otherwise(mark), F.coalesce("text", F.lit("")))
    return turns.select("conv_id", "turn", "role", F.posexplode(F.split(text, "\n")).alias("k", "line"))
