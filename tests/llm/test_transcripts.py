import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopy.llm import transcripts

TURNS = "conv_id long, turn long, role string, text string"


def conversations(n=120):
    rng = random.Random(4)
    rows = []
    for c in range(n):
        turn = 0
        if rng.random() < 0.3:
            rows.append((c, turn, "system", "You answer briefly."))
            turn += 1
        for k in range(rng.randint(2, 8)):
            role = ("user", "assistant")[k % 2]
            text = "What is it then?" if role == "user" else "It is " + "so " * rng.randint(5, 60) + "\nand more."
            rows.append((c, turn, role, text))
            turn += 1
    return rows


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame(conversations(), TURNS)


@pytest.fixture(scope="module")
def model(spark, turns):
    lines = transcripts.transcripts(turns)
    return transcripts.train(transcripts.labelled_turns(turns, transcripts.featured(lines)))


def numbered(turns):
    return transcripts.transcripts(turns).select("conv_id", (F.col("turn") * (1 << 20) + F.col("k")).alias("pos"), "line", "role", "turn", "k")


def test_roles_are_recovered(spark, turns, model):
    lines = numbered(turns)
    truth = {(r.conv_id, r.pos): r.role for r in lines.collect()}
    got = transcripts.parse(lines, model).collect()
    assert len(got) == len(truth)
    assert sum(truth[r.conv_id, r.pos] == r.role for r in got) >= 0.95 * len(truth)


def best_by_enumeration(model, emissions):
    """Viterbi over the whole sequence, without blocks."""
    return transcripts.path(model, emissions, None, int(transcripts.transfer(model, emissions, True).max(0).argmax()))


def test_blocks_give_the_path_of_the_whole(spark, turns, model):
    lines = numbered(turns).withColumn("conv_id", F.lit(1).cast("long")).withColumn("pos", F.monotonically_increasing_id())
    lines = spark.createDataFrame(lines.select("conv_id", "pos", "line").collect(), "conv_id long, pos long, line string")
    whole = sorted((r.pos, r.role, r.starts) for r in transcripts.parse(lines, model, span=1 << 62).collect())
    blocks = sorted((r.pos, r.role, r.starts) for r in transcripts.parse(lines, model, span=7).collect())
    assert whole == blocks


def test_transfer_agrees_with_enumeration(model):
    rng = np.random.default_rng(2)
    k = len(transcripts.STATES)
    emissions = rng.standard_normal((4, k))
    best = max(
        ((model.start[a] + emissions[0, a] + model.step[a, b] + emissions[1, b] + model.step[b, c] + emissions[2, c] + model.step[c, d] + emissions[3, d]), (a, b, c, d))
        for a in range(k) for b in range(k) for c in range(k) for d in range(k)
    )
    assert tuple(best_by_enumeration(model, emissions)) == best[1]


def test_odd_rows(spark, model):
    rows = [(None, None, "x", None), (None, 1, "User: hi", None), (1, 5, None, None), (1, 5, "", None), (1, 5, "", None), (2, 0, "Assistant: " + "long " * 50_000, None)]
    df = spark.createDataFrame(rows, "conv_id long, pos long, line string, role string").withColumn("block", F.lit("b"))
    got = transcripts.parse(df, model).collect()
    assert len(got) == len(rows)
    assert all(r.role in transcripts.ROLES for r in got)
    assert {r.body for r in got if r.conv_id == 1} == {""}
    assert transcripts.parse(df.limit(0), model).count() == 0


def test_training_without_labels_gives_a_model(spark):
    turns = spark.createDataFrame([(1, 0, None, "x"), (1, 1, "narrator", "y")], TURNS)
    lines = transcripts.transcripts(turns)
    model = transcripts.train(transcripts.labelled_turns(turns, transcripts.featured(lines)))
    assert transcripts.parse(numbered(turns), model).count() == 2


def test_canonical_form(spark):
    row = spark.range(1).select(transcripts.rendered(F.lit("user"), F.lit("a\nb")).alias("t")).first()
    assert row.t == "<|user|>\na\nb\n<|end|>"


def test_turns_follow_the_path(spark, turns, model):
    """Turns equal those cut by hand out of the path, whatever the size of the blocks."""
    path = {}
    for r in sorted(transcripts.parse(numbered(turns), model, span=1 << 62).collect(), key=lambda r: (r.conv_id, r.pos)):
        of = path.setdefault(r.conv_id, [])
        if r.starts:
            of.append([r.role, r.pos, []])
        of[-1][2].append(r.body)
    expected = sorted((c, k, role, pos, len(b), "\n".join(b)) for c, of in path.items() for k, (role, pos, b) in enumerate(of))
    for span in (1 << 62, 3 << 20):
        found = transcripts.recovered(transcripts.parse(numbered(turns), model, span=span))
        assert sorted(tuple(r) for r in found.select("conv_id", "turn", "role", "first_pos", "n_lines", "text").collect()) == expected


def test_turns_begin_where_the_given_ones_do(spark, turns, model):
    """The given turns judge the segmentation; the model sees lines and their order only."""
    found = transcripts.recovered(transcripts.parse(numbered(turns), model)).select("conv_id", "first_pos").collect()
    begins = {(r.conv_id, r.first_pos) for r in found}
    truth = {(r.conv_id, r.pos) for r in numbered(turns).where("k = 0").collect()}
    right = len(begins & truth)
    assert right >= 0.95 * len(begins) and right >= 0.95 * len(truth)


def test_turns_of_odd_rows(spark, model):
    rows = [(None, None, "x"), (None, 1, "User: hi"), (1, 5, None), (1, 5, ""), (1, 5, ""), (2, 0, "Assistant: " + "long " * 50_000)]
    df = spark.createDataFrame(rows, "conv_id long, pos long, line string")
    got = transcripts.recovered(transcripts.parse(df, model)).collect()
    assert sum(r.n_lines for r in got) == len(rows)
    assert {r.conv_id for r in got} == {None, 1, 2}
    assert [r.turn for r in sorted(got, key=lambda r: r.turn) if r.conv_id == 2] == [0]
    assert transcripts.recovered(transcripts.parse(df.limit(0), model)).count() == 0
