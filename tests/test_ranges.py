"""Snapshots laid out in ranges: differences found by digests."""

import os
import random

import pytest
from pyspark.sql import functions as F

from canopy.operators import snapshots
from canopy.operators.tables import Key, TableDef
from canopy.sources.ranges import Ranges, differing, digest_table
from canopy.sources.store import Store

ITEMS = TableDef.of("items", Key("tag:INTEGER"), Key("id:INTEGER"), Key("part"), "a", "b")
SCHEMA = "id long, part string, a string, b string"


def brute(before, after):
    b, a = ({r[:2]: r[2:] for r in side} for side in (before, after))
    status = {k: "added" if k not in b else "removed" if k not in a else "changed" for k in b.keys() | a.keys() if b.get(k, 0) != a.get(k, 0)}
    return sorted((*k, s) for k, s in status.items())


def found(store, first="x", second="y"):
    return sorted(tuple(r) for r in snapshots.diff_commits(store, "items", first, second, ["id", "part"]).collect())


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"), [ITEMS], fresh=True, ranged={"items": Ranges(3, 8)})


def load(spark, store, commit, rows):
    return store.load(commit, {"items": spark.createDataFrame(rows, SCHEMA)})




def test_one_changed_row_reads_one_range(spark, store):
    rows = [(i, "p", f"a{i}", None) for i in range(4_000)]
    load(spark, store, "x", rows)
    load(spark, store, "y", [(i, p, "new" if i == 1234 else a, b) for i, p, a, b in rows])
    folders, leaves = differing(store._stored(digest_table("items").name), [store.tag_of("x"), store.tag_of("y")], Ranges(3, 8))
    assert len(folders) == 1 and leaves.count() == 1
    before, after = store.changed("items", "x", "y")
    assert 0 < before.count() == after.count() < 60
    text = before._jdf.queryExecution().executedPlan().toString()
    assert "_range" in text.split("PartitionFilters: [")[1].split("]")[0]
    # Unreadable files in all other ranges: the difference is found without them.
    broken = 0
    for folder, _, names in os.walk(store._folder("items")):
        if "_range=" in folder and not folder.endswith(f"_range={folders[0]}"):
            for name in names:
                if name.endswith(".parquet"):
                    crc = os.path.join(folder, f".{name}.crc")
                    if os.path.exists(crc):
                        os.remove(crc)
                    open(os.path.join(folder, name), "w").write("no parquet")
                    broken += 1
    assert broken >= 14
    assert found(store) == [(1234, "p", "changed")]


def test_random_snapshots_equal_brute_force(spark, store):
    rng = random.Random(6)
    before = [(i, rng.choice("pq"), rng.choice([None, "", "u", "v"]), rng.choice([None, "", "u", "v"])) for i in range(600)]
    after = [r for r in before if rng.random() > 0.02]
    after = [(i, p, b, a) if rng.random() < 0.05 else (i, p, a, b) for i, p, a, b in after]  # columns swapped: nulls move
    after += [(i, "n", "new", None) for i in range(1_000, 1_010)]
    load(spark, store, "x", before)
    load(spark, store, "y", after)
    assert found(store) == brute(before, after)
    assert found(store, "x", "x") == [] and found(store, "y", "x") == brute(after, before)


def test_empty_snapshots(spark, store):
    rows = [(1, "p", "a", "b"), (2, "p", "a", "b")]
    for commit, of in (("x", []), ("y", rows), ("z", [])):
        load(spark, store, commit, of)
    assert found(store) == [(1, "p", "added"), (2, "p", "added")]
    assert found(store, "y", "z") == [(1, "p", "removed"), (2, "p", "removed")]
    assert found(store, "x", "z") == []


def test_appended_and_replaced_rows_count(spark, store):
    rows = [(i, "p", "a", None) for i in range(50)]
    load(spark, store, "x", rows)
    tag = load(spark, store, "y", rows)
    more = spark.createDataFrame([(tag, 7, "p", "ignored", None), (tag, 77, "p", "more", None)], "tag long, " + SCHEMA)
    store.append("items", more)
    assert found(store) == [(77, "p", "added")]
    load(spark, store, "y", rows[1:])
    assert found(store) == [(0, "p", "removed")]
    store.remove_commit("x")
    assert store._stored(digest_table("items").name).select("tag").distinct().count() == 1


def test_a_tag_without_digests_is_compared_as_a_whole(spark, store):
    from canopy.session import delete_path

    load(spark, store, "x", [(1, "p", "a", None)])
    tag = load(spark, store, "y", [(1, "p", "b", None)])
    delete_path(spark, store._folder(digest_table("items").name, tag))
    assert differing(store._stored(digest_table("items").name), [tag - 1, tag], Ranges(3, 8)) is None
    assert found(store) == [(1, "p", "changed")]


def test_ranges_need_keys(spark, tmp_path):
    with pytest.raises(ValueError):
        Store(spark, str(tmp_path / "s"), [TableDef.of("t", Key("tag:INTEGER"), "a")], ranged={"t": Ranges()})
    with pytest.raises(ValueError):
        Ranges(5, 4)


def test_other_stores_are_compared_as_before(spark, tmp_path):
    store = Store(spark, str(tmp_path / "plain"), [ITEMS], fresh=True)
    load(spark, store, "x", [(1, "p", "a", None), (2, "p", "a", None)])
    load(spark, store, "y", [(1, "p", "a", "b")])
    assert found(store) == [(1, "p", "changed"), (2, "p", "removed")]
    assert store.read("items").where(F.col("id") == 1).count() == 2
