import pytest
from pyspark.sql import functions as F

from canopy.operators import snapshots
from canopy.operators.tables import Key, TableDef
from canopy.sources.store import Store, allocate_tags
from canopy.streaming.load import file_stream, load_new_keys, load_snapshots, read_new_keys

NODES = TableDef.of("node_data", Key("tag:INTEGER"), Key("id:INTEGER"), "kind", "data")
PLAIN = TableDef.of("plain", Key("k:INTEGER"), "v")


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"), [NODES, PLAIN], fresh=True)


def nodes(spark, *names):
    return spark.createDataFrame([(i, "TypeSpec", n) for i, n in enumerate(names)], "id int, kind string, data string")


def test_insert_ignore_on_append(spark, rows, store):
    store.append("plain", spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string"))
    store.append("plain", spark.createDataFrame([(1, "c"), (2, "d")], "k int, v string"))
    assert rows(store.read("plain")) == [(1, "a"), (2, "d")]


def test_reopening_keeps_or_drops(spark, store):
    store.append("plain", spark.createDataFrame([(1, "a")], "k int, v string"))
    assert Store(spark, store.path, [NODES, PLAIN], must_exist=True).read("plain").count() == 1
    assert Store(spark, store.path, [NODES, PLAIN], fresh=True).read("plain").count() == 0
    with pytest.raises(FileNotFoundError):
        Store(spark, store.path + "-not-there", [PLAIN], must_exist=True)


def test_loading_a_commit_again_replaces_it(spark, rows, store):
    first = store.load("c1", {"node_data": nodes(spark, "A", "B")})
    other = store.load("c2", {"node_data": nodes(spark, "A")})
    for _ in range(2):
        again = store.load("c1", {"node_data": nodes(spark, "C")})
    assert first < other < again and store.tag_of("c1") == again
    assert rows(store.read("node_data"), "tag", "data") == [(other, "A"), (again, "C")]
    assert rows(store.tags(), "commit_id") == [("c1",), ("c2",)]


def test_loading_an_empty_snapshot_leaves_nothing_behind(spark, store):
    store.load("c1", {"node_data": nodes(spark, "A")})
    store.load("c1", {"node_data": nodes(spark, "A").where("false")})
    assert store.read("node_data").count() == 0 and store.tag_of("c1") == 2


def test_removed_tags_are_not_used_again(spark, store):
    store.load("c1", {"node_data": nodes(spark, "A")})
    assert store.remove_commit("c1") == [1]
    assert store.read("node_data").count() == 0 and store.tags().count() == 0
    with pytest.raises(LookupError):
        store.tag_of("c1")
    assert store.load("c1", {"node_data": nodes(spark, "A")}) == 2


def test_many_commits_at_once(spark, rows, store):
    data = nodes(spark, "A").withColumn("commit_id", F.explode(F.array(F.lit("x"), F.lit("y"))))
    tags = store.load_many(["x", "y"], {"node_data": data})
    assert rows(store.read("node_data"), "tag") == sorted((t,) for t in tags.values())
    with pytest.raises(ValueError):
        store.load_many(["x", "y"], {"node_data": nodes(spark, "A")})


def test_reading_one_tag_prunes_partitions(spark, store):
    store.load("c1", {"node_data": nodes(spark, "A")})
    plan = store.read("node_data").where(F.col("tag") == 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tag" in plan


def test_sql_with_marks(spark, rows, store):
    store.append("plain", spark.createDataFrame([(i, f"v{i}") for i in range(9)], "k int, v string"))
    got = store.query("SELECT k FROM plain WHERE k IN (?, ?, ?) AND v <> '?' AND k > ? OR v ILIKE ?", 1, 2, 3, 1.5, "V8")
    assert rows(got) == [(2,), (3,), (8,)]
    assert store.query("SELECT '?' AS q FROM plain").count() == 9
    with pytest.raises(ValueError):
        store.query("SELECT * FROM plain WHERE k = ?")


def test_allocate_tags(spark, rows):
    none = spark.createDataFrame([], "tag bigint, commit_id string")
    commits = spark.createDataFrame([("b",), ("a",), ("b",)], "commit_id string")
    old = allocate_tags(none, commits)
    assert rows(old) == [(1, "a"), (2, "b")]
    assert rows(allocate_tags(old, commits.union(spark.createDataFrame([("0",)], "c string")))) == [(3, "0")]


def test_diff(spark, rows):
    before = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "d")], "k int, v string")
    after = spark.createDataFrame([(2, "b"), (3, None), (4, "e"), (5, "f")], "k int, v string")
    assert rows(snapshots.diff(before, after, ["k"])) == [(1, "removed"), (4, "changed"), (5, "added")]
    assert rows(snapshots.diff(before, after, ["k"], keep_common=True)) == [
        (1, "removed"), (2, "common"), (3, "common"), (4, "changed"), (5, "added"),
    ]


def test_listings_look_at_one_tag(spark, rows):
    decls = spark.createDataFrame(
        [(1, "b", None), (1, "a", None), (1, "m", "T"), (2, "z", None)], "tag int, name string, receiver string"
    )
    assert rows(snapshots.list_functions(decls, 1)) == [(1, "a"), (2, "b")]
    assert rows(snapshots.list_methods(decls, 1)) == [(1, "T", "m")]
    types = spark.createDataFrame([(1, "TypeSpec", "B"), (1, "TypeSpec", "A"), (1, "Ident", "i")], "tag int, kind string, data string")
    assert rows(snapshots.list_types(types, 1)) == [(1, "A"), (2, "B")]


def test_like_join_keeps_tags_apart(spark, rows):
    functions = spark.createDataFrame([(1, "getObject", "f", 10), (2, "OBJECTS", "f", 10)], "tag int, name string, type string, block_id int")
    links = spark.createDataFrame([(1, 10, 1, 11), (2, 10, 1, 12)], "tag int, id int, link_number int, link_id int")
    kinds = spark.createDataFrame([(1, 11, "If"), (2, 12, "For"), (2, 11, "Go")], "tag int, id int, kind string")
    got = rows(snapshots.functions_like(functions, links, kinds, "%object%"))
    assert got == [("OBJECTS", "f", 1, "For"), ("getObject", "f", 1, "If")]


def test_a_failed_load_is_never_seen_and_its_tag_not_used_again(spark, rows, store):
    good = nodes(spark, "A")
    broken = good.withColumn("data", F.raise_error(F.lit("stop")).cast("string"))
    store.load("c0", {"node_data": good})
    # The data of the first table is written before the second fails.
    with pytest.raises(Exception):
        store.load("c1", {"node_data": good, "plain": broken})
    assert rows(store.read("node_data"), "tag") == [(1,)] and store.query("SELECT * FROM node_data").count() == 1
    assert store.load("c2", {"node_data": good.where("false")}) == 3
    assert rows(store.read("node_data"), "tag") == [(1,)]
    assert rows(store.tags(), "commit_id") == [("c0",), ("c2",)]


def test_diff_of_commits(spark, rows, store):
    store.load("c1", {"node_data": nodes(spark, "A", "B")})
    store.load("c2", {"node_data": nodes(spark, "A", "C", "D")})
    assert rows(snapshots.diff_commits(store, "node_data", "c1", "c2", ["id"])) == [(1, "changed"), (2, "added")]


def write_file(spark, folder, name, data):
    path = str(folder / f"tmp-{name}")
    spark.createDataFrame(data, "id int, kind string, data string").coalesce(1).write.parquet(path)
    import glob
    import shutil

    shutil.copy(glob.glob(f"{path}/*.parquet")[0], str(folder / "in" / f"{name}.parquet"))


def test_stream_of_snapshots_equals_batch_and_goes_on(spark, rows, store, tmp_path):
    (tmp_path / "in").mkdir()
    write_file(spark, tmp_path, "one", [(1, "TypeSpec", "A")])
    write_file(spark, tmp_path, "two", [(1, "TypeSpec", "B"), (2, "TypeSpec", "C")])

    def run():
        load_snapshots(
            file_stream(spark, str(tmp_path / "in"), "id int, kind string, data string"),
            store,
            lambda df: {"node_data": df},
            str(tmp_path / "checkpoint"),
        )

    run()
    run()  # nothing new
    assert rows(store.read("node_data"), "data") == [("A",), ("B",), ("C",)]
    write_file(spark, tmp_path, "three", [(9, "TypeSpec", "D")])
    run()
    names = sorted(c.rsplit("/", 1)[1] for (c,) in rows(store.tags(), "commit_id"))
    assert names == ["one.parquet", "three.parquet", "two.parquet"]
    assert store.read("node_data").count() == 4


def test_files_of_equal_name_in_two_folders_are_two_commits(spark, rows, store, tmp_path):
    for n in ("x", "y"):
        (tmp_path / n / "in").mkdir(parents=True)
        write_file(spark, tmp_path / n, "part", [(1, "TypeSpec", n)])
    stream = file_stream(spark, str(tmp_path / "*" / "in"), "id int, kind string, data string")
    load_snapshots(stream, store, lambda df: {"node_data": df}, str(tmp_path / "checkpoint"))
    assert rows(store.read("node_data"), "data") == [("x",), ("y",)]


def test_stream_insert_ignore_across_batches(spark, rows, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "id int, kind string, data string"

    def run():
        stream = file_stream(spark, str(tmp_path / "in"), schema, max_files=1)
        load_new_keys(stream, str(tmp_path / "out"), ["id"], str(tmp_path / "checkpoint"), ["data"])
        return rows(read_new_keys(spark, str(tmp_path / "out"), stream.schema), "id", "data")

    write_file(spark, tmp_path, "one", [(1, "k", "b"), (1, "k", "a"), (2, "k", "c")])
    assert run() == [(1, "a"), (2, "c")]
    write_file(spark, tmp_path, "two", [(1, "k", "0"), (3, "k", "d")])
    assert run() == [(1, "a"), (2, "c"), (3, "d")]
