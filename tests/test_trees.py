import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from canopy.operators import hierarchy, shred, tree
from canopy.sources import markup

SCHEMA = "id int, name string, meta struct<note:string>, children array<struct<name:string,children:array<struct<name:string>>>>"
DATA = [
    (1, "r1", ("n",), [("a", [("x",), ("y",)]), ("b", []), ("c", None)]),
    (2, "r2", None, []),
    (3, None, ("m",), None),
]


@pytest.fixture
def shredded(spark):
    df = spark.createDataFrame(DATA, SCHEMA)
    shape = shred.Node(
        "Root",
        data="name",
        links={"meta": shred.Node("Meta", data="note")},
        lists={"children": shred.Node("Child", data="name", lists={"children": shred.Node("Leaf", data="name")})},
    )
    return shred.shred(df, shape, F.col("id"))


def test_nodes(rows, shredded):
    got = rows(shred.nodes(shredded), "id", "kind", "data")
    assert got == [
        ("1", "Root", "r1"), ("1/children[1]", "Child", "a"), ("1/children[1]/children[1]", "Leaf", "x"),
        ("1/children[1]/children[2]", "Leaf", "y"), ("1/children[2]", "Child", "b"), ("1/children[3]", "Child", "c"),
        ("1/meta", "Meta", "n"), ("2", "Root", "r2"), ("3", "Root", None), ("3/meta", "Meta", "m"),
    ]


def test_links_number_lists_from_one_and_keep_missing_children(rows, shredded):
    got = rows(shred.links(shredded))
    assert ("1", "children", 3, "1/children[3]") in got
    assert ("1", "meta", None, "1/meta") in got and ("2", "meta", None, None) in got
    assert len(got) == 3 + 3 + 2


def test_ids_do_not_depend_on_the_run(rows, shredded):
    once, twice = (shred.nodes(shredded.repartition(n), ids=True) for n in (1, 5))
    assert rows(once) == rows(twice)
    shred.check_ids(once)
    with pytest.raises(ValueError):
        shred.check_ids(once.unionByName(once.limit(1)))
    ids = shred.links(shredded, ids=True)
    assert ids.join(once, ids.link_id == once.id, "left_anti").where("link_id IS NOT NULL").count() == 0


def test_shape_from_a_schema(spark, rows):
    df = spark.createDataFrame(DATA, SCHEMA)
    shape = shred.Node.infer(df.schema, "Root", data="name")
    got = rows(tree.kind_census(shred.nodes(shred.shred(df, shape, F.col("id")))))
    assert got == [("Root", 3), ("children", 5), ("meta", 2)]


def test_shred_then_reassemble_gives_the_input_back(spark, shredded):
    nodes, links = shred.nodes(shredded), shred.links(shredded)
    for chunk in (1000, 1, 2):
        held = {}
        for r in sorted(tree.reassemble(nodes, links, chunk=chunk).collect(), key=lambda r: (r["id"], r["part"])):
            held.setdefault(r["id"], (r["data"], []))[1].extend((c["label"], c["link_id"]) for c in r["children"] or [])

        def build(i):
            data, kids = held[i]
            return data, [build(k) for lab, k in kids if lab == "children"]

        def given(name, kids):
            return name, [given(k[0], k[1] if len(k) > 1 else None) for k in kids or []]

        assert [build(str(r[0])) for r in DATA] == [given(r[1], r[3]) for r in DATA]


def test_leaves_are_kept_unless_told_otherwise(rows, shredded):
    nodes, links = shred.nodes(shredded), shred.links(shredded).where("link_id IS NOT NULL")
    assert tree.reassemble(nodes, links, keep_leaves=False).select("id").distinct().count() == 3
    assert tree.reassemble(nodes, links).count() == 10
    assert tree.children(nodes, links, keep_leaves=False).count() == links.count()
    assert tree.children(nodes, links).select("id").distinct().count() == 10
    counts = dict(rows(tree.child_summary(nodes, links), "id", "n_children"))
    assert counts["1"] == 4 and counts["2"] == 0


def test_list_entries(rows, shredded):
    got = rows(tree.entries(shred.links(shredded), "children").where(F.col("id") == "1"))
    assert got == [("1", i, f"1/children[{i}]") for i in (1, 2, 3)]


def test_member_over_links(spark, rows, shredded):
    got = rows(tree.member(shred.nodes(shredded), shred.links(shredded), ["meta"]).where("length(id) = 1"))
    assert got == [("1", "1/meta", "Meta", "n"), ("2", None, None, None), ("3", "3/meta", "Meta", "m")]


def test_root_decls(spark, rows):
    nodes = spark.createDataFrame(
        [("f", "File", None), ("g", "GenDecl", None), ("t", "TypeSpec", "T"), ("d", "FuncDecl", "F"), ("c", "Comment", None)],
        "id string, kind string, data string",
    )
    links = spark.createDataFrame([("f", "g"), ("g", "t"), ("f", "d"), ("f", "c")], "id string, link_id string")
    assert rows(tree.root_decls(nodes, links, "File", "GenDecl")) == [("f", "d", "FuncDecl", "F"), ("f", "t", "TypeSpec", "T")]


def test_wide_tables(spark, rows):
    links = spark.createDataFrame([(1, "X", 5), (1, "Y", 6), (2, "X", 7), (2, "X", 3)], "id int, label string, link_id int")
    assert rows(tree.wide(links, ["id"], ["X", "Y"])) == [(1, 5, 6), (2, 3, None)]


@pytest.fixture
def functions(spark):
    decls = spark.createDataFrame(
        [(1, 100, "f", 10), (2, 100, "f", 10), (1, 101, "g", 20)], "tag long, id long, name string, block_id long"
    ).selectExpr("tag", "id", "concat('x:', id, ':1') AS location", "'' AS end_location", "name", "'func()' AS type", "block_id")
    nodes = spark.createDataFrame(
        [(1, 11, "If", None), (1, 12, "Ident", "a"), (2, 11, "For", None), (1, 21, "Go", None)],
        "tag long, id long, kind string, data string",
    ).selectExpr("tag", "id", "kind", "data", "concat('x:', id, ':2') AS location", "'' AS end_location", "'' AS type")
    links = spark.createDataFrame(
        [(1, 10, "List", 1, 11), (1, 11, "Cond", None, 12), (2, 10, "List", 1, 11), (1, 20, "List", 1, 21)],
        "tag long, id long, label string, link_number long, link_id long",
    )
    return decls, nodes, links


def test_function_subtrees(rows, functions):
    got = rows(tree.function_subtree(*functions, F.col("name") == "f"), "tag", "kind", "depth")
    assert got == [(1, "FuncDecl", 0), (1, "Ident", 2), (1, "If", 1), (2, "For", 1), (2, "FuncDecl", 0)]
    inner = rows(tree.function_subtree(*functions, F.col("name") == "f", keep_leaves=False), "tag", "kind", "depth")
    assert inner == [(1, "FuncDecl", 0), (1, "If", 1), (2, "FuncDecl", 0)]


def test_functions_as_nodes_and_links(rows, functions):
    decls, nodes, links = functions
    more_nodes, more_links = tree.function_rows(decls, links)
    assert nodes.unionByName(more_nodes).count() == 7
    whole = tree.children(
        nodes.unionByName(more_nodes).where("tag = 1").drop("tag"), links.unionByName(more_links).where("tag = 1").drop("tag")
    )
    assert rows(whole.where("kind = 'FuncDecl'"), "data", "link_id", "child_kind") == [("f", 11, "If"), ("g", 21, "Go")]


def test_hierarchy_links_are_numbered_by_parent(spark, rows):
    top = spark.createDataFrame([("a",), ("b",)], "k string")
    low = spark.createDataFrame([("z", "a", 2), ("y", "a", 1), ("x", "b", 9)], "k string, p string, o int")
    levels = [
        hierarchy.Level("Top", top, F.col("k"), F.col("k")),
        hierarchy.Level("Low", low, F.col("k"), F.col("k"), F.col("p"), "low", F.col("o")),
    ]
    assert rows(hierarchy.links(levels)) == [("a", "low", 1, "y"), ("a", "low", 2, "z"), ("b", "low", 1, "x")]
    assert hierarchy.nodes(levels).count() == 5


PAGE = "<html><body>\n<p>one<br>two</p><img src='a'/></b></body></html>"


def test_html_tree():
    got = [(n[1], n[2], n[3], n[4], n[5]) for n in markup.html_tree(PAGE)]
    assert got == [
        (None, None, "html", None, 0), (0, 1, "body", None, 1), (1, 1, "p", None, 2), (2, 1, "#text", "one", 3),
        (2, 2, "br", None, 3), (2, 3, "#text", "two", 3), (1, 2, "img", None, 2),
    ]
    assert markup.html_tree(PAGE)[2][6:] == (2, 1)


def test_bad_texts_go_to_quarantine(spark, rows):
    def builder(t):
        if "bad" in t:
            raise ValueError("no tree")
        return markup.html_tree(t)

    df = spark.createDataFrame([(1, PAGE), (2, "bad"), (3, None)], "k long, t string").repartition(1)
    trees = markup.parse_trees(df, "k", "t", builder, batch=2)
    assert rows(markup.quarantine(trees, "k"), "k") == [(2,), (3,)]
    assert markup.tree_nodes(trees, "k").count() == 7
    links = markup.tree_links(trees, "k")
    assert rows(links.where(F.col("id") == "1/2"), "link_number", "link_id") == [(1, "1/3"), (2, "1/4"), (3, "1/5")]


def test_workers_need_no_copy_of_the_package(tmp_path):
    """Run where the package is on the driver's path only."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = f"""
import sys
sys.path.insert(0, {root!r})
from canopy.session import local_session
from canopy.sources import markup
spark = local_session("elsewhere", 1, "1g")
df = spark.createDataFrame([(1, "<p>a<br>b</p>")], "k long, t string")
print("nodes", markup.tree_nodes(markup.parse_trees(df, "k", "t"), "k").count())
"""
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True, timeout=180)
    assert "nodes 4" in done.stdout, done.stderr[-2000:]


def test_html_links_against_brute_force(spark, rows):
    """The registered links query has no SQL counterpart: compare with parsing in plain Python."""
    pages = [(i, "<div>" * (i % 5) + f"<p>t{i}</p>" * (i % 4) + "<br>" * (i % 3)) for i in range(40)]
    trees = markup.parse_trees(spark.createDataFrame(pages, "k long, t string").repartition(6), "k", "t")
    want = sorted(
        (f"{k}/{n[1]}", "children", n[2], f"{k}/{n[0]}", n[5]) for k, t in pages for n in markup.html_tree(t) if n[1] is not None
    )
    assert sorted(rows(markup.tree_links(trees, "k"))) == want


def test_documents_are_dealt_out_by_size(spark, tmp_path):
    """The number of tasks follows the bytes read, not the number of cores."""
    from canopy.session import spread_by_size

    rows = spark.range(20_000).selectExpr("id AS doc_id", "sha2(cast(id AS string), 256) AS text")
    rows.coalesce(1).write.parquet(str(tmp_path / "documents"))
    scan = spark.read.parquet(str(tmp_path / "documents"))
    cores = spark.sparkContext.defaultParallelism
    bytes_read = int(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    made = spread_by_size(scan, bytes_read // (3 * cores))
    assert made.rdd.getNumPartitions() >= 3 * cores and made.count() == 20_000
    assert spread_by_size(scan).rdd.getNumPartitions() <= cores


def test_nodes_and_links_meet_where_the_documents_are_shredded(spark, rows, tmp_path):
    """Ids are made once, and the result comes from what was joined then."""
    from canopy.plans.trees import hashed_ids

    texts = [(1, "a b\n\nc", "en", "s"), (2, None, "en", ""), (3, "", None, None), (None, "x y", "en", "s"), (5, "d  e d", "de", "t")]
    documents = spark.createDataFrame([(*t, 0) for t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    got = hashed_ids(spark, str(tmp_path))
    assert got.columns == ["doc", "kind", "n", "children", "different_children"]
    want = []
    for i, text, *_ in texts:
        if i is None:
            continue
        lines = [] if text is None else [[w for w in line.split(" ") if w] for line in text.split("\n")]
        kinds = {"Document": [1 + len(lines)], "Origin": [0], "Line": [len(ws) for ws in lines], "Word": [0 for ws in lines for _ in ws]}
        want += [(f"D{i}", k, sum(max(1, c) for c in cs), sum(cs), sum(cs)) for k, cs in kinds.items() if cs]
    assert rows(got) == sorted(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan
    documents.unionByName(documents.where("doc_id = 5")).write.parquet(str(tmp_path / "twice" / "documents.parquet"))
    with pytest.raises(ValueError):
        hashed_ids(spark, str(tmp_path / "twice"))


def test_joined_nodes_keep_links_that_lead_nowhere(spark, rows, shredded):
    joined = shred.joined(shredded.withColumn("root", F.substring_index(F.coalesce("path", "parent"), "/", 1)), ["root"])
    nodes, links = shred.nodes(shredded, ids=True).select("id", "kind"), shred.links(shredded, ids=True).select("id", "link_id")
    want = nodes.join(links.withColumn("_l", F.lit(1)), "id", "left").groupBy("id", "kind").agg(
        F.lit(1).alias("n_nodes"), F.count("_l").alias("n_links"), F.count("link_id").alias("children"), F.count_distinct("link_id").alias("different")
    )
    assert rows(joined.drop("root")) == rows(want)
    shred.check_ids(joined, joined.count())
    with pytest.raises(ValueError):
        shred.check_ids(joined.unionByName(joined.limit(1)), 99)
