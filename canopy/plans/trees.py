"""Shredding, reassembly and walks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.operators import closure, hierarchy, shred, tree
from canopy.plans.bindings import table, tree as tree_levels
from canopy.plans.registry import query
from canopy.session import materialize, spread, spread_by_size
from canopy.sources import markup

# A document holds its origin (single child) and its lines, a line holds its words.
DOCUMENT = shred.Node(
    "Document",
    data="lang",
    links={"origin": shred.Node("Origin", data="source")},
    lists={"lines": shred.Node("Line", data="text", lists={"words": shred.Node("Word", data=".")})},
)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return _shredded(spread_by_size(documents))


def _shredded(documents: DataFrame, **more) -> DataFrame:
    def line(text):
        words = F.filter(F.split(text, " "), lambda w: w != "")
        return F.struct(text.alias("text"), words.alias("words"))

    nested = documents.select(
        "doc_id",
        "lang",
        F.struct(F.nullif("source", F.lit("")).alias("source")).alias("origin"),
        F.transform(F.split("text", "\n"), line).alias("lines"),
    )
    return shred.shred(nested, DOCUMENT, F.concat(F.lit("D"), "doc_id"), **more)


_DOC_NODES = r"""
WITH d AS (SELECT 'D' || doc_id AS id, lang, nullif(source, '') AS source, string_split(text, chr(10)) AS lines FROM documents),
 l AS (SELECT id AS parent, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line FROM d),
 ln AS (SELECT parent, i, parent || '/lines[' || i || ']' AS id, line,
               list_filter(string_split(line, ' '), lambda w: w <> '') AS words FROM l),
 w AS (SELECT id AS parent, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS word FROM ln),
 nodes AS (
  SELECT id, 'Document' AS kind, lang AS data, split_part(id, '/', 1) AS doc FROM d
  UNION ALL SELECT id || '/origin', 'Origin', source, id FROM d
  UNION ALL SELECT id, 'Line', line, parent FROM ln
  UNION ALL SELECT parent || '/words[' || i || ']', 'Word', word, split_part(parent, '/', 1) FROM w),
 links AS (
  SELECT id, 'origin' AS label, CAST(NULL AS BIGINT) AS link_number, id || '/origin' AS link_id, id AS doc FROM d
  UNION ALL SELECT parent, 'lines', i, id, parent FROM ln
  UNION ALL SELECT parent, 'words', i, parent || '/words[' || i || ']', split_part(parent, '/', 1) FROM w)
"""


@query(
    _DOC_NODES
    + """SELECT doc, kind, count(*) AS n, count(data) AS with_data, CAST(sum(length(data)) AS BIGINT) AS chars,
  min(id) AS first_id, max(id) AS last_id, min(data) AS least, max(data) AS greatest
FROM nodes GROUP BY doc, kind"""
)
def tree_shred_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = shred.nodes(_documents(spark, sf_dir))
    return nodes.groupBy(F.substring_index("id", "/", 1).alias("doc"), "kind").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("data").alias("with_data"),
        F.sum(F.char_length("data")).cast("bigint").alias("chars"),
        F.min("id").alias("first_id"),
        F.max("id").alias("last_id"),
        F.min("data").alias("least"),
        F.max("data").alias("greatest"),
    )


@query(
    _DOC_NODES
    + """SELECT doc, label, count(*) AS n, count(link_number) AS numbered, max(link_number) AS last_number,
  CAST(sum(link_number) AS BIGINT) AS numbers, min(id) AS least_parent, min(link_id) AS least_child, max(link_id) AS greatest_child
FROM links GROUP BY doc, label"""
)
def tree_shred_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = shred.links(_documents(spark, sf_dir))
    return links.groupBy(F.substring_index("id", "/", 1).alias("doc"), "label").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("link_number").alias("numbered"),
        F.max("link_number").alias("last_number"),
        F.sum("link_number").cast("bigint").alias("numbers"),
        F.min("id").alias("least_parent"),
        F.min("link_id").alias("least_child"),
        F.max("link_id").alias("greatest_child"),
    )


_TREE = """
WITH nodes AS (
  SELECT 'R' || r_regionkey AS id, 'Region' AS kind, r_name AS data FROM region
  UNION ALL SELECT 'N' || n_nationkey, 'Nation', n_name FROM nation
  UNION ALL SELECT 'C' || c_custkey, 'Customer', c_name FROM customer
  UNION ALL SELECT 'O' || o_orderkey, 'Order', o_orderpriority FROM orders),
 edges AS (
  SELECT 'R' || n_regionkey AS id, n_nationkey AS position, 'N' || n_nationkey AS link_id FROM nation
  UNION ALL SELECT 'N' || c_nationkey, c_custkey, 'C' || c_custkey FROM customer
  UNION ALL SELECT 'C' || o_custkey, o_orderkey, 'O' || o_orderkey FROM orders),
 links AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY position) AS link_number, link_id FROM edges),
 ups AS (
  SELECT 'O' || o_orderkey AS id, 'R' || n_regionkey AS root, 3 AS depth FROM orders
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'C' || c_custkey, 'R' || n_regionkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, 1 FROM nation
  UNION ALL SELECT 'R' || r_regionkey, 'R' || r_regionkey, 0 FROM region)
"""


@query(
    _TREE
    + """SELECT id, kind, data, coalesce(n, 0) AS n_children, first_child, last_child FROM nodes LEFT JOIN (
  SELECT id, count(*) AS n, arg_min(link_id, link_number) AS first_child, arg_max(link_id, link_number) AS last_child
  FROM links GROUP BY id) USING (id)"""
)
def tree_reassemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = tree_levels(spark, sf_dir)
    return tree.child_summary(hierarchy.nodes(levels), hierarchy.links(levels))


@query(
    _TREE
    + """SELECT p.id, p.kind, l.link_number, l.link_id, c.kind AS child_kind, c.data AS child_data
FROM nodes p LEFT JOIN links l USING (id) LEFT JOIN nodes c ON c.id = l.link_id"""
)
def ordered_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node with its children in order, one row per child."""
    levels = tree_levels(spark, sf_dir)
    return tree.children(hierarchy.nodes(levels), hierarchy.links(levels)).select(
        "id", "kind", "link_number", "link_id", "child_kind", "child_data"
    )


@query(_DOC_NODES + "SELECT id, link_number AS entry_num, link_id AS entry_id FROM links WHERE label = 'words'")
def body_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each line as numbered entries."""
    return tree.entries(shred.links(_documents(spark, sf_dir)), "words")


@query(
    _DOC_NODES
    + """SELECT n.doc, n.kind, count(*) AS n, count(l.link_id) AS children, count(DISTINCT l.link_id) AS different_children
FROM nodes n LEFT JOIN links l ON l.id = n.id GROUP BY n.doc, n.kind"""
)
def hashed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and links under 64-bit ids, checked to be unique, joined by them.

    A document's nodes and links meet in the task that shreds it; only the ids go round for the check.
    Without an id a document has no paths. Once ids are known to be unique, no child has two parents,
    so that the different children of nodes add up.
    """
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source").where("doc_id IS NOT NULL")
    entries = _shredded(spread_by_size(documents, 4 << 20, by="doc_id"), keep=["doc_id"], attributes=())
    rows, n = materialize(shred.joined(entries, ["doc_id"]), "hashed")
    if rows.where("n_nodes > 1").limit(1).count():
        raise ValueError("node ids are not unique")
    shred.check_ids(rows, n)
    return rows.groupBy(F.concat(F.lit("D"), "doc_id").alias("doc"), "kind").agg(
        F.sum(F.greatest("n_links", F.lit(1))).alias("n"), F.sum("children").alias("children"), F.sum("different_children").alias("different_children")
    )


@query(
    _TREE
    + """SELECT root, kind, CAST(depth AS BIGINT) AS depth, count(*) AS n, min(id) AS first_id
FROM ups JOIN nodes USING (id) GROUP BY root, kind, depth"""
)
def subtree_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = tree_levels(spark, sf_dir)
    nodes = hierarchy.nodes(levels)
    roots = nodes.where(F.col("kind") == "Region").select("id")
    below = closure.subtree(hierarchy.edges(levels), roots)
    return (
        below.join(nodes, "id")
        .groupBy("root", "kind", F.col("depth").cast("bigint").alias("depth"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
    )


@query(
    """SELECT 'R' || n_regionkey AS root, 'C' || c_custkey AS id, 'Customer' AS kind, c_name AS data
FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'R' || n_regionkey, 'N' || n_nationkey, 'Nation', n_name FROM nation"""
)
def root_decls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations opened as groups (two hops), and nations listed themselves (one hop)."""
    levels = tree_levels(spark, sf_dir)
    nodes, links = hierarchy.nodes(levels), hierarchy.edges(levels)
    opened = tree.root_decls(nodes, links, "Region", "Nation")
    listed = tree.root_decls(nodes, links, "Region", "GenDecl")
    return opened.unionByName(listed)


@query(
    """SELECT l_orderkey, l_linenumber, min('P' || l_partkey) AS part_id, min('S' || l_suppkey) AS supplier_id
FROM lineitem GROUP BY l_orderkey, l_linenumber"""
)
def wide_kind_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as nodes with a part and a supplier child; several rows of a key keep the least id."""
    lines = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    child = F.explode(
        F.array(
            F.struct(F.lit("part").alias("label"), F.concat(F.lit("P"), F.col("l_partkey")).alias("link_id")),
            F.struct(F.lit("supplier").alias("label"), F.concat(F.lit("S"), F.col("l_suppkey")).alias("link_id")),
        )
    )
    links = lines.select("l_orderkey", "l_linenumber", child.alias("c")).select("l_orderkey", "l_linenumber", "c.*")
    return tree.wide(links, ["l_orderkey", "l_linenumber"], ["part", "supplier"])


@query(
    """WITH f AS (SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT 'BUILDING' AS name, 'FuncDecl' AS kind, c_name AS location, CAST(NULL AS VARCHAR) AS data, 0 AS depth FROM f
UNION ALL SELECT 'BUILDING', 'Order', 'O' || o_orderkey, o_orderpriority, 1 FROM orders JOIN f ON o_custkey = c_custkey
UNION ALL SELECT DISTINCT 'BUILDING', 'Part', 'P' || p_partkey, p_name, 2 FROM orders JOIN f ON o_custkey = c_custkey
  JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey"""
)
def function_subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as functions named by segment; orders are body entries, their parts lie below."""
    tag, none = F.lit(1).alias("tag"), F.lit(None).cast("string").alias("end_location")

    def key(prefix: str, column: str):
        return F.concat(F.lit(prefix), F.col(column))

    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    part, lines = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    functions = customer.select(
        tag, F.col("c_mktsegment").alias("name"), F.col("c_name").alias("location"), none, key("C", "c_custkey").alias("block_id")
    )
    nodes = orders.select(
        tag, key("O", "o_orderkey").alias("id"), F.lit("Order").alias("kind"), key("O", "o_orderkey").alias("location"), none, F.col("o_orderpriority").alias("data")
    ).unionByName(
        part.select(
            tag, key("P", "p_partkey").alias("id"), F.lit("Part").alias("kind"), key("P", "p_partkey").alias("location"), none, F.col("p_name").alias("data")
        )
    )
    links = orders.select(tag, key("C", "o_custkey").alias("id"), key("O", "o_orderkey").alias("link_id")).unionByName(
        lines.select(tag, key("O", "l_orderkey").alias("id"), key("P", "l_partkey").alias("link_id"))
    )
    return tree.function_subtree(functions, nodes, links, F.col("name") == "BUILDING").drop("tag", "end_location")


def _turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Conversations as chains: the parent of a turn is the turn before."""
    turns = table(spark, sf_dir, "conversations")
    nodes = turns.select(F.concat_ws("/", "conv_id", "turn").alias("id"), F.col("role").alias("kind"))
    links = turns.where(F.col("turn") > 0).select(
        F.concat_ws("/", F.col("conv_id"), F.col("turn") - 1).alias("id"), F.concat_ws("/", "conv_id", "turn").alias("link_id")
    )
    return nodes, links


@query("SELECT conv_id || '/' || turn AS id, conv_id || '/0' AS root, CAST(turn AS BIGINT) AS depth FROM conversations")
def node_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, links = _turns(spark, sf_dir)
    return closure.node_depth(nodes, links).withColumn("depth", F.col("depth").cast("bigint"))


@query("SELECT conv_id || '/' || turn AS id, conv_id || '/' || greatest(turn - 2, 0) AS ancestor FROM conversations")
def parent_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, links = _turns(spark, sf_dir)
    return closure.ancestor(nodes, links, 2)


@query(
    """SELECT 'O' || o_orderkey AS id, 'R' || r_regionkey AS member_id, 'Region' AS member_kind, r_name AS member_data
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey"""
)
def member_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order.customer.nation.region over single links."""
    levels = tree_levels(spark, sf_dir)
    nodes = hierarchy.nodes(levels)
    ups = {"nations": "region", "customers": "nation", "orders": "customer"}
    label = F.create_map(*[F.lit(x) for pair in ups.items() for x in pair])[F.col("label")]
    links = hierarchy.edges(levels).select(
        F.col("link_id").alias("id"), label.alias("label"), F.lit(None).cast("bigint").alias("link_number"), F.col("id").alias("link_id")
    )
    orders = hierarchy.nodes(levels[3:])
    return tree.member(nodes, links, ["customer", "nation", "region"], start=orders)


@query(_TREE + "SELECT kind, count(*) AS n FROM nodes GROUP BY kind")
def kind_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.kind_census(hierarchy.nodes(tree_levels(spark, sf_dir)))


@query(
    _TREE
    + """SELECT id, repeat('  ', depth) || kind || ' ' || data || ' ID=<' || id || '>' AS line
FROM ups JOIN nodes USING (id)"""
)
def format_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = tree_levels(spark, sf_dir)
    nodes = hierarchy.nodes(levels)
    depths = closure.node_depth(nodes, hierarchy.edges(levels))
    text = F.format_string("%s %s ID=<%s>", "kind", "data", "id")
    return nodes.join(depths, "id").select("id", tree.outline(F.col("depth"), text).alias("line"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages").select("page_id", "html"))


@query(
    r"""WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<[a-zA-Z][a-zA-Z0-9]*')) AS tag FROM pages)
SELECT page_id, lower(substr(tag, 2)) AS kind, count(*) AS n FROM t GROUP BY 1, 2"""
)
def html_tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.tag_names(_pages(spark, sf_dir), "page_id", "html").groupBy("page_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query()
def html_tree_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    trees = markup.parse_trees(_pages(spark, sf_dir), "page_id", "html")
    return markup.tree_links(trees, "page_id")
