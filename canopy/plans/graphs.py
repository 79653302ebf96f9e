"""Long chains, strong components, and subtrees by visit-order numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.operators import hierarchy, reach, tour, tree
from canopy.operators.numbering import number_rows
from canopy.plans.bindings import table, tree as tree_levels
from canopy.plans.registry import query

_PART_GRAPH = """
WITH RECURSIVE edges AS (
  SELECT p.p_partkey AS src, q.p_partkey AS dst FROM part p
  JOIN part q ON q.p_partkey = p.p_partkey // 8 * 8 + (p.p_partkey % 8 * 5 + 3) % 8
  UNION SELECT p.p_partkey, q.p_partkey FROM part p JOIN part q ON q.p_partkey = p.p_partkey // 2),
 reach(root, node) AS (
  SELECT src, src FROM edges UNION SELECT dst, dst FROM edges
  UNION SELECT r.root, e.dst FROM reach r JOIN edges e ON r.node = e.src)
"""


@query(
    _PART_GRAPH
    + """, same AS (SELECT a.root AS id, min(a.node) AS component FROM reach a JOIN reach b ON b.root = a.node AND b.node = a.root GROUP BY a.root)
SELECT id, component, count(*) OVER (PARTITION BY component) AS size FROM same"""
)
def strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that replace each other in rings of eight, with ways from every part to part ``key div 2``."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("src"))
    following = F.expr("src div 8 * 8 + (src % 8 * 5 + 3) % 8").alias("dst")
    ways = part.select("src", following).unionByName(part.select("src", F.expr("src div 2").alias("dst")))
    edges = ways.join(part.select(F.col("src").alias("dst")), "dst", "left_semi").select("src", "dst")
    found = reach.strong_components(edges)
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return found.join(sizes, "component").select("id", "component", "size")


@query("SELECT first_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS root, event_id AS node FROM events WHERE user_id IS NOT NULL")
def reach_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that follows each user's first event, over links from an event to the user's next one."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id").where("user_id IS NOT NULL")
    placed = number_rows(events, ["ts", "event_id"], partition=["user_id"], name="n").select("user_id", "n", "event_id")
    following = placed.select("user_id", (F.col("n") - 1).alias("n"), F.col("event_id").alias("dst"))
    links = placed.withColumnRenamed("event_id", "src").join(following, ["user_id", "n"]).select("src", "dst")
    return reach.reach(links, placed.where("n = 1").select("event_id"))


_VISITS = """
WITH nodes AS (
  SELECT 'R' || r_regionkey AS root, 'R' || r_regionkey AS id, 'Region' AS kind, r_name AS data, NULL::BIGINT AS n, NULL::BIGINT AS c, NULL::BIGINT AS o FROM region
  UNION ALL SELECT 'R' || n_regionkey, 'N' || n_nationkey, 'Nation', n_name, n_nationkey, NULL, NULL FROM nation
  UNION ALL SELECT 'R' || n_regionkey, 'C' || c_custkey, 'Customer', c_name, n_nationkey, c_custkey, NULL
    FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'R' || n_regionkey, 'O' || o_orderkey, 'Order', o_orderpriority, n_nationkey, c_custkey, o_orderkey
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
 numbered AS (SELECT *, (n IS NOT NULL)::BIGINT + (c IS NOT NULL)::BIGINT + (o IS NOT NULL)::BIGINT AS depth,
   row_number() OVER (PARTITION BY root ORDER BY n NULLS FIRST, c NULLS FIRST, o NULLS FIRST) AS pre,
   row_number() OVER (PARTITION BY root ORDER BY n NULLS LAST, c NULLS LAST, o NULLS LAST) AS post FROM nodes)
"""


def _numbers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    levels = tree_levels(spark, sf_dir)
    nodes = hierarchy.nodes(levels)
    return nodes, tour.tour(nodes, hierarchy.links(levels))


@query(_VISITS + "SELECT root, id, pre, post, depth, post - pre + 1 + depth AS size FROM numbered")
def tour_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node's place in the visit order of its tree."""
    return _numbers(spark, sf_dir)[1]


@query(
    _VISITS
    + """SELECT 'N' || n AS top, kind, count(*) AS n, min(id) AS first_id, max(depth) - 1 AS deepest
FROM numbered WHERE n IS NOT NULL GROUP BY ALL"""
)
def subtree_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies below each nation, by the range of its numbers: no walk."""
    nodes, numbers = _numbers(spark, sf_dir)
    found = tour.below(numbers, nodes.where("kind = 'Nation'").select("id"))
    kinds = found.join(nodes.select("id", "kind"), "id").groupBy("top", "kind")
    return kinds.agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), (F.max("depth") - 1).alias("deepest"))


@query(
    _VISITS
    + """SELECT row_number() OVER (ORDER BY root, pre) AS line_number, repeat('  ', depth::INTEGER) || kind || ' ' || data || ' ID=<' || id || '>' AS line
FROM numbered"""
)
def visit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole forest as indented lines, numbered in visit order."""
    nodes, numbers = _numbers(spark, sf_dir)
    text = F.format_string("%s %s ID=<%s>", "kind", "data", "id")
    lines = nodes.join(numbers, "id").select("root", "pre", tree.outline(F.col("depth").cast("int"), text).alias("line"))
    return tour.in_visit_order(lines).select("line_number", "line")
