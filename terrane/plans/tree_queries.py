"""Queries over layouts and layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.operators import layout
from terrane.plans.tables import table


def longest_path_layers(spark, sf_dir):
    """Layers of a DAG with skip edges: nation n points to 2n + 1, 2n + 2 and n + 5; a layer is the longest path to a node."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("a"))
    edges = n.select("a", F.explode(F.array(2 * F.col("a") + 1, 2 * F.col("a") + 2, F.col("a") + 5)).alias("b")).filter("b < 25").distinct()
    return layout.longest_path(n.select(F.col("a").alias("node")), edges)


LAYERS_SQL = """
WITH RECURSIVE e AS (SELECT DISTINCT n_nationkey AS a, unnest([2 * n_nationkey + 1, 2 * n_nationkey + 2, n_nationkey + 5]) AS b FROM nation),
w AS (SELECT n_nationkey AS node, 0 AS layer FROM nation UNION SELECT e.b, w.layer + 1 FROM w JOIN e ON e.a = w.node WHERE e.b < 25)
SELECT node, CAST(max(layer) AS INTEGER) AS layer FROM w GROUP BY 1"""


def _tree(spark, sf_dir):
    region, nation, supplier = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    place = lambda *cols: F.concat_ws("/", *(F.lpad(F.col(c).cast("string"), 8, "0") for c in cols))
    r = region.select(place("r_regionkey").alias("path"), F.lit(0).alias("depth"), F.lit(60).alias("height"), F.lit(200).alias("width"))
    n = nation.select(place("n_regionkey", "n_nationkey").alias("path"), F.lit(1).alias("depth"), (40 + F.col("n_nationkey") % 3 * 10).cast("int").alias("height"), F.lit(180).alias("width"))
    s = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(place("n_regionkey", "n_nationkey", "s_suppkey").alias("path"), F.lit(2).alias("depth"), F.lit(30).alias("height"), (140 + F.col("s_suppkey") % 5 * 20).cast("int").alias("width"))
    return r.unionByName(n).unionByName(s)


_TREE_SQL = """t AS (
  SELECT lpad(CAST(r_regionkey AS VARCHAR), 8, '0') AS path, 0 AS depth, 60 AS height, 200 AS width FROM region
  UNION ALL SELECT lpad(CAST(n_regionkey AS VARCHAR), 8, '0') || '/' || lpad(CAST(n_nationkey AS VARCHAR), 8, '0'), 1, 40 + n_nationkey % 3 * 10, 180 FROM nation
  UNION ALL SELECT lpad(CAST(n_regionkey AS VARCHAR), 8, '0') || '/' || lpad(CAST(n_nationkey AS VARCHAR), 8, '0') || '/' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0'), 2, 30, CAST(140 + s_suppkey % 5 * 20 AS INTEGER) FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
_POS_SQL = f"{_TREE_SQL}, p AS (SELECT *, depth * 44 AS x, CAST(coalesce(sum(height + 28) OVER (PARTITION BY substr(path, 1, 8) ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS y FROM t)"


def tree_positions(spark, sf_dir):
    """Each root is a drawing of its own: x by depth, y by the heights before it in pre-order."""
    return layout.tree_positions(_tree(spark, sf_dir).withColumn("root", F.substring("path", 1, 8)), "root").drop("root")


def scope_regions(spark, sf_dir):
    """Bounds of each scope that has children, padded by its height above the deepest node inside it."""
    return layout.scope_regions(tree_positions(spark, sf_dir))


REGIONS_SQL = f"""WITH {_POS_SQL},
c AS (SELECT a.path, d.depth - a.depth AS k, d.x, d.y, d.width, d.height FROM p a JOIN p d ON d.path = a.path OR starts_with(d.path, a.path || '/'))
SELECT path, depth, min(x - 18 - 10 * k) AS left_x, min(y - 18 - 10 * k) AS top_y, max(x + width + 18 + 10 * k) AS right_x, max(y + height + 18 + 10 * k) AS bottom_y
FROM (SELECT c.*, p.depth FROM c JOIN p USING (path)) GROUP BY 1, 2 HAVING count(*) > 1"""


def edge_lift_dedup(spark, sf_dir):
    """Line-to-part edges lifted to the customer where the line is hidden; one edge per pair, structural ones first."""
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    lifted = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("a"), F.col("l_suppkey").alias("b"), F.lit(1).alias("priority"))
    structural = orders.select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 50).alias("b"), F.lit(0).alias("priority"))
    return layout.dedup_edges(lifted.unionByName(structural))


LIFT_SQL = """
SELECT a, b, min(priority) AS priority FROM (SELECT o_custkey AS a, l_suppkey AS b, 1 AS priority FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION ALL SELECT o_custkey, o_orderkey % 50, 0 FROM orders) WHERE a <> b GROUP BY 1, 2"""

_ALL = {
    "longest_path_layers": (longest_path_layers, LAYERS_SQL),
    "tree_positions": (tree_positions, f"WITH {_POS_SQL} SELECT * FROM p"),
    "scope_regions": (scope_regions, REGIONS_SQL),
    "edge_lift_dedup": (edge_lift_dedup, LIFT_SQL),
}
QUERIES = {k: f for k, (f, _) in _ALL.items()}
ORACLES = {k: sql for k, (_, sql) in _ALL.items()}
