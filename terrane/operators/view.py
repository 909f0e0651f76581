"""What a viewer derives from a report's nodes: arcs, visible nodes, lifted edges, drill-down, navigation, styles, the work queue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrane.operators import layout


def structural_edges(nodes: DataFrame) -> DataFrame:
    """report, from, to of each node and its parent."""
    return nodes.filter("parent_id is not null").select("report", F.col("parent_id").alias("from"), F.col("id").alias("to"))


def branch_arcs(nodes: DataFrame) -> DataFrame:
    """report, from, to, label of the branches of decisions whose target is a node of the report; nodes: with branches (condition, target)."""
    arcs = nodes.filter("kind = 'decision'").select("report", F.col("id").alias("from"), F.explode("branches").alias("b")).select("report", "from", F.col("b.target").alias("to"), F.col("b.condition").alias("label"))
    return arcs.join(nodes.select("report", F.col("id").alias("to")).distinct(), ["report", "to"], "left_semi").select("report", "from", "to", "label")


def sequential_arcs(arcs: DataFrame, nodes: DataFrame) -> DataFrame:
    """arcs (report, from, to) with two or more ways out of a node that is no decision turned into a chain by start line, then id."""
    n = nodes.select("report", F.col("id").alias("to"), F.coalesce("start_line", F.lit(0)).alias("_line"))
    decisions = nodes.filter("kind = 'decision'").select("report", F.col("id").alias("from")).distinct().withColumn("_keep", F.lit(True))
    rows = arcs.join(n, ["report", "to"]).join(decisions, ["report", "from"], "left")
    before = F.lag("to").over(W.partitionBy("report", "from").orderBy("_line", "to"))
    return rows.withColumn("_before", before).select("report", F.when(F.col("_keep"), F.col("from")).otherwise(F.coalesce("_before", "from")).alias("from"), "to")


def visible(nodes: DataFrame, layers: list[str], collapsed: DataFrame | None = None) -> DataFrame:
    """Nodes that show: their own and all ancestors' layers are on, and no ancestor is collapsed (report, path). A root shows always."""
    parts = F.split("path", "/")
    ups = nodes.select("report", F.col("path").alias("at"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("path"))
    off = nodes.filter(~F.col("layer").isin(*layers) & (F.col("depth") > 0)).select("report", "path")
    hidden = ups.join(off, ["report", "path"], "left_semi").select("report", F.col("at").alias("path"))
    if collapsed is not None:
        below = ups.filter("at <> path").join(collapsed.select("report", "path"), ["report", "path"], "left_semi")
        hidden = hidden.unionByName(below.select("report", F.col("at").alias("path")))
    return nodes.join(hidden.distinct(), ["report", "path"], "left_anti").select(*nodes.columns)


def lifted_edges(edges: DataFrame, nodes: DataFrame, collapsed: DataFrame) -> DataFrame:
    """Edges (from, to) of one report between what shows: structural ones first, then those given, each pair once. nodes: id, path, parent_id; collapsed: path."""
    shown = layout.visible_ancestors(nodes.select("id", "path"), collapsed)
    a, b = shown.select(F.col("id").alias("from"), F.col("shown").alias("a")), shown.select(F.col("id").alias("to"), F.col("shown").alias("b"))
    own = nodes.filter("parent_id is not null").select(F.col("parent_id").alias("from"), F.col("id").alias("to"), F.lit(0).alias("priority"))
    every = own.unionByName(edges.select("from", "to", F.lit(1).alias("priority")))
    return layout.dedup_edges(every.join(a, "from").join(b, "to").select("a", "b", "priority")).select(F.col("a").alias("from"), F.col("b").alias("to"), "priority")


def drill_down(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """The sub-trees of some nodes (report, id), each with its root's id."""
    parts = F.split("path", "/")
    ups = nodes.withColumn("_up", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))))
    at = nodes.join(roots.select("report", "id"), ["report", "id"], "left_semi").select("report", F.col("path").alias("_up"), F.col("id").alias("root"))
    return ups.join(at, ["report", "_up"]).select("root", *nodes.columns)


def navigate(requests: DataFrame, symbols: DataFrame) -> DataFrame:
    """requests: symbol, file (may be null); the file to open: the one asked for, or else the symbol's."""
    s = symbols.select(F.col("id").alias("symbol"), F.col("source.file").alias("_file"))
    return requests.join(s, "symbol", "left").select("symbol", F.coalesce("file", "_file").alias("file"))


def styles(nodes: DataFrame, palette: DataFrame, kinds: DataFrame) -> DataFrame:
    """report, id, color: the element type's, or else the kind's, or else that of actions. nodes: with element_type; kinds: kind, color."""
    p, k = palette.select(F.col("type").alias("element_type"), F.col("color").alias("_p")), kinds.select("kind", F.col("color").alias("_k"))
    action = kinds.filter("kind = 'action'").select(F.lit("action").alias("_a"), F.col("color").alias("_d"))
    out = nodes.withColumn("_a", F.lit("action")).join(p, "element_type", "left").join(k, "kind", "left").join(action, "_a", "left")
    return out.select("report", "id", F.coalesce("_p", "_k", "_d").alias("color"))


def queue(plan: DataFrame) -> DataFrame:
    """Files to be analysed, pending ones and those in error without a report, with their place in the queue."""
    todo = plan.filter("status = 'pending' or (status = 'error' and report_path is null)")
    return todo.withColumn("place", F.row_number().over(W.orderBy("path")))


def progress(results: DataFrame) -> DataFrame:
    """results: path, error (null if it went well), done; total, completed and failed."""
    return results.agg(F.count("*").alias("total"), F.count_if("done").alias("completed"), F.count_if(F.col("done") & F.col("error").isNotNull()).alias("failed"))
