"""Deterministic layout of trees and graphs; positions are whole numbers of pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrane.sources.staging import settle

#: Pixels: indent per depth, gap between rows, padding of a region, and more of it per level of nesting.
INDENT, GAP, PADDING, NESTING = 44, 28, 18, 10
LAYER_GAP, ROW_GAP = 40, 70


def longest_path(nodes: DataFrame, edges: DataFrame, passes: int | None = None) -> DataFrame:
    """node, layer: length of the longest path to each node. One relaxation of all edges at a time, as many as there are nodes at
    most, so a cycle ends there. nodes: node; edges: a, b."""
    edges = settle(edges.select("a", "b").distinct(), "layers-edges")
    layers = settle(nodes.select("node").distinct().withColumn("layer", F.lit(0)), "layers")
    passes = layers.count() if passes is None else passes
    total = -1
    for _ in range(passes):
        low = edges.join(layers, F.col("a") == F.col("node")).groupBy("b").agg((F.max("layer") + 1).alias("least"))
        layers = settle(layers.join(low, F.col("node") == F.col("b"), "left").select("node", F.greatest("layer", F.coalesce("least", F.lit(0))).alias("layer")), "layers")
        now = layers.agg(F.sum("layer")).first()[0]
        if now == total or now is None:
            break
        total = now
    return layers


def barycentre(layers: DataFrame, edges: DataFrame, positions: DataFrame) -> DataFrame:
    """node, centre: mean centre of its predecessors that have a place (node, x, width); null without any."""
    at = positions.select(F.col("node").alias("a"), (F.col("x") + F.col("width") / 2).alias("c"))
    mean = edges.join(at, "a").groupBy(F.col("b").alias("node")).agg(F.avg("c").alias("centre"))
    return layers.join(mean, "node", "left").select("node", "layer", "centre")


def layered(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes: node, width, height; node, layer, x, y. A layer is placed from left to right by its members' barycentres, then ids, and
    centred; one step per layer, as each depends on the one before it."""
    layers = longest_path(nodes.select("node"), edges)
    sized = settle(layers.join(nodes, "node"), "layout-sized")
    placed = None
    last = sized.agg(F.max("layer")).first()[0]
    for k in range(0 if last is None else last + 1):
        group = sized.filter(F.col("layer") == k)
        if placed is None:
            group = group.withColumn("centre", F.lit(None).cast("double"))
        else:
            group = barycentre(group.select("node", "layer"), edges, placed).join(group.drop("layer"), "node")
        w = W.partitionBy("layer").orderBy(F.col("centre").asc_nulls_last(), "node").rowsBetween(W.unboundedPreceding, -1)
        new = group.withColumn("x", 40 + F.coalesce(F.sum(F.col("width") + LAYER_GAP).over(w), F.lit(0))).select("node", "layer", "x", "width", "height")
        placed = settle(new if placed is None else placed.unionByName(new), "layout-placed")
    if placed is None:
        return sized.select("node", "layer", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    per = placed.groupBy("layer").agg(F.max(F.col("x") + F.col("width")).alias("w"), F.max("height").alias("h"))
    top = per.withColumn("top", 40 + F.coalesce(F.sum(F.col("h") + ROW_GAP).over(W.orderBy("layer").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("most", F.max("w").over(W.partitionBy()))
    out = placed.join(top, "layer")
    return out.select("node", "layer", (F.col("x") + F.greatest((F.col("most") - F.col("w")) / 2, F.lit(0.0))).alias("x"), (F.col("top") + (F.col("h") - F.col("height")) / 2).alias("y"))


def tree_positions(nodes: DataFrame, tree: str) -> DataFrame:
    """nodes: tree, path (pre-order sort key), depth, width, height; x by depth, y the sum of the heights and gaps before."""
    before = W.partitionBy(tree).orderBy("path").rowsBetween(W.unboundedPreceding, -1)
    y = F.coalesce(F.sum(F.col("height") + GAP).over(before), F.lit(0)).cast("long")
    return nodes.withColumn("x", F.col("depth") * INDENT).withColumn("y", y)


def scope_regions(placed: DataFrame) -> DataFrame:
    """Bounds of every scope with something inside: each node counts for all its ancestors, padded more for each level between."""
    parts = F.split("path", "/")
    each = placed.select(F.explode(F.sequence(F.lit(1), F.size(parts))).alias("n"), parts.alias("p"), "depth", "x", "y", "width", "height")
    pad = PADDING + NESTING * (F.size("p") - F.col("n"))
    bounds = each.groupBy(F.array_join(F.slice("p", F.lit(1), F.col("n")), "/").alias("path"), "n").agg(
        F.min(F.col("x") - pad).alias("left_x"), F.min(F.col("y") - pad).alias("top_y"), F.max(F.col("x") + F.col("width") + pad).alias("right_x"), F.max(F.col("y") + F.col("height") + pad).alias("bottom_y"), F.count("*").alias("inside")
    )
    return bounds.filter("inside > 1").select("path", (F.col("n") - 1).alias("depth"), "left_x", "top_y", "right_x", "bottom_y")


def dedup_edges(edges: DataFrame) -> DataFrame:
    """One edge for each pair (a, b), that of the smallest priority; loops go."""
    return edges.filter("a <> b").groupBy("a", "b").agg(F.min("priority").alias("priority"))


def visible_ancestors(nodes: DataFrame, hidden: DataFrame) -> DataFrame:
    """nodes: id, path; hidden: path of collapsed scopes. id and the nearest node that shows: below a collapsed scope that is the
    outermost collapsed one. Each node meets its own prefixes only."""
    prefixes = nodes.select("id", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda n: F.array_join(F.slice(F.split("path", "/"), F.lit(1), n), "/"))).alias("up"))
    outer = prefixes.join(hidden.select(F.col("path").alias("up")).distinct(), "up").filter("up <> path").groupBy("id").agg(F.min("up").alias("up"))
    at = nodes.select(F.col("path").alias("up"), F.col("id").alias("shown"))
    return nodes.join(outer, "id", "left").withColumn("up", F.coalesce("up", "path")).join(at, "up").select("id", "shown")
