"""Labelling in line windows with a pluggable labeller, strict application, pairwise merging."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrane.operators import coverage, windows
from terrane.sources.staging import settle

ATTEMPTS = 3
DONE, NEXT = "[СДЕЛАНО]", "[ДАЛЬШЕ]"
#: A labeller takes the nodes of some windows (report, window_no, id, kind, label, summary, lines) and gives id, label, summary, group_id per report.
Labeller = Callable[[DataFrame], DataFrame]


def offline(nodes: DataFrame) -> DataFrame:
    """The default labeller: each node keeps its label, and its summary is that or its label."""
    return nodes.select("report", "id", "label", F.coalesce(F.nullif(F.trim("summary"), F.lit("")), "label").alias("summary"), F.lit(None).cast("string").alias("group_id"))


def label_windows(nodes: DataFrame, budget: int = windows.BUDGET) -> DataFrame:
    """nodes with window_no, by report and start line whatever the file; a node without lines counts as line 1."""
    rows = nodes.withColumn("_line", F.coalesce("start_line", F.lit(1)))
    w = windows.greedy_windows(rows, "report", "_line", budget)
    w = w.withColumnRenamed("start_line", "_first")
    return windows.window_of(rows, w, "report", "_line", budget, "_first").drop("_line", "_first")


def faults(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """report, id, fault of a reply that isn't exactly the nodes asked for, each with a label and a summary."""
    key = F.struct("report", "id").alias("key")
    bad = coverage.strict_cover(nodes.select(key), labels.select(key, "label", "summary"), "key", "label", "summary")
    return bad.select("key.*", "fault")


def label(nodes: DataFrame, labeller: Labeller = offline, attempts: int = ATTEMPTS) -> DataFrame:
    """nodes with labels, summaries and groups from the labeller. Windows whose reply has a fault are asked again, others aren't;
    after the last attempt a fault is an error, and nothing is applied."""
    todo = settle(label_windows(nodes), "label-todo")
    done = None
    for k in range(attempts):
        reply = settle(labeller(todo), "label-reply")
        bad = settle(faults(todo, reply), "label-faults")
        at = todo.select("report", "id", "window_no")
        wrong = bad.join(at, ["report", "id"], "left").select("report", "window_no").distinct()
        whole = wrong.filter("window_no is null").select("report").distinct()  # an unexpected id spoils all of its report's windows
        again = todo.join(wrong.filter("window_no is not null"), ["report", "window_no"], "left_semi").unionByName(todo.join(whole, "report", "left_semi")).dropDuplicates(["report", "id"])
        again = settle(again, "label-again")
        good = reply.join(again.select("report", "id"), ["report", "id"], "left_anti").join(at.select("report", "id"), ["report", "id"], "left_semi")
        done = good if done is None else done.unionByName(good)
        if again.isEmpty():
            break
        todo = again
    else:
        first = bad.orderBy("report", "id").first()
        raise ValueError(f"labels of {first['report']}: {first['fault']} '{first['id']}'")
    key = F.struct("report", "id").alias("_key")
    new = done.select(key, "label", "summary", "group_id")
    return coverage.apply_labels(nodes.withColumn("_key", F.struct("report", "id")), new, "_key", ["label", "summary", "group_id"]).drop("_key")


def merge_groups(nodes: DataFrame) -> DataFrame:
    """Neighbouring siblings of one group merge in twos: the first keeps its id, label and summary; lines span both, and coverage and
    children of the second come behind its own. A merged node has no group any more."""
    placed = windows.adjacent_merge(nodes.withColumn("_up", F.struct("report", F.coalesce("parent_id", F.lit("")).alias("p"))), "_up", ["ord", "id"], "group_id")
    place = F.struct("ord", "id")
    by = W.partitionBy("_up", "island", "pair")
    heads = placed.withColumn("_head", F.min(place).over(by)["id"]).withColumn("_size", F.count("*").over(by))
    ids = settle(heads.select("report", "id", F.col("_head").alias("head")), "merge-heads")
    firsts = F.array_sort(F.collect_list(F.struct("ord", "id", "coverage_ids")))
    spans = heads.groupBy("report", "_head").agg(F.min("start_line").alias("_s"), F.max("end_line").alias("_e"), F.flatten(F.transform(firsts, lambda x: x["coverage_ids"])).alias("_c"))
    kept = heads.filter(F.col("id") == F.col("_head")).join(spans, ["report", "_head"])
    kept = kept.withColumn("start_line", F.col("_s")).withColumn("end_line", F.col("_e")).withColumn("coverage_ids", F.col("_c")).withColumn("group_id", F.when(F.col("_size") == 1, F.col("group_id")))
    kept = kept.select(*nodes.columns)
    up = ids.select("report", F.col("id").alias("parent_id"), F.col("head").alias("_parent"))
    moved = kept.join(up, ["report", "parent_id"], "left").withColumn("_rank", F.struct(F.col("path"))).withColumn("parent_id", F.coalesce("_parent", "parent_id"))
    return moved.withColumn("ord", F.row_number().over(W.partitionBy("report", "parent_id").orderBy("path", "id"))).select(*nodes.columns)


def marked_source(lines: DataFrame, nodes: DataFrame, window: int) -> DataFrame:
    """lines: report, line_no, numbered; each line marked as done if a unit of an earlier window covers it, else as next; without marks
    in a report where nothing is done."""
    before = nodes.filter((F.col("window_no") < window) & (F.size("coverage_ids") > 0)).select("report", F.explode(F.sequence("start_line", "end_line")).alias("line_no")).distinct().withColumn("_done", F.lit(True))
    some = before.select("report").distinct().withColumn("_some", F.lit(True))
    out = lines.join(before, ["report", "line_no"], "left").join(some, "report", "left")
    mark = F.when(F.col("_some").isNull(), F.col("numbered")).otherwise(F.concat(F.when(F.col("_done"), F.lit(DONE + " ")).otherwise(F.lit(NEXT + " ")), "numbered"))
    return out.select("report", "line_no", mark.alias("text"))
