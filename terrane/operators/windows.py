"""Ordered operators: line windows and pairwise merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Source lines a labelling window may span: what an output cap of 8192 tokens allows at 64 tokens a line, and 24 at least.
BUDGET = max(8192 // 64, 24)


def greedy_starts(lines: Column, budget: int = BUDGET) -> Column:
    """Start lines of the windows over an ascending array of lines: a window opens at the first line beyond the last one's budget."""
    empty = F.array().cast("array<int>")
    return F.aggregate(lines, empty, lambda opened, x: F.when((F.size(opened) == 0) | (x > F.element_at(opened, -1) + (budget - 1)), F.concat(opened, F.array(x))).otherwise(opened))


def greedy_windows(df: DataFrame, key: str, line: str, budget: int = BUDGET) -> DataFrame:
    """key, window_no (from 1), start_line. A key's distinct lines are folded in one row: their number is bounded by the file's length."""
    per_key = df.select(key, F.col(line).cast("int").alias("_l")).distinct().groupBy(key).agg(F.array_sort(F.collect_list("_l")).alias("_ls"))
    return per_key.select(key, F.posexplode(greedy_starts(F.col("_ls"), budget)).alias("_n", "start_line")).select(key, (F.col("_n") + 1).alias("window_no"), "start_line")


def window_of(df: DataFrame, windows: DataFrame, key: str, line: str, budget: int = BUDGET, first: str = "start_line") -> DataFrame:
    """df with the window_no each row falls in: an equi-join on the key and the block of lines, as a window meets two blocks at most."""
    w = windows.withColumn("_block", F.explode(F.array_distinct(F.array(F.expr(f"{first} div {budget}"), F.expr(f"({first} + {budget - 1}) div {budget}")))))
    rows = df.withColumn("_block", F.expr(f"cast({line} as int) div {budget}"))
    return rows.join(w, [key, "_block"]).filter(F.col(line).between(F.col(first), F.col(first) + (budget - 1))).drop("_block")


def adjacent_merge(df: DataFrame, key: str, order: list[str], group: str) -> DataFrame:
    """df with island and pair numbers: neighbours of one non-null group merge in twos, as a merged node's group is cleared."""
    w = W.partitionBy(key).orderBy(*order)
    new = F.coalesce((F.col(group) != F.lag(group).over(w)) | F.col(group).isNull() | F.lag(group).over(w).isNull(), F.lit(True))
    df = df.withColumn("_new", new.cast("int")).withColumn("island", F.sum("_new").over(w)).drop("_new")
    return df.withColumn("pair", F.floor((F.row_number().over(W.partitionBy(key, "island").orderBy(*order)) - 1) / 2).cast("int"))
