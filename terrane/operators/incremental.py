"""Incremental planning: what is ready, pending or in error, by content hash and cache key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def update_plan(files: DataFrame, state: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """files: path, hash, cache_key; state: path, hash, cache_key, report_path, error; errors: path, message.

    A compile error makes a file `error`, and so does an error cached for the same hash and key; a report for the same hash and key
    makes it `ready`; else it is `pending`. An old report's path is kept for errors."""
    s = state.select("path", F.col("hash").alias("_h"), F.col("cache_key").alias("_k"), "report_path", F.col("error").alias("_e"))
    out = files.join(s, "path", "left")
    if errors is not None:
        joined = errors.groupBy("path").agg(F.array_join(F.array_sort(F.collect_list("message")), "; ").alias("_c"))
        out = out.join(joined, "path", "left")
    else:
        out = out.withColumn("_c", F.lit(None).cast("string"))
    same = F.coalesce((F.col("hash") == F.col("_h")) & (F.col("cache_key") == F.col("_k")), F.lit(False))
    status = F.when(F.col("_c").isNotNull() | (same & F.col("_e").isNotNull()), "error").when(same & F.col("report_path").isNotNull(), "ready").otherwise("pending")
    shown = F.when((status == "ready") | (status == "error"), F.col("report_path"))
    return out.select("path", "hash", status.alias("status"), shown.alias("report_path"), F.when(status == "error", F.coalesce("_c", "_e")).alias("error"))


def plan_totals(plan: DataFrame) -> DataFrame:
    """total, pending, cached; files in error are in neither of the last two."""
    return plan.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "ready").alias("cached"))


def upsert(state: DataFrame, changes: DataFrame, key: str = "path") -> DataFrame:
    """state with the rows of changes in place of those with the same key."""
    return state.join(changes.select(key).distinct(), key, "left_anti").unionByName(changes)


def retain(state: DataFrame, files: DataFrame, key: str = "path") -> DataFrame:
    """state without the files that are gone."""
    return state.join(files.select(key).distinct(), key, "left_semi")
