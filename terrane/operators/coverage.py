"""Coverage and label checks: full outer joins on ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exactly_once(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Ids whose count isn't one: missing, duplicate (with the count) or unknown. Both sides are counted before they meet."""
    want = expected.select(key).distinct().withColumn("_want", F.lit(True))
    have = actual.groupBy(key).agg(F.count("*").alias("n"))
    both = want.join(have, key, "full_outer")
    status = F.when(F.col("_want").isNull(), "unknown").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicate")
    return both.select(key, status.alias("status"), F.coalesce("n", F.lit(0)).alias("n")).filter("status is not null")


def strict_cover(expected: DataFrame, labels: DataFrame, key: str, label: str, summary: str) -> DataFrame:
    """Faults of a label reply: omitted, empty label, empty summary, unexpected; nothing is applied unless this is empty."""
    both = expected.select(key).distinct().withColumn("_e", F.lit(True)).join(labels.select(key, label, summary).withColumn("_l", F.lit(True)), key, "full_outer")
    fault = (
        F.when(F.col("_e").isNull(), "unexpected")
        .when(F.col("_l").isNull(), "omitted")
        .when(F.coalesce(F.trim(label), F.lit("")) == "", "empty label")
        .when(F.trim(summary) == "", "empty summary")
    )
    return both.select(key, fault.alias("fault")).filter("fault is not null")


def apply_labels(nodes: DataFrame, labels: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """nodes with the given columns overwritten where labels has the id, also by null."""
    hit = labels.select(key, *(F.col(c).alias(f"_new_{c}") for c in columns)).withColumn("_hit", F.lit(True))
    out = nodes.join(hit, key, "left")
    for c in columns:
        out = out.withColumn(c, F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)))
    return out.drop("_hit", *(f"_new_{c}" for c in columns))
