"""Source ranges: snapping to the nearest call, and clamping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE = 5


def nearest(left: DataFrame, right: DataFrame, key: str, at: str, to: str, rid: str, order: list[str], tolerance: int = TOLERANCE) -> DataFrame:
    """For each left row (rid) the right row of its key with the smallest distance |at - to|, first in order; none beyond the tolerance.

    The range condition becomes an equi-join: values are dealt to blocks of tolerance + 1, and a left row probes three blocks. The
    choice is an aggregate with a partial stage, so a key with many rows is no single task.
    """
    size = tolerance + 1
    probe = left.withColumn("_b", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col(at) / size).cast("long") + d)))
    found = right.withColumn("_b", F.floor(F.col(to) / size).cast("long"))
    hit = probe.join(found, [key, "_b"]).filter(F.abs(F.col(at) - F.col(to)) <= tolerance)
    rank = F.struct(F.abs(F.col(at) - F.col(to)).alias("distance"), *order)
    return hit.groupBy(rid).agg(F.min(F.struct(*[rank[c].alias(c) for c in ["distance", *order]])).alias("_best")).select(rid, "_best.*")


def midpoint(start: Column, end: Column) -> Column:
    """Whole-number middle of a range."""
    return F.floor((start + end) / 2).cast("long")


def clamp(start: Column, end: Column, last: Column) -> tuple[Column, Column]:
    """A range inside [1, last] (1 where there is no last line), its ends swapped if they are the wrong way round."""
    top = F.coalesce(last, F.lit(1))
    a, b = F.least(F.greatest(start, F.lit(1)), top), F.least(F.greatest(end, F.lit(1)), top)
    return F.least(a, b), F.greatest(a, b)
