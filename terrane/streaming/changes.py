"""Incremental planning as a stream: file snapshots come in, files to be analysed come out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from terrane.operators import incremental

SNAPSHOT = "path STRING, hash STRING, cache_key STRING, seen TIMESTAMP"


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of snapshot rows from JSON files that land in a folder."""
    return spark.readStream.schema(SNAPSHOT).json(folder)


def changes(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each content of a file once: repeats within the watermark are dropped, with state that the watermark bounds."""
    return stream.withWatermark("seen", late).dropDuplicatesWithinWatermark(["path", "hash", "cache_key"])


def pending(stream: DataFrame, state: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, late: str = "1 hour") -> StreamingQuery:
    """Plans each batch against the state as it is then and gives the sink the pending files (path, hash); of several contents of a
    file in a batch the last one seen counts."""

    def plan(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("path").agg(F.max_by(F.struct("hash", "cache_key"), "seen").alias("x")).select("path", "x.*")
        sink(incremental.update_plan(last, state()).filter("status = 'pending'").select("path", "hash"), number)

    return changes(stream, late).writeStream.foreachBatch(plan).option("checkpointLocation", checkpoint).start()
