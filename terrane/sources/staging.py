"""Tables on the folder that all machines share, for loops that must cut their lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def settle(df: DataFrame, what: str) -> DataFrame:
    """Write df as Parquet under spark.checkpoint.dir and read it back. Where that is unset a local session takes the warehouse; a cluster fails."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        root = f"{spark.conf.get('spark.sql.warehouse.dir')}/_terrane_stage"
    path = f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
