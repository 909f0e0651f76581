"""Sharding by proportional stratified interleaving, with DataFrame operations only.

Within each source the rows stand in seeded-shuffled order; row r of n gets the fractional rank (2r + 1) / 2n.
All rows, sorted by fractional rank, are cut into shards whose row counts differ by one at most, so each shard
holds every source in its share of the whole. No rank needs all rows of a source in one task: rows are dealt to
buckets of the first bits of their shuffle hash (then of their fractional rank), ranked inside the bucket, and shifted
by the bucket's running count. The number of buckets follows the number of rows, and doesn't change the ranks.
The hash is of id and text checksum, so that null ids and an id of many rows are spread like others.

Defined results: a null source is a source of its own; null and repeated ids are ranked like others (rows that agree
in id, size and checksum are alike, and share a bucket); a null text has size 16 and checksum 0; an empty table gives no rows.
Equal texts aren't held together: the law kept is equal row counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrane.llm.common import stratum

#: Rows for a bucket, about, and the least buckets for each source and for the fractional rank, as powers of two.
BUCKET_ROWS = 1 << 18
LEAST_BITS, LEAST_SLICE_BITS = 7, 12


def interleave(df: DataFrame, shards: int, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = 7, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """key, source, size, text_crc32, rank (position in the whole), shard, slot."""
    crc = F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long")
    needed = (df.count() // bucket_rows).bit_length()
    bits, slices = max(LEAST_BITS, needed), 1 << max(LEAST_SLICE_BITS, needed)
    rows = df.select(
        F.col(key).alias("k"),
        F.col(source).alias("src"),
        stratum(F.col(source)).alias("s"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        crc.alias("crc"),
        F.xxhash64(F.lit(seed), F.col(key), crc).alias("h"),
    ).withColumn("b", F.shiftrightunsigned("h", 64 - bits))

    by_source = W.partitionBy("s")
    counts = rows.groupBy("s", "b").agg(F.count("*").alias("n"))
    offsets = counts.select("s", "b", (F.sum("n").over(by_source.orderBy("b")) - F.col("n")).alias("before"), F.sum("n").over(by_source).alias("of"))

    in_bucket = W.partitionBy("s", "b").orderBy("h", "k", "crc", "size")
    ranked = rows.withColumn("r", F.row_number().over(in_bucket) - 1).join(offsets, ["s", "b"])
    ranked = ranked.withColumn("f", (2 * (F.col("before") + F.col("r")) + 1) / (2 * F.col("of")).cast("double"))
    ranked = ranked.select("k", "src", "s", "size", "crc", "h", "f", F.least(F.floor(F.col("f") * slices), F.lit(slices - 1)).cast("int").alias("g"))

    per_slice = ranked.groupBy("g").agg(F.count("*").alias("n"))
    # One row for BUCKET_ROWS rows, about, or a few thousand.
    starts = per_slice.select("g", (F.sum("n").over(W.orderBy("g")) - F.col("n")).alias("start"), F.sum("n").over(W.partitionBy()).alias("total"))
    in_slice = W.partitionBy("g").orderBy("f", "s", "h", "k", "crc", "size")
    whole = ranked.withColumn("r", F.row_number().over(in_slice) - 1).join(starts, "g").withColumn("rank", F.col("start") + F.col("r"))

    shard = F.expr(f"(rank * {int(shards)}) div total")
    first = F.expr(f"(shard * total + {int(shards) - 1}) div {int(shards)}")
    return whole.withColumn("shard", shard.cast("long")).select(
        F.col("k").alias(key), F.col("src").alias(source), "size", F.col("crc").alias("text_crc32"), "rank", F.col("shard").cast("int").alias("shard"), (F.col("rank") - first).cast("long").alias("slot")
    )
