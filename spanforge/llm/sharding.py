"""Contiguous shards of near-equal bytes from a global prefix sum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import checkpointed


def byte_size(text: Column) -> Column:
    """UTF-8 bytes of the text and one for its end; a null text has only its end."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def shard_by_bytes(docs: DataFrame, shards: int = 8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Returns key, size, text_crc32, shard and slot for each row; shards are runs of rows in the order of key.

    Rows are dealt by range; the running sum within a partition plus the totals of the partitions
    before it is a row's place in the whole. A row belongs to the shard that holds its middle byte,
    so a cut is off its equal share by less than one row. slot counts from 0 in each shard.

    Null keys come first. Rows with equal keys are ordered by size, checksum and place in the scan,
    so a hot key can fill many partitions. A null text has size 1 and the checksum of the empty
    text. An empty table gives no rows. Other columns are not read. Only these few numbers are
    shuffled, never the texts.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    order = ["key", "size", "text_crc32", "place"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    checksum = F.crc32(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(F.col(key).alias("key"), byte_size(F.col(text)).alias("size"), checksum.alias("text_crc32"), F.monotonically_increasing_id().alias("place"))
    # The checkpoint fixes the partition of each row: another pass might sample other range bounds.
    dealt = checkpointed(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))

    totals = dealt.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))  # a row for each partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        (2 * F.sum("bytes").over(Window.partitionBy())).alias("double_total"),
    )
    within = Window.partitionBy("part").orderBy(*order)
    placed = dealt.join(F.broadcast(offsets), "part").select(
        F.col("key"),
        F.col("size"),
        F.col("text_crc32"),
        ((2 * (F.col("bytes_before") + F.sum("size").over(within)) - F.col("size")) * shards).alias("middle"),
        (F.col("rows_before") + F.row_number().over(within) - 1).alias("nth"),
        F.col("double_total"),
    )
    placed = placed.withColumn("shard", ((F.col("middle") - F.col("middle") % F.col("double_total")) / F.col("double_total")).cast("int"))
    first = placed.groupBy("shard").agg(F.min("nth").alias("first"))  # a row for each shard
    slotted = placed.join(F.broadcast(first), "shard")
    return slotted.select(F.col("key").alias(key), "size", "text_crc32", "shard", (F.col("nth") - F.col("first")).alias("slot"))
