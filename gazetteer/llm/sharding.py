"""Sharding by global prefix sums.

All rows are put in one global order (equal texts side by side), their sizes are summed along it, and the running sum is
cut at equal targets, so each shard is a contiguous run and shard sizes differ by less than two rows' sizes.  A cut that
falls into a group of equal texts moves to the group's nearer edge, unless the group is larger than a twentieth of a
shard, as a third of all rows may be.

The order is a range partitioning.  Each partition gives one total; the running sum of those totals (one row a
partition) is added to the running sums inside the partitions, so no task ever sees more than its own partition.  Only
keys and sizes are shuffled, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written


#: The largest group that is kept whole, as a share of a shard's target.
WHOLE = 0.05


def prefix_shards(rows: DataFrame, size: str, order: list[Column], shards: int, group: str | None = None, whole: float = WHOLE) -> DataFrame:
    """`rows` with `shard` (int, 0 to shards-1) and `slot` (long, gapless from 0 in its shard).

    `size`: a column of positive longs.  `order` should hold enough columns to tell rows apart; equal ones are told apart
    by where they were read.  No rows give no rows; with fewer rows than shards some shards stay empty.  A row larger than
    a shard's target makes the shards that it covers empty.  Rows of equal `group` (a column that leads the order) stay
    together if they are at most the share `whole` of a target.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    placed = written(
        rows.withColumn("_read", F.monotonically_increasing_id())
        .repartitionByRange(*order, F.col("_read"))
        .sortWithinPartitions(*order, F.col("_read"))
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id())
    )
    totals = placed.groupBy("_part").agg(F.sum(size).alias("_bytes"), F.count("*").alias("_rows"))
    # One row a partition: the only rows that meet in one task.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_part",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        F.sum("_bytes").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"),
    )
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    summed = (
        placed.withColumn("_bytes_inside", F.coalesce(F.sum(size).over(inside), F.lit(0)))
        .withColumn("_rows_inside", F.row_number().over(Window.partitionBy("_part").orderBy("_at")) - 1)
        .join(offsets, "_part")
    )
    middle = (F.col("_bytes_before") + F.col("_bytes_inside")) * 2 + F.col(size)  # twice the row's centre
    cut = summed.withColumn("shard", F.least(F.lit(shards - 1), F.expr("cast(0 as int)") + F.floor(middle * shards / (F.col("_all") * 2)).cast("int"))).withColumn("_row", F.col("_rows_before") + F.col("_rows_inside"))
    cut = cut.withColumn("_start", F.col("_bytes_before") + F.col("_bytes_inside"))
    cut = written(cut.drop("_part", "_at", "_read", "_bytes_inside", "_rows_inside", "_bytes_before", "_rows_before"))
    if group is not None:
        cut = _aligned(cut, size, shards, group, whole)
    cut = cut.drop("_start", "_all")
    first = cut.groupBy("shard").agg(F.min("_row").alias("_first"))  # one row a shard
    return cut.join(F.broadcast(first), "shard").withColumn("slot", F.col("_row") - F.col("_first")).drop("_row", "_first")


def _aligned(cut: DataFrame, size: str, shards: int, group: str, whole: float) -> DataFrame:
    """Groups that a cut splits go, with all their rows, where their middle lies."""
    ends = cut.groupBy("shard").agg(F.min_by(group, "_row").alias("first"), F.max_by(group, "_row").alias("last")).orderBy("shard").collect()  # one row a shard
    split = {b["first"] for a, b in zip(ends, ends[1:]) if a["last"] == b["first"]}
    if not split:
        return cut
    # at most one group a cut
    mine = cut.where(F.col(group).isin(*split)).groupBy(group).agg(F.min("_start").alias("_from"), F.sum(size).alias("_size"), F.max("_all").alias("_of"))
    moved = mine.where(F.col("_size") * shards <= F.col("_of") * whole).select(group, F.least(F.lit(shards - 1), F.floor((F.col("_from") * 2 + F.col("_size")) * shards / (F.col("_of") * 2))).cast("int").alias("_to"))
    return cut.join(F.broadcast(moved), group, "left").withColumn("shard", F.coalesce("_to", "shard")).drop("_to")


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Every row of `docs` (doc_id, text) in one of `shards` contiguous shards of near equal bytes.

    A row's size is its text's UTF-8 bytes (null: none) plus 8.  Equal texts are neighbours in the order, and a group of
    them lies in one shard unless it is larger than a twentieth of one: then it fills a run of shards.  A null text stands
    with the empty ones.  Repeated rows and null ids each keep a place of their own; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text.cast("binary")).alias("_group"),
    )
    out = prefix_shards(rows, "size", [F.col("_group"), F.col("doc_id")], shards, "_group")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
