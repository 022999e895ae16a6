"""Contiguous byte-balanced shards by global prefix sums.

Rows have a total order: hash of the text, then (only where a hash range holds many
rows, say a large group of copies) a salt from the id, then hash and id. Bytes and
rows are summed per partition of that order, the partition totals are summed up to
running totals, and a row's global position is its partition's running total plus
its position inside. Shards are cut at equal byte targets, so each is a contiguous
piece of the order. Equal texts are neighbours: a hash range of up to 1/64 of a
shard goes whole to the shard of its middle, a larger one is cut at rows.

The text is read once, into a narrow staged table. No task gets more than one hash
range's rows, and large ranges are salted in proportion to their rows.

Defined cases: a null text has no bytes (size 1, crc32 0) and equals the empty text
for the order; null ids are kept; rows that repeat are separate rows; an empty table
gives an empty result. law is ``bytes``, so ``grown_shard`` is null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import prefix_sums, staged, table

SHARDS = 8
RANGE_BITS = 10
#: Rows of a salted partition: at least these, and at most 2^20 partitions in all.
PART_ROWS = 128
MAX_PARTS = 1 << 20
LIGHT = 64


def shards(docs: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of
    ``docs`` (doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    slim = staged(docs.select("doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h")), "shard-sizes")
    slim = slim.withColumn("range", F.shiftrightunsigned("h", 64 - RANGE_BITS).cast("int"))
    everything = Window.partitionBy()
    ranges = slim.groupBy("range").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))
    ranges = ranges.select("*", F.sum("bytes").over(everything).alias("total"), F.sum("rows").over(everything).alias("all_rows"))
    part_rows = F.greatest(F.lit(PART_ROWS), F.ceil(F.col("all_rows") / F.lit(MAX_PARTS)))
    # at most 2^RANGE_BITS rows
    ranges = ranges.select("range", "bytes", "total", F.ceil(F.col("rows") / part_rows).cast("long").alias("salts"))
    rows = slim.join(F.broadcast(ranges.select("range", "salts")), "range").withColumn("salt", F.pmod(F.xxhash64("doc_id", "h", F.lit("salt")), "salts"))
    parts = rows.groupBy("range", "salt").agg(F.sum("size").alias("part_bytes"), F.count("*").alias("part_n"))
    parts = prefix_sums(parts, [], "range", "salt", ["part_bytes", "part_n"])
    of_range = ranges.join(parts.groupBy("range").agg(F.min("before_part_bytes").alias("before_range")), "range")
    parts = parts.join(F.broadcast(of_range.select("range", "bytes", "total", "before_range")), "range")
    inside = Window.partitionBy("range", "salt").orderBy("h", "doc_id", "size", "text_crc32")
    placed = rows.join(parts, ["range", "salt"]).select(
        "doc_id", "size", "text_crc32", "bytes", "total", "before_range",
        (F.col("before_part_bytes") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("before"),
        (F.col("before_part_n") + F.row_number().over(inside) - 1).alias("row"),
    )
    light = F.col("bytes") * F.lit(LIGHT * n_shards) <= F.col("total")
    twice_middle = F.when(light, 2 * F.col("before_range") + F.col("bytes")).otherwise(2 * F.col("before") + F.col("size"))
    shard = F.least(F.expr(f"({n_shards} * twice_middle) div (2 * total)"), F.lit(n_shards - 1)).cast("int")
    placed = staged(placed.withColumn("twice_middle", twice_middle).select("doc_id", "size", "text_crc32", shard.alias("shard"), "row"), "shard-rows")
    first = placed.groupBy("shard").agg(F.min("row").alias("first_row"))  # a row for each shard
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first_row")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents"))
