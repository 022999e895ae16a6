"""Global order without a task that holds a whole table or group: positions, running
sums, ranks and exact quantiles.

Rows are ranged into partitions once, sorted and written to the shared folder with
their partition and place; counts and offsets are read from that one table, so they
agree whatever the planner, the sampling or a lost executor does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import staged

#: Rows of one level of running sums that share a task.
CHUNK = 4096


def ranged(df: DataFrame, order: list[str], tag: str) -> DataFrame:
    """``df`` in the shared folder, with the number of its range (``_part``) and its
    place there (``_place``, from 0)."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    # the id's upper bits are the partition, its lower 33 bits the place
    rows = rows.withColumn("_part", F.shiftright("_place", 33)).withColumn("_place", F.col("_place").bitwiseAND((1 << 33) - 1))
    return staged(rows, tag)


def row_index(df: DataFrame, order: list[str], name: str = "rix") -> DataFrame:
    """0-based global position by ``order`` (unique)."""
    rows = ranged(df, order, "row-index")
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each partition
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_place")).select(*df.columns, name)


def prefix_sums(buckets: DataFrame, keys: list[str], coarse: str, fine: str, values: list[str]) -> DataFrame:
    """Exclusive running sums of ``values`` (added as ``before_<value>``) over rows
    that are unique by (keys, coarse, fine), in that order within ``keys``; none of
    these may be null.

    Two levels, so that no task gets more than one coarse bucket's rows or one
    row for each coarse bucket.
    """
    inner = Window.partitionBy(*keys, coarse).orderBy(fine).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*keys).orderBy(coarse).rowsBetween(Window.unboundedPreceding, -1)
    tops = buckets.groupBy(*keys, coarse).agg(*(F.sum(v).alias(f"top_{v}") for v in values))
    tops = tops.select(*keys, coarse, *(F.coalesce(F.sum(f"top_{v}").over(outer), F.lit(0)).alias(f"top_{v}") for v in values))
    rows = buckets.select("*", *(F.coalesce(F.sum(v).over(inner), F.lit(0)).alias(f"in_{v}") for v in values))
    both = rows.join(tops, [*keys, coarse])
    return both.select(*buckets.columns, *((F.col(f"in_{v}") + F.col(f"top_{v}")).alias(f"before_{v}") for v in values))


def running_sums(df: DataFrame, key: str, position: str, values: dict[str, Column]) -> DataFrame:
    """Adds, for each name, the sum of its expression over the earlier rows of the same
    ``key`` (not null) by ``position`` (unique); chunks of positions are summed first,
    so a key may hold any part of the rows."""
    own = df.select("*", F.expr(f"{position} div {CHUNK}").alias("_chunk"), *(c.alias(f"_v_{n}") for n, c in values.items()))
    cells = own.groupBy(key, "_chunk").agg(*(F.sum(f"_v_{n}").alias(f"_s_{n}") for n in values)).withColumn("_top", F.expr(f"_chunk div {CHUNK}"))
    cells = cells.select(key, "_chunk", "_top", *(F.coalesce(F.col(f"_s_{n}"), F.lit(0)).alias(f"_s_{n}") for n in values))
    cells = prefix_sums(cells, [key], "_top", "_chunk", [f"_s_{n}" for n in values]).select(key, "_chunk", *(f"before__s_{n}" for n in values))
    inside = Window.partitionBy(key, "_chunk").orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    rows = own.select("*", *(F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)).alias(f"_i_{n}") for n in values)).join(cells, [key, "_chunk"])
    return rows.select(*df.columns, *((F.col(f"_i_{n}") + F.col(f"before__s_{n}")).alias(n) for n in values))


def counted_values(df: DataFrame, x: str, by: list[str]) -> DataFrame:
    """(by..., x, n, before) of each distinct value (missing ones left out): its rows and
    the rows of lesser values in its group."""
    counts = df.groupBy(*by, x).agg(F.count(x).alias("n"))  # missing values count 0, so they move nobody
    rows = ranged(counts, [*by, x], "value-counts")
    inner = Window.partitionBy("_part", *by).orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("_part", *by).agg(F.sum("n").alias("_n"))  # a row for each partition and group
    outer = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", *by, F.coalesce(F.sum("_n").over(outer), F.lit(0)).alias("_offset"))
    same = F.lit(True)
    for c in ["_part", *by]:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    rows = rows.select("*", F.coalesce(F.sum("n").over(inner), F.lit(0)).alias("_in")).where(F.col(x).isNotNull())
    return rows.alias("l").join(F.broadcast(parts).alias("r"), same).select(*(F.col(f"l.{c}").alias(c) for c in by), F.col(f"l.{x}").alias(x), "n", (F.col("_in") + F.col("_offset")).alias("before"))


def with_average_rank(df: DataFrame, x: str, by: list[str], out: str) -> DataFrame:
    """Adds the rank of ``x`` in its group, ties at their mean; none for a missing one."""
    ranks = counted_values(df, x, by).select(*by, x, (F.col("before") + (F.col("n") + 1) / F.lit(2.0)).alias(out))
    same = F.lit(True)
    for c in [*by, x]:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    return df.alias("l").join(ranks.alias("r"), same, "left").select(*(F.col(f"l.{c}").alias(c) for c in df.columns), out)


def quantiles(df: DataFrame, x: str, probs: list[float], by: list[str] | None = None) -> DataFrame:
    """(by..., q0, q1, ...): exact quantiles, linear between neighbours, of the values
    that are not missing; groups without any have no row."""
    by = by or []
    counts = counted_values(df, x, by)
    totals = counts.groupBy(*by).agg(F.sum("n").alias("_all"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    rows = counts.alias("l").join(F.broadcast(totals).alias("r"), same).select(*(F.col(f"l.{c}").alias(c) for c in by), F.col(x).cast("double").alias("_x"), "n", "before", "_all")
    at = lambda k: F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("n")), F.col("_x")))
    aggs = []
    for k, p in enumerate(probs):
        place = (F.col("_all") - 1) * F.lit(float(p))
        aggs += [at(F.floor(place)).alias(f"_lo{k}"), at(F.ceil(place)).alias(f"_hi{k}"), F.first(place - F.floor(place)).alias(f"_w{k}")]
    out = rows.groupBy(*by).agg(*aggs)
    return out.select(*by, *((F.col(f"_lo{k}") + F.col(f"_w{k}") * (F.col(f"_hi{k}") - F.col(f"_lo{k}"))).alias(f"q{k}") for k in range(len(probs))))
