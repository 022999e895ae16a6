"""Embedding near-duplicates through a pivot-permutation index.

A vector is described by its ``NEAREST`` nearest reference points (pivots), in order.
Near vectors see the pivots in nearly the same order, so they share several of them.
The inverted lists are by pairs of pivots, so members of a list share at least
``LEAST_SHARED`` = 2; each pair is verified by its cosine in double precision, in
bounded blocks that emit sums and spanning links, never pairs. A pair that meets in
several lists counts in one only: the list of its two smallest shared pivots.

Pivots are vectors from the table: those of the smallest hashes that are not near an
earlier one, ``4 * sqrt(n)`` of them between ``MIN_PIVOTS`` and ``MAX_PIVOTS``, out of
twice as many (the documented sample; every vector is indexed). Equal vectors are one class, compared once, with their number.

Defined cases: null or zero vectors, and those with null or non-finite components,
link with nothing and are their own component; vectors of different lengths never
link (a length with fewer than two pivots is one list, in blocks); null ids are kept, and are a component's id only
where it has no other; rows that repeat count as separate vectors; empty tables give
empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import Forest, in_blocks, starts, whole_groups
from .common import staged, table, tidied
from .components import components

COSINE = 0.95
NEAREST = 6
LEAST_SHARED = 2
MIN_PIVOTS = 128
MAX_PIVOTS = 4096
#: No two pivots are as near as this: the members of a large group of near copies
#: would else crowd each other's orders.
PIVOT_COSINE = 0.8
CHUNK = 2048


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # squares of very large or small numbers would not fit
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def spread(rows: np.ndarray, wanted: int) -> np.ndarray:
    """The first ``wanted`` rows that are not near an earlier one."""
    rows, kept = unit(rows), 0
    out = np.empty((min(wanted, len(rows)), rows.shape[1]))
    for x in rows:
        if kept == len(out):
            break
        if not kept or (out[:kept] @ x).max() < PIVOT_COSINE:
            out[kept] = x
            kept += 1
    return out[:kept]


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def nearest(rows: np.ndarray, pivots: np.ndarray, count: int = NEAREST) -> np.ndarray:
    """Numbers of the nearest pivots, nearest first; of equally near ones the first."""
    out = np.empty((len(rows), min(count, len(pivots))), np.int32)
    for k in range(0, len(rows), 1024):
        near = -(unit(rows[k : k + 1024]) @ pivots.T)
        top = np.argpartition(near, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
        top.sort(axis=1)
        out[k : k + 1024] = np.take_along_axis(top, np.argsort(np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1)
    return out


def _describe(pivots: dict[int, np.ndarray]):
    """Adds each vector's pivots in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = np.diff(b.column(2).offsets.to_numpy())
            for dim in np.unique(dims):
                some = b.take(pa.array(np.flatnonzero(dims == dim)))
                if len(pivots.get(dim, ())) >= LEAST_SHARED:
                    near = nearest(matrix(some.column(2)), pivots[dim])
                else:  # nothing to tell them apart by: one list
                    near = np.tile(np.arange(LEAST_SHARED, dtype=np.int32), (some.num_rows, 1))
                if some.num_rows:
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1) * near.shape[1], pa.int32()), pa.array(near.ravel(), pa.int32()))
                    yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), some.column(2), lists], ["cls", "copies", "v", "near"])

    return run


def _linked(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = ["dim", "p", "q", "part_a", "part_b"]
        for t in whole_groups(batches, by, 1 << 13):
            first = starts(t, by)
            size = np.diff(np.append(first, t.num_rows))
            cls, copies, part, q = (t.column(c).to_numpy() for c in ("cls", "copies", "part", "q"))
            cross = t.column("part_a").to_numpy() != t.column("part_b").to_numpy()
            forest, sums = Forest(t.num_rows), np.zeros(t.num_rows, np.int64)
            v_all, near_all = t.column("v").combine_chunks(), t.column("near").combine_chunks()
            v_all, near_all = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (v_all, near_all))
            for at, n in zip(first[size > 1], size[size > 1]):
                v, near = unit(matrix(v_all.slice(at, n))), matrix(near_all.slice(at, n))
                for k in range(0, n, 512):
                    i, j = np.nonzero(np.triu(v[k : k + 512] @ v.T >= threshold, k + 1))
                    i += k
                    if cross[at]:
                        apart = part[at + i] != part[at + j]
                        i, j = i[apart], j[apart]
                    for m in range(0, len(i), 1 << 15):
                        a, b = i[m : m + (1 << 15)], j[m : m + (1 << 15)]
                        forest.add(at + a, at + b)
                        shared = (near[a][:, :, None] == near[b][:, None, :]).any(axis=2)
                        here = ((near[a] <= q[at]) & shared).sum(axis=1) == LEAST_SHARED
                        sums[at : at + n] += np.bincount(a[here], copies[at + b[here]], n).astype(np.int64) + np.bincount(b[here], copies[at + a[here]], n).astype(np.int64)
            some = np.flatnonzero(sums)
            a, b = forest.links()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([cls[some], cls[a]])), pa.array(np.concatenate([sums[some], np.zeros(len(a), np.int64)])), pa.array(np.concatenate([cls[some], cls[b]]))],
                ["a", "links", "b"],
            )

    return run


def near_vectors(vectors: DataFrame, threshold: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id,
    embedding)."""
    spark = vectors.sparkSession
    v = F.col("embedding")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    good = F.coalesce(v.isNotNull() & (F.size(v) > 0) & F.forall(v, finite) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select("vec_id", F.when(good, F.xxhash64("embedding")).alias("cls"), F.when(good, v).alias("v"))
    ids = staged(rows.select("vec_id", "cls"), "vector-classes")
    classes = staged(rows.where("cls IS NOT NULL").groupBy("cls").agg(F.count("*").alias("copies"), F.first("v").alias("v"), F.min("vec_id").alias("least")), "classes")
    n = classes.count()
    wanted = int(min(MAX_PIVOTS, max(MIN_PIVOTS, 4 * n**0.5)))
    sample = classes.select("v").orderBy(F.xxhash64("cls"), "cls").limit(2 * wanted).collect()  # at most 2 * MAX_PIVOTS vectors
    by_dim: dict[int, list] = {}
    for (x,) in sample:
        by_dim.setdefault(len(x), []).append(x)
    pivots = {d: spread(np.array(x, np.float64), wanted) for d, x in by_dim.items()}
    v_type = classes.schema["v"].dataType.simpleString()
    described = classes.select("cls", "copies", "v").mapInArrow(tidied(_describe(pivots)), f"cls long, copies long, v {v_type}, near array<int>")
    pairs = F.flatten(F.transform(F.array_sort("near"), lambda p: F.transform(F.filter("near", lambda q: q > p), lambda q: F.struct(p.alias("p"), q.alias("q")))))
    index = described.select("cls", "copies", "v", "near", F.size("v").alias("dim"), F.explode(pairs).alias("x")).select("cls", "copies", "v", "near", "dim", "x.p", "x.q")
    found = staged(in_blocks(index, ["dim", "p", "q"], "cls", CHUNK).mapInArrow(tidied(_linked(threshold)), "a long, links long, b long"), "vector-links")
    sums = found.where("a = b").groupBy("a").agg(F.sum("links").alias("links"))
    comps = components(found.where("a <> b").select("a", "b"))
    of = classes.select("cls", "copies", "least").join(sums.withColumnRenamed("a", "cls"), "cls", "left").join(comps.withColumnRenamed("node", "cls"), "cls", "left")
    of = staged(of.select("cls", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "least", F.coalesce("component", "cls").alias("component")), "vector-members")
    least = of.groupBy("component").agg(F.min("least").alias("component_id"))
    of = of.join(least, "component").select("cls", "n_links", "component_id")
    out = ids.join(of, "cls", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
