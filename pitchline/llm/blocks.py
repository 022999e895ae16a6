"""Work on the members of index lists in bounded blocks.

A list of an inverted index is compared member by member inside one task, without
emitting pairs. A list longer than a chunk is dealt into parts, and each pair of
parts is a block of its own, so no task holds more than two parts; every pair of
members still meets in exactly one block of the list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_blocks(index: DataFrame, keys: list[str], member: str, chunk: int) -> DataFrame:
    """``index`` sorted by list and block, with the part of each member (``part``) and
    the two parts of its block (``part_a``, ``part_b``)."""
    long = index.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > chunk).select(*keys, F.ceil(F.col("n") / F.lit(chunk)).cast("int").alias("parts"))
    rows = index.join(long, keys, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64(member), F.col("parts")), F.lit(0)).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    rows = rows.select(*index.columns, "part", F.least("part", "other").alias("part_a"), F.greatest("part", "other").alias("part_b"))
    by = [*keys, "part_a", "part_b"]
    return rows.repartition(*by).sortWithinPartitions(*by)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], at_least: int = 1 << 15) -> Iterator[pa.Table]:
    """Tables of whole groups from sorted batches; singletons may be among them."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            rows += b.num_rows
        if rows >= at_least:
            t = pa.Table.from_batches(held)
            cut = int(starts(t, keys)[-1])
            if cut:
                yield t.slice(0, cut).combine_chunks()
            t = t.slice(cut).combine_chunks()
            held, rows = t.to_batches(), t.num_rows
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Where groups begin."""
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for k in keys:
        x = t.column(k).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


class Forest:
    """Labels of rows as links are added; keeps only links between different labels."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.a: list[np.ndarray] = []
        self.b: list[np.ndarray] = []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        new = self.label[i] != self.label[j]
        if not new.any():
            return
        i, j = i[new], j[new]
        self.a.append(i)
        self.b.append(j)
        label = self.label
        while True:
            x, y = label[i], label[j]
            apart = x != y
            if not apart.any():
                break
            np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
        self.label = label

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        return (np.concatenate(self.a), np.concatenate(self.b)) if self.a else (none, none)
