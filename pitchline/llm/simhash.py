"""SimHash near-duplicates through a byte-position inverted index.

A fingerprint is eight bytes at eight positions. If at most three bits differ, at
most three bytes do, so at least five positional bytes are shared (the guaranteed
minimum). The index lists fingerprints by (position set, bytes there); the position
sets are such that any five of eight positions contain one of them, so every such
pair meets. Within a list the shared positional bytes of each pair are tallied,
pairs below the minimum go, the rest are verified by their differing bits.

One list by a single byte would hold 1/256 of all fingerprints, so lists by three to
five bytes are used, more bytes with more fingerprints; all are exact. Equal
fingerprints are one node, lists are worked on in bounded blocks that emit only
spanning links, and components are found by contraction.

Defined cases: null text and text without words have fingerprint zero and link like
any other; a null id never is a component's id unless the component has no other;
rows that repeat share their fingerprint; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import Forest, in_blocks, starts, whole_groups
from .common import joined, staged, table, texts_of, tidied, whole_rows
from .components import components

SHINGLE = 3
SEED = 42
MAX_BITS = 3
BYTES = 8
LEAST_SHARED = BYTES - MAX_BITS
CHUNK = 4096
#: Up to so many distinct fingerprints, lists by so many bytes.
WIDTHS = ((1 << 22, 3), (1 << 30, 4), (1 << 63, 5))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """As a signed 64-bit integer."""
    words = text.lower().split()  # bytes: A-Z only, ASCII blanks only
    if not words:
        return 0
    whole, digest = b" ".join(words), xxhash.xxh64_digest
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    if len(words) <= shingle:
        hashes = [digest(whole, SEED)]
    else:
        begins = [0, *(e + 1 for e in ends[: len(words) - shingle])]
        hashes = [digest(whole[a:b], SEED) for a, b in zip(begins, ends[shingle - 1 :])]
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(np.frombuffer(b"".join(hashes[k : k + (1 << 14)]), np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = [fingerprint(t) for t in texts_of(b.column(2))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp, pa.int64())], ["doc_id", "h", "fp"])


def position_sets(width: int) -> list[tuple[int, ...]]:
    """Sets of ``width`` of eight positions, one of which is in any five positions.

    Of five positions at least three are in the same half, so the triples inside a
    half do for three. For four, five positions have four in one half, or three and
    two, which hold two and two: so those sets with none, two or four in the low half.
    """
    low, high = range(4), range(4, 8)
    if width == 3:
        return [*combinations(low, 3), *combinations(high, 3)]
    chosen = [*combinations(range(BYTES), width)]
    return [c for c in chosen if sum(p in low for p in c) % 2 == 0] if width == 4 else chosen


def _mask(positions: tuple[int, ...]) -> int:
    m = sum(0xFF << (8 * p) for p in positions)
    return m - (1 << 64) if m >> 63 else m


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links of each block: pairs at shift 1, 2, ... within their group."""
    by = ["positions", "key", "part_a", "part_b"]
    for t in whole_groups(batches, by):
        first = starts(t, by)
        size = np.diff(np.append(first, t.num_rows))
        big = np.repeat(size > 1, size)
        fp = t.column("fp").to_numpy().view(np.uint64)[big]
        part, cross = t.column("part").to_numpy()[big], (t.column("part_a").to_numpy() != t.column("part_b").to_numpy())[big]
        group = np.repeat(np.arange(len(size)), size)[big]
        left = np.arange(len(fp))
        forest, shift = Forest(len(fp)), 1
        while True:
            left = left[left + shift < len(fp)]
            left = left[group[left] == group[left + shift]]
            if not len(left):
                break
            i = left[(~cross[left] | (part[left] != part[left + shift])) & (forest.label[left] != forest.label[left + shift])]
            x = fp[i] ^ fp[i + shift]
            shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
            i, x = i[shared >= LEAST_SHARED], x[shared >= LEAST_SHARED]
            i = i[np.bitwise_count(x) <= MAX_BITS]
            forest.add(i, i + shift)
            shift += 1
        a, b = forest.links()
        fp = fp.view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], ["a", "b"])


def links(distinct: DataFrame, n: int) -> DataFrame:
    """(a, b): links that span the components of fingerprints (fp, distinct) at up to
    three differing bits."""
    width = next(w for most, w in WIDTHS if n <= most)
    masks = [_mask(p) for p in position_sets(width)]
    lists = F.array(*(F.struct(F.lit(k).alias("positions"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks)))
    index = distinct.select("fp", F.explode(lists).alias("x")).select("fp", "x.positions", "x.key")
    return in_blocks(index, ["positions", "key"], "fp", CHUNK).mapInArrow(tidied(_linked), "a long, b long")


def simhash_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, h, fp, component_id, first_h) for each row of ``docs`` (doc_id, text); h
    is a hash of the text, first_h the least one of the component's rows with its id."""
    own = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    rows = staged(own.mapInArrow(tidied(_fingerprints), f"doc_id {own.schema['doc_id'].dataType.simpleString()}, h long, fp long"), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "h")).alias("first")
    distinct = staged(rows.groupBy("fp").agg(first), "distinct")
    found = components(links(distinct.select("fp"), distinct.count()))
    of = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    of = staged(of, "members")
    least = of.groupBy("component").agg(F.min("first").alias("least"))
    of = of.join(least, "component").select("fp", F.col("least.doc_id").alias("component_id"), F.col("least.h").alias("first_h"))
    return rows.join(of, "fp").select("doc_id", "h", "fp", "component_id", "first_h")


def one_of_each_group(docs: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row of least id
    (of rows that agree in id and text, one). ``groups`` if not those by fingerprint.
    Texts stay where they are: ids of rows that go, and of rows that repeat, go to them."""
    groups = simhash_groups(docs) if groups is None else groups
    keys = groups.groupBy("doc_id", "h").agg(F.count("*").alias("n"), F.first("component_id").alias("c"), F.first("first_h").alias("f"))
    kept = F.col("doc_id").eqNullSafe(F.col("c")) & (F.col("h") == F.col("f"))
    marks = staged(keys.select(F.col("doc_id").alias("id"), "h", "n", kept.alias("kept")).where("NOT kept OR n > 1").select("id", "h", "kept"), "not-as-they-are")
    rows = whole_rows(docs, F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"))
    both = joined(rows, marks, ["id", "h"], "left")
    out = both.where("kept IS NULL").select("row")
    if not marks.where("kept").isEmpty():
        again = both.where("kept").groupBy("id", "h").agg(F.min_by("row", F.xxhash64("row")).alias("row"))  # combined before the shuffle
        out = out.unionByName(again.select("row"))
    return out.select("row.*")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
