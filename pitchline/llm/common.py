"""Shared plumbing: reading tables, shared-folder staging, word hashing."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import prefix_sums  # noqa: F401  (used by operators of this subpackage)
from ..staging import new_folder, release, remove, shared_dir, staged  # noqa: F401

#: Java regex of a word: a run of anything but ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"

#: Entries a worker's word cache may hold before it starts anew (about 40 MB).
CACHE_WORDS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- the shared folder -------------------------------------------------------


def local_path(path: str) -> str:
    """The path by which Python opens a shared folder; it must be mounted."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"spark.checkpoint.dir must be a mounted folder for memory-mapped models, not {path}")
    return path


# -- workers ----------------------------------------------------------------------


def tidied(run):
    """``run`` for mapInArrow, giving unused memory back when a task ends: workers are
    used again by later stages, and would else keep the most that any of them took."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return whole


# -- joins with tables of unknown size --------------------------------------------

#: Rows of a narrow table (ids and hashes) that may be broadcast: some 12 MB.
BROADCAST_ROWS = 250_000
SALTS = 16


def whole_rows(df: DataFrame, *keys) -> DataFrame:
    """The rows of ``df`` as one struct ``row`` beside ``keys``: no name of a helper
    column can clash with the caller's."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), *keys)


def joined(rows: DataFrame, small: DataFrame, keys: list[str], how: str, salt=None) -> DataFrame:
    """``rows`` with the columns of ``small`` (staged, unique by ``keys``, equal nulls
    match): by broadcast if its size allows it, else by a shuffle in which rows of one
    key are spread by ``salt`` (a hash of the row)."""
    other = small.select(*(F.col(k).alias(f"_of_{k}") for k in keys), *(c for c in small.columns if c not in keys))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    if small.count() <= BROADCAST_ROWS:
        out = rows.join(F.broadcast(other), same, how)
    else:
        salt = F.lit(0) if salt is None else F.pmod(salt, F.lit(SALTS))
        other = other.withColumn("_of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = rows.withColumn("_salt", salt.cast("int")).join(other, same & (F.col("_salt") == F.col("_of_salt")), how).drop("_salt", "_of_salt")
    return out.drop(*(f"_of_{k}" for k in keys))


# -- words -------------------------------------------------------------------


class WordHashes(dict):
    """Word (bytes) -> XXH64 as int64; filled on demand, bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        v = xxhash.xxh64_intdigest(word)
        v = self[word] = v - (1 << 64) if v >> 63 else v
        return v

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words)).view(np.uint64)


_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * _A
    x = x ^ (x >> np.uint64(29))
    x = x * _B
    return x ^ (x >> np.uint64(32))


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each ordered pair of hashes."""
    return mixed(a * np.uint64(3) + mixed(b ^ _B))


def texts_of(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 of each text, null as empty."""
    for x in column.cast(pa.large_binary()):
        yield x.as_py() or b""


def id_crc_mod5(col):
    """crc32 of the id as text, modulo 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % 5
