"""Row order, temporal folds, blocks, strata and block permutation."""

from __future__ import annotations

from math import ceil

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ordering import CHUNK, row_index  # noqa: F401  (row_index is part of this module's interface)


def tscv_bounds(n: int, k: int) -> list[tuple[int, int, int]]:
    """(fold, start, end) of each validation part; training is all before its start."""
    size = n // (k + 1)
    if size == 0:
        raise ValueError(f"{n} rows are too few for {k} folds")
    return [(i, n - (k - i) * size, n - (k - i) * size + size) for i in range(k)]


def tscv_folds(df: DataFrame, k: int, n: int | None = None, rix: str = "rix") -> DataFrame:
    """Rows with ``fold`` and ``role`` (train, valid), a row once for each fold it is in."""
    n = df.count() if n is None else n
    folds = F.array(*(F.struct(F.lit(f).alias("fold"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for f, a, b in tscv_bounds(n, k)))
    rows = df.withColumn("_f", F.explode(folds)).where(F.col(rix) < F.col("_f.b"))
    role = F.when(F.col(rix) < F.col("_f.a"), "train").otherwise("valid")
    return rows.select(*df.columns, F.col("_f.fold").alias("fold"), role.alias("role"))


def block_bounds(n: int, blocks: int) -> list[int]:
    return np.linspace(0, n, blocks + 1).astype(np.int64).tolist()


def block_of(rix: str, n: int, blocks: int):
    """Number of the contiguous block of a row."""
    out = None
    for b, end in enumerate(block_bounds(n, blocks)[1:]):
        out = F.when(F.col(rix) < end, b) if out is None else out.when(F.col(rix) < end, b)
    return out


def strata_index(n: int, sample: int, strata: int) -> list[int]:
    """Rows of a sample spread evenly over contiguous strata."""
    if sample >= n:
        return list(range(n))
    bounds, out = np.linspace(0, n, strata + 1).astype(np.int64), []
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        take = min(max(1, sample // strata), int(hi - lo))
        if take > 0:
            out.append(np.linspace(lo, hi - 1, take).astype(np.int64))
    return np.unique(np.concatenate(out))[:sample].tolist()


def strata_sample(df: DataFrame, n: int, sample: int, strata: int, rix: str = "rix") -> DataFrame:
    """Rows of the stratified sample: ``sample`` is the feature's own bound."""
    ids = df.sparkSession.createDataFrame([(i,) for i in strata_index(n, sample, strata)], f"{rix} long")
    return df.join(F.broadcast(ids), rix, "left_semi")


def walk_forward_ends(n: int, k: int) -> list[int]:
    return np.linspace(n // 2, n, k + 1).astype(np.int64).tolist()[1:]


def autocorrelation(df: DataFrame, y: str, lags: int = 60, rix: str = "rix") -> DataFrame:
    """(lag, acf). Positions are cut into chunks; a chunk's task also gets the first
    ``lags`` rows of the next one, so rows look ahead without a join or an explode."""
    mean = df.agg(F.avg(y)).first()[0]  # one number
    own = df.select(F.col(rix).alias("r"), (F.col(y) - F.lit(mean)).alias("c"), F.expr(f"{rix} div {CHUNK}").alias("chunk"), F.lit(True).alias("own"))
    reach = -(-lags // CHUNK)
    halo = own.where(F.col("chunk") > 0).where(F.col("r") % CHUNK < lags) if reach == 1 else own
    rows = own
    for k in range(1, reach + 1):
        rows = rows.unionByName(halo.withColumn("chunk", F.col("chunk") - k).withColumn("own", F.lit(False)))
    ahead = Window.partitionBy("chunk").orderBy("r")
    terms = []
    for k in range(1, lags + 1):
        follows = F.lead("r", k).over(ahead) == F.col("r") + k
        terms.append(F.when(follows, F.col("c") * F.lead("c", k).over(ahead)).alias(f"t{k}"))
    sums = rows.select("c", "own", *terms).where("own").agg(F.sum(F.col("c") * F.col("c")).alias("var"), *(F.coalesce(F.sum(f"t{k}"), F.lit(0.0)).alias(str(k)) for k in range(1, lags + 1)))
    out = sums.unpivot(["var"], [str(k) for k in range(1, lags + 1)], "lag", "s")
    return out.select(F.col("lag").cast("int").alias("lag"), (F.col("s") / F.col("var")).alias("acf"))


def acf_block_size(acf: list[float], n: int, min_block: int = 1, max_block: int = 250) -> tuple[int, float, int]:
    """(block, noise band, lag at which it is reached) from the lags in order."""
    if n < 20 or not acf:
        return min_block, 0.0, 1
    band, cut = 2 / np.sqrt(n), 1
    for lag, r in enumerate(acf, 1):
        if abs(r) < band:
            cut = lag
            break
        cut = lag + 1
    block = min(max(3 * (cut - 1) if cut > 1 else 1, min_block), max_block)
    return min(block, max(1, n // 10)), float(band), cut


def run_length_changes(df: DataFrame, label: str, rix: str = "rix") -> DataFrame:
    """(n, changes): how often the label differs from the row before."""
    before = df.select((F.col(rix) + 1).alias(rix), F.col(label).alias("_before"))
    both = df.join(before, rix, "left")
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("_before").isNotNull() & (F.col("_before") != F.col(label))).alias("changes"))


def run_length_block(n: int, changes: int) -> int:
    return int(min(max(ceil(3 * n / (changes + 1)), 5), max(5, min(250, n // 10))))


def block_permutation(rng: np.random.Generator, n: int, block: int) -> np.ndarray:
    """Source row of each row: contiguous blocks in random order; blocks of one row are
    an independent permutation."""
    if block <= 1:
        return rng.permutation(n)
    starts = np.arange(0, n, block)
    return np.concatenate([np.arange(s, min(s + block, n)) for s in starts[rng.permutation(len(starts))]])


def safe_permutation(rng: np.random.Generator, y: np.ndarray, block: int, classes: bool, tries: int | None = None) -> np.ndarray:
    """A block permutation whose prefix keeps every class (or any variance), with an
    independent one after some tries."""
    for _ in range(tries or (20 if classes else 10)):
        out = y[block_permutation(rng, len(y), block)]
        if (len(np.unique(out)) == len(np.unique(y))) if classes else np.var(out) > 0:
            return out
    return y[rng.permutation(len(y))]


def permuted_targets(spark: SparkSession, y: np.ndarray, block: int, runs: int, seed: int, classes: bool = False) -> DataFrame:
    """(run, rix, y): one generator in run order, so the same for any parallelism."""
    import pandas as pd

    rng = np.random.default_rng(seed)
    parts = [pd.DataFrame({"run": r, "rix": np.arange(len(y)), "y": safe_permutation(rng, y, block, classes)}) for r in range(runs)]
    return spark.createDataFrame(pd.concat(parts))
