"""Ranks, correlations, screens and significance."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ordering


def average_rank(x: str, by: list[str]):
    """Rank with ties at their mean, for groups that a task can hold (features); see
    :func:`ordering.with_average_rank` for any size."""
    order = Window.partitionBy(*by).orderBy(x)
    return F.rank().over(order) + (F.count("*").over(Window.partitionBy(*by, x)) - 1) / F.lit(2.0)


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """(by..., rho, n) of the rows where neither value is missing."""
    rows = df.select(*by, x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranks = ordering.with_average_rank(ordering.with_average_rank(rows, x, by, "_rx"), y, by, "_ry")
    return ranks.groupBy(*by).agg(F.corr("_rx", "_ry").alias("rho"), F.count("*").alias("n"))


def spearman_p(rho: float, n: int) -> float:
    """Two-sided p of a rank correlation, from Student's t by numerical integration."""
    if n < 3 or not math.isfinite(rho):
        return float("nan")
    if abs(rho) >= 1:
        return 0.0
    df = n - 2
    t = abs(rho) * math.sqrt(df / (1 - rho * rho))
    log_c = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi)
    u = np.linspace(0.0, math.atan(t / math.sqrt(df)), 4001)  # x = sqrt(df) tan u
    f = np.cos(u) ** (df - 1)
    h = u[1] - u[0]
    area = h / 3 * (f[0] + f[-1] + 4 * f[1:-1:2].sum() + 2 * f[2:-1:2].sum())
    return float(max(0.0, 1 - 2 * math.exp(log_c) * math.sqrt(df) * area))


def top_value_share(long: DataFrame, feature: str = "feature", value: str = "value") -> DataFrame:
    """(feature, n, missing, top, top_non_missing) from long form, in one shuffle by
    (feature, value): counts of values, missing being a value of its own too."""
    counts = long.groupBy(feature, value).count()
    missing = F.col(value).isNull()
    return counts.groupBy(feature).agg(F.sum("count").alias("n"), F.coalesce(F.sum(F.when(missing, F.col("count"))), F.lit(0)).alias("missing"), F.max("count").alias("top"), F.coalesce(F.max(F.when(~missing, F.col("count"))), F.lit(0)).alias("top_non_missing"))


def drop_sparse(long: DataFrame, top_share: float, missing_share: float | None = None, feature: str = "feature", value: str = "value") -> DataFrame:
    """(feature, share, missing_rate, kept). Without ``missing_share`` missing counts as a
    value; with it, features missing more often go, and the share is among the rest."""
    s = top_value_share(long, feature, value).withColumn("missing_rate", F.col("missing") / F.col("n"))
    if missing_share is None:
        s = s.withColumn("share", F.col("top") / F.col("n"))
        return s.select(feature, "share", "missing_rate", (F.col("share") <= top_share).alias("kept"))
    s = s.withColumn("share", F.try_divide(F.col("top_non_missing"), F.col("n") - F.col("missing")))
    return s.select(feature, "share", "missing_rate", ((F.col("missing_rate") <= missing_share) & (F.coalesce("share", F.lit(1.0)) <= top_share)).alias("kept"))


def block_correlations(long: DataFrame, block: str = "block", feature: str = "feature", value: str = "value", rix: str = "rix") -> DataFrame:
    """(a, b, rho): median over blocks of the absolute rank correlation of each pair of
    features. A row's centred ranks are one vector; tasks add up products of vectors, so
    what moves is features squared a task and block, not a row. A missing value counts
    as the block's mean rank; a feature that does not vary in a block has none there."""
    ranks = ordering.with_average_rank(long.select(block, feature, rix, value), value, [block, feature], "_r")
    half = ranks.groupBy(block, feature).agg(((F.count(value) + 1) / F.lit(2.0)).alias("_half"))
    names = [r[0] for r in long.select(feature).distinct().orderBy(feature).collect()]  # features, not rows
    kind, at = long.schema[feature].dataType.simpleString(), {f: k for k, f in enumerate(names)}
    ranks = ranks.join(F.broadcast(half), [block, feature]).where(F.col("_r").isNotNull())
    vectors = ranks.groupBy(block, rix).agg(F.collect_list(F.struct(F.col(feature).alias("f"), (F.col("_r") - F.col("_half")).alias("c"))).alias("v"))

    def products(batches):
        sums: dict = {}
        for pdf in batches:
            for b, part in pdf.groupby("block"):
                x = np.zeros((len(part), len(names)))
                for k, v in enumerate(part["v"]):
                    for cell in v:
                        x[k, at[cell["f"]]] = cell["c"]
                sums[b] = sums.get(b, 0.0) + x.T @ x
        for b, g in sums.items():
            for k in range(len(names)):
                yield pd.DataFrame({"block": [b], "i": [k], "g": [g[k]]})

    block_kind = long.schema[block].dataType.simpleString()
    grams = vectors.select(F.col(block).alias("block"), "v").mapInPandas(products, f"block {block_kind}, i int, g array<double>")
    cells = grams.select("block", "i", F.posexplode("g").alias("j", "x")).where("i <= j").groupBy("block", "i", "j").agg(F.sum("x").alias("x"))
    own = cells.where("i = j").select("block", F.col("i").alias("k"), F.col("x").alias("d"))
    pairs = cells.where("i < j").join(F.broadcast(own.toDF("block", "i", "di")), ["block", "i"]).join(F.broadcast(own.toDF("block", "j", "dj")), ["block", "j"])
    rho = F.when((F.col("di") > 0) & (F.col("dj") > 0), F.abs(F.col("x")) / F.sqrt(F.col("di") * F.col("dj")))
    per = pairs.select("i", "j", rho.alias("rho")).groupBy("i", "j").agg(F.median("rho").alias("rho"))
    name = F.array(*(F.lit(f) for f in names)) if names else F.array().cast(f"array<{kind}>")
    return per.select(F.get(name, F.col("i")).alias("a"), F.get(name, F.col("j")).alias("b"), "rho")


def average_linkage(distance: np.ndarray, cut: float) -> list[int]:
    """Cluster numbers of a symmetric matrix of features, by average linkage cut at a
    height; the matrix has features squared cells, not rows."""
    d = distance.astype(float).copy()
    n = len(d)
    np.fill_diagonal(d, np.inf)
    members: list[list[int] | None] = [[k] for k in range(n)]
    while n > 1:
        i, j = divmod(int(np.argmin(d)), len(d))
        if not d[i, j] <= cut:
            break
        i, j = min(i, j), max(i, j)
        wi, wj = len(members[i]), len(members[j])
        row = (wi * d[i] + wj * d[j]) / (wi + wj)
        row[i] = np.inf
        d[i], d[:, i] = row, row
        d[j], d[:, j] = np.inf, np.inf
        members[i], members[j] = members[i] + members[j], None
        n -= 1
    label = [0] * len(d)
    for k, m in enumerate(x for x in members if x):
        for f in m:
            label[f] = k
    return label


def cluster_representatives(pairs: list[tuple], features: list, score: dict, threshold: float) -> list[tuple]:
    """(feature, cluster, kept): of each cluster the feature of the highest score, the
    first of equal ones, stays."""
    at = {f: k for k, f in enumerate(features)}
    d = np.ones((len(features), len(features)))
    for a, b, rho in pairs:
        d[at[a], at[b]] = d[at[b], at[a]] = min(max(1 - (rho if rho is not None and rho == rho else 0.0), 0.0), 2.0)
    label = average_linkage(d, 1 - threshold) if len(features) > 1 else [0] * len(features)
    best: dict[int, object] = {}
    for f, c in zip(features, label):
        if c not in best or score.get(f, 0.0) > score.get(best[c], 0.0):
            best[c] = f
    return [(f, c, best[c] == f) for f, c in zip(features, label)]


def bh_adjust(df: DataFrame, p: str, key: str, out: str = "p_adj") -> DataFrame:
    """Benjamini and Hochberg's step-up over all rows (one for each feature)."""
    asc = Window.orderBy(p, key)
    ranked = df.withColumn("_rank", F.row_number().over(asc)).withColumn("_m", F.count("*").over(Window.partitionBy()))
    down = Window.orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn(out, F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_rank")).over(down))).drop("_rank", "_m")


def null_statistics(null: DataFrame, real: DataFrame, feature: str = "feature", imp: str = "imp", real_imp: str = "imp_real") -> DataFrame:
    """(feature, imp_real, runs, mean, std, max, exceed, p_emp, z, log_mean, log_std)."""
    both = null.join(real, feature)
    log = F.log(F.col(imp) + F.lit(1e-12))
    stats = both.groupBy(feature).agg(
        F.first(real_imp).alias(real_imp), F.count(imp).alias("runs"), F.avg(imp).alias("mean"), (F.stddev_samp(imp) + F.lit(1e-12)).alias("std"), F.stddev_samp(imp).alias("raw_std"),
        F.max(imp).alias("max"), F.count_if(F.col(imp) >= F.col(real_imp)).alias("exceed"), F.avg(log).alias("log_mean"), F.stddev_samp(log).alias("log_std"),
    )
    stats = stats.withColumn("p_emp", (1 + F.col("exceed")) / (F.col("runs") + 1))
    return stats.withColumn("z", (F.col(real_imp) - F.col("mean")) / F.col("std"))


def lognormal_tail(x: float, n: int, spread: float | None, top: float, mean: float, std: float | None) -> float:
    """P of a null importance of at least x, from the logarithms' mean and deviation."""
    if n < 5 or spread is None or not spread > 0:
        return 1.0 if x <= top else 1e-12
    if x <= 0:
        return 1.0
    if not std > 0:
        return 1e-12
    return min(max(0.5 * math.erfc((math.log(x + 1e-12) - mean) / std / math.sqrt(2)), 1e-300), 1.0)


def _lognormal_tails(real: pd.Series, runs: pd.Series, raw_std: pd.Series, top: pd.Series, mean: pd.Series, std: pd.Series) -> pd.Series:
    return pd.Series([lognormal_tail(*x) for x in zip(real, runs, raw_std, top, mean, std)])


def gamma_tail(x: float, null: np.ndarray) -> float:
    """P of at least x under a gamma fitted to null importances by maximum likelihood."""
    null = null[np.isfinite(null)]
    if len(null) < 5 or null.std() == 0:
        return 1.0 if x <= max(null.max(initial=0.0), 0.0) else 1e-12
    if x <= 0:
        return 1.0
    null = np.maximum(null, 1e-12)  # a gamma has no mass at zero
    s = math.log(null.mean()) - np.log(null).mean()
    a = (3 - s + math.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)
    for _ in range(30):
        step = (math.log(a) - float(_digamma(np.array([a]))[0]) - s) / (1 / a - float((_digamma(np.array([a + 1e-5])) - _digamma(np.array([a - 1e-5])))[0]) / 2e-5)
        a = max(a - step, 1e-6)
        if abs(step) < 1e-10 * a:
            break
    return min(max(_gamma_q(a, x * a / null.mean()), 1e-300), 1.0)


def _gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma, by its series or its continued fraction."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        for k in range(1, 2000):
            term *= x / (a + k)
            total += term
            if term < total * 1e-15:
                break
        return 1 - front * total
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for k in range(1, 2000):
        an = -k * (k - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


TAILS = ("lognormal", "gamma")


def _gamma_tails(null: DataFrame, real: DataFrame, real_imp: str) -> DataFrame:
    """(feature, p_param): each feature's runs, of which there are hundreds, make a fit."""
    fit = lambda runs, x: pd.Series([gamma_tail(float(b), np.sort(np.asarray(a, float))) for a, b in zip(runs, x)])
    runs = null.groupBy("feature").agg(F.collect_list("imp").alias("runs")).join(real, "feature")
    return runs.select("feature", F.pandas_udf(fit, "double")("runs", real_imp).alias("p_param"))


def significance(null: DataFrame, real: DataFrame, method: str = "zscore", alpha: float = 0.05, z_min: float = 4.0, real_imp: str = "imp_real", tail: str = "lognormal", floor_guard: bool = True) -> DataFrame:
    """Adds p_param (right tail of the distribution ``tail`` fitted to the null), both
    adjusted p, at_floor and ``significant`` by the method."""
    if tail not in TAILS:
        raise ValueError(f"unknown tail {tail!r}; known: {', '.join(TAILS)}")
    s = null_statistics(null, real, real_imp=real_imp)
    if tail == "gamma":
        s = s.join(_gamma_tails(null, real, real_imp), "feature")
    else:
        s = s.withColumn("p_param", F.pandas_udf(_lognormal_tails, "double")(real_imp, "runs", "raw_std", "max", "log_mean", "log_std"))
    s = bh_adjust(bh_adjust(s, "p_emp", "feature", "p_emp_adj"), "p_param", "feature", "p_param_adj")
    s = s.withColumn("at_floor", F.col("exceed") == 0)
    rules = {"empirical_bh": F.col("p_emp_adj") <= alpha, "parametric_bh": (F.col("p_param_adj") <= alpha) & (F.col("at_floor") | F.lit(not floor_guard)), "zscore": F.col("z") >= z_min}
    if method not in rules:
        raise ValueError(f"unknown method {method!r}; known: {', '.join(rules)}")
    return s.withColumn("significant", rules[method]).drop("raw_std")


def preflight(runs: int, features: int, alpha: float) -> dict:
    """Whether empirical p-values of so many runs can pass the first step-up bound."""
    floor, first = 1 / (runs + 1), alpha / max(features, 1)
    share = floor / alpha
    return {"floor": floor, "bh_rank_1": first, "floor_share": share, "empirical_bh": share <= 0.30, "parametric_bh": True, "viable": share <= 1}


def stability(importances: DataFrame, k: float, minimum: float, window: str = "window", feature: str = "feature", imp: str = "imp") -> DataFrame:
    """(feature, mean, std, score, stable): percentile rank in each window, its mean less
    k population deviations."""
    n = F.count("*").over(Window.partitionBy(window))
    pct = importances.select(feature, (average_rank(imp, [window]) / n).alias("pct"))
    s = pct.groupBy(feature).agg(F.avg("pct").alias("mean"), F.stddev_pop("pct").alias("std"))
    s = s.withColumn("score", F.col("mean") - F.lit(float(k)) * F.col("std"))
    return s.withColumn("stable", F.col("score") >= minimum)


def jaccard_pairs(sets: DataFrame, of: str, item: str) -> DataFrame:
    """(a, b, common, either, jaccard) of each pair of sets; items meet by an equi-join."""
    sets = sets.select(of, item).distinct()
    sizes = sets.groupBy(of).agg(F.count("*").alias("n"))
    a, b = sets.select(F.col(of).alias("a"), item), sets.select(F.col(of).alias("b"), item)
    common = a.join(b, item).where("a < b").groupBy("a", "b").agg(F.count("*").alias("common"))
    na, nb = sizes.select(F.col(of).alias("a"), F.col("n").alias("na")), sizes.select(F.col(of).alias("b"), F.col("n").alias("nb"))
    pairs = na.join(nb, F.col("a") < F.col("b")).join(common, ["a", "b"], "left").withColumn("common", F.coalesce("common", F.lit(0)))
    either = F.col("na") + F.col("nb") - F.col("common")
    return pairs.select("a", "b", "common", either.alias("either"), F.when(either > 0, F.col("common") / either).otherwise(1.0).alias("jaccard"))


def mutual_information_discrete(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """(by..., mi) in nats, from the contingency table."""
    cells = df.groupBy(*by, x, y).agg(F.count("*").alias("n"))
    all_, px, py = (F.sum("n").over(Window.partitionBy(*by, *c)) for c in ([], [x], [y]))
    cells = cells.select(*by, "n", all_.alias("t"), px.alias("nx"), py.alias("ny"))
    return cells.groupBy(*by).agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("nx") * F.col("ny")))).alias("mi"))


def _digamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    out, x = np.zeros_like(x), x.copy()
    while (small := x < 6).any():
        out[small] -= 1 / x[small]
        x[small] += 1
    f = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f / 252))


def mi_discrete_target(x: np.ndarray, y: np.ndarray, k: int = 3) -> float:
    """Mutual information of a continuous and a discrete variable by nearest neighbours."""
    ks, ms, ns, n = [], [], [], 0
    order = np.sort(x)
    for c in np.unique(y):
        own = np.sort(x[y == c])
        if len(own) < 2:
            continue
        near = min(k, len(own) - 1)
        wide = np.pad(own, near, constant_values=(-np.inf, np.inf))
        ahead = np.stack([np.abs(wide[s : s + len(own)] - own) for s in range(2 * near + 1) if s != near])
        radius = np.sort(ahead, axis=0)[near - 1] * (1 - 1e-9)  # the neighbour itself stays outside
        ms.append(np.searchsorted(order, own + radius, "right") - np.searchsorted(order, own - radius, "left"))
        ks.append(np.full(len(own), near))
        ns.append(np.full(len(own), len(own)))
        n += len(own)
    if not n:
        return 0.0
    ks, ms, ns = (np.concatenate(z) for z in (ks, ms, ns))
    return float(max(0.0, _digamma(np.array([n]))[0] + _digamma(ks).mean() - _digamma(ns).mean() - _digamma(np.maximum(ms, 1)).mean()))


def mi_continuous_target(x: np.ndarray, y: np.ndarray, k: int = 3) -> float:
    """Mutual information of two continuous variables: distances to the k-th neighbour in
    the plane (largest coordinate), neighbours counted on each axis. Rows squared in
    slices, so for bounded samples."""
    n = len(x)
    if n <= k:
        return 0.0
    sx, sy, total = np.sort(x), np.sort(y), 0.0
    for a in range(0, n, 256):
        px, py = x[a : a + 256, None], y[a : a + 256, None]
        d = np.maximum(np.abs(px - x), np.abs(py - y))
        radius = np.nextafter(np.partition(d, k, axis=1)[:, k], 0)  # the point itself is nearest
        within = [np.searchsorted(z, p[:, 0] + radius, "right") - np.searchsorted(z, p[:, 0] - radius, "left") for z, p in ((sx, px), (sy, py))]
        total += float((_digamma(within[0]) + _digamma(within[1])).sum())
    return max(0.0, float(_digamma(np.array([n]))[0] + _digamma(np.array([k]))[0] - total / n))


def mutual_information_of(x: np.ndarray, y: np.ndarray, classes: bool, k: int = 3, seeds: tuple[int, ...] = (0,)) -> float:
    """Mean over seeds of the estimate, with a little noise that parts equal values; the
    target is a class or a number."""
    x = x / (x.std() or 1.0)
    out = []
    for s in seeds:
        rng = np.random.default_rng(s)
        own = x + 1e-10 * max(1.0, np.abs(x).mean()) * rng.standard_normal(len(x))
        if classes:
            out.append(mi_discrete_target(own, y, k))
        else:
            t = y / (y.std() or 1.0)
            out.append(mi_continuous_target(own, t + 1e-10 * max(1.0, np.abs(t).mean()) * rng.standard_normal(len(t)), k))
    return float(np.mean(out))


def mutual_information(long: DataFrame, y: str, k: int = 3, feature: str = "feature", value: str = "value", seeds: tuple[int, ...] = (0,)) -> DataFrame:
    """(feature, mi) of continuous features in long form with a discrete target; a little
    noise parts equal values, and the mean over seeds counts. One task per feature."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([value, y])  # the noise meets rows in one order
        return pd.DataFrame({"feature": [pdf[feature].iloc[0]], "mi": [mutual_information_of(pdf[value].to_numpy(float), pdf[y].to_numpy(), True, k, seeds)]})

    kind = long.schema[feature].dataType.simpleString()
    return long.select(feature, value, y).groupBy(feature).applyInPandas(one, f"feature {kind}, mi double")
