"""Metrics of count distributions and of class probabilities, as DataFrame operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import distributions as D
from ..functions import probability as P
from . import ordering


def summary(df: DataFrame, x: str, by: list[str] | None = None) -> DataFrame:
    """mean, population std, median, interpolated p95 and n."""
    by = by or []
    out = df.groupBy(*by).agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.count(x).alias("n"))
    cuts = ordering.quantiles(df, x, [0.5, 0.95], by)
    out = out.join(cuts, by, "left") if by else out.crossJoin(cuts)  # one row each
    return out.select(*by, "mean", "std", F.col("q0").alias("median"), F.col("q1").alias("p95"), "n")


def count_rps(df: DataFrame, y: str, mu: str, k_max: int, family: str = "poisson", alpha: str | None = None) -> DataFrame:
    return df.withColumn("rps", D.rps_count(F.col(y), F.col(mu), k_max, family, F.col(alpha) if alpha else None))


def count_nll(df: DataFrame, y: str, mu: str, family: str = "poisson", alpha: str | None = None) -> DataFrame:
    return df.agg((-F.avg(D.log_pmf(F.col(y), F.col(mu), family, F.col(alpha) if alpha else None))).alias("nll"), F.count("*").alias("n"))


def poisson_deviance(y: Column, mu: Column) -> Column:
    """Twice the mean of y ln(y / mu) - (y - mu); y ln y is 0 at 0; mu at least 1e-9."""
    m = F.greatest(mu, F.lit(1e-9))
    return 2 * F.avg(F.when(y > 0, y * F.log(y / m)).otherwise(0.0) - (y - m))


def with_grids(df: DataFrame, k_max: int, mu: tuple[str, str], family: str, alpha: tuple[str, str] | None, keep: list) -> DataFrame:
    """(keep..., grid_a, grid_b): both components' probabilities, computed once a row."""
    a = [F.col(x) for x in alpha] if alpha else [None, None]
    return df.select(*keep, *(D.pmf(F.col(m), k_max, family, x).alias(n) for m, x, n in zip(mu, a, ("grid_a", "grid_b"))))


def over_under(df: DataFrame, thresholds: list[float], k_max: int, y: tuple[str, str] = ("y_home", "y_away"), mu: tuple[str, str] = ("mu_home", "mu_away"), family: str = "poisson", alpha: tuple[str, str] | None = None, method: str = "convolution") -> DataFrame:
    """(threshold, p_pred_mean, p_real, abs_error, n_over, n_samples): predicted against
    observed frequency of totals over each threshold. One aggregation without an explode
    of rows: a partial sum per threshold."""
    total = (F.col(y[0]) + F.col(y[1])).alias("total")
    if method == "convolution":
        rows = with_grids(df, k_max, mu, family, alpha, [total])
        most = max(math.floor(t) for t in thresholds)
        below = D.prefix(D.total_cells(F.col("grid_a"), F.col("grid_b"), k_max, most))
        sums = [D.prefix([F.col(g)[k] for k in range(k_max + 1)])[-1] for g in ("grid_a", "grid_b")]
        rows = rows.select("total", (sums[0] * sums[1]).alias("mass"), *(below[min(math.floor(t), 2 * k_max)].alias(f"b_{k}") for k, t in enumerate(thresholds)))
        over = [1 - F.col(f"b_{k}") / F.col("mass") for k in range(len(thresholds))]
    else:
        rows = df.select(total, D.total_pmf(F.col(mu[0]), F.col(mu[1]), k_max, family, method=method).alias("grid"))
        over = [D.total(F.slice("grid", int(math.floor(t)) + 2, 2 * k_max + 1)) for t in thresholds]
    aggs = []
    for t, o in zip(thresholds, over):
        aggs += [F.avg(o).alias(f"p_{t}"), F.count_if(F.col("total") > t).alias(f"n_{t}")]
    wide = rows.agg(F.count("*").alias("n_samples"), *aggs)
    long = wide.select("n_samples", F.explode(F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.col(f"`p_{t}`").alias("p_pred_mean"), F.col(f"`n_{t}`").alias("n_over")) for t in thresholds))).alias("x")).select("n_samples", "x.*")
    real = F.col("n_over") / F.col("n_samples")
    return long.select("threshold", "p_pred_mean", real.alias("p_real"), F.abs(F.col("p_pred_mean") - real).alias("abs_error"), "n_over", "n_samples")


def evaluate_counts(df: DataFrame, thresholds: list[float], k_max: int, family: str = "poisson") -> DataFrame:
    """One row: NLL and RPS of both components, and the mean calibration error."""
    nb, scores = family == "negbin", []
    for side in ("home", "away"):
        y, mu, a = F.col(f"y_{side}"), F.col(f"mu_{side}"), F.col(f"alpha_{side}") if nb else None
        scores += [(-F.avg(D.log_pmf(y, mu, family, a))).alias(f"nll_{side}"), F.avg(D.rps_count(y, mu, k_max, family, a)).alias(f"rps_{side}")]
    out = df.agg(*scores)
    ece = over_under(df, thresholds, k_max, family=family, alpha=("alpha_home", "alpha_away") if nb else None).agg(F.avg("abs_error").alias("ece_global"), F.max("n_samples").alias("n_samples"))
    return out.crossJoin(ece)  # one row each


def likelihood_ratio(nll_poisson: float, nll_negbin: float, n: int, level: float = 0.01) -> dict:
    """Poisson against NB2; the extra parameter lies on the boundary, so half a chi-square."""
    lr = 2 * n * (nll_poisson - nll_negbin)
    p = 0.5 * math.erfc(math.sqrt(max(lr, 0.0) / 2))
    return {"lr": lr, "p_value": p, "family": "negbin" if p < level else "poisson"}


def calibration_bins(df: DataFrame, p: str, hit: str, by: list[str]) -> DataFrame:
    """(by..., bin, n, conf, acc) over right-closed tenths; only bins with rows."""
    return df.withColumn("bin", P.bin_index(F.col(p))).groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg(p).alias("conf"), F.avg(F.col(hit).cast("double")).alias("acc"))


def by_class(df: DataFrame, probs: list[str], y: str, keep: list[str]) -> DataFrame:
    """A row for each class: (keep..., outcome, p, hit)."""
    each = F.array(*(F.struct(F.lit(k).alias("outcome"), F.col(c).alias("p"), (F.col(y) == k).cast("int").alias("hit")) for k, c in enumerate(probs)))
    return df.select(*keep, F.explode(each).alias("x")).select(*keep, "x.*")


def expected_calibration_error(df: DataFrame, probs: list[str], y: str, by: list[str]) -> DataFrame:
    """(by..., outcome, ece, n) for each class."""
    bins = calibration_bins(by_class(df, probs, y, by), "p", "hit", [*by, "outcome"])
    return bins.groupBy(*by, "outcome").agg((F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def evaluate_1x2(df: DataFrame, probs: list[str], y: str, by: list[str]) -> DataFrame:
    """(by..., rps, log_loss, accuracy, n, ece)."""
    p = [F.col(c) for c in probs]
    scores = df.groupBy(*by).agg(F.avg(P.rps_1x2(p, F.col(y))).alias("rps"), F.avg(P.log_loss(p, F.col(y))).alias("log_loss"), F.avg((P.argmax(p) == F.col(y)).cast("double")).alias("accuracy"), F.count("*").alias("n"))
    ece = expected_calibration_error(df, probs, y, by).groupBy(*by).agg(F.avg("ece").alias("ece"))
    return scores.join(ece, by)


def classification_report(df: DataFrame, probs: list[str], y: str, by: list[str]) -> DataFrame:
    """(by..., accuracy, macro_f1, log_loss) of class probabilities."""
    p = [F.col(c) for c in probs]
    rows = df.select(*by, F.col(y).alias("y"), P.argmax(p).alias("h"), P.log_loss(p, F.col(y)).alias("loss"))
    f1 = []
    for k in range(len(probs)):
        hit, said, real = (F.count_if(c) for c in ((F.col("h") == k) & (F.col("y") == k), F.col("h") == k, F.col("y") == k))
        f1.append(F.when(said + real > 0, 2 * hit / (said + real)).otherwise(0.0))
    return rows.groupBy(*by).agg(F.avg((F.col("h") == F.col("y")).cast("double")).alias("accuracy"), (sum(f1[1:], f1[0]) / len(f1)).alias("macro_f1"), F.avg("loss").alias("log_loss"))


def quantile_bins(df: DataFrame, x: str, bins: int, out: str = "bin") -> DataFrame:
    """Right-closed bins at exact interpolated quantiles, equal edges dropped."""
    edges = ordering.quantiles(df, x, [k / bins for k in range(bins + 1)]).first()  # bins + 1 numbers
    inner = sorted(set(edges or []))[1:-1]
    return df.withColumn(out, sum((F.when(F.col(x) > F.lit(e), 1).otherwise(0) for e in inner), F.lit(0)))
