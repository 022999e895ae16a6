"""Error analysis of count models and of 1X2 models, and ensembles."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distributions as D
from ..functions import probability as P
from . import metrics, ordering, statistics

# -- counts ------------------------------------------------------------------


def residual_frame(df: DataFrame, y: str, mu: str, k_max: int, family: str = "poisson", alpha: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Adds y_true, mean_pred, residual, log_diff, rps and pearson (NB2 variance)."""
    a = F.col(alpha) if alpha else None
    var = F.col(mu) + (a * F.col(mu) * F.col(mu) if alpha else F.lit(0.0))
    return df.select(
        *(keep or []), *([alpha] if alpha else []), F.col(y).alias("y_true"), F.col(mu).alias("mean_pred"), (F.col(y) - F.col(mu)).alias("residual"),
        (F.log1p(F.col(y).cast("double")) - F.log1p(mu)).alias("log_diff"), D.rps_count(F.col(y), F.col(mu), k_max, family, a).alias("rps"), ((F.col(y) - F.col(mu)) / F.sqrt(var)).alias("pearson"),
    )


def calibration_by_mean(res: DataFrame, edges: list[float]) -> DataFrame:
    """(bin, n, pred_mean, ytrue_mean, rps_mean) over [low, high) bins; rows outside all
    bins go, those at or above the last edge too."""
    label = None
    for lo, hi in zip(edges[:-1], edges[1:]):
        here = (F.col("mean_pred") >= lo) & (F.col("mean_pred") < hi)
        label = F.when(here, f"[{lo:g},{hi:g})") if label is None else label.when(here, f"[{lo:g},{hi:g})")
    return res.withColumn("bin", label).where("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n"), F.avg("mean_pred").alias("pred_mean"), F.avg("y_true").alias("ytrue_mean"), F.avg("rps").alias("rps_mean"))


def residual_by_count(res: DataFrame, cap: int) -> DataFrame:
    """(y_true, n, residual_mean) by observed count, from ``cap`` on in one group."""
    y = F.least("y_true", F.lit(cap)).cast("int")
    out = res.groupBy(y.alias("g")).agg(F.count("*").alias("n"), F.avg("residual").alias("residual_mean"))
    return out.select(F.when(F.col("g") == cap, F.concat(F.col("g").cast("string"), F.lit("+"))).otherwise(F.col("g").cast("string")).alias("y_true"), "n", "residual_mean")


def bootstrap_by_count(res: DataFrame, cap: int, resamples: int = 2000, seed: int = 42, key: str | None = None) -> DataFrame:
    """(g, ci_low, ci_high): percentile interval of the mean residual by observed
    count, from ``cap`` on in one group. A resample is a draw of Poisson(1) weights by
    row, so groups of any size resample in parallel with partial sums. A row's draws
    follow from its key (or, without one, its position by count and residual), so they
    are the same however rows are dealt out; groups under five rows have no interval."""
    rows = res.select(*([key] if key else []), F.least("y_true", F.lit(cap)).cast("int").alias("g"), F.col("residual").cast("double").alias("residual"))
    if key is None:
        rows, key = ordering.row_index(rows, ["g", "residual"], "_key"), "_key"
    rows = rows.select("g", "residual", F.xxhash64(key, F.lit(seed)).alias("h"))
    size = rows.groupBy("g").agg(F.count("*").alias("n"))
    cuts = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(13)])
    streams = (np.arange(1, resamples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]

    def weights(h: np.ndarray) -> np.ndarray:
        x = h.view(np.uint64)[None, :] ^ streams
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return np.searchsorted(cuts, (x >> np.uint64(11)) * 2.0**-53, "right").astype(float)

    def sums(batches):
        held: dict[int, np.ndarray] = {}
        for pdf in batches:
            for g, part in pdf.groupby("g"):
                for k in range(0, len(part), 512):
                    some = part.iloc[k : k + 512]
                    w = weights(some.h.to_numpy(np.int64))
                    held.setdefault(int(g), np.zeros((2, resamples)))
                    held[int(g)] += np.stack([w @ some.residual.to_numpy(), w.sum(axis=1)])
        for g, (s, w) in held.items():
            yield pd.DataFrame({"g": g, "b": np.arange(resamples), "s": s, "w": w})

    means = rows.mapInPandas(sums, "g int, b long, s double, w double").groupBy("g", "b").agg((F.sum("s") / F.greatest(F.sum("w"), F.lit(1.0))).alias("m"))
    ci = means.groupBy("g").agg(F.percentile("m", F.lit(0.025)).alias("lo"), F.percentile("m", F.lit(0.975)).alias("hi"))  # resamples, not rows
    return size.join(ci, "g").select("g", F.when(F.col("n") >= 5, F.round("lo", 4)).alias("ci_low"), F.when(F.col("n") >= 5, F.round("hi", 4)).alias("ci_high"))


def rps_tail(res: DataFrame, percentile: float = 0.95) -> DataFrame:
    """(in_tail, n, means) of rows at or above a percentile of RPS, and of the rest."""
    cut = ordering.quantiles(res, "rps", [percentile]).first()  # one number
    cut = cut.q0 if cut else None
    return res.groupBy((F.col("rps") >= F.lit(cut)).alias("in_tail")).agg(F.count("*").alias("n"), *(F.round(F.avg(c), 4).alias(f"{c}_mean") for c in ("rps", "residual", "y_true", "mean_pred")))


def bias_by_group(res: DataFrame, group: str, minimum: int = 20, top: int = 20) -> DataFrame:
    """The ``top`` groups of at least ``minimum`` rows by mean RPS."""
    out = res.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg("rps").alias("rps_mean"), F.avg("residual").alias("residual_mean"), F.avg("y_true").alias("ytrue_mean"), F.avg("mean_pred").alias("pred_mean"))
    return out.where(F.col("n") >= minimum).orderBy(F.desc("rps_mean"), group).limit(top)


def temporal_drift(res: DataFrame, time: str, window: int = 3) -> DataFrame:
    """By month: n, means, sample deviation of RPS, and a trailing mean over months."""
    m = res.groupBy(F.date_format(time, "yyyy-MM").alias("period")).agg(F.count("rps").alias("n"), F.avg("rps").alias("rps_mean"), F.stddev_samp("rps").alias("rps_std"), F.avg("residual").alias("residual_mean"), F.avg("y_true").alias("ytrue_mean"), F.avg("mean_pred").alias("pred_mean"))
    return m.withColumn("rps_rolling", F.avg("rps_mean").over(Window.orderBy("period").rowsBetween(1 - window, 0)))


def drift_trend(drift: DataFrame) -> tuple[float, float]:
    """(rho, p) of the months' order and their mean RPS."""
    rows = drift.select(F.col("period"), "rps_mean").withColumn("k", F.lit(0))
    out = statistics.spearman(rows, "period", "rps_mean", ["k"]).first()
    return (out.rho, statistics.spearman_p(out.rho, out.n)) if out else (float("nan"), float("nan"))


def dispersion(res: DataFrame, alpha: str) -> DataFrame:
    """alpha's mean, median, p05, p95, the population variance of Pearson residuals, and
    a verdict."""
    out = res.agg(F.avg(alpha).alias("alpha_mean"), F.var_pop("pearson").alias("pearson_var"))
    cuts = ordering.quantiles(res, alpha, [0.5, 0.05, 0.95]).toDF("alpha_median", "alpha_p05", "alpha_p95")
    out = out.crossJoin(cuts).select("alpha_mean", "alpha_median", "alpha_p05", "alpha_p95", "pearson_var")  # one row each
    verdict = F.when(F.col("alpha_mean") < 0.05, "collapses to poisson").when(F.col("pearson_var") > 1.3, "overdispersion left").when(F.col("pearson_var") < 0.7, "alpha overfitted").otherwise("reasonable")
    return out.withColumn("verdict", verdict)


def component_correlation(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(measure, rho): rank correlation of two components' errors, joined by key."""
    names = ["rps", "residual", "log_diff"]
    both = a.select(key, *(F.col(c).alias(f"a_{c}") for c in names)).join(b.select(key, *(F.col(c).alias(f"b_{c}") for c in names)), key)
    each = F.array(*(F.struct(F.lit(c).alias("measure"), F.col(f"a_{c}").alias("x"), F.col(f"b_{c}").alias("y")) for c in names))
    return statistics.spearman(both.select(F.explode(each).alias("e")).select("e.*"), "x", "y", ["measure"])


# -- 1X2 ---------------------------------------------------------------------

PROBS = ["p0", "p1", "p2"]


def with_rps(df: DataFrame, probs: list[str] = PROBS, y: str = "y_true") -> DataFrame:
    p = [F.col(c) for c in probs]
    return df.withColumn("rps", P.rps_1x2(p, F.col(y))).withColumn("pred", P.argmax(p))


def reliability(df: DataFrame, probs: list[str], y: str, by: list[str]) -> DataFrame:
    """(by..., outcome, bin, n, conf, acc) of bins with rows."""
    return metrics.calibration_bins(metrics.by_class(df, probs, y, by), "p", "hit", [*by, "outcome"])


def brier(df: DataFrame, p: str, y: str, outcome: int, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.pow(F.col(p) - (F.col(y) == outcome).cast("double"), F.lit(2.0))).alias("brier"))


def class_calibration(df: DataFrame, by: list[str], least_std: float = 0.01) -> DataFrame:
    """(by..., outcome, bin, n, conf, acc): a calibration curve for each class whose
    probabilities vary by more than ``least_std``; the spread follows from the bins' sums,
    so rows are read once."""
    rows = metrics.by_class(df, PROBS, "y_true", by).withColumn("bin", P.bin_index(F.col("p")))
    keys = [*by, "outcome"]
    bins = rows.groupBy(*keys, "bin").agg(F.count("p").alias("n"), F.avg("p").alias("conf"), F.avg(F.col("hit").cast("double")).alias("acc"), F.coalesce(F.var_pop("p"), F.lit(0.0)).alias("within"))
    curve = Window.partitionBy(*keys)
    total = F.sum("n").over(curve)
    bins = bins.withColumn("mean", F.sum(F.col("n") * F.col("conf")).over(curve) / total).withColumn("total", total)
    spread = F.sum(F.col("n") * (F.col("within") + F.pow(F.col("conf") - F.col("mean"), F.lit(2.0)))).over(curve) / F.col("total")
    return bins.withColumn("spread", F.sqrt(spread)).where(F.col("spread") > least_std).select(*keys, "bin", "n", "conf", "acc")


def segment_rps(df: DataFrame, group: str, top: int = 10) -> DataFrame:
    return with_rps(df).where(F.col(group).isNotNull()).groupBy(group).agg(F.avg("rps").alias("rps_mean"), F.count("*").alias("n")).orderBy(F.desc("rps_mean"), group).limit(top)


def ece_by_category(df: DataFrame, category: str, model: str, minimum: int = 30) -> DataFrame:
    """(category, model, outcome, ece, n) of categories with enough rows, and a MacroAvg
    row over the outcomes of each."""
    rows = df.where(F.col(category).isNotNull())
    each = metrics.expected_calibration_error(rows, PROBS, "y_true", [category, model]).where(F.col("n") >= minimum).withColumn("outcome", F.col("outcome").cast("string"))
    macro = each.groupBy(category, model).agg(F.avg("ece").alias("ece"), F.max("n").alias("n")).withColumn("outcome", F.lit("MacroAvg"))
    return each.unionByName(macro)


def disagreement(df: DataFrame, key: str = "match_id", model: str = "model") -> DataFrame:
    """(hard, n, rps_mean): rows on which models name different classes, and the rest."""
    rows = with_rps(df)
    kinds = rows.groupBy(key).agg((F.count_distinct("pred") > 1).alias("hard"), F.avg("rps").alias("rps"))
    return kinds.groupBy("hard").agg(F.count("*").alias("n"), F.avg("rps").alias("rps_mean"))


def failure_jaccard(df: DataFrame, key: str = "match_id", model: str = "model") -> DataFrame:
    fails = with_rps(df).where(F.col("pred") != F.col("y_true"))
    return statistics.jaccard_pairs(fails, model, key)


def model_correlation(df: DataFrame, p: str, key: str = "match_id", model: str = "model") -> DataFrame:
    """(a, b, corr) of two models' probabilities of one class."""
    a = df.select(key, F.col(model).alias("a"), F.col(p).alias("x"))
    b = df.select(key, F.col(model).alias("b"), F.col(p).alias("y"))
    return a.join(b, key).where("a < b").groupBy("a", "b").agg(F.corr("x", "y").alias("corr"))


def class_correlation(df: DataFrame, key: str = "match_id", model: str = "model") -> DataFrame:
    """(outcome, a, b, corr) of two models' probabilities of each class, in one join."""
    side = lambda name, x: df.select(key, F.col(model).alias(name), *(F.col(c).alias(f"{x}{k}") for k, c in enumerate(PROBS)))
    pairs = side("a", "x").join(side("b", "y"), key).where("a < b").groupBy("a", "b").agg(*(F.corr(f"x{k}", f"y{k}").alias(str(k)) for k in range(len(PROBS))))
    return pairs.unpivot(["a", "b"], [str(k) for k in range(len(PROBS))], "outcome", "corr").select(F.col("outcome").cast("int").alias("outcome"), "a", "b", "corr")


def diversity(df: DataFrame, key: str = "match_id", model: str = "model") -> DataFrame:
    """(kind, agreement, diversity): the mean over pairs of models of each class's
    correlation and of the rank correlation, and one less that."""
    by_class = class_correlation(df, key, model).groupBy(F.concat(F.lit("class "), F.col("outcome").cast("string")).alias("kind")).agg(F.avg("corr").alias("agreement"))
    by_rank = rank_agreement(df, key, model).agg(F.avg("rho").alias("agreement")).select(F.lit("rank").alias("kind"), "agreement")
    return by_class.unionByName(by_rank).withColumn("diversity", 1 - F.col("agreement"))


def rank_agreement(df: DataFrame, key: str = "match_id", model: str = "model") -> DataFrame:
    """(a, b, rho): mean rank correlation of two models' three probabilities by row, equal
    ones ranked in class order; 1 - sum d^2 / 4 for three ranks."""
    rank = lambda k: sum((F.when((F.col(PROBS[j]) < F.col(PROBS[k])) | ((F.col(PROBS[j]) == F.col(PROBS[k])) & F.lit(j < k)), 1).otherwise(0) for j in range(3) if j != k), F.lit(0))
    ranks = df.select(key, model, *(rank(k).alias(f"r{k}") for k in range(3)))
    a = ranks.select(key, F.col(model).alias("a"), *(F.col(f"r{k}").alias(f"a{k}") for k in range(3)))
    b = ranks.select(key, F.col(model).alias("b"), *(F.col(f"r{k}").alias(f"b{k}") for k in range(3)))
    d2 = sum((F.pow(F.col(f"a{k}") - F.col(f"b{k}"), F.lit(2.0)) for k in range(3)), F.lit(0.0))
    return a.join(b, key).where("a < b").groupBy("a", "b").agg(F.avg(1 - d2 / 4).alias("rho"))


def bias_by_result(df: DataFrame, model: str = "model") -> DataFrame:
    return with_rps(df).groupBy(model, "y_true").agg(F.avg("rps").alias("rps_mean"), F.count("*").alias("n"))


def confidence_gap(df: DataFrame, cut: float = 0.5, model: str = "model") -> DataFrame:
    rows = with_rps(df).withColumn("confident", F.greatest(*PROBS) > cut)
    return rows.groupBy(model, "confident").agg(F.avg((F.col("pred") == F.col("y_true")).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def quantile_rps(df: DataFrame, x: str, bins: int, by: list[str]) -> DataFrame:
    return metrics.quantile_bins(with_rps(df), x, bins).groupBy(*by, "bin").agg(F.avg("rps").alias("rps_mean"), F.count("*").alias("n"))


def best_model(df: DataFrame, score: str, model: str, by: list[str]) -> DataFrame:
    """The model of least score, the first by name of equal ones."""
    return df.groupBy(*by).agg(F.min(F.struct(score, model)).alias("m")).select(*by, F.col(f"m.{model}").alias("best"), F.col(f"m.{score}").alias(score))


def ensembles(df: DataFrame, key: str = "match_id") -> DataFrame:
    """Rows of two more models: the mean and the median of all models' probabilities."""
    aggs = [f(c).alias(f"{n}_{c}") for n, f in (("mean", F.avg), ("median", F.median)) for c in PROBS]
    wide = df.groupBy(key).agg(F.first("y_true").alias("y_true"), *aggs)
    each = F.array(*(F.struct(F.lit(n).alias("model"), *(F.col(f"{n}_{c}").alias(c) for c in PROBS)) for n in ("mean", "median")))
    return wide.select(key, "y_true", F.explode(each).alias("e")).select(key, "y_true", "e.*")


def validation_status(valid: DataFrame, test: DataFrame, model: str = "model") -> DataFrame:
    """(model, rps_val, rps_test, delta, ece_test, status)."""
    both = valid.select(model, F.col("rps").alias("rps_val")).join(test.select(model, F.col("rps").alias("rps_test"), F.col("ece").alias("ece_test")), model)
    delta = F.col("rps_test") - F.col("rps_val")
    status = F.when(delta > 0.01, "OVERFIT").when(F.col("ece_test") > 0.08, "POOR_CALIBRATION").otherwise("STABLE")
    return both.select(model, "rps_val", "rps_test", delta.alias("delta"), "ece_test", status.alias("status"))
