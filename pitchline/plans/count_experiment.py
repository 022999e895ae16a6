"""A count-target experiment end to end: split, select, compare, evaluate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import boosting, metrics, modelling


def compare_models(spark: SparkSession, tables: dict[str, modelling.ModelTable], models: dict[str, boosting.BoosterParams], folds: int = 5, k_max: int = 8) -> tuple[DataFrame, list[dict]]:
    """The grid of (component, model, fold), and a likelihood-ratio test of each Poisson
    model against its negative-binomial twin (``name``_poisson, ``name``_negbin)."""
    grid = modelling.tscv_grid(spark, tables, models, folds, k_max).cache()
    mean = {(r.component, r.model): (r.nll, r.n) for r in grid.where("error IS NULL").groupBy("component", "model").agg({"nll": "avg", "n_valid": "sum"}).toDF("component", "model", "nll", "n").collect()}  # a row for each model
    tests = []
    for (component, model), (nll, n) in sorted(mean.items()):
        twin = (component, model.removesuffix("_poisson") + "_negbin")
        if model.endswith("_poisson") and twin in mean:
            tests.append({"component": component, "model": model.removesuffix("_poisson"), **metrics.likelihood_ratio(nll, mean[twin][0], n)})
    return grid, tests


def evaluate(spark: SparkSession, train: dict[str, modelling.ModelTable], valid: dict[str, modelling.ModelTable], params: dict[str, boosting.BoosterParams], thresholds: list[float], k_max: int, early: dict[str, modelling.ModelTable] | None = None) -> tuple[DataFrame, DataFrame]:
    """(scores, calibration) of both components on a held-out table; early stopping uses
    a table of its own where given."""
    family, columns = None, {}
    for side, t in train.items():
        stop = (early or valid)[side]
        a, s, v = modelling.impute_columns(t.x, stop.x, valid[side].x)
        m = boosting.Booster(params[side]).fit(a, t.y, (s, stop.y))
        family = params[side].objective
        columns |= {f"y_{side}": valid[side].y.astype(int).tolist(), f"mu_{side}": m.predict(v).tolist(), f"alpha_{side}": [max(m.alpha, 1e-6)] * len(v)}
    rows = list(zip(*columns.values()))
    df = spark.createDataFrame(rows, list(columns)).cache()
    alpha = ("alpha_home", "alpha_away") if family == "negbin" else None
    return metrics.evaluate_counts(df, thresholds, k_max, family), metrics.over_under(df, thresholds, k_max, family=family, alpha=alpha)
