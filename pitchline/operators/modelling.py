"""Model tasks over a bounded modelling table: one Spark task for each fit.

The table of a model is rows in time order with named numeric features. It is read to
the driver once, its size checked against ``MAX_CELLS``, and broadcast; fits run as
tasks keyed by run, fold or trial, so results do not depend on the number of workers.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting as B
from . import statistics, temporal

#: Bound of a modelling table: 40 million doubles are 320 MB on the driver and in a worker.
MAX_CELLS = 40_000_000


@dataclass(frozen=True)
class ModelTable:
    x: np.ndarray
    y: np.ndarray
    features: tuple[str, ...]

    def take(self, names: list[str] | None = None, rows: slice | np.ndarray = slice(None)) -> ModelTable:
        at = list(range(len(self.features))) if names is None else [self.features.index(n) for n in names]
        return ModelTable(self.x[rows][:, at], self.y[rows], tuple(self.features[i] for i in at))


def model_table(df: DataFrame, features: list[str], y: str, rix: str = "rix") -> ModelTable:
    """Rows in order; missing stays missing. Refuses tables over ``MAX_CELLS``."""
    n = df.count()
    if n * (len(features) + 1) > MAX_CELLS:
        raise ValueError(f"{n} rows of {len(features)} features are over the bound of a modelling table; sample rows first (strata_sample)")
    pdf = df.select(rix, *(F.col(c).cast("double").alias(c) for c in features), F.col(y).cast("double").alias("_y")).toPandas().sort_values(rix)
    target = pdf["_y"].to_numpy()
    if not np.isfinite(target).all():
        raise ValueError("the target has missing values")
    return ModelTable(pdf[list(features)].to_numpy(float), target, tuple(features))


def run_tasks(spark: SparkSession, tasks: list, work: Callable, schema: str) -> DataFrame:
    """Rows that ``work(task)`` makes for each task, one partition for each."""
    bc = spark.sparkContext.broadcast(tasks)

    def run(batches):
        for pdf in batches:
            for k in pdf["id"]:
                yield work(bc.value[int(k)])

    return spark.range(len(tasks)).repartition(max(1, len(tasks)), "id").mapInPandas(run, schema)


# -- importances -------------------------------------------------------------


def importance_of(t: ModelTable, params: B.BoosterParams, sample: np.ndarray, classes: int) -> np.ndarray:
    return B.Booster(params, classes).fit(t.x, t.y).importance(t.x[sample])


def classes_of(t: ModelTable, params: B.BoosterParams) -> int:
    return int(t.y.max()) + 1 if params.objective == "multiclass" else 1


def real_importance(spark: SparkSession, t: ModelTable, params: B.BoosterParams, seeds: list[int], sample: int = 2000, strata: int = 10) -> DataFrame:
    """(feature, imp_real): mean over seeds."""
    rows, classes, bc = np.array(temporal.strata_index(len(t.y), sample, strata)), classes_of(t, params), spark.sparkContext.broadcast(t)
    work = lambda s: pd.DataFrame({"feature": list(bc.value.features), "imp": importance_of(bc.value, replace(params, seed=s), rows, classes)})
    return run_tasks(spark, seeds, work, "feature string, imp double").groupBy("feature").agg(F.avg("imp").alias("imp_real"))


def null_importance(spark: SparkSession, t: ModelTable, params: B.BoosterParams, runs: int, block: int, seed: int, sample: int = 2000, strata: int = 10) -> DataFrame:
    """(run, feature, imp) of models of block-permuted targets; the permutations are drawn
    in run order from one generator."""
    rng, classes = np.random.default_rng(seed), classes_of(t, params)
    targets = [(r, temporal.safe_permutation(rng, t.y, block, classes > 1)) for r in range(runs)]
    rows, bc = np.array(temporal.strata_index(len(t.y), sample, strata)), spark.sparkContext.broadcast(t)

    def work(task):
        r, y = task
        own = ModelTable(bc.value.x, y, bc.value.features)
        return pd.DataFrame({"run": r, "feature": list(own.features), "imp": importance_of(own, params, rows, classes)})

    return run_tasks(spark, targets, work, "run int, feature string, imp double")


def leakage_audit(spark: SparkSession, t: ModelTable, top: int = 40, flag: float = 0.15, params: B.BoosterParams | None = None) -> DataFrame:
    """(feature, rho, reduction, flagged) of the features most correlated with the
    target: how much one alone cuts the deviance of the last 30 %. Reports only."""
    params = params or B.BoosterParams(max_depth=4, min_leaf=90, feature_fraction=1.0)
    rho = [abs(_spearman(c, t.y)) for c in t.x.T]
    names = [t.features[i] for i in np.argsort(-np.array(rho), kind="stable")[:top]]
    cut, bc = int(0.7 * len(t.y)), spark.sparkContext.broadcast(t)
    if len(t.y) - cut < 50 or np.var(t.y[cut:]) == 0:
        return spark.createDataFrame([], "feature string, rho double, reduction double, flagged boolean")
    by_name = dict(zip(t.features, rho))

    def work(name):
        own = bc.value.take([name])
        base = B.poisson_deviance(own.y[cut:], np.full(len(own.y) - cut, own.y[:cut].mean()))
        mu = B.Booster(params).fit(own.x[:cut], own.y[:cut]).predict(own.x[cut:])
        r = (base - B.poisson_deviance(own.y[cut:], mu)) / max(abs(base), 1e-12)
        return pd.DataFrame({"feature": [name], "rho": [by_name[name]], "reduction": [r], "flagged": [bool(r > flag)]})

    return run_tasks(spark, names, work, "feature string, rho double, reduction double, flagged boolean")


def _spearman(a: np.ndarray, b: np.ndarray) -> float:
    ok = np.isfinite(a)
    a, b = pd.Series(a[ok]).rank().to_numpy(), pd.Series(b[ok]).rank().to_numpy()
    return 0.0 if len(a) < 3 or a.std() == 0 or b.std() == 0 else float(np.corrcoef(a, b)[0, 1])


def window_importance(spark: SparkSession, t: ModelTable, params: B.BoosterParams, windows: int = 5, least_rows: int = 300) -> DataFrame:
    """(window, feature, imp) over disjoint windows that are large enough and vary."""
    ends, classes, bc = temporal.block_bounds(len(t.y), windows), classes_of(t, params), spark.sparkContext.broadcast(t)
    tasks = [(w, a, b) for w, (a, b) in enumerate(zip(ends[:-1], ends[1:])) if b - a >= least_rows and np.var(t.y[a:b]) > 0]

    def work(task):
        w, a, b = task
        own = bc.value.take(rows=slice(a, b))
        imp = importance_of(own, replace(params, min_leaf=max(10, params.min_leaf // 2)), np.arange(b - a), classes)
        return pd.DataFrame({"window": w, "feature": list(own.features), "imp": imp})

    return run_tasks(spark, tasks, work, "window int, feature string, imp double")


def validate_selection(spark: SparkSession, train: ModelTable, valid: ModelTable, selected: list[str], params: B.BoosterParams, draws: int = 3, seed: int = 67, k_max: int = 8) -> DataFrame:
    """(tag, n_features, loss, score) of all features, the selected ones, and as many
    random ones (mean of draws). Counts: deviance and RPS; classes: log-loss and RPS."""
    rng, classes = np.random.default_rng(seed + 777), classes_of(train, params)
    sets = [("baseline_all", list(train.features)), ("selected", selected)]
    sets += [("random_k", sorted(rng.choice(train.features, size=len(selected), replace=False).tolist())) for _ in range(draws if selected else 0)]
    bc = spark.sparkContext.broadcast((train, valid))

    def work(task):
        tag, names = task
        a, b = (z.take(names) for z in bc.value)
        m = B.Booster(params, classes).fit(a.x, a.y, (b.x, b.y))
        p = m.predict(b.x)
        loss, score = (m._loss(m.raw(b.x), b.y), B.rps_1x2(b.y, p)) if classes > 1 else (B.poisson_deviance(b.y, p), B.rps_count(b.y, p, k_max))
        return pd.DataFrame({"tag": [tag], "n_features": [len(names)], "loss": [loss], "score": [score]})

    out = run_tasks(spark, [s for s in sets if s[1]], work, "tag string, n_features int, loss double, score double")
    return out.groupBy("tag").agg(F.first("n_features").alias("n_features"), F.avg("loss").alias("loss"), F.avg("score").alias("score"))


def calibrate_runtime(spark: SparkSession, t: ModelTable, params: B.BoosterParams, probes: int, runs: int, parallel: tuple[int, ...] = (1, 2, 4, 8)) -> list[tuple[int, float, float]]:
    """(tasks at once, seconds for a run, minutes for all runs) by a few real runs."""
    out = []
    for n in parallel:
        began = time.time()
        null_importance(spark, t, params, min(probes, n), 1, 0).write.format("noop").mode("overwrite").save()
        s = (time.time() - began) / min(probes, n)
        out.append((n, s, s * runs / 60))
    return out


# -- cross-validation, grids, tuning ---------------------------------------------


def impute_columns(train: np.ndarray, *others: np.ndarray) -> list[np.ndarray]:
    """Medians of the training rows for what is missing."""
    with np.errstate(all="ignore"):
        med = np.array([np.nanmedian(c) if np.isfinite(c).any() else 0.0 for c in train.T])
    return [np.where(np.isnan(a), med, a) for a in (train, *others)]


def fit_task(t: ModelTable, params: B.BoosterParams, start: int, end: int, k_max: int, names: list[str] | None = None) -> tuple[np.ndarray, float, dict]:
    """(predictions, alpha, metrics) of one temporal fold; all fitting is inside it."""
    own = t.take(names)
    a, v = impute_columns(own.x[:start], own.x[start:end])
    m = B.Booster(params, classes_of(t, params)).fit(a, own.y[:start], (v, own.y[start:end]))
    p, y = m.predict(v), own.y[start:end]
    loss = m._loss(m.raw(v), y)
    score = B.rps_1x2(y, p) if params.objective == "multiclass" else B.rps_count(y, p, k_max)
    return p, m.alpha, {"nll": loss, "rps": score, "rounds": len(m.trees)}


def tscv_grid(spark: SparkSession, tables: dict[str, ModelTable], models: dict[str, B.BoosterParams], folds: int = 5, k_max: int = 8) -> DataFrame:
    """(component, model, fold, n_train, n_valid, nll, rps, rounds, error): the full grid,
    one task for each cell; a cell that fails says why instead."""
    tasks = [(c, m, f, a, b) for c, t in tables.items() for m in models for f, a, b in temporal.tscv_bounds(len(t.y), folds)]
    bc = spark.sparkContext.broadcast((tables, models))

    def work(task):
        c, m, f, a, b = task
        tables, models = bc.value
        row = {"component": c, "model": m, "fold": f, "n_train": a, "n_valid": b - a, "nll": None, "rps": None, "rounds": None, "error": None}
        try:
            row |= fit_task(tables[c], models[m], a, b, k_max)[2]
        except (ValueError, FloatingPointError, np.linalg.LinAlgError) as e:
            row["error"] = str(e)
        return pd.DataFrame([row])

    return run_tasks(spark, tasks, work, "component string, model string, fold int, n_train long, n_valid long, nll double, rps double, rounds int, error string")


def out_of_fold(spark: SparkSession, t: ModelTable, params: B.BoosterParams, folds: int = 5, k_max: int = 8) -> DataFrame:
    """(rix, fold, mu, alpha) of counts, each row predicted from earlier rows only."""
    bc = spark.sparkContext.broadcast(t)

    def work(task):
        f, a, b = task
        p, alpha, _ = fit_task(bc.value, params, a, b, k_max)
        return pd.DataFrame({"rix": np.arange(a, b), "fold": f, "mu": p, "alpha": alpha})

    return run_tasks(spark, temporal.tscv_bounds(len(t.y), folds), work, "rix long, fold int, mu double, alpha double")


def fold_summary(grid: DataFrame, by: list[str]) -> DataFrame:
    """The folds' rows with a Mean and a Std (sample) row for each group."""
    rows = grid.select(*by, F.col("fold").cast("string").alias("fold"), "nll", "rps")
    mean = grid.groupBy(*by).agg(F.avg("nll").alias("nll"), F.avg("rps").alias("rps")).withColumn("fold", F.lit("Mean"))
    std = grid.groupBy(*by).agg(F.stddev_samp("nll").alias("nll"), F.stddev_samp("rps").alias("rps")).withColumn("fold", F.lit("Std"))
    return rows.unionByName(mean).unionByName(std)


SPACE_TYPES = ("int", "float", "categorical")


def suggest(space: dict, rng: np.random.Generator) -> dict:
    """A point of a search space {name: {type, low, high, step, log, choices}}."""
    out = {}
    for name, s in space.items():
        kind = s["type"]
        if kind not in SPACE_TYPES:
            raise ValueError(f"unknown type {kind!r} of {name}")
        if kind == "categorical":
            out[name] = s["choices"][int(rng.integers(len(s["choices"])))]
        elif kind == "int":
            step = s.get("step", 1)
            out[name] = int(s["low"] + step * rng.integers((s["high"] - s["low"]) // step + 1))
        elif s.get("log"):
            out[name] = float(np.exp(rng.uniform(np.log(s["low"]), np.log(s["high"]))))
        else:
            out[name] = float(rng.uniform(s["low"], s["high"]))
    return out


def tune(spark: SparkSession, t: ModelTable, base: B.BoosterParams, space: dict, trials: int = 20, folds: int = 5, metric: str = "nll", seed: int = 67, startup: int = 5, warmup: int = 1, k_max: int = 8) -> DataFrame:
    """(trial, state, value, folds_done, params): random search in waves of folds, trials
    worse than the median of a wave stop after ``warmup`` waves; failures are worst."""
    import json

    rng = np.random.default_rng(seed)
    points = [suggest(space, rng) for _ in range(trials)]
    bounds, bc = temporal.tscv_bounds(len(t.y), folds), spark.sparkContext.broadcast(t)
    sums, done, state = np.zeros(trials), np.zeros(trials, int), ["RUNNING"] * trials
    for f, (_, a, b) in enumerate(bounds):
        tasks = [(k, points[k]) for k in range(trials) if state[k] == "RUNNING"]

        def work(task, a=a, b=b):
            k, point = task
            try:
                value = fit_task(bc.value, replace(base, **point), a, b, k_max)[2][metric]
            except (ValueError, FloatingPointError):
                value = float("inf")
            return pd.DataFrame({"trial": [k], "value": [value]})

        for r in run_tasks(spark, tasks, work, "trial int, value double").collect():  # one number for each trial
            sums[r.trial] += min(r.value, 1e6)
            done[r.trial] += 1
        running = [sums[k] / done[k] for k in range(trials) if state[k] == "RUNNING"]
        if f >= warmup and len(running) > startup and f + 1 < folds:
            for k in range(trials):
                if state[k] == "RUNNING" and sums[k] / done[k] > np.median(running):
                    state[k] = "PRUNED"
    rows = [(k, "COMPLETE" if s == "RUNNING" else s, float(sums[k] / done[k]), int(done[k]), json.dumps(points[k], sort_keys=True)) for k, s in enumerate(state)]
    return spark.createDataFrame(rows, "trial int, state string, value double, folds_done int, params string")


# -- other learners ------------------------------------------------------------


def poisson_glm(df: DataFrame, features: list[str], y: str):
    """A fitted Poisson regression with a log link, by Spark's own solver."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    glm = GeneralizedLinearRegression(family="poisson", link="log", labelCol=y, featuresCol="_x", predictionCol="mu", regParam=1e-6)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x"), glm]).fit(df)


def logistic_pipeline(features: list[str], y: str, n: int, c: float = 0.05, l1: float = 0.5):
    """Mean imputation, scaling, and an elastic-net multinomial regression."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler

    filled = [f"_i_{f}" for f in features]
    return Pipeline(stages=[
        Imputer(strategy="mean", inputCols=features, outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="_v"),
        StandardScaler(inputCol="_v", outputCol="_x", withMean=True),
        LogisticRegression(featuresCol="_x", labelCol=y, family="multinomial", regParam=1 / (c * max(n, 1)), elasticNetParam=l1),
    ])


def forest_pipeline(features: list[str], y: str, trees: int = 50, depth: int = 8, seed: int = 67):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import Imputer, VectorAssembler

    filled = [f"_i_{f}" for f in features]
    return Pipeline(stages=[Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_x"), RandomForestClassifier(featuresCol="_x", labelCol=y, numTrees=trees, maxDepth=depth, seed=seed)])


def temporal_cv(df: DataFrame, pipeline, y: str, folds: int = 5, rix: str = "rix") -> DataFrame:
    """(fold, rps, log_loss, accuracy, n, ece) of any classifier pipeline of pyspark.ml."""
    from pyspark.ml.functions import vector_to_array

    from . import metrics

    out = None
    for f, a, b in temporal.tscv_bounds(df.count(), folds):
        model = pipeline.fit(df.where(F.col(rix) < a))
        p = model.transform(df.where((F.col(rix) >= a) & (F.col(rix) < b))).withColumn("_p", vector_to_array("probability"))
        rows = p.select(F.lit(f).alias("fold"), F.col(y).alias("y_true"), *(F.col("_p")[k].alias(f"p{k}") for k in range(3)))
        one = metrics.evaluate_1x2(rows, ["p0", "p1", "p2"], "y_true", ["fold"])
        out = one if out is None else out.unionByName(one)
    return out


# -- the selection pipeline --------------------------------------------------------


@dataclass(frozen=True)
class SelectionConfig:
    """Defaults of the count variant; ``with_overrides`` refuses unknown keys."""

    objective: str = "poisson"
    top_share: float = 0.98
    missing_share: float = 0.95
    mi_threshold: float = 1e-4
    mi_neighbors: int = 3
    mi_seeds: int = 3
    corr_threshold: float = 0.80
    corr_blocks: int = 5
    representative: str = "spearman"
    leakage_top: int = 40
    leakage_flag: float = 0.15
    runs: int = 300
    alpha: float = 0.01
    method: str = "parametric_bh"
    tail: str = "lognormal"
    floor_guard: bool = True
    z_min: float = 4.0
    robust_pass: bool = True
    real_seeds: int = 5
    sample: int = 2000
    strata: int = 10
    stability_windows: int = 5
    stability_k: float = 1.25
    stability_min: float = 0.35
    stability_rows: int = 300
    random_draws: int = 3
    rounds: int = 150
    seed: int = 67

    def with_overrides(self, **changes) -> SelectionConfig:
        unknown = set(changes) - set(self.__dataclass_fields__)
        if unknown:
            raise ValueError(f"unknown selection keys: {sorted(unknown)}")
        return replace(self, **changes)


@dataclass
class SelectionReport:
    counts: dict[str, int]
    selected: list[str]
    power: dict
    significance: DataFrame | None = None
    stability: DataFrame | None = None
    leakage: DataFrame | None = None
    validation: DataFrame | None = None
    information: dict[str, float] | None = None


def long_form(spark: SparkSession, t: ModelTable) -> DataFrame:
    """(rix, feature, value) of a modelling table; missing values stay missing."""
    import pyarrow as pa

    n, f = t.x.shape
    flat = t.x.ravel()
    cells = pa.table({"rix": np.repeat(np.arange(n), f), "feature": np.tile(np.array(t.features, dtype=object), n), "value": pa.array(flat, mask=~np.isfinite(flat))})
    return spark.createDataFrame(cells)


def sparsity_filter(spark: SparkSession, t: ModelTable, cfg: SelectionConfig) -> list[str]:
    """Features whose values vary enough: see :func:`statistics.drop_sparse`; a class
    target counts missing as a value."""
    if not t.features:
        return []
    rows = statistics.drop_sparse(long_form(spark, t), cfg.top_share, None if cfg.objective == "multiclass" else cfg.missing_share)
    kept = {r.feature for r in rows.where("kept").select("feature").collect()}  # features, not rows
    return [f for f in t.features if f in kept]


def information(spark: SparkSession, t: ModelTable, cfg: SelectionConfig) -> dict[str, float]:
    """Mutual information of each feature and the target, one task for each; for counts
    the mean over seeds, over the stratified sample."""
    classes = cfg.objective == "multiclass"
    rows = np.arange(len(t.y)) if classes else np.array(temporal.strata_index(len(t.y), cfg.sample, cfg.strata))
    bc = spark.sparkContext.broadcast(ModelTable(impute_columns(t.x)[0][rows], t.y[rows], t.features))
    seeds = tuple(cfg.seed + k for k in range(1 if classes else cfg.mi_seeds))

    def work(name):
        own = bc.value.take([name])
        return pd.DataFrame({"feature": [name], "mi": [statistics.mutual_information_of(own.x[:, 0], own.y, classes, cfg.mi_neighbors, seeds)]})

    return {r.feature: r.mi for r in run_tasks(spark, list(t.features), work, "feature string, mi double").collect()}  # features, not rows


def correlation_filter(spark: SparkSession, t: ModelTable, cfg: SelectionConfig, score: dict[str, float] | None = None) -> list[str]:
    """Representatives of clusters of features that rank rows alike in most blocks: those
    of the highest ``score``, or that rank rows most like the target."""
    names = list(t.features)
    if len(names) < 2:
        return names
    filled = impute_columns(t.x)[0]
    long = long_form(spark, ModelTable(filled, t.y, t.features)).withColumn("block", temporal.block_of("rix", len(t.y), cfg.corr_blocks))
    pairs = [(r.a, r.b, r.rho) for r in statistics.block_correlations(long).collect()]  # features squared
    score = score or {n: abs(_spearman(filled[:, i], t.y)) for i, n in enumerate(names)}
    return [f for f, _, kept in statistics.cluster_representatives(pairs, names, score, cfg.corr_threshold) if kept]


def robust_features(spark: SparkSession, t: ModelTable, cfg: SelectionConfig, params: B.BoosterParams, block: int) -> DataFrame:
    """(feature, robust_weak): does a feature beat all its null importances under a weak
    learner (stumps)? A check of the features already chosen, no second test."""
    weak = replace(params, max_depth=1, max_leaves=2)
    null = null_importance(spark, t, weak, max(30, cfg.runs // 4), block, cfg.seed + 20_000, cfg.sample, cfg.strata)
    real = real_importance(spark, t, weak, [cfg.seed], cfg.sample, cfg.strata)
    return null.join(real, "feature").groupBy("feature").agg((F.count_if(F.col("imp") >= F.col("imp_real")) == 0).alias("robust_weak"))


def select_features(spark: SparkSession, train: ModelTable, valid: ModelTable | None, cfg: SelectionConfig = SelectionConfig()) -> SelectionReport:
    """The steps in order: sparsity, leakage report, mutual information, correlation, null
    importances with multiple-testing control and a check by a weak learner, stability,
    honesty check. For counts an empty result falls back to what step two left."""
    if cfg.representative not in ("spearman", "mi"):
        raise ValueError(f"unknown representative {cfg.representative!r}; known: spearman, mi")
    counted = cfg.objective != "multiclass"
    if counted and (train.y < 0).any():
        raise ValueError("a count target must not be negative")
    params = B.BoosterParams(objective=cfg.objective, rounds=cfg.rounds, seed=cfg.seed)
    counts = {"candidates": len(train.features)}
    varied = sparsity_filter(spark, train, cfg)
    counts["sparsity"] = len(varied)
    leak = leakage_audit(spark, train.take(varied), cfg.leakage_top, cfg.leakage_flag) if counted else None
    info = information(spark, train.take(varied), cfg)
    told = [f for f in varied if info[f] >= cfg.mi_threshold]
    counts["information"] = len(told)
    by_info = cfg.representative == "mi" or not counted
    kept = correlation_filter(spark, train.take(told), cfg, info if by_info else None)
    counts["correlation"] = len(kept)
    own = train.take(kept)
    changes = int((np.diff(own.y) != 0).sum())
    block = temporal.acf_block_size(_acf(own.y), len(own.y))[0] if counted else temporal.run_length_block(len(own.y), changes)
    sig, names = None, []
    if kept:
        null = null_importance(spark, own, params, cfg.runs, block, cfg.seed + (10_000 if counted else 0), cfg.sample, cfg.strata)
        real = real_importance(spark, own, params, [cfg.seed + s for s in range(cfg.real_seeds if counted else 1)], cfg.sample, cfg.strata)
        sig = statistics.significance(null, real, cfg.method, cfg.alpha, cfg.z_min, tail=cfg.tail, floor_guard=cfg.floor_guard).cache()
        names = [r.feature for r in sig.where("significant").select("feature").collect()]  # features, not rows
        if counted and cfg.robust_pass and len(names) > 1:
            sig = sig.join(robust_features(spark, train.take(names), cfg, params, block), "feature", "left")
        sig = sig.orderBy(F.desc("z"))
    counts["significance"] = len(names)
    stab = None
    if names:
        stab = statistics.stability(window_importance(spark, train.take(names), params, cfg.stability_windows, cfg.stability_rows), cfg.stability_k, cfg.stability_min).orderBy(F.desc("score")).cache()
        rows = stab.collect()  # features, not rows
        if len(rows):
            names = [r.feature for r in rows if r.stable]
    counts["stability"] = len(names)
    selected = sorted(names or (kept if counted else []), key=list(train.features).index)
    check = validate_selection(spark, train, valid, selected, params, cfg.random_draws, cfg.seed) if valid is not None else None
    return SelectionReport(counts, selected, statistics.preflight(cfg.runs, max(1, len(kept)), cfg.alpha), sig, stab, leak, check, info)


def _acf(y: np.ndarray, lags: int = 60) -> list[float]:
    c = y - y.mean()
    var = float(c @ c)
    return [float(c[:-k] @ c[k:]) / var for k in range(1, min(lags, len(y) // 4) + 1)] if var else []


def select_dual(spark: SparkSession, tables: dict[str, tuple[ModelTable, ModelTable | None]], cfg: SelectionConfig = SelectionConfig()) -> tuple[dict[str, SelectionReport], dict]:
    """Both components, and what they share."""
    reports = {k: select_features(spark, a, b, cfg) for k, (a, b) in tables.items()}
    sets = [set(r.selected) for r in reports.values()]
    common, either = set.intersection(*sets), set.union(*sets)
    return reports, {"common": sorted(common), "union": sorted(either), "jaccard": len(common) / len(either) if either else 1.0}


def walk_forward_selection(spark: SparkSession, t: ModelTable, windows: int, cfg: SelectionConfig = SelectionConfig()) -> tuple[DataFrame, list[str]]:
    """Pairwise Jaccard of the features selected on growing windows, and the core set."""
    sets = [(k, f) for k, end in enumerate(temporal.walk_forward_ends(len(t.y), windows)) for f in select_features(spark, t.take(rows=slice(0, end)), None, cfg).selected]
    by: dict[int, set] = {}
    for k, f in sets:
        by.setdefault(k, set()).add(f)
    pairs = statistics.jaccard_pairs(spark.createDataFrame(sets, "window int, feature string"), "window", "feature")
    return pairs, sorted(set.intersection(*by.values())) if by else []
