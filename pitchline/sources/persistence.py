"""Metrics, parameters, feature sets and model bundles on disk."""

from __future__ import annotations

import datetime as dt
import json
import math
from dataclasses import asdict, is_dataclass
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.boosting import Booster
from .config import ModelConfig, load_yaml, save_yaml


def serializable(x):
    """Plain JSON values: non-finite numbers are null, times ISO, frames records."""
    if isinstance(x, DataFrame):
        return [serializable(r.asDict(True)) for r in x.collect()]  # reports, not data
    if is_dataclass(x) and not isinstance(x, type):
        return serializable(asdict(x))
    if isinstance(x, dict):
        return {str(k): serializable(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, set)):
        return [serializable(v) for v in x]
    if isinstance(x, np.ndarray):
        return serializable(x.tolist())
    if isinstance(x, (bool, np.bool_)):  # before int
        return bool(x)
    if isinstance(x, (int, np.integer)):
        return int(x)
    if isinstance(x, (float, np.floating)):
        return float(x) if math.isfinite(x) else None
    if isinstance(x, (dt.date, dt.datetime)):
        return x.isoformat()
    return x if x is None or isinstance(x, str) else str(x)


def save_metrics(results, name: str, config: ModelConfig, folder: str | Path, metadata: dict | None = None) -> Path:
    t = config.target
    path = Path(folder) / f"{name}.json"
    path.parent.mkdir(parents=True, exist_ok=True)
    head = {"target": t.name, "components": [asdict(c) for c in t.components], "thresholds": list(t.thresholds), "max_k": t.max_k}
    path.write_text(json.dumps(serializable(head | {"metadata": metadata or {}, "results": results}), indent=2, ensure_ascii=False), encoding="utf-8")
    return path


def save_evaluation(evaluation: DataFrame, calibration: DataFrame, name: str, config: ModelConfig, folder: str | Path) -> Path:
    return save_metrics({"summary": evaluation, "calibration": calibration}, name, config, folder)


def best_params_stem(model: str, family: str, component: str) -> str:
    return f"best_params_{model.lower()}_{family.lower()}_{component.lower()}"


def save_best_params(params: dict, model: str, family: str, component: str, folder: str | Path, **extra) -> Path:
    return save_yaml(serializable({"model": model, "family": family, "component": component, "params": params, **extra}), Path(folder) / f"{best_params_stem(model, family, component)}.yaml")


def load_best_params(model: str, family: str, component: str, folder: str | Path, params_only: bool = True) -> dict:
    out = load_yaml(Path(folder) / f"{best_params_stem(model, family, component)}.yaml")
    return out.get("params", {}) if params_only else out


def load_all_best_params(folder: str | Path, models: list[str], injected: tuple[str, ...] = ("random_state", "n_jobs", "verbose"), strict: bool = True) -> dict[str, dict]:
    """Best parameters by canonical model name, without injected ones; strict asks for all."""
    names, out = {m.lower().replace("_", ""): m for m in models}, {}
    for path in sorted(Path(folder).glob("best_params_*.yaml")):
        raw = load_yaml(path)
        key = str(raw.get("model", path.stem.removeprefix("best_params_"))).lower().replace("_", "")
        if key in names:
            out[names[key]] = {k: v for k, v in raw.get("params", raw).items() if k not in injected and k != "model"}
    missing = [m for m in models if m not in out]
    if missing and strict:
        raise FileNotFoundError(f"no best parameters of {missing} in {folder}")
    return out


def export_study(trials: DataFrame, name: str, config_dir: str | Path, metrics_dir: str | Path) -> dict:
    """One JSON of all trials and one YAML of the best complete one."""
    best = trials.where("state = 'COMPLETE'").orderBy("value", "trial").first()
    counts = {r.state: r["count"] for r in trials.groupBy("state").count().collect()}
    params = json.loads(best.params) if best else {}
    Path(metrics_dir).mkdir(parents=True, exist_ok=True)
    (Path(metrics_dir) / f"tuning_{name}.json").write_text(json.dumps(serializable({"counts": counts, "best": params, "trials": trials.orderBy("trial")}), indent=2))
    save_yaml(serializable({"model": name, "params": params, "value": best.value if best else None}), Path(config_dir) / f"best_params_{name}.yaml")
    return params


def save_feature_sets(df: DataFrame, sets: dict[str, list[str]], folder: str, metadata: list[str], datetime_col: str | None = None) -> dict[str, str]:
    """One Parquet per feature set: metadata and features that exist, no repeats; a text
    datetime becomes a timestamp, null where it can't be read."""
    if datetime_col in df.columns and dict(df.dtypes)[datetime_col] == "string":
        df = df.withColumn(datetime_col, F.try_to_timestamp(datetime_col))
    out = {}
    for name, features in sets.items():
        columns = [c for c in dict.fromkeys([*metadata, *features]) if c in df.columns]
        out[name] = f"{folder}/{name}"
        df.select(*columns).write.mode("overwrite").parquet(out[name])
    return out


def bundle_stem(model: str, family: str, component: str) -> str:
    return f"{model.lower()}_{family.lower()}_{component.lower()}"


def save_bundle(booster: Booster, features: list[str], levels: dict[str, list], imputer: dict, folder: str | Path, metadata: dict) -> Path:
    """Metadata, model and imputer as JSON; no pickles."""
    need = {"model", "family", "component"} - set(metadata)
    if need:
        raise ValueError(f"the metadata lacks {sorted(need)}")
    path = Path(folder) / bundle_stem(metadata["model"], metadata["family"], metadata["component"])
    path.mkdir(parents=True, exist_ok=True)
    (path / "metadata.json").write_text(json.dumps(serializable(metadata | {"features": features, "levels": levels, "imputer": imputer}), indent=2))
    (path / "model.json").write_text(booster.to_json())
    return path


def load_bundle(path: str | Path) -> tuple[dict, Booster]:
    path = Path(path)
    return json.loads((path / "metadata.json").read_text()), Booster.from_json((path / "model.json").read_text())


def predict_bundle(df: DataFrame, path: str | Path) -> DataFrame:
    """Adds mu and alpha. A missing feature is an error; an unseen level is null; missing
    values are imputed as in training; results are clipped."""
    from ..functions.distributions import clip_alpha, clip_mu

    meta, booster = load_bundle(path)
    features, levels, fill = meta["features"], meta["levels"], meta["imputer"]
    missing = [f for f in features if f not in df.columns]
    if missing:
        raise ValueError(f"missing features: {missing}")
    if {"mu", "alpha"} & set(df.columns):
        raise ValueError("the rows already have mu or alpha")
    exprs = []
    for f in features:
        c = F.col(f)
        if f in levels:  # codes of training levels
            code = None
            for k, level in enumerate(levels[f]):
                code = F.when(c == level, float(k)) if code is None else code.when(c == level, float(k))
            c = code if code is not None else F.lit(None)
        exprs.append(F.coalesce(c.cast("double"), F.lit(fill.get(f))).cast("double").alias(f"_f_{f}"))
    rows, alpha = df.select("*", *exprs), booster.alpha
    shared = df.sparkSession.sparkContext.broadcast(booster.to_json())

    def run(batches):
        model = Booster.from_json(shared.value)
        for pdf in batches:
            x = pdf[[f"_f_{f}" for f in features]].to_numpy(float)
            yield pdf.drop(columns=[f"_f_{f}" for f in features]).assign(mu=model.predict(x))

    schema = ", ".join([*(f"`{n}` {t}" for n, t in df.dtypes), "mu double"])
    return rows.mapInPandas(run, schema).withColumn("mu", clip_mu(F.col("mu"))).withColumn("alpha", clip_alpha(F.lit(alpha).cast("double")))


def predict_match(df: DataFrame, probs: list[str], labels: list[str]) -> DataFrame:
    """Probabilities rounded to four places, the likeliest label and its probability."""
    from ..functions.probability import argmax

    p = [F.col(c) for c in probs]
    return df.select("*", *(F.round(c, 4).alias(f"prob_{n}") for c, n in zip(p, labels)), F.array(*map(F.lit, labels))[argmax(p)].alias("prediction"), F.round(F.greatest(*p), 4).alias("confidence"))


def read_features(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A feature table; NaN becomes null. Unused columns never leave the file."""
    df = spark.read.parquet(path)
    df = df.select(*columns) if columns else df
    return df.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n, t in df.dtypes if t in ("double", "float")})
