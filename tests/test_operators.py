"""Closed forms, worked numbers, raised errors and planted signals."""

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchline.functions import distributions as D
from pitchline.functions import probability as P
from pitchline.operators import analysis, boosting, encoding, metrics, modelling, preparation, statistics, temporal
from pitchline.plans import count_experiment
from pitchline.sources import config, persistence


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_distributions(spark):
    lam = F.lit(1.7)
    assert sum(value(spark, D.pmf(lam, 30))) == pytest.approx(1)
    both = value(spark, D.convolve(D.pmf(lam, 12), D.pmf(F.lit(0.9), 12), 12, renormalize=False))
    assert both[:13] == pytest.approx(value(spark, D.pmf(F.lit(2.6), 12)))
    nearly = value(spark, D.pmf(lam, 8, "negbin", F.lit(1e-7)))
    assert nearly == pytest.approx(value(spark, D.pmf(lam, 8)), abs=1e-6)
    assert value(spark, D.survival(lam, 3)) == pytest.approx(1 - sum(value(spark, D.pmf(lam, 3))))
    assert value(spark, D.log_pmf(F.lit(4), lam, "negbin", F.lit(0.5))) == pytest.approx(math.log(value(spark, D.pmf(lam, 4, "negbin", F.lit(0.5)))[4]))
    assert value(spark, D.total_survival(F.array(*map(F.lit, (0.5, 0.3, 0.2))), 0.5)) == pytest.approx(0.5)
    with pytest.raises(ValueError):
        D.pmf(lam, 3, "gamma")
    with pytest.raises(ValueError):
        D.pmf(lam, 3, "negbin")


def test_scores(spark):
    p = [F.lit(x) for x in (1.0, 0.0, 0.0)]
    assert value(spark, P.rps_1x2(p, F.lit(0))) == 0
    assert value(spark, P.rps_1x2(p, F.lit(2))) == 1
    assert value(spark, P.argmax([F.lit(0.4), F.lit(0.4), F.lit(0.2)])) == 0
    assert value(spark, P.normal_sf(F.lit(1.959964))) == pytest.approx(0.025, abs=1e-6)


def test_likelihood_ratio():
    out = metrics.likelihood_ratio(1.664177742102, 1.663961186864, 5875)
    assert out["lr"] == pytest.approx(2.544524, abs=1e-5)
    assert out["p_value"] == pytest.approx(0.0553386292, abs=1e-8)
    assert out["family"] == "poisson"


def test_folds_and_blocks():
    bounds = temporal.tscv_bounds(7442, 5)
    assert [b - a for _, a, b in bounds] == [1240] * 5
    assert np.mean([a for _, a, _ in bounds]) == 3722
    assert np.std([a for _, a, _ in bounds], ddof=1) == pytest.approx(1960.612, abs=1e-3)
    assert temporal.block_bounds(10, 3) == [0, 3, 6, 10]
    assert temporal.strata_index(5, 10, 2) == [0, 1, 2, 3, 4]
    rng = np.random.default_rng(0)
    assert sorted(temporal.block_permutation(rng, 17, 5)) == list(range(17))
    assert temporal.run_length_block(1000, 99) == 30
    with pytest.raises(ValueError):
        temporal.tscv_bounds(3, 5)


def test_rebuild_is_idempotent(spark):
    df = spark.createDataFrame([(1, 2, 3, 99), (2, None, 1, 99)], "m int, home_1st_corners int, home_2nd_corners int, home_total_corners int")
    once = preparation.rebuild_totals(df)
    assert [r.home_total_corners for r in once.orderBy("m").collect()] == [5, None]
    assert preparation.rebuild_totals(once).orderBy("m").collect() == once.orderBy("m").collect()


def test_score_90(spark):
    matches = spark.createDataFrame([(1, 10, 20, 3, 1), (2, 10, 20, 2, 2), (3, None, 20, 1, 0)], "match_id long, home_team_id long, away_team_id long, home_score long, away_score long")
    events = spark.createDataFrame(
        [(1, 1, 10, 5, "12", "goal"), (2, 1, 10, 6, "105", "goal"), (3, 1, 10, 6, "92", "goal"), (4, 1, 20, 7, None, "goal"), (5, 1, 10, 5, "12", "goal"), (6, 3, None, 1, "95", "goal")],
        "event_id long, match_id long, team_id long, player_id long, minute string, event_type string",
    )
    shots = spark.createDataFrame([(3, "2")], "event_id long, added_time string")
    out = preparation.score_90(matches, events, shots)
    rows = {r.match_id: r for r in out.collect()}
    assert (rows[1].home_et_goals, rows[1].away_et_goals, rows[1].home_score_90, rows[1].away_score_90) == (1, 1, 2, 0)
    assert (rows[2].tiene_eventos, rows[2].home_score_90) == (False, 2)
    assert (rows[3].home_et_goals, rows[3].home_score_90) == (1, 0)  # missing team keys match
    again = preparation.score_90(out, events, shots)
    assert again.columns == out.columns and sorted(map(str, again.collect())) == sorted(map(str, out.collect()))


def test_encoding(spark):
    df = spark.createDataFrame([(0, "a", 1.0), (1, "a", 0.0), (2, None, 1.0), (3, "b", 0.0)], "rix long, c string, y double")
    te = {r.rix: r.te for r in encoding.expanding_target_encoding(df, "c", "y", 2.0).collect()}
    assert te == pytest.approx({0: 0.5, 1: (1 + 1) / 3, 2: 0.5, 3: 0.5})
    levels = encoding.category_levels(df, "c")
    codes = {r.rix: r.k for r in encoding.encode_categories(df, levels, "c", "k").collect()}
    assert codes == {0: 0, 1: 0, 2: -1, 3: 1}
    with pytest.raises(Exception, match="unseen class"):
        encoding.encode_target(spark.createDataFrame([("z",)], "c string"), levels, "c", "k").collect()
    out, changes = encoding.align_frame(df, spark.createDataFrame([("b", "7", 1)], "c string, rix string, z int"), {"c": ["a"]})
    assert out.columns == df.columns and out.first() == (7, None, None)
    assert {c[1] for c in changes} >= {"missing column", "extra column", "type", "levels"}
    with pytest.raises(ValueError):
        encoding.assert_same_schema(df, df.drop("y"), {}, {})
    fitted = encoding.fit_imputer(df, ["y"], ["c"])
    assert fitted == {"y": 0.5, "c": "a"}


def test_statistics(spark):
    assert statistics.preflight(100, 688, 0.05)["floor"] == pytest.approx(1 / 101)
    assert statistics.preflight(100, 688, 0.05)["bh_rank_1"] == pytest.approx(7.3e-5, abs=1e-6)
    rows = [(w, f, i) for w, pct in enumerate([0.95, 0.10, 0.95, 0.10, 0.95]) for f, i in (("a", pct), ("b", 0.5))]
    assert np.mean([r[2] for r in rows if r[1] == "a"]) == pytest.approx(0.61)
    assert statistics.average_linkage(np.array([[0, 0.1, 0.9], [0.1, 0, 0.9], [0.9, 0.9, 0]]), 0.5) == [0, 0, 1]
    p = spark.createDataFrame([(k, x) for k, x in enumerate([0.01, 0.04, 0.03, 0.5])], "k int, p double")
    adj = {r.k: r.p_adj for r in statistics.bh_adjust(p, "p", "k").collect()}
    assert adj == pytest.approx({0: 0.04, 1: 0.04 * 4 / 3, 2: 0.04 * 4 / 3, 3: 0.5})
    assert statistics.spearman_p(0.5, 20) == pytest.approx(0.0248, abs=2e-4)
    rng = np.random.default_rng(1)
    y = rng.integers(0, 3, 600)
    assert statistics.mi_discrete_target(y + 0.1 * rng.standard_normal(600), y) == pytest.approx(math.log(3), abs=0.02)
    assert statistics.mi_discrete_target(rng.standard_normal(600), y) < 0.1
    draws = rng.gamma(3.0, 2.0, 4000)
    assert statistics.gamma_tail(float(np.quantile(draws, 0.95)), draws) == pytest.approx(0.05, abs=0.01)
    assert statistics.lognormal_tail(1.0, 3, 0.1, 2.0, 0, 1) == 1.0


def planted(n=600, features=6, seed=3, classes=False):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, features))
    y = (x[:, 0] > 0).astype(float) + (x[:, 0] > 1) if classes else rng.poisson(np.exp(0.3 + 0.8 * x[:, 0]))
    return modelling.ModelTable(x, y.astype(float), tuple(f"f{k}" for k in range(features)))


@pytest.mark.parametrize("objective", boosting.OBJECTIVES)
def test_booster(objective):
    t = planted(classes=objective == "multiclass")
    params = boosting.BoosterParams(objective=objective, rounds=30, min_leaf=20, learning_rate=0.1)
    m = boosting.Booster(params, modelling.classes_of(t, params)).fit(t.x[:400], t.y[:400], (t.x[400:], t.y[400:]))
    assert m.history[-1] < m.history[0]
    again = boosting.Booster.from_json(m.to_json())
    assert np.allclose(again.raw(t.x), m.raw(t.x))
    phi = m.contributions(t.x[:50])
    mean = phi.sum(axis=2) - m.raw(t.x[:50])
    assert np.allclose(mean, mean[0])  # contributions add up to the score less one constant
    assert m.importance(t.x[:50]).argmax() == 0
    with pytest.raises(ValueError):
        boosting.BoosterParams(objective="tweedie")


def test_selection_keeps_the_signal(spark):
    t = planted()
    cfg = modelling.SelectionConfig(runs=10, real_seeds=1, rounds=15, sample=200, method="zscore", stability_windows=2, stability_rows=100, stability_min=0.2, leakage_top=2)
    out = modelling.select_features(spark, t.take(rows=slice(0, 450)), t.take(rows=slice(450, None)), cfg)
    assert "f0" in out.selected and len(out.selected) <= 2
    scores = {r.tag: r.loss for r in out.validation.collect()}
    assert scores["selected"] < scores["random_k"]
    with pytest.raises(ValueError):
        cfg.with_overrides(nonsense=1)


def test_null_importance_does_not_depend_on_workers(spark):
    t, params = planted(200, 3), boosting.BoosterParams(rounds=5, min_leaf=10)
    a = modelling.null_importance(spark, t, params, 4, 3, 9, 100, 2)
    assert sorted(a.collect()) == sorted(a.coalesce(1).collect())


def test_grid_and_tuning(spark):
    t, params = planted(300, 3), boosting.BoosterParams(rounds=5, min_leaf=10)
    grid, tests = count_experiment.compare_models(spark, {"home": t}, {"b_poisson": params, "b_negbin": replace(params, objective="negbin")}, 3)
    assert grid.count() == 6 and len(tests) == 1
    out = modelling.tune(spark, t, params, {"max_depth": {"type": "int", "low": 2, "high": 4}}, 5, 3, startup=2)
    assert {r.state for r in out.collect()} <= {"COMPLETE", "PRUNED"} and out.count() == 5
    scores, calibration = count_experiment.evaluate(spark, {"home": t, "away": t}, {"home": t, "away": t}, {"home": params, "away": params}, [0.5, 1.5], 8)
    e, c = scores.first(), calibration.collect()
    assert e.ece_global == pytest.approx(np.mean([abs(r.p_pred_mean - r.n_over / r.n_samples) for r in c]))


TARGET = """
target: {name: goals, max_k: 8, thresholds: [0.5, 1.5], components: [{key: home, column: h}, {key: away, column: a}]}
cv: {n_splits: 4}
"""


def test_config_and_bundles(spark, tmp_path):
    (tmp_path / "c.yaml").write_text(TARGET)
    cfg = config.load_config(tmp_path / "c.yaml")
    assert cfg.target.keys == ["home", "away"] and cfg.n_splits == 4 and cfg.random_state == 67
    for bad in (TARGET.replace("max_k: 8", "max_k: 1"), TARGET.replace("key: away", "key: home"), TARGET.replace("[0.5, 1.5]", "[]")):
        (tmp_path / "bad.yaml").write_text(bad)
        with pytest.raises(ValueError):
            config.load_config(tmp_path / "bad.yaml")
    assert persistence.serializable({"a": float("nan"), "b": np.bool_(True), "c": np.int64(3), "d": [float("inf")]}) == {"a": None, "b": True, "c": 3, "d": [None]}
    persistence.save_best_params({"depth": 3}, "Boost", "poisson", "home", tmp_path)
    assert persistence.load_best_params("boost", "poisson", "home", tmp_path) == {"depth": 3}
    assert persistence.load_all_best_params(tmp_path, ["Boost"]) == {"Boost": {"depth": 3}}
    t = planted(200, 2)
    m = boosting.Booster(boosting.BoosterParams(rounds=5, min_leaf=10)).fit(t.x, t.y)
    path = persistence.save_bundle(m, ["f0", "f1"], {"f1": ["u", "v"]}, {"f0": 0.0, "f1": 1.0}, tmp_path, {"model": "boost", "family": "poisson", "component": "home"})
    df = spark.createDataFrame([(0.5, "v"), (None, "new")], "f0 double, f1 string")
    got = [r.mu for r in persistence.predict_bundle(df, path).collect()]
    assert got == pytest.approx(m.predict(np.array([[0.5, 1.0], [0.0, 1.0]])).tolist())
    with pytest.raises(ValueError):
        persistence.predict_bundle(df.drop("f1"), path)
    with pytest.raises(ValueError):
        persistence.save_bundle(m, [], {}, {}, tmp_path, {"model": "x"})
    sets = persistence.save_feature_sets(df.withColumn("t", F.lit("bad")), {"s": ["f0", "absent", "f0"]}, str(tmp_path / "sets"), ["t"], "t")
    assert spark.read.parquet(sets["s"]).columns == ["t", "f0"]


def test_column_policy_and_xy(spark):
    policy = preparation.ColumnPolicy(exclude=("a", "a"), leaky=("b",))
    assert policy.apply(["a", "b", "c_luck_d", "y"], "y") == (["a"], ["b", "c_luck_d"], ["y"])
    df = spark.createDataFrame([(1, "u", 1.0), (2, "v", 2.0)], "k int, c string, y double")
    xy, levels = preparation.prepare_xy(df, ["k", "absent"], "y", always=(), below=3)
    assert xy.columns == ["c", "y"] and levels == {"c": ["u", "v"]}
    again, _ = preparation.prepare_xy(spark.createDataFrame([("w", 1.0)], "c string, y double"), [], "y", levels)
    assert again.first().c is None


def test_bootstrap_brackets_the_mean(spark):
    df = spark.createDataFrame([(k % 2, float(k % 7)) for k in range(400)], "y_true int, residual double")
    for r in analysis.bootstrap_by_count(df, 5, 300).collect():
        assert r.ci_low < 3.1 and r.ci_high > 2.9


def test_entry_works_without_the_optional_part(spark, monkeypatch):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 7
    monkeypatch.setitem(__import__("sys").modules, "pitchline.llm", None)
    assert "over_under_ece" in entry.queries() and not any(n.startswith("op") for n in entry.queries())
