"""Positions, running sums, ranks and quantiles over several partitions and files."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitchline import queries
from pitchline.operators import analysis, encoding, ordering, statistics, temporal


@pytest.fixture(scope="module")
def million(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("rows") / "million")
    rows = spark.range(0, 1_000_000, 1, 12).select((F.xxhash64("id") % 50_000).alias("day"), "id", F.rand(3).alias("x"))
    rows.write.parquet("file://" + path)
    return "file://" + path


@pytest.mark.parametrize("aqe", ["true", "false"])
@pytest.mark.parametrize("parts", ["1", "8", "32"])
def test_row_index_numbers_every_row_once(spark, million, aqe, parts):
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", aqe)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        out = temporal.row_index(spark.read.parquet(million), ["day", "id"]).select("day", "id", "rix").toPandas()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(out) == 1_000_000
    want = out.sort_values(["day", "id"]).reset_index(drop=True)
    assert (want["rix"] == np.arange(1_000_000)).all()


@pytest.mark.parametrize("name", ["row_index_order", "expanding_target_encoding"])
def test_no_rows_are_lost_at_the_larger_scale(spark, name):
    d = "/root/testdata/sf0.1"
    assert queries.queries()[name](spark, d).count() == spark.read.parquet(f"{d}/orders.parquet").count()


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"rix": np.arange(9000), "g": rng.choice(["a", "b", None], 9000, p=[0.9, 0.05, 0.05]), "x": rng.integers(0, 700, 9000) / 7.0, "y": rng.standard_normal(9000)})
    pdf.loc[::50, "y"] = None
    df = spark.createDataFrame(pdf).repartition(7)
    return pdf, df.withColumn("y", F.nanvl("y", F.lit(None))).withColumn("g", F.col("g"))


def test_target_encoding_of_a_hot_category(frame):
    pdf, df = frame
    got = {r.rix: r.te for r in encoding.expanding_target_encoding(df, "g", "y").collect()}
    mean, seen = pdf["y"].mean(), {}
    for r in pdf.itertuples():
        s, n = seen.get(r.g, (0.0, 0))
        want = mean if pd.isna(r.g) or n == 0 else (s + 20 * mean) / (n + 20)
        assert got[r.rix] == pytest.approx(want)
        if not pd.isna(r.y):
            seen[r.g] = (s + r.y, n + 1)
    assert len(got) == len(pdf)


def test_ranks_and_correlation(spark, frame):
    pdf, df = frame
    got = ordering.with_average_rank(df, "x", ["g"], "r").select("rix", "r").toPandas().set_index("rix")["r"]
    want = pdf.groupby("g", dropna=False)["x"].rank()
    assert np.allclose(got.sort_index(), want)
    rho = {r.g: (r.rho, r.n) for r in statistics.spearman(df, "x", "y", ["g"]).collect()}
    for g, part in pdf.dropna(subset=["y"]).groupby("g", dropna=False):
        key = None if pd.isna(g) else g
        assert rho[key] == (pytest.approx(part["x"].rank().corr(part["y"].rank())), len(part))


def test_quantiles_equal_numpy(spark, frame):
    pdf, df = frame
    probs = [0.0, 0.05, 0.5, 0.95, 1.0]
    got = ordering.quantiles(df, "y", probs).first()
    assert list(got) == pytest.approx(np.nanquantile(pdf["y"], probs).tolist())
    by = {r.g: list(r)[1:] for r in ordering.quantiles(df, "x", probs, ["g"]).collect()}
    for g, part in pdf.groupby("g", dropna=False):
        assert by[None if pd.isna(g) else g] == pytest.approx(np.quantile(part["x"], probs).tolist())
    assert ordering.quantiles(df.limit(0), "x", [0.5]).first().q0 is None


def test_autocorrelation_across_chunks(spark):
    rng = np.random.default_rng(2)
    y = np.convolve(rng.standard_normal(10_005), [1, 0.7, 0.4], "valid")
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate(y)], "rix long, y double").repartition(5)
    got = {r.lag: r.acf for r in temporal.autocorrelation(df, "y", 9).collect()}
    c = y - y.mean()
    assert got == pytest.approx({k: float(c[:-k] @ c[k:] / (c @ c)) for k in range(1, 10)})


def test_bootstrap_does_not_depend_on_partitions(spark, frame):
    pdf, df = frame
    res = df.where("y IS NOT NULL").select(F.col("rix").alias("match_id"), F.floor("x").alias("y_true"), F.col("y").alias("residual"))
    runs = [sorted(map(tuple, analysis.bootstrap_by_count(res.repartition(n), 2, 200).collect())) for n in (1, 6)]
    assert runs[0] == runs[1] and len(runs[0]) == 3
    own = pdf.dropna(subset=["y"]).query("x >= 2")["y"]
    low, high = runs[0][2][1:]
    half = 1.96 * own.std() / len(own) ** 0.5
    assert low == pytest.approx(own.mean() - half, abs=0.3 * half) and high == pytest.approx(own.mean() + half, abs=0.3 * half)


def test_block_correlations_equal_pandas(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 6))
    x[:, 1] = x[:, 0] + 0.3 * rng.standard_normal(400)
    x[:, 5] = 1.0  # does not vary
    rows = [(k // 100, k, f, float(x[k, f])) for k in range(400) for f in range(6)]
    df = spark.createDataFrame(rows, "block int, rix long, feature int, value double")
    got = {(r.a, r.b): r.rho for r in statistics.block_correlations(df).collect()}
    mats = [pd.DataFrame(x[b * 100 : b * 100 + 100]).rank().corr().abs().to_numpy() for b in range(4)]
    for (a, b), rho in got.items():
        want = np.median([m[a, b] for m in mats])
        assert rho is None if np.isnan(want) else rho == pytest.approx(want)
    assert len(got) == 15
