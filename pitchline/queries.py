"""The engine's queries over the test tables, each with SQL for DuckDB where there is one.

Doubles are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import view, with_views
from .functions import distributions as D
from .functions import probability as P
from .operators import analysis, encoding, metrics, preparation, statistics, temporal
from .streaming import drift

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

TRAIN, VALID, TEST = ["1995", "1996", "1997", "1998"], ["1999"], ["2000", "2001"]
SPLITS = {"train": TRAIN, "val": VALID, "test": TEST}
THRESHOLDS = [k + 0.5 for k in range(7)]
K = 8


def tidy(df: DataFrame) -> DataFrame:
    """Doubles rounded, negative zero made zero."""
    return df.select(*((F.round(c, 6) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = lambda spark, sf_dir: tidy(f(lambda name: view(spark, sf_dir, name), spark, sf_dir))
        if sql:
            _SQL[f.__name__] = with_views(sql)
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import model_queries

    return _QUERIES | model_queries.queries()


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _QUERIES["over_under_ece"](spark, sf_dir)


# SQL fragments -----------------------------------------------------------------

SPLIT_SQL = "CASE WHEN name IN ('1995','1996','1997','1998') THEN 'train' WHEN name = '1999' THEN 'val' ELSE 'test' END"
ORDERED = "SELECT *, row_number() OVER (ORDER BY match_datetime_utc, match_id) - 1 AS rix, count(*) OVER () AS n FROM matches"
LABELLED = f"SELECT m.match_id, m.tournament, m.rix, m.n, CASE WHEN h.home_score = h.away_score THEN 0 WHEN h.home_score > h.away_score THEN 1 ELSE 2 END AS y, {SPLIT_SQL} AS split FROM ({ORDERED}) m JOIN halves h USING (match_id)"


def _r(x: str, name: str) -> str:
    return f"round({x}, 6) + 0.0 AS {name}"


def _poisson(mu: str, k: str) -> str:
    return f"exp(-{mu}) * pow({mu}, {k}) / factorial(CAST({k} AS INT))"


def _nb(mu: str, a: str, k: str) -> str:
    n, p = f"(1/{a})", f"((1/{a})/((1/{a})+{mu}))"
    return f"exp(lgamma({k}+{n}) - lgamma({n}) - lgamma({k}+1) + {n}*ln({p}) + {k}*ln(1-{p}))"


def _grid(pmf: str, k: int = K) -> str:
    return f"list_transform(range(0, {k + 1}), lambda k: {pmf})"


RPS = "(pow(p0 - (CASE WHEN y_true = 0 THEN 1 ELSE 0 END), 2) + pow(p0 + p1 - (CASE WHEN y_true IN (0, 1) THEN 1 ELSE 0 END), 2)) / 2"
PRED = "CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END"
PY = "CASE y_true WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END"
SCORED = f"SELECT *, {RPS} AS rps, {PRED} AS pred, CAST({PRED} = y_true AS INT) AS hit FROM pred1x2"
BIN = " + ".join(f"CAST(p > {e!r} AS INT)" for e in P.EDGES)
CLASSES = "SELECT match_id, model, o.outcome, CASE o.outcome WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END AS p, CAST(y_true = o.outcome AS INT) AS hit FROM pred1x2, (SELECT unnest([0, 1, 2]) AS outcome) o"
BINS = f"SELECT model, outcome, {BIN} AS bin, count(*) AS n, avg(p) AS conf, avg(hit) AS acc FROM ({CLASSES}) GROUP BY ALL"
ECE = f"SELECT model, outcome, sum(n * abs(acc - conf)) / sum(n) AS ece, CAST(sum(n) AS BIGINT) AS n FROM ({BINS}) GROUP BY ALL"
SEEN_RPS = "list_sum(list_transform(range(0, 9), lambda k: pow(list_sum(list_slice(g, 1, k + 1)) - CASE WHEN k >= y_true THEN 1 ELSE 0 END, 2)))"


def _residuals(side: str = "home") -> str:
    inner = f"SELECT match_id, y_{side} AS y_true, mu_{side} AS mean_pred, alpha_{side} AS alpha, {_grid(_nb(f'mu_{side}', f'alpha_{side}', 'k'))} AS g FROM predcnt"
    return f"SELECT match_id, y_true, mean_pred, alpha, y_true - mean_pred AS residual, ln(1 + y_true) - ln(1 + mean_pred) AS log_diff, (y_true - mean_pred) / sqrt(mean_pred + alpha * mean_pred * mean_pred) AS pearson, {SEEN_RPS} AS rps FROM ({inner})"


# preparation -----------------------------------------------------------------


@query("SELECT match_id, CAST(home_1st_corners + home_2nd_corners AS BIGINT) AS home_total_corners, CAST(away_1st_corners + away_2nd_corners AS BIGINT) AS away_total_corners FROM halves")
def targets_from_halves(v, spark, d):
    return preparation.rebuild_totals(v("halves")).select("match_id", "home_total_corners", "away_total_corners")


@query("""
WITH g AS (SELECT e.*, s.added_time, row_number() OVER (PARTITION BY match_id, team_id, player_id, minute, added_time ORDER BY e.event_id) AS k
  FROM ev_base e LEFT JOIN ev_shots s ON e.event_id = s.event_id WHERE event_type = 'goal'),
c AS (SELECT match_id, team_id, CAST(sum(CASE WHEN minute <= 90 OR (minute > 90 AND minute - added_time = 90) THEN 1 ELSE 0 END) AS BIGINT) AS g90, count(event_id) AS n FROM g WHERE k = 1 GROUP BY ALL),
m AS (SELECT m.*, coalesce(h.n - h.g90, 0) AS het, coalesce(a.n - a.g90, 0) AS aet, coalesce(h.n, 0) AS hn, coalesce(a.n, 0) AS an, m.match_id IN (SELECT match_id FROM ev_base) AS seen
  FROM ev_matches m LEFT JOIN c h ON m.match_id = h.match_id AND m.home_team_id IS NOT DISTINCT FROM h.team_id LEFT JOIN c a ON m.match_id = a.match_id AND m.away_team_id IS NOT DISTINCT FROM a.team_id)
SELECT match_id, het AS home_et_goals, aet AS away_et_goals, seen AS tiene_eventos, hn = home_score AND an = away_score AS eventos_cuadran,
  CASE WHEN seen THEN greatest(home_score - het, 0) ELSE home_score END AS home_score_90, CASE WHEN seen THEN greatest(away_score - aet, 0) ELSE away_score END AS away_score_90 FROM m""")
def score90_regulation(v, spark, d):
    return preparation.score_90(v("ev_matches"), v("ev_base"), v("ev_shots")).select("match_id", "home_et_goals", "away_et_goals", "tiene_eventos", "eventos_cuadran", "home_score_90", "away_score_90")


@query("SELECT match_id, home_1st_corners FROM halves WHERE home_1st_corners IS NOT NULL")
def clean_key_missing(v, spark, d):
    return preparation.clean_key_missing(v("halves"), ("home_1st_corners",)).select("match_id", "home_1st_corners")


@query(f"SELECT {SPLIT_SQL} AS split, count(*) AS n, min(match_id) AS first_id FROM matches WHERE tournament IN ('1-URGENT', '2-HIGH', '5-LOW') AND name BETWEEN '1995' AND '2001' GROUP BY ALL")
def split_counts_by_season(v, spark, d):
    out = preparation.split_by_season(v("matches"), SPLITS, tournaments=["1-URGENT", "2-HIGH", "5-LOW"])
    return out.groupBy("split").agg(F.count("*").alias("n"), F.min("match_id").alias("first_id"))


@query("SELECT match_id, CASE WHEN home_score = away_score THEN 0 WHEN home_score > away_score THEN 1 ELSE 2 END AS target_result FROM halves")
def label_1x2(v, spark, d):
    return v("halves").select("match_id", preparation.label_1x2(F.col("home_score"), F.col("away_score")).alias("target_result"))


@query("SELECT 'tournament' AS \"column\", count(DISTINCT tournament) AS n_distinct, count(DISTINCT tournament) < 20 AS categorical FROM matches UNION ALL SELECT 'home_team_id', count(DISTINCT home_team_id), count(DISTINCT home_team_id) < 20 FROM matches UNION ALL SELECT 'name', count(DISTINCT name), count(DISTINCT name) < 20 FROM matches")
def low_cardinality_columns(v, spark, d):
    return preparation.low_cardinality(v("matches"), ["tournament", "home_team_id", "name"])


# order, folds, samples ----------------------------------------------------------


def _ordered(v) -> DataFrame:
    return temporal.row_index(v("matches"), ["match_datetime_utc", "match_id"])


def _labelled(v) -> DataFrame:
    y = preparation.label_1x2(F.col("home_score"), F.col("away_score"))
    return preparation.split_by_season(_ordered(v), SPLITS).join(v("halves").select("match_id", y.alias("y")), "match_id")


@query(f"SELECT match_id, rix FROM ({ORDERED})")
def row_index_order(v, spark, d):
    return _ordered(v).select("match_id", "rix")


@query(f"""
WITH o AS ({ORDERED}), f AS (SELECT unnest(range(0, 5)) AS fold), b AS (SELECT o.*, fold, n - (5 - fold) * (n // 6) AS a, n // 6 AS ts FROM o, f)
SELECT CAST(fold AS INT) AS fold, CASE WHEN rix < a THEN 'train' ELSE 'valid' END AS role, count(*) AS n, min(rix) AS lo, max(rix) AS hi FROM b WHERE rix < a + ts GROUP BY ALL""")
def tscv_folds(v, spark, d):
    return temporal.tscv_folds(_ordered(v), 5).groupBy("fold", "role").agg(F.count("*").alias("n"), F.min("rix").alias("lo"), F.max("rix").alias("hi"))


@query(f"WITH o AS ({ORDERED}), b AS (SELECT *, list_filter(range(0, 7), lambda k: rix < CAST(floor((k + 1) * n / 7.0) AS BIGINT))[1] AS block FROM o) SELECT CAST(block AS INT) AS block, count(*) AS n, min(rix) AS lo, max(rix) AS hi FROM b GROUP BY ALL")
def block_bounds_agg(v, spark, d):
    rows = _ordered(v)
    return rows.groupBy(temporal.block_of("rix", rows.count(), 7).alias("block")).agg(F.count("*").alias("n"), F.min("rix").alias("lo"), F.max("rix").alias("hi"))


@query(f"""
WITH o AS ({ORDERED}), b AS (SELECT CAST(floor(s * n / 10.0) AS BIGINT) AS lo, CAST(floor((s + 1) * n / 10.0) AS BIGINT) - 1 AS hi, n FROM (SELECT max(n) AS n FROM o), (SELECT unnest(range(0, 10)) AS s)),
t AS (SELECT DISTINCT CASE WHEN n <= 200 THEN lo + i WHEN hi - lo + 1 <= 20 THEN lo + i ELSE CAST(floor(lo + i * ((hi - lo) / 19.0)) AS BIGINT) END AS rix, lo, hi FROM b, (SELECT unnest(range(0, 20)) AS i))
SELECT rix, match_id FROM o WHERE rix IN (SELECT rix FROM t WHERE rix <= hi)""")
def strata_sample(v, spark, d):
    rows = _ordered(v)
    return temporal.strata_sample(rows, rows.count(), 200, 10).select("rix", "match_id")


@query(f"WITH t AS ({LABELLED}), c AS (SELECT rix, y - avg(y) OVER () AS c FROM t) SELECT CAST(l.lag AS INT) AS lag, {_r('sum(a.c * b.c) / (SELECT sum(c * c) FROM c)', 'acf')} FROM c a, (SELECT unnest(range(1, 21)) AS lag) l JOIN c b ON b.rix = a.rix + l.lag GROUP BY ALL")
def acf_block_size(v, spark, d):
    return temporal.autocorrelation(_labelled(v), "y", 20)


@query(f"WITH t AS (SELECT y, lag(y) OVER (ORDER BY rix) AS b FROM ({LABELLED})) SELECT count(*) AS n, count(CASE WHEN b <> y THEN 1 END) AS changes FROM t")
def runlength_block_size(v, spark, d):
    return temporal.run_length_changes(_labelled(v), "y")


# encoding -----------------------------------------------------------------------


@query(f"WITH t AS ({LABELLED}) SELECT match_id, {_r('''CASE WHEN tournament IS NULL THEN (SELECT avg(y) FROM t) ELSE (coalesce(sum(y) OVER w, 0) + 20 * (SELECT avg(y) FROM t)) / (count(y) OVER w + 20) END''', 'te')} FROM t WINDOW w AS (PARTITION BY tournament ORDER BY rix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def expanding_target_encoding(v, spark, d):
    return encoding.expanding_target_encoding(_labelled(v), "tournament", "y").select("match_id", "te")


@query(f"WITH t AS ({LABELLED}), g AS (SELECT avg(y) AS g FROM t WHERE split = 'train'), s AS (SELECT tournament, sum(y) AS s, count(y) AS c FROM t WHERE split = 'train' AND tournament IS NOT NULL GROUP BY ALL) SELECT match_id, {_r('coalesce((s + 10 * g) / (c + 10), g)', 'te')} FROM t CROSS JOIN g LEFT JOIN s ON t.tournament = s.tournament WHERE split = 'val'")
def target_encoding_val(v, spark, d):
    rows = _labelled(v)
    return encoding.target_encoding(rows.where("split = 'train'"), rows.where("split = 'val'"), "tournament", "y").select("match_id", "te")


@query(f"""
WITH o AS ({ORDERED}), b AS (SELECT o.*, CAST(fold AS INT) AS fold, n - (3 - fold) * (n // 4) AS a, n // 4 AS ts, CAST(match_id % 3 AS DOUBLE) AS y FROM o, (SELECT unnest(range(0, 3)) AS fold)),
g AS (SELECT fold, avg(y) AS g FROM b WHERE rix < a GROUP BY ALL), s AS (SELECT fold, tournament, sum(y) AS s, count(y) AS c FROM b WHERE rix < a AND tournament IS NOT NULL GROUP BY ALL)
SELECT b.fold, b.tournament, {_r('avg(coalesce((s + 20 * g) / (c + 20), g))', 'te')}, count(*) AS n FROM b JOIN g ON b.fold = g.fold LEFT JOIN s ON b.fold = s.fold AND b.tournament = s.tournament WHERE rix >= a AND rix < a + ts GROUP BY ALL""")
def in_fold_target_encoding(v, spark, d):
    """Each fold's validation rows, encoded from its own training rows."""
    rows = _ordered(v).withColumn("y", (F.col("match_id") % 3).cast("double"))
    parts = temporal.tscv_folds(rows, 3)
    out = None
    for f in range(3):
        one = parts.where(F.col("fold") == f)
        enc = encoding.target_encoding(one.where("role = 'train'"), one.where("role = 'valid'"), "tournament", "y", 20.0).groupBy("fold", "tournament").agg(F.avg("te").alias("te"), F.count("*").alias("n"))
        out = enc if out is None else out.unionByName(enc)
    return out


@query("WITH l AS (SELECT tournament, row_number() OVER (ORDER BY tournament) - 1 AS code FROM (SELECT DISTINCT tournament FROM matches WHERE tournament IS NOT NULL AND tournament <> '5-LOW')) SELECT match_id, CAST(coalesce(code, -1) AS INT) AS code FROM matches LEFT JOIN l USING (tournament)")
def category_codes(v, spark, d):
    m = v("matches")
    return encoding.encode_categories(m, encoding.category_levels(m.where("tournament <> '5-LOW'"), "tournament"), "tournament", "code").select("match_id", "code")


@query(f"WITH t AS (SELECT *, {SPLIT_SQL} AS split FROM matches), l AS (SELECT DISTINCT tournament FROM t WHERE split = 'train' AND tournament <> '2-HIGH') SELECT 'tournament' AS \"column\", round(greatest(avg(CASE WHEN tournament IS NOT NULL THEN 1.0 ELSE 0 END) - avg(CASE WHEN tournament IN (SELECT tournament FROM l) THEN 1.0 ELSE 0 END), 0), 4) + 0.0 AS extra_missing FROM t WHERE split = 'val'")
def unseen_level_audit(v, spark, d):
    rows = preparation.split_by_season(v("matches"), SPLITS)
    return encoding.unseen_audit(rows.where("split = 'train' AND tournament <> '2-HIGH'"), rows.where("split = 'val'"), ["tournament"])


@query("WITH s AS (SELECT median(home_1st_corners) AS med FROM halves), m AS (SELECT tournament AS top FROM matches WHERE tournament IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT match_id, CAST(coalesce(home_1st_corners, med) AS DOUBLE) AS home_1st_corners, coalesce(tournament, top) AS tournament FROM halves JOIN matches USING (match_id), s, m")
def impute_median_mode(v, spark, d):
    rows = v("halves").join(v("matches"), "match_id").withColumn("home_1st_corners", F.col("home_1st_corners").cast("double"))
    return encoding.impute(rows, encoding.fit_imputer(rows, ["home_1st_corners"], ["tournament"])).select("match_id", "home_1st_corners", "tournament")


# distributions ------------------------------------------------------------------


def _cells(df: DataFrame, grid, name: str = "p") -> DataFrame:
    return df.select("match_id", F.posexplode(grid).alias("k", name))


@query(f"SELECT match_id, CAST(k.k AS INT) AS k, {_r(_poisson('mu_home', 'k.k'), 'p')} FROM predcnt, (SELECT unnest(range(0, 9)) AS k) k")
def poisson_pmf_grid(v, spark, d):
    return _cells(v("predcnt"), D.pmf(F.col("mu_home"), K))


@query(f"SELECT match_id, CAST(k.k AS INT) AS k, {_r(_nb('mu_home', 'alpha_home', 'k.k'), 'p')} FROM predcnt, (SELECT unnest(range(0, 9)) AS k) k")
def negbin_pmf_grid(v, spark, d):
    return _cells(v("predcnt"), D.pmf(F.col("mu_home"), K, "negbin", F.col("alpha_home")))


@query(f"WITH g AS (SELECT match_id, {_grid(_poisson('mu_home', 'k'))} AS g FROM predcnt) SELECT match_id, CAST(k.k AS INT) AS k, {_r('list_sum(list_slice(g, 1, k.k + 1))', 'p')} FROM g, (SELECT unnest(range(0, 9)) AS k) k")
def poisson_cdf_grid(v, spark, d):
    return _cells(v("predcnt"), D.cdf(F.col("mu_home"), K))


@query(f"WITH g AS (SELECT match_id, {_grid(_poisson('mu_home', 'k'), 2)} AS g FROM predcnt) SELECT match_id, {_r('1 - list_sum(g)', 'p_over_2')} FROM g")
def survival(v, spark, d):
    return v("predcnt").select("match_id", D.survival(F.col("mu_home"), 2).alias("p_over_2"))


@query(f"WITH x AS (SELECT match_id, CASE WHEN match_id % 7 = 0 THEN CAST('nan' AS DOUBLE) WHEN match_id % 11 = 0 THEN -1.0 ELSE mu_home END AS mu, CASE WHEN match_id % 5 = 0 THEN CAST('infinity' AS DOUBLE) ELSE alpha_home * 400 END AS a FROM predcnt) SELECT match_id, {_r('CASE WHEN isfinite(mu) THEN greatest(mu, 0.000001) ELSE 0.000001 END', 'mu')}, {_r('CASE WHEN isfinite(a) THEN least(greatest(a, 0.000001), 100.0) ELSE 0.000001 END', 'alpha')} FROM x")
def clip_params(v, spark, d):
    mu = F.when(F.col("match_id") % 7 == 0, F.lit(float("nan"))).when(F.col("match_id") % 11 == 0, -1.0).otherwise(F.col("mu_home"))
    a = F.when(F.col("match_id") % 5 == 0, F.lit(float("inf"))).otherwise(F.col("alpha_home") * 400)
    return v("predcnt").select("match_id", D.clip_mu(mu).alias("mu"), D.clip_alpha(a).alias("alpha"))


CONVOLVED = "list_transform(range(0, 17), lambda t: list_sum(list_transform(range(greatest(0, t - 8), least(t, 8) + 1), lambda i: a[i + 1] * b[t - i + 1])))"


@query(f"WITH g AS (SELECT match_id, {_grid(_nb('mu_home', 'alpha_home', 'k'))} AS a, {_grid(_nb('mu_away', 'alpha_away', 'k'))} AS b FROM predcnt), c AS (SELECT match_id, {CONVOLVED} AS g FROM g) SELECT match_id, CAST(k.k AS INT) AS k, {_r('g[k.k + 1] / list_sum(g)', 'p')} FROM c, (SELECT unnest(range(0, 17)) AS k) k")
def total_pmf_convolution(v, spark, d):
    return _cells(v("predcnt"), D.total_pmf(F.col("mu_home"), F.col("mu_away"), K, "negbin", F.col("alpha_home"), F.col("alpha_away")))


@query(f"WITH g AS (SELECT match_id, {_grid(_poisson('(mu_home + mu_away)', 'k'), 16)} AS g FROM predcnt) SELECT match_id, CAST(k.k AS INT) AS k, {_r('g[k.k + 1] / list_sum(g)', 'p')} FROM g, (SELECT unnest(range(0, 17)) AS k) k")
def total_pmf_poisson_approx(v, spark, d):
    return _cells(v("predcnt"), D.total_pmf(F.col("mu_home"), F.col("mu_away"), K, method="poisson"))


@query(f"""
WITH g AS (SELECT y_home + y_away AS y, {_grid(_poisson('mu_home', 'k'))} AS a, {_grid(_poisson('mu_away', 'k'))} AS b FROM predcnt), c AS (SELECT y, {CONVOLVED} AS g FROM g),
t AS (SELECT unnest([0.5, 1.5, 2.5, 3.5, 4.5, 5.5, 6.5]::DOUBLE[]) AS threshold),
s AS (SELECT threshold, avg(list_sum(list_slice(g, CAST(floor(threshold) AS INT) + 2, 17)) / list_sum(g)) AS p, count(CASE WHEN y > threshold THEN 1 END) AS n_over, count(*) AS n FROM c, t GROUP BY ALL)
SELECT threshold, {_r('p', 'p_pred_mean')}, {_r('n_over / n', 'p_real')}, {_r('abs(p - n_over / n)', 'abs_error')}, n_over, n AS n_samples FROM s""")
def over_under_ece(v, spark, d):
    return metrics.over_under(v("predcnt"), THRESHOLDS, K)


@query(f"""
WITH g AS (SELECT y_home + y_away AS y, {_grid(_nb('mu_home', 'alpha_home', 'k'))} AS a, {_grid(_nb('mu_away', 'alpha_away', 'k'))} AS b FROM predcnt), c AS (SELECT y, {CONVOLVED} AS g FROM g),
s AS (SELECT threshold, avg(list_sum(list_slice(g, CAST(floor(threshold) AS INT) + 2, 17)) / list_sum(g)) AS p, count(CASE WHEN y > threshold THEN 1 END) / count(*) AS p_real, count(*) AS n FROM c, (SELECT unnest([0.5, 1.5, 2.5]::DOUBLE[]) AS threshold) GROUP BY ALL),
h AS (SELECT avg(rps) AS rps FROM ({_residuals('home')})), w AS (SELECT avg(rps) AS rps FROM ({_residuals('away')})),
l AS (SELECT -avg(ln({_nb('mu_home', 'alpha_home', 'y_home')})) AS nh, -avg(ln({_nb('mu_away', 'alpha_away', 'y_away')})) AS na FROM predcnt)
SELECT {_r('nh', 'nll_home')}, {_r('na', 'nll_away')}, {_r('h.rps', 'rps_home')}, {_r('w.rps', 'rps_away')}, {_r('e.ece', 'ece_global')}, e.n AS n_samples FROM (SELECT avg(abs(p - p_real)) AS ece, max(n) AS n FROM s) e, h, w, l""")
def evaluate_counts(v, spark, d):
    return metrics.evaluate_counts(v("predcnt"), [0.5, 1.5, 2.5], K, "negbin")


@query(f"WITH r AS ({_residuals()}) SELECT {_r('avg(rps)', 'mean')}, {_r('stddev_pop(rps)', 'std')}, {_r('median(rps)', 'median')}, {_r('quantile_cont(rps, 0.95)', 'p95')}, count(rps) AS n FROM r")
def rps_count_report(v, spark, d):
    return metrics.summary(metrics.count_rps(v("predcnt"), "y_home", "mu_home", K, "negbin", "alpha_home"), "rps")


@query(f"SELECT 'poisson' AS family, {_r('-avg(y_home * ln(mu_home) - mu_home - lgamma(y_home + 1))', 'nll')}, count(*) AS n FROM predcnt UNION ALL SELECT 'negbin', {_r('-avg(ln(' + _nb('mu_home', 'alpha_home', 'y_home') + '))', 'nll')}, count(*) FROM predcnt")
def nll_count(v, spark, d):
    p = v("predcnt")
    a, b = metrics.count_nll(p, "y_home", "mu_home"), metrics.count_nll(p, "y_home", "mu_home", "negbin", "alpha_home")
    return a.withColumn("family", F.lit("poisson")).unionByName(b.withColumn("family", F.lit("negbin"))).select("family", "nll", "n")


def _both_nll(v) -> DataFrame:
    return v("predcnt").agg((-F.avg(D.log_pmf(F.col("y_home"), F.col("mu_home")))).alias("a"), (-F.avg(D.log_pmf(F.col("y_home"), F.col("mu_home"), "negbin", F.col("alpha_home")))).alias("b"), F.count("*").alias("n"))


@query()
def lr_test(v, spark, d):
    lr = _both_nll(v).select((2 * F.col("n") * (F.col("a") - F.col("b"))).alias("lr"))
    out = lr.withColumn("p_value", 0.5 * P.chi2_1_sf("lr"))
    return out.withColumn("family", F.when(F.col("p_value") < 0.01, "negbin").otherwise("poisson"))


@query(f"WITH x AS (SELECT avg(y_home * ln(mu_home) - mu_home - lgamma(y_home + 1)) AS a, avg(ln({_nb('mu_home', 'alpha_home', 'y_home')})) AS b, count(*) AS n FROM predcnt) SELECT round(2 * n * (b - a), 3) + 0.0 AS lr, n FROM x")
def lr_statistic(v, spark, d):
    return _both_nll(v).select(F.round(2 * F.col("n") * (F.col("a") - F.col("b")), 3).alias("lr"), "n")


@query(f"SELECT {_r('2 * avg(CASE WHEN y_home > 0 THEN y_home * ln(y_home / mu_home) ELSE 0 END - (y_home - mu_home))', 'deviance')} FROM predcnt")
def poisson_deviance(v, spark, d):
    return v("predcnt").agg(metrics.poisson_deviance(F.col("y_home"), F.col("mu_home")).alias("deviance"))


@query(f"WITH g AS (SELECT match_id, mu_home, {_grid(_nb('mu_home', 'alpha_home', 'k'), 3)} AS g FROM predcnt) SELECT match_id, {_r('mu_home', 'mean_pred')}, {_r('g[1]', 'p_0')}, {_r('g[2]', 'p_1')}, {_r('g[3]', 'p_2')}, {_r('g[4]', 'p_3')}, {_r('least(greatest(1 - list_sum(g), 0), 1)', 'p_ge_4')} FROM g")
def predict_distribution(v, spark, d):
    grid = D.pmf(F.col("mu_home"), 3, "negbin", F.col("alpha_home"))
    rows = v("predcnt").select("match_id", F.col("mu_home").alias("mean_pred"), grid.alias("g"))
    return rows.select("match_id", "mean_pred", *(F.col("g")[k].alias(f"p_{k}") for k in range(4)), F.least(F.greatest(1 - D.total(F.col("g")), F.lit(0.0)), F.lit(1.0)).alias("p_ge_4"))


@query(f"WITH x AS (SELECT match_id, 1 + match_id % 9 AS n, (1 + match_id % 7) / 9.0 AS p FROM predcnt) SELECT match_id, {_r('n * (1 - p) / p', 'mu_a')}, {_r('1.0 / n', 'alpha_a')}, {_r('n / (p * 3)', 'mu_b')}, {_r('1.0 / n', 'alpha_b')} FROM x")
def negbin_from_backend(v, spark, d):
    n, p = (1 + F.col("match_id") % 9).cast("double"), (1 + F.col("match_id") % 7) / F.lit(9.0)
    (a, b), (c, e) = D.nb_from_count_probs(n, p), D.nb_from_concentration_rate(n, p * 3)
    return v("predcnt").select("match_id", a.alias("mu_a"), b.alias("alpha_a"), c.alias("mu_b"), e.alias("alpha_b"))


# 1X2 metrics ----------------------------------------------------------------------


@query(f"SELECT model, {_r('avg(rps)', 'rps')}, {_r('avg(-ln(least(greatest(' + PY + ', 1e-15), 1 - 1e-15)))', 'log_loss')}, {_r('avg(hit)', 'accuracy')}, count(*) AS n FROM ({SCORED}) GROUP BY ALL")
def scores_1x2(v, spark, d):
    p = [F.col(c) for c in analysis.PROBS]
    return v("pred1x2").groupBy("model").agg(F.avg(P.rps_1x2(p, F.col("y_true"))).alias("rps"), F.avg(P.log_loss(p, F.col("y_true"))).alias("log_loss"), F.avg((P.argmax(p) == F.col("y_true")).cast("double")).alias("accuracy"), F.count("*").alias("n"))


@query(f"WITH s AS (SELECT model, avg(rps) AS rps, avg(-ln(least(greatest({PY}, 1e-15), 1 - 1e-15))) AS ll, avg(hit) AS acc, count(*) AS n FROM ({SCORED}) GROUP BY ALL), e AS (SELECT model, avg(ece) AS ece FROM ({ECE}) GROUP BY ALL) SELECT model, {_r('rps', 'rps')}, {_r('ll', 'log_loss')}, {_r('acc', 'accuracy')}, n, {_r('ece', 'ece')} FROM s JOIN e USING (model)")
def evaluate_1x2(v, spark, d):
    return metrics.evaluate_1x2(v("pred1x2"), analysis.PROBS, "y_true", ["model"])


@query(f"SELECT model, outcome, {_r('ece', 'ece')}, n FROM ({ECE})")
def ece_multiclass(v, spark, d):
    return metrics.expected_calibration_error(v("pred1x2"), analysis.PROBS, "y_true", ["model"])


@query(f"SELECT model, outcome, bin, n, {_r('conf', 'conf')}, {_r('acc', 'acc')} FROM ({BINS})")
def reliability_bins(v, spark, d):
    return analysis.reliability(v("pred1x2"), analysis.PROBS, "y_true", ["model"])


@query(f"SELECT model, {_r('avg(pow(p1 - CAST(y_true = 1 AS INT), 2))', 'brier')} FROM pred1x2 GROUP BY ALL")
def brier_home(v, spark, d):
    return analysis.brier(v("pred1x2"), "p1", "y_true", 1, ["model"])


def _f1(k: int) -> str:
    return f"CASE WHEN count(CASE WHEN pred = {k} THEN 1 END) + count(CASE WHEN y_true = {k} THEN 1 END) > 0 THEN 2.0 * count(CASE WHEN pred = {k} AND y_true = {k} THEN 1 END) / (count(CASE WHEN pred = {k} THEN 1 END) + count(CASE WHEN y_true = {k} THEN 1 END)) ELSE 0 END"


@query(f"SELECT model, {_r('avg(hit)', 'accuracy')}, {_r('(' + ' + '.join(_f1(k) for k in range(3)) + ') / 3', 'macro_f1')}, {_r('avg(-ln(least(greatest(' + PY + ', 1e-15), 1 - 1e-15)))', 'log_loss')} FROM ({SCORED}) GROUP BY ALL")
def classification_report(v, spark, d):
    return metrics.classification_report(v("pred1x2"), analysis.PROBS, "y_true", ["model"])


def _joined(v) -> DataFrame:
    return v("pred1x2").join(v("matches"), "match_id")


@query(f"WITH b AS (SELECT tournament, model, outcome, {BIN} AS bin, count(*) AS n, avg(p) AS conf, avg(hit) AS acc FROM ({CLASSES}) JOIN matches USING (match_id) WHERE tournament IS NOT NULL GROUP BY ALL), e AS (SELECT tournament, model, CAST(outcome AS STRING) AS outcome, sum(n * abs(acc - conf)) / sum(n) AS ece, CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY ALL HAVING sum(n) >= 30), u AS (SELECT * FROM e UNION ALL SELECT tournament, model, 'MacroAvg', avg(ece), max(n) FROM e GROUP BY ALL) SELECT tournament, model, outcome, {_r('ece', 'ece')}, n FROM u")
def ece_by_category(v, spark, d):
    return analysis.ece_by_category(_joined(v), "tournament", "model")


@query(f"SELECT tournament, {_r('avg(rps)', 'rps_mean')}, count(*) AS n FROM ({SCORED}) JOIN matches USING (match_id) WHERE tournament IS NOT NULL GROUP BY ALL ORDER BY avg(rps) DESC, tournament LIMIT 10")
def segment_rps(v, spark, d):
    return analysis.segment_rps(_joined(v), "tournament")


def _quantile_sql(x: str, bins: int) -> str:
    edges = f"list_sort(list_distinct(quantile_cont({x}, [{', '.join(str(k / bins) for k in range(bins + 1))}])))"
    return f"WITH s AS (SELECT *, greatest(p0, p1, p2) AS favourite FROM ({SCORED})), e AS (SELECT {edges} AS e FROM s), b AS (SELECT model, rps, len(list_filter(list_slice(e, 2, -2), lambda z: {x} > z)) AS bin FROM s, e) SELECT model, CAST(bin AS INT) AS bin, {_r('avg(rps)', 'rps_mean')}, count(*) AS n FROM b GROUP BY ALL"


@query(_quantile_sql("p1", 10))
def decile_rps(v, spark, d):
    return analysis.quantile_rps(v("pred1x2"), "p1", 10, ["model"])


@query(_quantile_sql("favourite", 5))
def difficulty_bucket(v, spark, d):
    return analysis.quantile_rps(v("pred1x2").withColumn("favourite", F.greatest(*analysis.PROBS)), "favourite", 5, ["model"])


@query(f"WITH m AS (SELECT tournament, model, avg(rps) AS rps FROM ({SCORED}) JOIN matches USING (match_id) WHERE tournament IS NOT NULL GROUP BY ALL) SELECT tournament, arg_min(model, rps) AS best, {_r('min(rps)', 'rps')} FROM m GROUP BY ALL")
def best_model_by_segment(v, spark, d):
    rows = analysis.with_rps(_joined(v)).where("tournament IS NOT NULL").groupBy("tournament", "model").agg(F.avg("rps").alias("rps"))
    return analysis.best_model(rows, "rps", "model", ["tournament"])


@query(f"SELECT a.model AS a, b.model AS b, {_r('corr(a.p1, b.p1)', 'corr')} FROM pred1x2 a JOIN pred1x2 b ON a.match_id = b.match_id AND a.model < b.model GROUP BY ALL")
def model_correlation(v, spark, d):
    return analysis.model_correlation(v("pred1x2"), "p1")


_RANKS = "SELECT match_id, model, CAST(p1 < p0 AS INT) + CAST(p2 < p0 AS INT) AS r0, CAST(p0 <= p1 AS INT) + CAST(p2 < p1 AS INT) AS r1, CAST(p0 <= p2 AS INT) + CAST(p1 <= p2 AS INT) AS r2 FROM pred1x2"


@query(f"WITH r AS ({_RANKS}) SELECT a.model AS a, b.model AS b, {_r('avg(1 - (pow(a.r0 - b.r0, 2) + pow(a.r1 - b.r1, 2) + pow(a.r2 - b.r2, 2)) / 4)', 'rho')} FROM r a JOIN r b ON a.match_id = b.match_id AND a.model < b.model GROUP BY ALL")
def rank_agreement(v, spark, d):
    return analysis.rank_agreement(v("pred1x2"))


PAIRS = "pred1x2 a JOIN pred1x2 b ON a.match_id = b.match_id AND a.model < b.model"
BY_CLASS = f"SELECT o AS outcome, a.model AS a, b.model AS b, CASE o WHEN 0 THEN corr(a.p0, b.p0) WHEN 1 THEN corr(a.p1, b.p1) ELSE corr(a.p2, b.p2) END AS corr FROM {PAIRS}, (SELECT unnest([0, 1, 2]) AS o) GROUP BY o, a.model, b.model"


@query(f"WITH s AS (SELECT model, outcome FROM ({CLASSES}) GROUP BY ALL HAVING stddev_pop(p) > 0.01) SELECT model, outcome, bin, n, {_r('conf', 'conf')}, {_r('acc', 'acc')} FROM ({BINS}) JOIN s USING (model, outcome)")
def class_calibration(v, spark, d):
    return analysis.class_calibration(v("pred1x2"), ["model"])


@query(f"WITH c AS ({BY_CLASS}) SELECT outcome, a, b, {_r('corr', 'corr')} FROM c")
def class_correlation(v, spark, d):
    return analysis.class_correlation(v("pred1x2"))


@query(f"WITH c AS ({BY_CLASS}), r AS ({_RANKS}), p AS (SELECT avg(1 - (pow(a.r0 - b.r0, 2) + pow(a.r1 - b.r1, 2) + pow(a.r2 - b.r2, 2)) / 4) AS rho FROM r a JOIN r b ON a.match_id = b.match_id AND a.model < b.model GROUP BY a.model, b.model), u AS (SELECT 'class ' || outcome AS kind, avg(corr) AS x FROM c GROUP BY ALL UNION ALL SELECT 'rank', avg(rho) FROM p) SELECT kind, {_r('x', 'agreement')}, {_r('1 - x', 'diversity')} FROM u")
def model_diversity(v, spark, d):
    return analysis.diversity(v("pred1x2"))


@query(f"WITH s AS (SELECT match_id, count(DISTINCT pred) > 1 AS hard, avg(rps) AS rps FROM ({SCORED}) GROUP BY ALL) SELECT hard, count(*) AS n, {_r('avg(rps)', 'rps_mean')} FROM s GROUP BY ALL")
def disagreement(v, spark, d):
    return analysis.disagreement(v("pred1x2"))


@query(f"WITH f AS (SELECT match_id, model FROM ({SCORED}) WHERE hit = 0), c AS (SELECT a.model AS a, b.model AS b, count(*) AS common FROM f a JOIN f b ON a.match_id = b.match_id AND a.model < b.model GROUP BY ALL), n AS (SELECT model, count(*) AS n FROM f GROUP BY ALL) SELECT a, b, common, x.n + y.n - common AS either, {_r('common / (x.n + y.n - common)', 'jaccard')} FROM c JOIN n x ON x.model = a JOIN n y ON y.model = b")
def failure_jaccard(v, spark, d):
    return analysis.failure_jaccard(v("pred1x2"))


@query(f"SELECT model, y_true, {_r('avg(rps)', 'rps_mean')}, count(*) AS n FROM ({SCORED}) GROUP BY ALL")
def bias_by_result(v, spark, d):
    return analysis.bias_by_result(v("pred1x2"))


@query(f"SELECT model, greatest(p0, p1, p2) > 0.5 AS confident, {_r('avg(hit)', 'accuracy')}, count(*) AS n FROM ({SCORED}) GROUP BY ALL")
def confidence_gap(v, spark, d):
    return analysis.confidence_gap(v("pred1x2"))


_ENS = "SELECT match_id, 'mean' AS model, any_value(y_true) AS y_true, avg(p0) AS p0, avg(p1) AS p1, avg(p2) AS p2 FROM pred1x2 GROUP BY match_id UNION ALL SELECT match_id, 'median', any_value(y_true), median(p0), median(p1), median(p2) FROM pred1x2 GROUP BY match_id"


@query(f"WITH e AS ({_ENS}) SELECT model, {_r('avg(' + RPS + ')', 'rps')}, count(*) AS n FROM e GROUP BY ALL")
def ensemble_mean_median(v, spark, d):
    return analysis.with_rps(analysis.ensembles(v("pred1x2"))).groupBy("model").agg(F.avg("rps").alias("rps"), F.count("*").alias("n"))


def _ece_of(where: str) -> str:
    bins = f"SELECT model, outcome, {BIN} AS bin, count(*) AS n, avg(p) AS conf, avg(hit) AS acc FROM ({CLASSES}) JOIN matches USING (match_id) WHERE {where} GROUP BY ALL"
    return f"SELECT model, avg(e) AS ece FROM (SELECT model, outcome, sum(n * abs(acc - conf)) / sum(n) AS e FROM ({bins}) GROUP BY ALL) GROUP BY ALL"


@query(f"WITH a AS (SELECT model, avg(rps) AS rps FROM ({SCORED}) JOIN matches USING (match_id) WHERE name = '1999' GROUP BY ALL), b AS (SELECT model, avg(rps) AS rps FROM ({SCORED}) JOIN matches USING (match_id) WHERE name IN ('2000', '2001') GROUP BY ALL), e AS ({_ece_of('''name IN ('2000', '2001')''')}) SELECT a.model, {_r('a.rps', 'rps_val')}, {_r('b.rps', 'rps_test')}, {_r('b.rps - a.rps', 'delta')}, {_r('ece', 'ece_test')}, CASE WHEN b.rps - a.rps > 0.01 THEN 'OVERFIT' WHEN ece > 0.08 THEN 'POOR_CALIBRATION' ELSE 'STABLE' END AS status FROM a JOIN b USING (model) JOIN e USING (model)")
def val_vs_test_status(v, spark, d):
    rows = _joined(v)
    parts = [metrics.evaluate_1x2(rows.where(F.col("name").isin(s)), analysis.PROBS, "y_true", ["model"]) for s in (VALID, TEST)]
    return analysis.validation_status(*parts)


# count error analysis ----------------------------------------------------------------


def _residual_rows(v, side: str = "home") -> DataFrame:
    return analysis.residual_frame(v("predcnt"), f"y_{side}", f"mu_{side}", K, "negbin", f"alpha_{side}", ["match_id"])


@query(f"WITH r AS ({_residuals()}), b AS (SELECT *, CASE WHEN mean_pred >= 0 AND mean_pred < 0.5 THEN '[0,0.5)' WHEN mean_pred >= 0.5 AND mean_pred < 1 THEN '[0.5,1)' WHEN mean_pred >= 1 AND mean_pred < 2 THEN '[1,2)' END AS bin FROM r) SELECT bin, count(*) AS n, {_r('avg(mean_pred)', 'pred_mean')}, {_r('avg(y_true)', 'ytrue_mean')}, {_r('avg(rps)', 'rps_mean')} FROM b WHERE bin IS NOT NULL GROUP BY ALL")
def calibration_bins(v, spark, d):
    return analysis.calibration_by_mean(_residual_rows(v), [0, 0.5, 1, 2])


@query(f"WITH r AS ({_residuals()}) SELECT CASE WHEN y_true >= 2 THEN '2+' ELSE CAST(y_true AS STRING) END AS y_true, count(*) AS n, {_r('avg(residual)', 'residual_mean')} FROM r GROUP BY 1")
def residual_by_y(v, spark, d):
    return analysis.residual_by_count(_residual_rows(v), 2)


@query()
def residual_bootstrap(v, spark, d):
    return analysis.bootstrap_by_count(_residual_rows(v), 2, 200, key="match_id")


@query(f"WITH r AS ({_residuals()}), c AS (SELECT quantile_cont(rps, 0.95) AS c FROM r) SELECT rps >= c AS in_tail, count(*) AS n, round(avg(rps), 4) + 0.0 AS rps_mean, round(avg(residual), 4) + 0.0 AS residual_mean, round(avg(y_true), 4) + 0.0 AS y_true_mean, round(avg(mean_pred), 4) + 0.0 AS mean_pred_mean FROM r, c GROUP BY ALL")
def rps_tail(v, spark, d):
    return analysis.rps_tail(_residual_rows(v))


@query(f"WITH r AS ({_residuals()}) SELECT tournament, count(*) AS n, {_r('avg(rps)', 'rps_mean')}, {_r('avg(residual)', 'residual_mean')}, {_r('avg(y_true)', 'ytrue_mean')}, {_r('avg(mean_pred)', 'pred_mean')} FROM r JOIN matches USING (match_id) WHERE tournament IS NOT NULL GROUP BY ALL HAVING count(*) >= 20 ORDER BY avg(rps) DESC, tournament LIMIT 20")
def bias_by_group(v, spark, d):
    return analysis.bias_by_group(_residual_rows(v).join(v("matches"), "match_id"), "tournament")


@query(f"WITH r AS ({_residuals()}), m AS (SELECT strftime(match_datetime_utc, '%Y-%m') AS period, count(rps) AS n, avg(rps) AS rps_mean, stddev_samp(rps) AS rps_std, avg(residual) AS residual_mean, avg(y_true) AS ytrue_mean, avg(mean_pred) AS pred_mean FROM r JOIN matches USING (match_id) GROUP BY ALL) SELECT period, n, {', '.join(_r(c, c) for c in ('rps_mean', 'rps_std', 'residual_mean', 'ytrue_mean', 'pred_mean'))}, {_r('avg(rps_mean) OVER (ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)', 'rps_rolling')} FROM m")
def temporal_drift(v, spark, d):
    return analysis.temporal_drift(_residual_rows(v).join(v("matches"), "match_id"), "match_datetime_utc")


@query(f"WITH r AS ({_residuals()}) SELECT {_r('avg(alpha)', 'alpha_mean')}, {_r('median(alpha)', 'alpha_median')}, {_r('quantile_cont(alpha, 0.05)', 'alpha_p05')}, {_r('quantile_cont(alpha, 0.95)', 'alpha_p95')}, {_r('var_pop(pearson)', 'pearson_var')}, CASE WHEN avg(alpha) < 0.05 THEN 'collapses to poisson' WHEN var_pop(pearson) > 1.3 THEN 'overdispersion left' WHEN var_pop(pearson) < 0.7 THEN 'alpha overfitted' ELSE 'reasonable' END AS verdict FROM r")
def dispersion(v, spark, d):
    return analysis.dispersion(_residual_rows(v), "alpha_home")


def _rank(x: str, by: str = "") -> str:
    return f"rank() OVER (PARTITION BY {by or '1'} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by + ', ' if by else ''}{x}) - 1) / 2.0"


@query(f"WITH a AS ({_residuals('home')}), b AS ({_residuals('away')}), j AS (SELECT 'rps' AS measure, a.rps AS x, b.rps AS y FROM a JOIN b USING (match_id) UNION ALL SELECT 'residual', a.residual, b.residual FROM a JOIN b USING (match_id) UNION ALL SELECT 'log_diff', a.log_diff, b.log_diff FROM a JOIN b USING (match_id)), q AS (SELECT measure, round(x, 9) AS x, round(y, 9) AS y FROM j), r AS (SELECT measure, {_rank('x', 'measure')} AS rx, {_rank('y', 'measure')} AS ry FROM q) SELECT measure, {_r('corr(rx, ry)', 'rho')}, count(*) AS n FROM r GROUP BY ALL")
def component_corr(v, spark, d):
    parts = [_residual_rows(v, s).withColumns({c: F.round(c, 9) for c in ("rps", "residual", "log_diff")}) for s in ("home", "away")]
    return analysis.component_correlation(*parts, "match_id")


# selection --------------------------------------------------------------------------


def _sparse_long(v) -> DataFrame:
    """Coarse values with gaps: long form of the embeddings."""
    value = F.when(F.col("rix") % (F.col("feature") + 2) == 0, None).otherwise(F.round(F.col("value") * F.lit(2.0)))
    return v("feat_long").select("rix", "feature", "label", (value + F.lit(0.0)).alias("value"))


_SPARSE = "SELECT rix, feature, label, CASE WHEN rix % (feature + 2) = 0 THEN NULL ELSE round(value * 2.0) + 0.0 END AS value FROM feat_long"
_TOP = f"SELECT feature, sum(c) AS n, coalesce(sum(CASE WHEN value IS NULL THEN c END), 0) AS missing, max(c) AS top, coalesce(max(CASE WHEN value IS NOT NULL THEN c END), 0) AS top_some FROM (SELECT feature, value, count(*) AS c FROM ({_SPARSE}) GROUP BY ALL) GROUP BY ALL"


@query(f"SELECT feature, {_r('top / n', 'share')}, {_r('missing / n', 'missing_rate')}, top / n <= 0.98 AS kept FROM ({_TOP})")
def sparsity_multiclass(v, spark, d):
    return statistics.drop_sparse(_sparse_long(v), 0.98)


@query(f"SELECT feature, {_r('top_some / (n - missing)', 'share')}, {_r('missing / n', 'missing_rate')}, missing / n <= 0.3 AND top_some / (n - missing) <= 0.98 AS kept FROM ({_TOP})")
def sparsity_count(v, spark, d):
    return statistics.drop_sparse(_sparse_long(v), 0.98, 0.3)


def _blocked(v) -> DataFrame:
    rows = v("feat_long")
    n = rows.agg(F.max("rix") + 1).first()[0]
    return rows.withColumn("block", temporal.block_of("rix", n, 5))


@query(f"WITH n AS (SELECT max(rix) + 1 AS n FROM feat_long), l AS (SELECT f.*, list_filter(range(0, 5), lambda k: rix < CAST(floor((k + 1) * n / 5.0) AS BIGINT))[1] AS block FROM feat_long f, n), r AS (SELECT block, feature, rix, {_rank('value', 'block, feature')} AS r FROM l), c AS (SELECT a.feature AS a, b.feature AS b, a.block, abs(corr(a.r, b.r)) AS rho FROM r a JOIN r b ON a.block = b.block AND a.rix = b.rix AND a.feature < b.feature GROUP BY ALL) SELECT a, b, {_r('median(rho)', 'rho')} FROM c GROUP BY ALL")
def spearman_blocks_median(v, spark, d):
    return statistics.block_correlations(_blocked(v))


@query()
def cluster_representatives(v, spark, d):
    pairs = [(r.a, r.b, r.rho) for r in statistics.block_correlations(_blocked(v)).collect()]  # features squared
    rows = statistics.cluster_representatives(pairs, list(range(64)), {f: -f for f in range(64)}, 0.2)
    return spark.createDataFrame(rows, "feature int, cluster int, kept boolean")


_NULLS = "SELECT n.feature, any_value(imp_real) AS imp_real, count(imp) AS runs, avg(imp) AS mean, stddev_samp(imp) + 1e-12 AS std, max(imp) AS top, count(CASE WHEN imp >= imp_real THEN 1 END) AS exceed FROM nullimp n JOIN realimp r USING (feature) GROUP BY n.feature"
_ADJ = f"SELECT *, (1 + exceed) / (runs + 1) AS p, (imp_real - mean) / std AS z FROM ({_NULLS})"
_BH = f"SELECT *, least(1.0, min(p * m / k) OVER (ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS adj FROM (SELECT *, row_number() OVER (ORDER BY p, feature) AS k, count(*) OVER () AS m FROM ({_ADJ}))"


@query(f"SELECT feature, {_r('imp_real', 'imp_real')}, runs, {_r('mean', 'mean')}, {_r('std', 'std')}, {_r('top', 'max')}, exceed, {_r('p', 'p_emp')}, {_r('z', 'z')}, {_r('adj', 'p_emp_adj')}, exceed = 0 AS at_floor, z >= 4.0 AS significant FROM ({_BH})")
def significance_table(v, spark, d):
    s = statistics.significance(v("nullimp"), v("realimp"))
    return s.select("feature", "imp_real", "runs", "mean", "std", "max", "exceed", "p_emp", "z", "p_emp_adj", "at_floor", "significant")


@query(f"SELECT feature, {_r('p', 'p')}, {_r('adj', 'p_adj')} FROM ({_BH})")
def bh_adjust(v, spark, d):
    s = statistics.null_statistics(v("nullimp"), v("realimp")).select("feature", F.col("p_emp").alias("p"))
    return statistics.bh_adjust(s, "p", "feature")


@query()
def significance_parametric(v, spark, d):
    return statistics.significance(v("nullimp"), v("realimp"), "parametric_bh").select("feature", "p_param", "p_param_adj", "at_floor", "significant")


_WIN = "SELECT run % 5 AS w, feature, avg(imp) AS imp FROM nullimp GROUP BY ALL"


@query(f"WITH w AS ({_WIN}), p AS (SELECT feature, ({_rank('imp', 'w')}) / count(*) OVER (PARTITION BY w) AS pct FROM w), s AS (SELECT feature, avg(pct) AS m, stddev_pop(pct) AS s FROM p GROUP BY ALL) SELECT feature, {_r('m', 'mean')}, {_r('s', 'std')}, {_r('m - s', 'score')}, m - s >= 0.35 AS stable FROM s")
def stability_scores(v, spark, d):
    windows = v("nullimp").groupBy(F.expr("run % 5").alias("window"), "feature").agg(F.avg("imp").alias("imp"))
    return statistics.stability(windows, 1.0, 0.35)


@query(f"WITH w AS ({_WIN}), s AS (SELECT w, feature FROM (SELECT *, avg(imp) OVER (PARTITION BY w) AS m FROM w) WHERE imp > m), c AS (SELECT a.w AS a, b.w AS b, count(*) AS common FROM s a JOIN s b ON a.feature = b.feature AND a.w < b.w GROUP BY ALL), n AS (SELECT w, count(*) AS n FROM s GROUP BY ALL) SELECT a, b, common, x.n + y.n - common AS either, {_r('common / (x.n + y.n - common)', 'jaccard')} FROM c JOIN n x ON x.w = a JOIN n y ON y.w = b")
def jaccard_walkforward(v, spark, d):
    from pyspark.sql import Window

    w = v("nullimp").groupBy(F.expr("run % 5").alias("w"), "feature").agg(F.avg("imp").alias("imp"))
    chosen = w.withColumn("m", F.avg("imp").over(Window.partitionBy("w"))).where("imp > m")
    return statistics.jaccard_pairs(chosen, "w", "feature")


@query(f"WITH l AS (SELECT feature, label, round(value * 2.0) + 0.0 AS b FROM feat_long), c AS (SELECT feature, b, label, count(*) AS n FROM l GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, b) AS nx, sum(n) OVER (PARTITION BY feature, label) AS ny FROM c) SELECT feature, {_r('sum(n / t * ln(n * t / (nx * ny)))', 'mi')} FROM t GROUP BY ALL")
def mi_discrete(v, spark, d):
    rows = v("feat_long").select("feature", "label", (F.round(F.col("value") * F.lit(2.0)) + F.lit(0.0)).alias("b"))
    return statistics.mutual_information_discrete(rows, "b", "label", ["feature"])


@query()
def mi_knn(v, spark, d):
    return statistics.mutual_information(v("feat_long"), "label")


# monitoring -----------------------------------------------------------------


@query(f"SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, {_r('avg(value)', 'mean')}, {_r('stddev_samp(value)', 'std')} FROM events GROUP BY ALL")
def drift_windows(v, spark, d):
    """The streaming plan over a batch: events by day and type."""
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    out = drift.drift_stream(e, "ts", "value", "event_type")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", "mean", "std")
