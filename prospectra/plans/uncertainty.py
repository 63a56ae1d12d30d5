"""Queries of calibration and uncertainty."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import counter
from ..operators import calibration as U
from . import views as V
from .registry import add

RES = "(SELECT *, target - prediction AS r, abs(target - prediction) AS e FROM pred)"
LEVELS = ", ".join(f"({p!r}::DOUBLE, {U.z_of(p)!r}::DOUBLE, {i})" for i, p in enumerate(U.LEVELS))
CURVE = f"(SELECT p, i, avg(CASE WHEN e <= z * uncertainty THEN 1.0 ELSE 0.0 END) AS c FROM {RES}, (VALUES {LEVELS}) l(p, z, i) GROUP BY p, i)"


def area(table: str, y: str, x: str, at: str) -> str:
    return f"(SELECT sum((nx - {x}) * (ny + {y}) / 2) FROM (SELECT {x}, {y}, lead({x}) OVER (ORDER BY {at}) AS nx, lead({y}) OVER (ORDER BY {at}) AS ny FROM {table}))"


add("uq_calibration_curve", f"SELECT round(p, 6) AS expected, round(c, 6) AS empirical FROM {CURVE}")(lambda s, d: U.calibration_curve(V.pred(s, d)))
add("uq_miscalibration_area", f"SELECT round({area(f'(SELECT p, i, abs(c - p) AS y FROM {CURVE})', 'y', 'p', 'i')}, 6) AS miscalibration_area")(lambda s, d: U.miscalibration_area(V.pred(s, d)))

FRACTIONS = ", ".join(f"({f!r}::DOUBLE, {i})" for i, f in enumerate(U.FRACTIONS))
SPARSE = f"(SELECT f, i, sum(e) FILTER (a <= n - floor(f * n)) / (n - floor(f * n)) AS model, sum(e) FILTER (b <= n - floor(f * n)) / (n - floor(f * n)) AS oracle FROM (SELECT e, row_number() OVER (ORDER BY uncertainty, id) AS a, row_number() OVER (ORDER BY e, id) AS b, count(*) OVER () AS n FROM {RES}), (VALUES {FRACTIONS}) l(f, i) GROUP BY f, i, n)"
add("uq_sparsification", f"SELECT round(f, 6) AS fraction, round(model, 6) AS model_mae, round(oracle, 6) AS oracle_mae FROM {SPARSE}")(lambda s, d: U.sparsification(V.pred(s, d)))
add("uq_ause", f"SELECT round({area(f'(SELECT f, i, model - oracle AS y FROM {SPARSE})', 'y', 'f', 'i')}, 5) AS ause")(lambda s, d: U.ause(V.pred(s, d)).select(F.round("ause", 5).alias("ause")))

REMOVED = ", ".join(f"({f!r}::DOUBLE, {1 - f!r}::DOUBLE, {i})" for i, f in enumerate(U.REMOVED))
PART = "greatest(0, least(1, (k - {0} + 1) / {1}))"
TIES = f"(SELECT f, i, sum(e * {PART.format('ra', 'ta')}) / max(k) / avg(e) AS model, sum(e * {PART.format('rb', 'tb')}) / max(k) / avg(e) AS oracle FROM (SELECT *, greatest(1, round_even(g * n, 0)) AS k FROM (SELECT e, rank() OVER (ORDER BY uncertainty) AS ra, count(*) OVER (PARTITION BY uncertainty) AS ta, rank() OVER (ORDER BY e) AS rb, count(*) OVER (PARTITION BY e) AS tb, count(*) OVER () AS n FROM {RES}), (VALUES {REMOVED}) l(f, g, i)) GROUP BY f, i)"
add("tie_aware_sparsification", f"SELECT round(f, 6) AS fraction, round(model, 6) AS model, round(oracle, 6) AS oracle FROM {TIES}")(lambda s, d: U.tie_aware_sparsification(V.pred(s, d)))
add("normalized_ause", f"SELECT round({area(f'(SELECT f, i, model - oracle AS y FROM {TIES})', 'y', 'f', 'i')} / 0.9, 6) AS normalized_ause")(lambda s, d: U.normalized_ause(V.pred(s, d)))

RANKS = f"(SELECT e, r, rank() OVER (ORDER BY uncertainty) + (count(*) OVER (PARTITION BY uncertainty) - 1) / 2.0 AS a, rank() OVER (ORDER BY e) + (count(*) OVER (PARTITION BY e) - 1) / 2.0 AS b FROM {RES})"
add("uq_summary", f"SELECT round(avg(e), 6) AS mae, round(sqrt(avg(r * r)), 6) AS rmse, round(corr(a, b), 6) AS spearman FROM {RANKS}")(lambda s, d: U.summary(V.pred(s, d)))

TILES = f"(SELECT t, count(*) AS n, sqrt(avg(r * r)) AS a, sqrt(avg(uncertainty * uncertainty)) AS b FROM (SELECT *, ntile(10) OVER (ORDER BY uncertainty, id) AS t FROM {RES}) GROUP BY t)"
add("uq_scale_errors", f"SELECT round(sum(abs(a - b) * n) / sum(n), 6) AS uce, round(avg(abs(a - b) / b), 6) AS ence FROM {TILES}")(lambda s, d: U.scale_errors(V.pred(s, d)))
add("uq_ence_decomposition", f"SELECT (t - 1)::INT AS tile, n AS rows, round(a, 6) AS rmse, round(b, 6) AS rmv, a > b AS overconfident FROM {TILES}")(lambda s, d: U.tile_scales(V.pred(s, d)).select("tile", "rows", F.round("rmse", 6).alias("rmse"), F.round("rmv", 6).alias("rmv"), "overconfident"))
COVER = [0.5, 0.8, 0.9, 0.95]
ERR = {p: f"(avg(CASE WHEN e <= {U.z_of(p)!r} * uncertainty THEN 1.0 ELSE 0.0 END) - {p})" for p in COVER}
add("uq_coverage_errors", "SELECT " + ", ".join(f"round({x}, 6) AS coverage_error_{round(p * 100)}" for p, x in ERR.items()) + f", round(({' + '.join(f'abs({x})' for x in ERR.values())}) / {len(ERR)}, 6) AS mean_error, round(greatest({', '.join(f'abs({x})' for x in ERR.values())}), 6) AS max_error FROM {RES}")(lambda s, d: U.coverage_errors(V.pred(s, d), COVER))
add("uq_scale_bounded", f"SELECT round(greatest(0.01, least(100, sqrt(avg((r / uncertainty) ** 2)))), 6) AS scale FROM {RES}")(lambda s, d: U.bounded_scale(V.pred(s, d)))


def bounds(spark, d, z: float = 500.0):
    return V.pred(spark, d).selectExpr("id", "target", f"prediction - {z}D * uncertainty AS lower", f"prediction + {z}D * uncertainty AS upper")


BOUNDS = "(SELECT id, target, prediction - 500.0::DOUBLE * uncertainty AS lo, prediction + 500.0::DOUBLE * uncertainty AS hi FROM pred)"
add("interval_metrics", f"SELECT round(avg(i), 6) AS coverage, round(avg(i) - 0.9, 6) AS coverage_error, round(avg(hi - lo), 6) AS mean_width, round(avg(hi - lo + 2 / (1 - 0.9::DOUBLE) * (greatest(lo - target, 0) + greatest(target - hi, 0))), 5) AS interval_score, round(avg(CASE WHEN lo > hi THEN 1.0 ELSE 0.0 END), 6) AS crossed, round(median(hi - lo), 6) AS median_width FROM (SELECT *, CASE WHEN target BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END AS i FROM {BOUNDS})")(lambda s, d: U.interval_metrics(bounds(s, d), 0.9).withColumn("interval_score", F.round("interval_score", 5)))
CQR = f"(SELECT m AS raw FROM (SELECT greatest(lo - target, target - hi) AS m, row_number() OVER (ORDER BY greatest(lo - target, target - hi), id) AS i, count(*) OVER () AS n FROM {BOUNDS} WHERE id % 2 = 0) WHERE i = least(n, ceil((n + 1) * 0.8)))"


@add("cqr_bounds", f"SELECT id, round(lo - greatest(0, raw), 5) AS lower, round(hi + greatest(0, raw), 5) AS upper FROM {BOUNDS}, {CQR} WHERE id % 2 = 1")
def cqr_bounds(spark, d):
    """Calibration rows have even ids, test rows odd ones."""
    rows = bounds(spark, d)
    return U.cqr(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), 0.8).select("id", F.round("lower", 5).alias("lower"), F.round("upper", 5).alias("upper"))


@add("member_mad_iqr", "SELECT vec_id, round(list_median(list_transform(e, lambda x: abs(x - list_median(e)))), 6) AS mad, round((quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 2, 6) AS half_iqr FROM (SELECT vec_id, embedding::DOUBLE[] AS e, unnest(embedding::DOUBLE[]) AS x FROM embeddings) GROUP BY vec_id, e")
def member_mad_iqr(spark, d):
    return U.member_spread(V.table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("members"))).select("vec_id", F.round("mad", 6).alias("mad"), F.round("half_iqr", 6).alias("half_iqr"))


TRAIN = 12


@add("jackknife_variance", f"WITH t AS (SELECT vec_id, x - avg(x) OVER (PARTITION BY vec_id) AS x, b, x AS raw FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS b FROM embeddings)), c AS (SELECT vec_id, i, sum(((b * 7 + i * 13) % 3 - 1) * x) / count(*) AS c FROM t, range({TRAIN}) r(i) GROUP BY vec_id, i), v AS (SELECT vec_id, var_pop(raw) AS v, count(*) AS n FROM t GROUP BY vec_id) SELECT vec_id, round(sum(c * c), 6) AS raw_variance, round(sum(c * c) - {TRAIN} * max(v) / max(n), 6) AS corrected_variance, round(sqrt(greatest(0, sum(c * c) - {TRAIN} * max(v) / max(n))), 6) AS standard_error FROM c JOIN v USING (vec_id) GROUP BY vec_id")
def jackknife_variance(spark, d):
    """The components of a vector are the members; their samples of 12 rows come from a formula."""
    counts = [[(b * 7 + i * 13) % 3 for i in range(TRAIN)] for b in range(64)]
    out = U.jackknife(V.table(spark, d, "embeddings").withColumnRenamed("embedding", "members"), counts, key="vec_id")
    return out.select("vec_id", *(F.round(c, 6).alias(c) for c in out.columns[1:]))


@add("mid_cdf", "SELECT id, round((SELECT (count(*) FILTER (r.prediction < p.prediction) + count(*) FILTER (r.prediction <= p.prediction)) / (2.0 * count(*)) FROM (SELECT prediction FROM pred WHERE id % 10 < 2) r), 6) AS mid_cdf FROM pred p WHERE id IN (SELECT id FROM selected)")
def mid_cdf(spark, d):
    rows = V.pred(spark, d).join(V.selected(spark, d), "id", "left_semi")
    return U.mid_cdf(rows, rows, "prediction").select("id", F.round("mid_cdf", 6).alias("mid_cdf"))


@add("rank_blend", "SELECT id, round(((a + b) / 2), 6) AS blend FROM (SELECT id, (2 * rank() OVER (ORDER BY prediction) - 2 + count(*) OVER (PARTITION BY prediction)) / (2.0 * count(*) OVER ()) AS a, (2 * rank() OVER (ORDER BY uncertainty) - 2 + count(*) OVER (PARTITION BY uncertainty)) / (2.0 * count(*) OVER ()) AS b FROM pred)")
def rank_blend(spark, d):
    rows = V.pred(spark, d)
    return U.rank_blend(rows, rows, ["prediction", "uncertainty"], "blend").select("id", F.round("blend", 6).alias("blend"))


@add("group_kfold", "SELECT doc_id, CASE WHEN r < 5 THEN r ELSE 9 - r END::INT AS fold FROM text JOIN (SELECT scaffold, (row_number() OVER (ORDER BY count(*) DESC, scaffold) - 1) % 10 AS r FROM text GROUP BY scaffold) USING (scaffold)")
def group_kfold(spark, d):
    return U.group_folds(V.text(spark, d), "scaffold").select("doc_id", "fold")


PERM = "(SELECT id, target, prediction, uncertainty, row_number() OVER (ORDER BY id) AS p, row_number() OVER (ORDER BY {0}, id) AS q FROM pred)"


def importance_sql(group: str, column: str) -> str:
    t = PERM.format(counter.uniform_sql(f"0:{group}", "id"))
    made = {"prediction": "abs(a.target - (b.prediction + a.uncertainty))", "uncertainty": "abs(a.target - (a.prediction + b.uncertainty))"}[column]
    return f"SELECT '{group}' AS \"group\", round(avg({made}) - avg(abs(a.target - (a.prediction + a.uncertainty))), 6) AS importance FROM {t} a JOIN {t} b ON a.p = b.q"


@add("permutation_importance", f"{importance_sql('level', 'prediction')} UNION ALL {importance_sql('noise', 'uncertainty')}")
def permutation_importance(spark, d):
    """Of the model prediction + uncertainty."""
    guess = lambda rows: rows.withColumn("guess", F.col("prediction") + F.col("uncertainty"))
    return U.permutation_importance(V.pred(spark, d).select("id", "target", "prediction", "uncertainty"), {"level": ["prediction"], "noise": ["uncertainty"]}, guess, F.abs(F.col("target") - F.col("guess")))


@add("decision_gate", "SELECT count(*) AS runs, round(min(g), 6) AS least, round(avg(g), 6) AS mean, bool_and(g > 0) AS all_improve, bool_and(g < 0) AS all_worsen, bool_and(abs(g) <= 1000) AS within FROM (SELECT a.metric - b.metric AS g FROM runs a JOIN runs b ON a.run_id = b.run_id AND a.cycle = 1 AND b.cycle = 2)")
def decision_gate(spark, d):
    rows = V.runs(spark, d).select("run_id", F.col("cycle").cast("string").alias("method"), "metric")
    return U.decision_gate(rows, "run_id", "method", "metric", "1", "2", 1000.0)
