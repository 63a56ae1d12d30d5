"""Queries of a cycle's metrics and of run analytics that need more than a line."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import counter, exact
from ..operators import acquisition as A
from ..operators import analytics, evaluation, pool
from . import views as V
from .registry import QUERIES, add


def stats_sql(columns: dict[str, str]) -> str:
    kinds = {"mean": "avg", "std": "stddev_pop", "min": "min", "max": "max"}
    return ", ".join(f"round({f}({c}), 6) AS {n}_{k}" for n, c in columns.items() for k, f in kinds.items())


add("prediction_stats", f"SELECT count(*) AS n, {stats_sql({'prediction': 'prediction', 'uncertainty': 'uncertainty'})}, round(median(prediction), 6) AS prediction_median FROM pred")(lambda s, d: evaluation.prediction_stats(V.pred(s, d)))
for way, best in (("higher", "max"), ("lower", "min")):
    name = "measured_stats" if way == "higher" else "measured_stats_low"
    add(name, f"SELECT round(avg(target) FILTER (labeled_cycle = 2), 6) AS batch_mean, round(stddev_pop(target) FILTER (labeled_cycle = 2), 6) AS batch_std, min(target) FILTER (labeled_cycle = 2) AS batch_min, max(target) FILTER (labeled_cycle = 2) AS batch_max, {best}(target) FILTER (labeled_cycle = 2) AS batch_best, {best}(target) AS best_so_far FROM master WHERE status = 'labeled'")(lambda s, d, w=way: evaluation.measured_stats(V.master(s, d), 2, w))
    sort = "" if way == "higher" else " DESC"
    add("selected_percentile" if way == "higher" else "selected_percentile_low", f"SELECT round(100 * avg(c), 6) AS selected_percentile FROM (SELECT id, cume_dist() OVER (ORDER BY target{sort}) AS c FROM cand) WHERE id % 10 < 2")(lambda s, d, w=way: evaluation.selected_percentile(V.cand(s, d), V.selected(s, d), "target", w))
add("average_score", "SELECT round(avg(target), 6) AS average_score, count(target) AS n FROM master")(lambda s, d: evaluation.average_score(V.master(s, d)))
add("prune_stats", "SELECT count(*) FILTER (r <= k) AS kept, count(*) FILTER (r > k) AS removed, round(count(*) FILTER (r > k) / count(*), 6) AS removed_share, round(max(prediction) FILTER (r = k), 6) AS threshold, round(min(prediction) FILTER (r <= k), 6) AS kept_min, round(max(prediction) FILTER (r <= k), 6) AS kept_max, round(avg(prediction) FILTER (r <= k), 6) AS kept_mean FROM (SELECT prediction, row_number() OVER (ORDER BY prediction DESC, id) AS r, n - floor(n * 0.3) AS k FROM pred, (SELECT count(*) AS n FROM pred))")(lambda s, d: pool.prune_stats(V.pred(s, d), 0.3))
add("scaffold_diversity", "SELECT round(count(DISTINCT scaffold) FILTER (doc_id % 5 = 0) / count(scaffold) FILTER (doc_id % 5 = 0), 6) AS scaffold_diversity_batch, round(count(DISTINCT scaffold) / count(scaffold), 6) AS scaffold_diversity_cumulative FROM text")(lambda s, d: evaluation.key_diversity(V.text(s, d), "scaffold", F.col("doc_id") % 5 == 0))
add("reservoir_sample", f"SELECT id FROM cand ORDER BY {counter.uniform_sql('9', 'id')}, id LIMIT 300")(lambda s, d: evaluation.reservoir(V.cand(s, d), 300, "9").select("id"))
add("acq_sa")(lambda s, d: A.acquisition("simulated_annealing").select(V.pred(s, d), 50, last=100.0, first=20000.0).select("id", F.round("acquisition_score", 6).alias("score"), "visited"))
add("acq_sa_random")(lambda s, d: A.anneal(V.pred(s, d), 50, 42, first=20000.0, last=100.0, neighbours="random", schedule="linear", direction="lower").select("id", F.round("acquisition_score", 6).alias("score"), "visited"))


def bit_sets(spark, d):
    return V.table(spark, d, "embeddings").selectExpr("vec_id AS id", "label", "filter(transform(embedding, (x, i) -> if(x > 0, i, -1)), i -> i >= 0) AS b")


# M18 over all vectors: pilot pairs, then as many hashed pairs as their variance asks for. No SQL: tests/test_operators.py has brute force.
add("mean_tanimoto")(lambda s, d: evaluation.mean_tanimoto(bit_sets(s, d)))

BITS = "(SELECT label, vec_id, unnest(range(len(embedding))) AS bit, unnest(embedding) AS x FROM embeddings)"


@add("run_cache", f"WITH c AS (SELECT DISTINCT label FROM embeddings), keys AS (SELECT scaffold, min(label) AS label FROM (SELECT label, vec_id % 37 AS scaffold FROM embeddings) GROUP BY scaffold), b AS (SELECT c.label, bit, count(*) AS n FROM c JOIN {BITS} t ON t.label <= c.label WHERE x > 0 GROUP BY c.label, bit) SELECT c.label, (SELECT count(*) FROM embeddings e WHERE e.label <= c.label) AS seen, (SELECT count(*) FROM keys WHERE keys.label <= c.label) AS keys, (SELECT sum(n)::BIGINT FROM b WHERE b.label = c.label) AS bits, (SELECT round(-sum(n / t * log2(n / t)), 6) FROM b, (SELECT sum(n) AS t FROM b WHERE b.label = c.label) WHERE b.label = c.label) AS bit_entropy FROM c")
def run_cache(spark, d):
    """Vectors' labels stand for cycles, the key modulo 37 for scaffolds."""
    return evaluation.run_cache(bit_sets(spark, d).withColumn("scaffold", F.col("id") % 37), "label", "scaffold", "b")


@add("evaluate_cycle")
def evaluate_cycle(spark, d):
    """All metrics of cycle 2; each has its own query with SQL, this is their assembly (tests/test_cycle.py compares them)."""
    chosen = V.selected(spark, d)
    return evaluation.evaluate_cycle(V.cand(spark, d), V.pred(spark, d).select("id", "prediction", "uncertainty"), chosen, chosen.where("id % 3 = 2"), 2)


@add("metric_change", "SELECT run_id, cycle, CASE WHEN a IS NULL THEN 'none' WHEN abs(a) < 1 THEN 'same' WHEN a > 0 THEN 'up' ELSE 'down' END AS change, CASE WHEN b IS NULL THEN 'none' WHEN abs(b) < 0.01 THEN 'same' WHEN b > 0 THEN 'up' ELSE 'down' END AS ratio_change FROM (SELECT run_id, cycle, metric - lag(metric) OVER w AS a, cost / n - lag(cost / n) OVER w AS b FROM runs WINDOW w AS (PARTITION BY run_id ORDER BY cycle))")
def metric_change(spark, d):
    rows = V.runs(spark, d).withColumn("ratio", F.col("cost") / F.col("n"))
    return rows.select("run_id", "cycle", evaluation.change_of("metric", True).alias("change"), evaluation.change_of("ratio", False).alias("ratio_change"))


@add("run_aggregates", "SELECT run_id, round(avg(metric), 6) AS avg_metric, round(stddev_pop(metric), 6) AS std_metric, round(max(metric), 6) AS best, min(cycle) FILTER (metric = m) AS best_cycle, round(arg_max(metric, cycle), 6) AS final_metric, round(arg_max(cost, cycle), 6) AS final_cost, round(avg(cost), 6) AS avg_cost, count(*) AS total_cycles FROM (SELECT *, max(metric) OVER (PARTITION BY run_id) AS m FROM runs) GROUP BY run_id")
def run_aggregates(spark, d):
    return analytics.run_aggregates(V.runs(spark, d, exact.mean), "metric", ["cost"])


@add("replicate_curve", "SELECT family, cycle, round(avg(n), 6) AS mean_x, round(avg(metric), 6) AS mean, round(min(metric), 6) AS low, round(max(metric), 6) AS high, count(*) AS n FROM runs JOIN manifest USING (run_id) GROUP BY family, cycle")
def replicate_curve(spark, d):
    return analytics.curve(V.runs(spark, d).join(V.manifest(spark, d), "run_id"), ["family", "cycle"], "n", "metric")


@add("short_groups", "WITH g AS (SELECT family, count(*) AS n FROM manifest GROUP BY family), m AS (SELECT n AS usual FROM g GROUP BY n ORDER BY count(*) DESC, n DESC LIMIT 1) SELECT family, n, usual FROM g, m WHERE n < usual")
def short_groups(spark, d):
    return analytics.short_groups(V.manifest(spark, d), "family")


@add("labeled_fraction", "SELECT min(f) AS least, max(f) AS most, max(f) - min(f) <= 0.01 AS constant FROM (SELECT round(count(*) FILTER (status = 'labeled') / count(*), 6) AS f FROM master GROUP BY id % 4)")
def labeled_fraction(spark, d):
    return analytics.constant_share(V.master(spark, d).withColumn("run", F.col("id") % 4), "run", F.col("status") == "labeled", 0.01)


@add("split_counts", "SELECT id % 4 AS run, status AS split, count(*) AS n FROM master GROUP BY ALL")
def split_counts(spark, d):
    return V.master(spark, d).groupBy((F.col("id") % 4).alias("run"), F.col("status").alias("split")).agg(F.count("*").alias("n"))


@add("pruned_top", "SELECT m.id % 5 AS run, count(*) FILTER (status = 'pruned') AS pruned_top FROM master m JOIN (SELECT id FROM cand ORDER BY target DESC, id LIMIT 500) t ON m.id = t.id GROUP BY m.id % 5")
def pruned_top(spark, d):
    """Of the 500 best candidates, how many each run has pruned."""
    from ..operators import order

    top = order.best(V.cand(spark, d), "target", 500).select("id")
    return analytics.lost(V.master(spark, d).withColumn("run", F.col("id") % 5), top, "run", "pruned_top")


@add("prune_by_cycle", "SELECT pruned_cycle, round(avg(c), 6) AS mean, min(c) AS low, max(c) AS high FROM (SELECT pruned_cycle, id % 7 AS run, count(*) AS c FROM master WHERE status = 'pruned' GROUP BY ALL) GROUP BY pruned_cycle")
def prune_by_cycle(spark, d):
    return analytics.two_levels(V.master(spark, d).where("status = 'pruned'").withColumn("run", F.col("id") % 7), "pruned_cycle", "run")


SETS = "(SELECT 'greedy' AS s, id FROM (SELECT id FROM pred ORDER BY prediction DESC, id LIMIT 400) UNION ALL SELECT 'ucb', id FROM (SELECT id FROM pred ORDER BY prediction + 2.0 * uncertainty DESC, id LIMIT 400) UNION ALL SELECT 'truth', id FROM (SELECT id FROM pred ORDER BY target DESC, id LIMIT 400))"


@add("overlap_percent", f"SELECT a.s AS l, b.s AS r, round(100.0 * count(*) / 400, 6) AS overlap FROM {SETS} a JOIN {SETS} b ON a.id = b.id GROUP BY ALL")
def overlap_percent(spark, d):
    from ..operators import order

    rows = V.pred(spark, d)
    sets = [order.best(rows.withColumn("s", c), "s", 400).select(F.lit(n).alias("l"), "id") for n, c in (("greedy", A.greedy()), ("ucb", A.ucb()), ("truth", F.col("target")))]
    return analytics.overlaps(sets[0].unionByName(sets[1]).unionByName(sets[2]), "l", "id")


@add("campaign_hours", "SELECT pool, cost, round((15.0 + (0.0012 + 0.1 * cost / w) * pool) / 3600, 9) AS hours, w AS workers FROM (SELECT 10 ** unnest([3, 4, 5, 6])::DOUBLE AS pool), (SELECT unnest([0.1, 1.0, 10.0])::DOUBLE AS cost), (SELECT unnest([1, 8]) AS w)")
def campaign_hours(spark, d):
    return analytics.campaign_hours(spark, [1e3, 1e4, 1e5, 1e6], [0.1, 1.0, 10.0], [1, 8], 0.1, 15.0, 0.0012)


@add("cycle_timings")
def cycle_timings(spark, d):
    """Seconds of the parts of a small cycle; another number each time."""
    time = evaluation.Timings()
    with time("prediction"):
        V.pred(spark, d).count()
    with time("acquisition"):
        QUERIES["acq_greedy_high"](spark, d).count()
    return spark.createDataFrame([time.row()])
