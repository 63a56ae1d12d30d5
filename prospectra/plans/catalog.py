"""Registered queries of the engine and their SQL: each name has a DataFrame form and, where possible, one for DuckDB."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import counter, normal
from ..operators import acquisition as A
from ..operators import calibration as U
from ..operators import evaluation as M
from ..operators import order, pool
from . import views as V
from .registry import ORACLE_SQL, QUERIES, add

BEST = "(SELECT max(target) FROM master WHERE status = 'labeled')"
Z90 = 1.6448536269514722


# Pool states
add("master_init", "SELECT id, 'unlabeled' AS status, NULL::BIGINT AS labeled_cycle, NULL::BIGINT AS selected_cycle, NULL::BIGINT AS pruned_cycle, NULL::DOUBLE AS target FROM cand")(lambda s, p: pool.master_table(V.cand(s, p)))
add("status_filter", "SELECT id, labeled_cycle FROM master WHERE status = 'labeled'")(lambda s, p: pool.with_status(V.master(s, p), "labeled", ["id", "labeled_cycle"]))
add("unlabeled_index", "SELECT id, row_number() OVER (ORDER BY id) - 1 AS global_index FROM master WHERE status = 'unlabeled'")(lambda s, p: order.indexed(pool.with_status(V.master(s, p), "unlabeled", ["id"]), "id").select("id", "global_index"))
add("label_update", "SELECT m.id, CASE WHEN n.id IS NOT NULL THEN 'labeled' ELSE status END AS status, CASE WHEN n.id IS NOT NULL THEN 5 ELSE labeled_cycle END AS labeled_cycle, CASE WHEN n.id IS NOT NULL AND selected_cycle IS NULL THEN 5 ELSE selected_cycle END AS selected_cycle, pruned_cycle, coalesce(n.target, m.target) AS target FROM master m LEFT JOIN (SELECT id, target FROM cand WHERE id % 7 = 0) n ON m.id = n.id")(lambda s, p: pool.label(V.master(s, p), V.cand(s, p).where("id % 7 = 0").select("id", F.col("target").alias("value")), 5))
add("prune_update", "SELECT m.id, CASE WHEN m.id % 7 = 3 THEN 'pruned' ELSE status END AS status, labeled_cycle, selected_cycle, CASE WHEN m.id % 7 = 3 THEN 6 ELSE pruned_cycle END AS pruned_cycle, target FROM master m")(lambda s, p: pool.prune(V.master(s, p), V.cand(s, p).where("id % 7 = 3"), 6))
add("unlabeled_predictions", "SELECT p.id, prediction FROM pred p WHERE NOT EXISTS (SELECT 1 FROM selected s WHERE s.id = p.id)")(lambda s, p: V.pred(s, p).join(V.selected(s, p), "id", "left_anti").select("id", "prediction"))
add("lenient_cast", "SELECT o_orderkey AS id, TRY_CAST(o_orderstatus AS DOUBLE) AS value, TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS priority FROM orders")(lambda s, p: V.table(s, p, "orders").selectExpr("o_orderkey AS id", "try_cast(o_orderstatus AS double) AS value", "try_cast(substr(o_orderpriority, 1, 1) AS double) AS priority"))
add("duplicate_split", "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) = 1 AS is_valid FROM lineitem")(lambda s, p: pool.split_duplicates(V.table(s, p, "lineitem").select("l_orderkey", "l_linenumber", F.struct("l_orderkey", "l_linenumber").alias("k")), "k").drop("k"))
add("success_rate", "SELECT round(avg(CASE WHEN c = 1 THEN 1.0 ELSE 0.0 END), 6) AS success_rate FROM (SELECT count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS c FROM lineitem)")(lambda s, p: QUERIES["duplicate_split"](s, p).agg(F.round(F.avg(F.col("is_valid").cast("double")), 6).alias("success_rate")))
add("status_counts", "SELECT status, count(*) AS n FROM master GROUP BY status")(lambda s, p: V.master(s, p).groupBy("status").agg(F.count("*").alias("n")))
# Joins
add("selection_pool", "SELECT m.id, prediction, uncertainty FROM master m JOIN pred p ON m.id = p.id WHERE status = 'unlabeled'")(lambda s, p: pool.with_status(V.master(s, p), "unlabeled", ["id"]).join(V.pred(s, p).select("id", "prediction", "uncertainty"), "id"))
add("labeled_with_pred", "SELECT m.id, m.target, prediction FROM master m JOIN pred p ON m.id = p.id WHERE status = 'labeled'")(lambda s, p: pool.with_status(V.master(s, p), "labeled", ["id", "target"]).join(V.pred(s, p).select("id", "prediction"), "id"))
add("oracle_lookup", "SELECT r.o, r.id, c.target FROM (SELECT row_number() OVER (ORDER BY prediction DESC, id) AS o, id FROM pred ORDER BY prediction DESC, id LIMIT 100) r JOIN cand c ON r.id = c.id")(lambda s, p: order.best(V.pred(s, p), "prediction", 100).select("id", F.row_number().over(Window.orderBy(F.desc("prediction"), "id")).cast("bigint").alias("o")).join(V.cand(s, p).select("id", "target"), "id").orderBy("o"))
add("oracle_reconcile", "SELECT id, CASE WHEN id IN (SELECT l_orderkey FROM lineitem) THEN 'known' ELSE 'unknown' END AS state FROM cand")(lambda s, p: (lambda c, k: c.join(k, "id", "left_semi").select("id", F.lit("known").alias("state")).unionByName(c.join(k, "id", "left_anti").select("id", F.lit("unknown").alias("state"))))(V.cand(s, p), V.table(s, p, "lineitem").select(F.col("l_orderkey").alias("id"))))
add("validation_report", "SELECT c.id, coalesce(e.error, '') AS error FROM cand c LEFT JOIN (SELECT DISTINCT l_orderkey AS id, 'returned' AS error FROM lineitem WHERE l_returnflag = 'R') e ON c.id = e.id")(lambda s, p: V.cand(s, p).join(V.table(s, p, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"), F.lit("returned").alias("error")).distinct(), "id", "left").select("id", F.coalesce("error", F.lit("")).alias("error")))
add("tidy_join", "SELECT r.run_id, cycle, family, design, round(metric, 6) AS metric FROM runs r LEFT JOIN manifest m ON r.run_id = m.run_id")(lambda s, p: V.runs(s, p).join(V.manifest(s, p), "run_id", "left").select("run_id", "cycle", "family", "design", F.round("metric", 6).alias("metric")))
add("cold_cache_flag", "SELECT a.run_id, a.cost > 1.1 * b.steady AS cold FROM (SELECT run_id, cost FROM runs WHERE cycle = 1) a JOIN (SELECT run_id, avg(cost) AS steady FROM runs WHERE cycle > 1 GROUP BY run_id) b ON a.run_id = b.run_id")(lambda s, p: V.runs(s, p).groupBy("run_id").agg(F.max(F.when(F.col("cycle") == 1, F.col("cost"))).alias("first"), F.avg(F.when(F.col("cycle") > 1, F.col("cost"))).alias("steady")).where("first IS NOT NULL AND steady IS NOT NULL").select("run_id", (F.col("first") > 1.1 * F.col("steady")).alias("cold")))
add("prune_speedup", "SELECT a.run_id, round(b.cost / a.cost, 6) AS speedup FROM runs a LEFT JOIN runs b ON b.cycle = 1 AND b.run_id = a.run_id WHERE a.cycle = 2")(lambda s, p: V.runs(s, p).where("cycle = 2").join(V.runs(s, p).where("cycle = 1").select("run_id", F.col("cost").alias("base")), "run_id", "left").select("run_id", F.round(F.col("base") / F.col("cost"), 6).alias("speedup")))
add("out_of_sample", "SELECT p.id, c.cycle FROM pred p JOIN master m ON p.id = m.id, (SELECT unnest([0, 1, 2]) AS cycle) c WHERE selected_cycle IS NULL OR selected_cycle >= c.cycle")(lambda s, p: V.pred(s, p).join(V.master(s, p).select("id", "selected_cycle"), "id").select("id", "selected_cycle", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("cycle")).where("selected_cycle IS NULL OR selected_cycle >= cycle").select("id", "cycle"))
add("feature_hits", "SELECT id FROM cand WHERE id IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1)")(lambda s, p: V.cand(s, p).select("id").join(V.table(s, p, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("id")), "id", "left_semi"))
add("feature_misses", "SELECT id FROM cand WHERE id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1)")(lambda s, p: V.cand(s, p).select("id").join(V.table(s, p, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("id")), "id", "left_anti"))
# Acquisition
for way, sort in (("higher", "DESC"), ("lower", "ASC")):
    one = 1 if way == "higher" else -1
    short = way.removesuffix("er")
    add(f"acq_greedy_{short}", f"SELECT id, round({one} * prediction, 6) AS score FROM pred ORDER BY prediction {sort}, id LIMIT 150")(lambda s, p, w=way: A.choose(V.pred(s, p), A.greedy(w), 150).select("id", F.round("acquisition_score", 6).alias("score")))
    add(f"acq_ucb_{short}", f"SELECT id, round({one} * prediction + 2.0 * uncertainty, 6) AS score FROM pred ORDER BY {one} * prediction + 2.0 * uncertainty DESC, id LIMIT 150")(lambda s, p, w=way: A.choose(V.pred(s, p), A.ucb(w), 150).select("id", F.round("acquisition_score", 6).alias("score")))
    add(f"prune_score_{short}", f"SELECT id FROM (SELECT id, row_number() OVER (ORDER BY prediction {sort}, id) AS r, count(*) OVER () AS n FROM pred) WHERE r <= greatest(1, n - floor(n * 0.3))")(lambda s, p, w=way: pool.keep_best(V.pred(s, p), 0.3, w)[0].select("id"))
add("acq_random", f"SELECT id FROM pred ORDER BY {counter.uniform_sql(42, 'id')} DESC, id LIMIT 150")(lambda s, p: A.choose_random(V.pred(s, p), 150, 42).select("id"))
add("initial_batch", f"SELECT id FROM pred ORDER BY {counter.uniform_sql('42-0', 'id')} DESC, id LIMIT (SELECT greatest(1, ceil(count(*) * 0.01))::BIGINT FROM pred)")(lambda s, p: (lambda c: A.choose_random(c, max(1, -(-c.count() // 100)), "42-0").select("id"))(V.pred(s, p)))
add("acq_topk", f"SELECT id FROM (SELECT id FROM pred ORDER BY prediction DESC, id LIMIT (SELECT greatest(100, floor(count(*) * 0.05))::BIGINT FROM pred)) ORDER BY {counter.uniform_sql(42, 'id')} DESC, id LIMIT 100")(lambda s, p: A.choose_topk(V.pred(s, p), 100, 0.05, 42).select("id"))
add("acq_thompson", f"SELECT id FROM (SELECT *, {counter.uniform_sql(7, 'id')} AS u FROM pred) ORDER BY prediction + uncertainty * ({normal.quantile('u')}) DESC, id LIMIT 150")(lambda s, p: A.choose_thompson(V.pred(s, p), 150, 7).select("id"))
for name, f in (("acq_ei", A.expected_improvement_sql), ("acq_pi", A.probability_of_improvement_sql)):
    add(name, f"SELECT id, round(s, 6) AS score FROM (SELECT id, {f('higher', BEST, 0.01)} AS s FROM pred) ORDER BY s DESC, id LIMIT 150")(lambda s, p, n=name: A.acquisition(n.removeprefix("acq_")).select(V.pred(s, p), 150, best=A.current_best(V.master(s, p))).select("id", F.round("acquisition_score", 6).alias("score")))
for name, k in (("acq_entropy", 1), ("acq_entropy_variance", 2)):
    add(name, f"SELECT id, round(0.5 * ln(2 * pi() * exp(1)) + {k} * ln(uncertainty), 6) AS score FROM pred ORDER BY uncertainty DESC, id LIMIT 150")(lambda s, p, k=k: A.choose(V.pred(s, p), A.entropy(k == 2), 150).select("id", F.round("acquisition_score", 6).alias("score")))
add("topk_ties", "SELECT id FROM pred ORDER BY uncertainty DESC, id LIMIT 77")(lambda s, p: order.best(V.pred(s, p), "uncertainty", 77).select("id"))
# Evaluation
ks = {"10": "least(10, n)", "100": "least(100, n)", "1000": "least(1000, n)", "0_1_pct": "greatest(1, floor(n * 0.001))", "1_pct": "greatest(1, floor(n * 0.01))", "10_pct": "greatest(1, floor(n * 0.1))"}
add("discovery_rates", "SELECT " + ", ".join(f"round(100.0 * count(*) FILTER (r <= {k} AND hit) / max({k}), 6) AS top_{n}_discovery" for n, k in ks.items()) + " FROM (SELECT row_number() OVER (ORDER BY target DESC, id) AS r, count(*) OVER () AS n, id % 10 < 2 AS hit FROM cand)")(lambda s, p: M.discovery(V.cand(s, p), V.selected(s, p)))
ef = "SELECT count(*) FILTER ({0}) AS selected, sum(activity) FILTER ({0}) AS hits, round((sum(activity) FILTER ({0}) / count(*) FILTER ({0})) / (sum(activity) / count(*)), 6) AS enrichment, round(sum(activity) FILTER ({0}) / count(*) FILTER ({0}), 6) AS hit_rate FROM cand"
add("cumulative_ef", ef.format("id % 10 < 2"))(lambda s, p: M.enrichment(V.cand(s, p), V.selected(s, p)))
add("batch_ef", ef.format("id % 10 < 2 AND id % 3 = 2"))(lambda s, p: M.enrichment(V.cand(s, p), V.selected(s, p).where("id % 3 = 2")))
add("batch_hit_rate", "SELECT round(avg(activity), 6) AS hit_rate FROM cand WHERE id % 10 < 2 AND id % 3 = 2")(lambda s, p: M.enrichment(V.cand(s, p), V.selected(s, p).where("id % 3 = 2")).select("hit_rate"))
add("improvement_ratio", "SELECT round((avg(target) FILTER (id % 10 < 2) - avg(target)) / abs(avg(target)), 6) AS improvement_ratio FROM cand")(lambda s, p: M.improvement_ratio(V.cand(s, p), V.selected(s, p)))


def ef_sql(score: str, percents: tuple, where: str = "TRUE") -> str:
    k = lambda x: f"greatest(1, floor(n * {x!r} / 100))"
    cols = ", ".join(f"round(max(n) * sum(activity) FILTER (r <= {k(x)}) / (sum(activity) * max({k(x)})), 6) AS ef_{x:g}".replace("ef_0.", "ef_0_") for x in percents)
    return f"SELECT {cols} FROM (SELECT activity, row_number() OVER (ORDER BY {score} DESC, id) AS r, count(*) OVER () AS n FROM pred WHERE {where})"


add("enrichment_factor", ef_sql("prediction", (1.0,)))(lambda s, p: M.enrichment_at(V.pred(s, p), "prediction", (1.0,)))
add("ground_truth_ef", ef_sql("target", (5.0, 1.0, 0.5, 0.1)))(lambda s, p: M.enrichment_at(V.pred(s, p), "target", (5.0, 1.0, 0.5, 0.1)))
add("unlabeled_ef", ef_sql("prediction", (1.0, 5.0), "id % 10 >= 2"))(lambda s, p: M.enrichment_at(V.pred(s, p).join(V.selected(s, p), "id", "left_anti"), "prediction", (1.0, 5.0)))
for name, where in (("topk_overlap", "TRUE"), ("unlabeled_overlap", "id % 10 >= 2")):
    add(name, "SELECT " + ", ".join(f"round(100.0 * count(*) FILTER (a <= {k} AND b <= {k}) / max({k}), 6) AS overlap_{n}" for n, k in ks.items() if n != "10") + f" FROM (SELECT row_number() OVER (ORDER BY prediction DESC, id) AS a, row_number() OVER (ORDER BY target DESC, id) AS b, count(*) OVER () AS n FROM pred WHERE {where})")(lambda s, p, w=where: M.overlap(V.pred(s, p) if w == "TRUE" else V.pred(s, p).join(V.selected(s, p), "id", "left_anti")))
add("unlabeled_spearman", "SELECT round(corr(a, b), 6) AS spearman FROM (SELECT rank() OVER (ORDER BY prediction) + (count(*) OVER (PARTITION BY prediction) - 1) / 2.0 AS a, rank() OVER (ORDER BY target) + (count(*) OVER (PARTITION BY target) - 1) / 2.0 AS b FROM pred WHERE id % 10 >= 2)")(lambda s, p: M.spearman(V.pred(s, p).join(V.selected(s, p), "id", "left_anti"), "prediction", "target"))
add("prediction_entropy", "SELECT round(-sum(q * ln(q)), 6) AS prediction_entropy FROM (SELECT (coalesce(c, 0) / n + 1e-10 / 50) / (1 + 1e-10) AS q FROM range(50) g(b) LEFT JOIN (SELECT least(floor((prediction - a) / ((z - a) / 50)), 49) AS bin, count(*) AS c FROM pred, (SELECT min(prediction) AS a, max(prediction) AS z FROM pred) GROUP BY bin) h ON g.b = h.bin, (SELECT count(*) AS n FROM pred))")(lambda s, p: M.histogram_entropy(V.pred(s, p), "prediction"))
add("bit_entropy", "SELECT round(-sum(p * log2(p)), 6) AS bit_entropy FROM (SELECT c / sum(c) OVER () AS p FROM (SELECT i, count(*) AS c FROM (SELECT unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings) WHERE x > 0 GROUP BY i))")(lambda s, p: V.table(s, p, "embeddings").select(F.posexplode("embedding").alias("i", "x")).where("x > 0").groupBy("i").agg(F.count("*").alias("c")).withColumn("p", F.col("c") / F.sum("c").over(Window.partitionBy())).agg(F.round(-F.sum(F.col("p") * F.log2("p")), 6).alias("bit_entropy")))
# Run analytics
add("running_sum", "SELECT run_id, cycle, round(sum(cost) OVER (PARTITION BY run_id ORDER BY cycle ROWS UNBOUNDED PRECEDING), 6) AS total FROM runs")(lambda s, p: V.runs(s, p).select("run_id", "cycle", F.round(F.sum("cost").over(Window.partitionBy("run_id").orderBy("cycle").rowsBetween(Window.unboundedPreceding, 0)), 6).alias("total")))
add("last_cycle", "SELECT run_id, max(cycle) AS cycle, round(arg_max(metric, cycle), 6) AS metric FROM runs GROUP BY run_id")(lambda s, p: V.runs(s, p).groupBy("run_id").agg(F.max("cycle").alias("cycle"), F.round(F.max_by("metric", "cycle"), 6).alias("metric")))
add("replicate_count", "SELECT run_id, count(*) OVER (PARTITION BY family) AS replicates FROM manifest")(lambda s, p: V.manifest(s, p).select("run_id", F.count("*").over(Window.partitionBy("family")).alias("replicates")))
add("final_summary", "SELECT family, round(avg(m), 6) AS mean, round(min(m), 6) AS low, round(max(m), 6) AS high FROM (SELECT run_id, arg_max(metric, cycle) AS m FROM runs GROUP BY run_id) JOIN manifest USING (run_id) GROUP BY family")(lambda s, p: V.runs(s, p).groupBy("run_id").agg(F.max_by("metric", "cycle").alias("m")).join(V.manifest(s, p), "run_id").groupBy("family").agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.min("m"), 6).alias("low"), F.round(F.max("m"), 6).alias("high")))
add("seed_summary", "SELECT cycle, 'metric' AS name, round(avg(metric), 6) AS mean, round(coalesce(stddev_samp(metric), 0), 6) AS std FROM runs GROUP BY cycle UNION ALL SELECT cycle, 'cost', round(avg(cost), 6), round(coalesce(stddev_samp(cost), 0), 6) FROM runs GROUP BY cycle")(lambda s, p: V.runs(s, p).select("cycle", F.expr("stack(2, 'metric', metric, 'cost', cost) AS (name, v)")).groupBy("cycle", "name").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("v"), F.lit(0.0)), 6).alias("std")))
add("metric_pivot", "SELECT design, " + ", ".join(f"round(avg(metric) FILTER (cycle = {c}), 6) AS c{c}" for c in range(1, 8)) + " FROM runs JOIN manifest USING (run_id) GROUP BY design")(lambda s, p: V.runs(s, p).join(V.manifest(s, p), "run_id").groupBy("design").pivot("cycle", [*range(1, 8)]).agg(F.round(F.avg("metric"), 6)).toDF("design", *(f"c{c}" for c in range(1, 8))))
add("cumulative_timing", "SELECT family, round(sum(cost), 6) AS total, round(avg(m), 6) AS last_metric FROM (SELECT run_id, sum(cost) AS cost, arg_max(metric, cycle) AS m FROM runs GROUP BY run_id) JOIN manifest USING (run_id) GROUP BY family")(lambda s, p: V.runs(s, p).groupBy("run_id").agg(F.sum("cost").alias("cost"), F.max_by("metric", "cycle").alias("m")).join(V.manifest(s, p), "run_id").groupBy("family").agg(F.round(F.sum("cost"), 6).alias("total"), F.round(F.avg("m"), 6).alias("last_metric")))
add("rank_percentile", "SELECT id, r AS rank, round(100.0 * (r - 1) / (n - 1), 6) AS percentile FROM (SELECT id, rank() OVER (ORDER BY prediction) AS r, count(*) OVER () AS n FROM pred) WHERE id % 10 < 2")(lambda s, p: order.ranked(V.pred(s, p), "prediction", "id").join(V.selected(s, p), "id", "left_semi").select("id", "rank", F.round(100 * (F.col("rank") - 1) / (F.col("total") - 1), 6).alias("percentile")))
hist = "SELECT floor(prediction / 5000)::BIGINT AS bin, count(*) AS n FROM pred GROUP BY 1"
add("score_histogram", hist)(lambda s, p: V.pred(s, p).groupBy(F.floor(F.col("prediction") / 5000).alias("bin")).agg(F.count("*").alias("n")))
add("rebin", f"SELECT floor(bin / 4)::BIGINT * 4 AS bin, sum(n)::BIGINT AS n FROM ({hist}) GROUP BY 1")(lambda s, p: QUERIES["score_histogram"](s, p).groupBy((F.floor(F.col("bin") / 4) * 4).alias("bin")).agg(F.sum("n").alias("n")))
add("hist_quantile", f"SELECT min(bin) AS bin FROM (SELECT bin, sum(n) OVER (ORDER BY bin) AS c, sum(n) OVER () AS t FROM ({hist})) WHERE c >= 0.9 * t")(lambda s, p: QUERIES["score_histogram"](s, p).withColumn("c", F.sum("n").over(Window.orderBy("bin"))).withColumn("t", F.sum("n").over(Window.partitionBy())).where("c >= 0.9 * t").agg(F.min("bin").alias("bin")))
add("ecdf_grid", "SELECT g AS step, round(avg(CASE WHEN target <= g * 10000 THEN 1.0 ELSE 0.0 END), 6) AS share FROM cand, range(51) r(g) GROUP BY g")(lambda s, p: V.cand(s, p).agg(*(F.avg((F.col("target") <= g * 10000).cast("double")).alias(f"g{g}") for g in range(51))).select(F.expr("stack(51, " + ", ".join(f"{g}L, g{g}" for g in range(51)) + ") AS (step, share)")).select("step", F.round("share", 6).alias("share")))
add("top_candidates", "SELECT id, target FROM cand ORDER BY target DESC, id LIMIT 20")(lambda s, p: order.best(V.cand(s, p), "target", 20).select("id", "target"))
whole_sets = "SELECT DISTINCT l_linenumber AS family, l_partkey AS part FROM lineitem"


def whole_part_sets(s, p):
    return V.table(s, p, "lineitem").select(F.col("l_linenumber").alias("family"), F.col("l_partkey").alias("part")).distinct()


add("jaccard_matrix", f"SELECT a.family AS l, b.family AS r, round(100.0 * count(*) / (max(x.n) + max(y.n) - count(*)), 6) AS jaccard FROM ({whole_sets}) a JOIN ({whole_sets}) b ON a.part = b.part JOIN (SELECT family, count(*) AS n FROM ({whole_sets}) GROUP BY family) x ON x.family = a.family JOIN (SELECT family, count(*) AS n FROM ({whole_sets}) GROUP BY family) y ON y.family = b.family GROUP BY ALL")(lambda s, p: (lambda t: (lambda n: t.join(t.select("part", F.col("family").alias("r")), "part").groupBy(F.col("family").alias("l"), "r").agg(F.count("*").alias("i")).join(n.toDF("l", "x"), "l").join(n.toDF("r", "y"), "r").select("l", "r", F.round(100 * F.col("i") / (F.col("x") + F.col("y") - F.col("i")), 6).alias("jaccard")))(t.groupBy("family").agg(F.count("*"))))(whole_part_sets(s, p)))
add("overlap_matrix", f"SELECT a.family AS l, b.family AS r, count(*) AS shared FROM ({whole_sets}) a JOIN ({whole_sets}) b ON a.part = b.part GROUP BY ALL")(lambda s, p: (lambda t: t.join(t.select("part", F.col("family").alias("r")), "part").groupBy(F.col("family").alias("l"), "r").agg(F.count("*").alias("shared")))(whole_part_sets(s, p)))
add("effective_count", "SELECT round(exp(-sum(p * ln(p))), 6) AS effective FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM text GROUP BY scaffold)")(lambda s, p: V.text(s, p).groupBy("scaffold").agg(F.count("*").alias("c")).withColumn("p", F.col("c") / F.sum("c").over(Window.partitionBy())).agg(F.round(F.exp(-F.sum(F.col("p") * F.log("p"))), 6).alias("effective")))
add("novel_count", "SELECT count(DISTINCT l_partkey) AS novel FROM lineitem WHERE l_linenumber = 4 AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 1)")(lambda s, p: (lambda t: t.where("l_linenumber = 4").join(t.where("l_linenumber = 1").select("l_partkey"), "l_partkey", "left_anti").agg(F.countDistinct("l_partkey").alias("novel")))(V.table(s, p, "lineitem")))
add("diagonal_union", "SELECT id, prediction, NULL AS status FROM pred UNION ALL SELECT id, NULL, status FROM master")(lambda s, p: V.pred(s, p).select("id", "prediction").unionByName(V.master(s, p).select("id", "status"), allowMissingColumns=True))
add("bijection_check", "SELECT (SELECT count(*) FROM (SELECT run_id FROM manifest EXCEPT SELECT run_id FROM runs)) AS only_manifest, (SELECT count(*) FROM (SELECT run_id FROM runs EXCEPT SELECT run_id FROM manifest)) AS only_runs")(lambda s, p: (lambda a, b: a.withColumn("m", F.lit(1)).join(b.withColumn("r", F.lit(1)), "run_id", "full").agg(F.count_if(F.col("r").isNull()).alias("only_manifest"), F.count_if(F.col("m").isNull()).alias("only_runs")))(V.manifest(s, p).select("run_id").distinct(), V.runs(s, p).select("run_id").distinct()))
add("break_even", "SELECT w AS speed, l AS share, round(w * l * (15.0 / 1e6 + 0.0012) / (1 - l * 0.01), 9) AS cost FROM range(1, 5) a(w), range(1, 5) b(l)")(lambda s, p: s.range(1, 5).toDF("speed").withColumn("share", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(4).cast("bigint")))).withColumn("cost", F.round(F.expr("speed * share * (15.0D / 1e6 + 0.0012D) / (1 - share * 0.01D)"), 9)))
# Calibration
res = "(SELECT *, target - prediction AS r, abs(target - prediction) AS e FROM pred)"
add("uq_nll", f"SELECT round(avg(0.5 * ln(2 * pi() * uncertainty * uncertainty) + r * r / (2 * uncertainty * uncertainty)), 6) AS nll FROM {res}")(lambda s, p: U.nll(V.pred(s, p)))
add("uq_ence", f"SELECT round(avg(abs(a - b) / b), 6) AS ence FROM (SELECT sqrt(avg(r * r)) AS a, sqrt(avg(uncertainty * uncertainty)) AS b FROM (SELECT *, ntile(10) OVER (ORDER BY uncertainty, id) AS t FROM {res}) GROUP BY t)")(lambda s, p: U.ence(V.pred(s, p)))
add("uq_quantile_error", f"SELECT (t - 1)::INT AS tile, count(*) AS n, round(avg(e), 6) AS mean_error, round(median(e), 6) AS median_error FROM (SELECT *, ntile(5) OVER (ORDER BY uncertainty, id) AS t FROM {res}) GROUP BY t")(lambda s, p: U.tile_errors(V.pred(s, p)))
LEVELS = {0.5: 0.6744897501960817, 0.9: Z90, 0.95: 1.959963984540054}
add("uq_coverage", "SELECT " + ", ".join(f"round(avg(CASE WHEN e <= {z!r} * uncertainty THEN 1.0 ELSE 0.0 END), 6) AS coverage_{round(lv * 100)}" for lv, z in LEVELS.items()) + f" FROM {res}")(lambda s, p: U.coverage(V.pred(s, p), LEVELS))
zs = "(r / uncertainty)"
add("uq_crps", f"SELECT round(avg(uncertainty * ({zs} * (2 * ({normal.cdf(zs)}) - 1) + 2 * {normal.pdf(zs)} - 0.5641895835477563)), 6) AS crps FROM {res}")(lambda s, p: U.crps(V.pred(s, p)))
add("conformal_quantile", f"SELECT round(q, 6) AS quantile FROM (SELECT e / uncertainty AS q, row_number() OVER (ORDER BY e / uncertainty, id) AS i, count(*) OVER () AS n FROM {res}) WHERE i = least(n, ceil((n + 1) * 0.9))")(lambda s, p: U.conformal_quantile(V.pred(s, p), 0.9))
add("interval_score", f"SELECT round(avg(2 * {Z90!r} * uncertainty + 20 * greatest(e - {Z90!r} * uncertainty, 0)), 6) AS interval_score FROM {res}")(lambda s, p: U.interval_score(V.pred(s, p), Z90, 0.1))
add("uq_scale", f"SELECT round(sqrt(avg((r / uncertainty) ** 2)), 6) AS scale FROM {res}")(lambda s, p: U.scale(V.pred(s, p)))
add("ensemble_aggregate", "SELECT vec_id, round(list_avg(embedding), 6) AS mean, round(list_median(embedding), 6) AS middle FROM (SELECT vec_id, embedding::DOUBLE[] AS embedding FROM embeddings)")(lambda s, p: V.table(s, p, "embeddings").selectExpr("vec_id", "sort_array(transform(embedding, x -> cast(x AS double))) AS e", "size(embedding) AS n").selectExpr("vec_id", "round(aggregate(e, 0D, (a, x) -> a + x) / n, 6) AS mean", "round((e[cast(floor((n - 1) / 2) AS int)] + e[cast(floor(n / 2) AS int)]) / 2, 6) AS middle"))
add("variance_mask", "SELECT i, var_pop(x) > 1e-10 AS kept FROM (SELECT unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY i")(lambda s, p: V.table(s, p, "embeddings").select(F.posexplode("embedding").alias("i", "x")).groupBy(F.col("i").cast("bigint").alias("i")).agg((F.var_pop(F.col("x").cast("double")) > 1e-10).alias("kept")))

# The other parts register themselves.
from . import campaigns, metrics, spaces, states, uncertainty  # noqa: E402, F401
