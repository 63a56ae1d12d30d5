"""Queries of pool states, predicates, guards and joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import splitmix
from ..operators import acquisition as A
from ..operators import checks, cycle, oracles, order, pool
from . import views as V
from .registry import add


@add("dedup_first", "SELECT l_orderkey, l_partkey, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity) AS i FROM lineitem) WHERE i = 1")
def dedup_first(spark, d):
    rows = V.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("place"))
    return pool.first_row(rows, "l_orderkey", "place").drop("place")


@add("value_map", "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'other' END AS state FROM orders")
def value_map(spark, d):
    return V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), pool.mapped("o_orderstatus", {"F": "finished", "O": "open"}, "other").alias("state"))


@add("value_map_strict", "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 WHEN 'P' THEN 3 END AS state FROM orders")
def value_map_strict(spark, d):
    return V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), pool.mapped("o_orderstatus", {"F": 1, "O": 2, "P": 3}, strict=True).alias("state"))


@add("conditional_label", "SELECT run_id, CASE WHEN design IN ('ASIA', 'EUROPE') THEN 'delayed' ELSE 'immediate' END AS schedule FROM manifest")
def conditional_label(spark, d):
    return V.manifest(spark, d).select("run_id", F.when(F.col("design").isin("ASIA", "EUROPE"), "delayed").otherwise("immediate").alias("schedule"))


@add("rows_with_null", "SELECT id FROM master WHERE labeled_cycle IS NULL OR target IS NULL")
def rows_with_null(spark, d):
    return V.master(spark, d).where(checks.any_null("labeled_cycle", "target")).select("id")


@add("null_counts", "SELECT count(*) - count(labeled_cycle) AS labeled_cycle, count(*) - count(pruned_cycle) AS pruned_cycle, count(*) - count(target) AS target FROM master")
def null_counts(spark, d):
    return V.master(spark, d).agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in ("labeled_cycle", "pruned_cycle", "target")))


@add("strict_cast", "SELECT o_orderkey AS id, CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS priority FROM orders")
def strict_cast(spark, d):
    rows = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.substring("o_orderpriority", 1, 1).alias("p"))
    return rows.select("id", checks.strict_number("p").alias("priority"))


@add("finite_rows", "SELECT id FROM (SELECT id, CASE WHEN id % 11 = 0 THEN 'nan'::DOUBLE WHEN id % 11 = 1 THEN 'inf'::DOUBLE WHEN id % 11 = 2 THEN NULL ELSE prediction END AS p, uncertainty AS u FROM pred) WHERE p IS NOT NULL AND NOT isnan(p) AND NOT isinf(p) AND u > 0")
def finite_rows(spark, d):
    p = "CASE WHEN id % 11 = 0 THEN double('nan') WHEN id % 11 = 1 THEN double('inf') WHEN id % 11 = 2 THEN NULL ELSE prediction END AS p"
    return V.pred(spark, d).selectExpr("id", p, "uncertainty AS u").where(checks.finite("p", "u") & (F.col("u") > 0)).select("id")


@add("active_rows", "SELECT id FROM cand WHERE CAST(activity AS BIGINT) = 1")
def active_rows(spark, d):
    c = V.cand(spark, d)
    return c.where(checks.active(c)).select("id")


FAULTY = "SELECT id, CASE WHEN id % 13 = 0 THEN 'lost' ELSE status END AS status, CASE WHEN id % 17 = 0 THEN NULL ELSE labeled_cycle END AS labeled_cycle, selected_cycle, CASE WHEN id % 19 = 0 THEN NULL ELSE pruned_cycle END AS pruned_cycle, CASE WHEN id % 23 = 0 THEN 1.0 ELSE target END AS target FROM master"


@add("master_faults", f"SELECT count(*) FILTER (id IS NULL) AS null_id, count(*) FILTER (status NOT IN ('unlabeled', 'labeled', 'pruned')) AS unknown_status, count(*) FILTER (status = 'labeled' AND labeled_cycle IS NULL) AS labeled_without_cycle, count(*) FILTER (status = 'pruned' AND pruned_cycle IS NULL) AS pruned_without_cycle, count(*) FILTER (status = 'unlabeled' AND target IS NOT NULL) AS unlabeled_with_target, (SELECT coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM master GROUP BY id HAVING count(*) > 1)) AS repeated_id FROM ({FAULTY})")
def master_faults(spark, d):
    rows = V.master(spark, d).selectExpr(
        "id", "CASE WHEN id % 13 = 0 THEN 'lost' ELSE status END AS status", "CASE WHEN id % 17 = 0 THEN NULL ELSE labeled_cycle END AS labeled_cycle", "selected_cycle",
        "CASE WHEN id % 19 = 0 THEN NULL ELSE pruned_cycle END AS pruned_cycle", "CASE WHEN id % 23 = 0 THEN 1.0D ELSE target END AS target",
    )
    return spark.createDataFrame([checks.master_faults(rows)])


@add("uncertainty_faults", "SELECT count(*) FILTER (uncertainty - 30 < 0) AS negative, count(*) FILTER (id % 11 = 0) AS not_finite FROM pred")
def uncertainty_faults(spark, d):
    rows = V.pred(spark, d).selectExpr("id", "uncertainty - 30 AS a", "CASE WHEN id % 11 = 0 THEN double('nan') ELSE uncertainty END AS b")
    return spark.createDataFrame([checks.counts(rows, {"negative": F.col("a") < 0, "not_finite": ~checks.finite("b")})])


@add("batch_sizes", "SELECT cycle, least(greatest(1, ceil(n * 0.07))::BIGINT, r) AS batch FROM (SELECT (SELECT count(*) FROM cand) AS n, labeled_cycle AS cycle, count(*) AS r FROM master WHERE status = 'labeled' GROUP BY labeled_cycle)")
def batch_sizes(spark, d):
    n = V.cand(spark, d).count()
    rows = V.master(spark, d).where("status = 'labeled'").groupBy(F.col("labeled_cycle").alias("cycle")).agg(F.count("*").alias("r")).collect()  # a row a cycle
    return spark.createDataFrame([(r["cycle"], A.batch_size(n, 0.07, r["r"])) for r in rows], "cycle long, batch long")


@add("target_backfill", "SELECT m.id, coalesce(m.target, c.target) AS target FROM master m LEFT JOIN (SELECT id, target FROM cand WHERE id % 3 = 0) c ON m.id = c.id")
def target_backfill(spark, d):
    return oracles.backfill(V.master(spark, d), oracles.TableOracle(V.cand(spark, d).where("id % 3 = 0"))).select("id", "target")


@add("function_oracle", "SELECT row_number() OVER (ORDER BY prediction DESC, id) AS place, id, id * 0.5::DOUBLE AS value FROM pred ORDER BY prediction DESC, id LIMIT 200")
def function_oracle(spark, d):
    ids = order.best(V.pred(spark, d), "prediction", 200).select("id", F.row_number().over(Window.orderBy(F.desc("prediction"), "id")).cast("bigint").alias("place"))  # a batch
    return oracles.FunctionOracle(lambda ids: {x: 0.5 * x for x in reversed(ids)}).measure(ids)


@add("known_ids", "SELECT id FROM master WHERE target IS NOT NULL")
def known_ids(spark, d):
    return oracles.TableOracle(V.master(spark, d)).known()


@add("shortlist_gather", "SELECT global_index, id, prediction FROM (SELECT p.id, prediction, row_number() OVER (ORDER BY p.id) - 1 AS global_index FROM pred p JOIN master m ON p.id = m.id WHERE status = 'unlabeled') ORDER BY prediction DESC, global_index LIMIT 120")
def shortlist_gather(spark, d):
    left = order.indexed(pool.with_status(V.master(spark, d), "unlabeled", ["id"]).join(V.pred(spark, d).select("id", "prediction"), "id"), "id")
    short = order.best(left.select("global_index", F.col("prediction").alias("s")), "s", 120, "global_index").select("global_index")
    return left.join(F.broadcast(short), "global_index").select("global_index", "id", "prediction").orderBy("global_index")  # 120 rows


@add("one_to_one_join", "SELECT c.id, c.target, p.prediction FROM cand c LEFT JOIN pred p ON c.id = p.id")
def one_to_one_join(spark, d):
    """Each id once on both sides, and no row without a partner."""
    left, right = checks.unique(V.cand(spark, d).select("id", "target"), "id"), checks.unique(V.pred(spark, d).select("id", "prediction"), "id")
    out = left.join(right, "id", "left")
    return out.withColumn("prediction", F.coalesce("prediction", F.raise_error(F.lit("a row has no partner")).cast("double")))


@add("collision_join", "SELECT r.run_id, r.cycle, round(r.metric, 6) AS metric, m.family AS family, m.design AS design FROM runs r LEFT JOIN manifest m ON r.run_id = m.run_id")
def collision_join(spark, d):
    """A left join that refuses columns that both sides have."""
    runs, manifest = V.runs(spark, d).select("run_id", "cycle", F.round("metric", 6).alias("metric")), checks.unique(V.manifest(spark, d), "run_id")
    if clash := (set(runs.columns) & set(manifest.columns)) - {"run_id"}:
        raise ValueError(f"both sides have {', '.join(sorted(clash))}")
    return runs.join(manifest, "run_id", "left")


@add("paired_deltas", "SELECT a.run_id, a.cycle, round(a.metric - b.metric, 6) AS delta FROM runs a JOIN runs b ON a.cycle = b.cycle AND b.run_id = 1")
def paired_deltas(spark, d):
    """Each run less the baseline run of the same cycle; the baseline has one row a cycle, so that no row is doubled."""
    runs = V.runs(spark, d)
    base = checks.unique(runs.where("run_id = 1").select("cycle", F.col("metric").alias("base")), "cycle")
    return runs.join(base, "cycle").select("run_id", "cycle", F.round(F.col("metric") - F.col("base"), 6).alias("delta"))


@add("cycle_seeds")
def cycle_seeds(spark, d):
    """A seed for each cycle of a run; numpy's, so that there is no SQL (tests/test_operators.py)."""
    return spark.createDataFrame([(c, A.cycle_seed(42, c)) for c in range(10)], "cycle int, seed long")


SCHEDULES = "(SELECT r_regionkey, 'random:0.0' || (r_regionkey + 1) || ' greedy:0.01*' || (r_regionkey + 2) || '  ucb:0.5' AS t FROM region)"


@add("parse_schedule", f"SELECT r_regionkey, block, strategy, batch_fraction, unnest(range(1, n + 1))::INT AS repeat FROM (SELECT r_regionkey, (i - 1)::INT AS block, split_part(b, ':', 1) AS strategy, split_part(split_part(b, ':', 2), '*', 1)::DOUBLE AS batch_fraction, coalesce(nullif(split_part(b, '*', 2), '')::INT, 1) AS n FROM (SELECT r_regionkey, unnest(string_split_regex(t, ' +')) AS b, generate_subscripts(string_split_regex(t, ' +'), 1) AS i FROM {SCHEDULES}))")
def parse_schedule(spark, d):
    rows = V.table(spark, d, "region").select("r_regionkey", F.expr("concat('random:0.0', r_regionkey + 1, ' greedy:0.01*', r_regionkey + 2, '  ucb:0.5')").alias("t"))
    return cycle.schedule_table(rows, "t").select("r_regionkey", "block", "strategy", "batch_fraction", "repeat")


@add("schedule_expand", "SELECT c - 1 AS cycle, CASE WHEN c = 1 THEN 'random' WHEN c < 7 THEN 'greedy' ELSE 'ucb' END AS strategy, CASE WHEN c = 1 THEN 0.02 ELSE 0.01 END::DOUBLE AS batch_fraction, CASE WHEN c < 7 THEN 'score' ELSE 'none' END AS pruning FROM range(1, 10) r(c)")
def schedule_expand(spark, d):
    """One row a cycle; blocks without their own pruning inherit the campaign's."""
    blocks = [*cycle.parse_schedule("random:0.02 greedy:0.01*5"), cycle.CycleConfig("ucb", 3, 0.01, "none")]
    return spark.createDataFrame([(i, c.strategy, c.batch_fraction, c.pruning) for i, c in enumerate(cycle.expand(blocks, pruning="score"))], "cycle long, strategy string, batch_fraction double, pruning string")


@add("splitmix_uniform", f"SELECT id, global_index, u FROM (SELECT id, global_index, {splitmix.uniform_sql('global_index', 42, 3)} AS u FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS global_index FROM cand))")
def splitmix_uniform(spark, d):
    """Uniform numbers of the stream (seed 42, cycle 3) by the rows' places; equal to the last bit."""
    rows = order.indexed(V.cand(spark, d).select("id"), "id")
    return rows.select("id", "global_index", splitmix.uniform(F.col("global_index"), 42, 3).alias("u"))
