import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prospectra.errors import AcquisitionError, EngineWarning, InputError, LearnerError
from prospectra.operators import acquisition, analytics, calibration, checks, evaluation, neighbours, order, pool


def ids(df):
    return [r["id"] for r in df.collect()]


def scores(spark, values, parts=3):
    return spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "id long, score double").repartition(parts)


def test_ties_go_to_the_smaller_id(spark):
    assert ids(order.best(scores(spark, [3, 2, 2, 2, 2, 1, 1]), "score", 3)) == [0, 1, 2]
    assert ids(order.best(scores(spark, [0.0] * 100), "score", 10)) == list(range(10))
    assert ids(order.best(scores(spark, [1.0, float("nan"), None, 2.0]), "score", 9)) == [3, 0, 1, 2]
    assert ids(order.best(scores(spark, [1.0]), "score", 0)) == []


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(-3, 3), min_size=1, max_size=60), st.integers(1, 70), st.sampled_from([1, 3, 17]), st.sampled_from([2, 5, 1000]))
def test_best_and_ranked_against_python(spark, values, k, parts, width):
    usual, order.RANGE_ROWS = order.RANGE_ROWS, width  # many ranges, so that ties lie across them
    try:
        rows = scores(spark, [float(v) for v in values], parts)
        want = sorted(range(len(values)), key=lambda i: (-values[i], i))
        assert ids(order.best(rows, "score", k)) == want[:k]
        got = {r["id"]: r for r in order.ranked(rows, "score", "id", descending=True).collect()}
        assert [got[i]["position"] for i in want] == list(range(1, len(values) + 1))
        assert all(got[i]["rank"] == 1 + sum(v > values[i] for v in values) and got[i]["ties"] == values.count(values[i]) for i in got)
        steps = scores(spark, sorted(set(values)), parts).withColumn("w", F.col("id") + 1)
        sums = {r["score"]: (r["__before"], r["__all"]) for r in order.running(steps, "score", "w").collect()}
        assert all(sums[v] == (sum(range(1, i + 1)), sum(range(1, len(set(values)) + 1))) for i, v in enumerate(sorted(set(values))))
    finally:
        order.RANGE_ROWS = usual


def test_a_constant_score_is_no_single_task(spark, monkeypatch):
    monkeypatch.setattr(order, "RANGE_ROWS", 500)
    rows = order.ranked(spark.range(10_000).withColumn("s", F.lit(1.0)), "s", "id")
    got = rows.agg(F.min("position"), F.max("position"), F.count_distinct("position"), F.max("rank"), F.min("ties")).first()
    assert tuple(got) == (1, 10_000, 10_000, 1, 10_000)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "__range" in plan


def test_large_k_is_cut_by_rank(spark, monkeypatch):
    monkeypatch.setattr(order, "TOP", 10)
    rows = scores(spark, [float(i * 7 % 50) for i in range(200)])
    want = sorted(range(200), key=lambda i: (-(i * 7 % 50), i))[:60]
    assert sorted(ids(order.best(rows, "score", 60))) == sorted(want)


def test_quantiles_and_medians(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(order, "RANGE_ROWS", 20)
    dice = random.Random(4)
    data = [(i, i % 3, dice.choice([1.0, 2.5, 7.25]) if i % 2 else dice.random()) for i in range(141)]
    rows = spark.createDataFrame(data, "id long, g long, x double")
    got = order.at_quantiles(rows, "x", "id", {"a": 0.5, "b": 0.9}).first()
    assert abs(got["a"] - np.median([x for *_, x in data])) < 1e-12 and abs(got["b"] - np.quantile([x for *_, x in data], 0.9)) < 1e-12
    for r in order.group_medians(rows, "g", "x", "id").collect():
        assert abs(r["median"] - np.median([x for _, g, x in data if g == r["g"]])) < 1e-12


def test_prune_ties(spark):
    rows = lambda v: spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "id long, prediction double")
    assert sorted(ids(pool.keep_best(rows([5, 5, 5, 1, 1]), 0.4)[0])) == [0, 1, 2]
    assert sorted(ids(pool.keep_best(rows([5, 1, 1, 1, 9]), 0.4, "lower")[0])) == [1, 2, 3]
    with pytest.raises(ValueError):
        pool.keep_best(rows([1]), 0.95)


def test_label_keeps_the_first_selection(spark):
    master = pool.master_table(spark.range(3))
    once = pool.label(master, spark.createDataFrame([(1, 2.0)], "id long, value double"), 0)
    twice = pool.label(once, spark.createDataFrame([(1, 3.0)], "id long, value double"), 4)
    r = twice.where("id = 1").first()
    assert (r.status, r.selected_cycle, r.labeled_cycle, r.target) == ("labeled", 0, 4, 3.0)
    with pytest.raises(ValueError):
        pool.with_status(master, "lost")


def test_all_rows_of_a_duplicate_are_invalid(spark):
    got = pool.split_duplicates(spark.createDataFrame([("a",), ("b",), ("a",)], "k string"), "k").where("NOT is_valid")
    assert [r.k for r in got.collect()] == ["a", "a"]


def test_index_and_random_do_not_depend_on_partitions(spark):
    rows = spark.range(200_000).where("id % 3 = 0")
    got = order.indexed(rows.repartition(7), "id").agg(F.min("global_index"), F.max("global_index"), F.count_distinct("global_index")).first()
    assert tuple(got) == (0, 66_666, 66_667)
    sets = [set(ids(acquisition.choose_random(spark.range(500).repartition(n), 20, 1))) for n in (1, 3, 17)]
    assert sets[0] == sets[1] == sets[2]


def test_improvement_ratio_with_zero_mean(spark):
    rows = spark.createDataFrame([(0, 1.0), (1, -1.0)], "id long, target double")
    assert evaluation.improvement_ratio(rows, spark.range(1)).first()[0] == float("inf")
    assert evaluation.improvement_ratio(rows, spark.range(2)).first()[0] == 0


def test_constant_column_has_no_entropy(spark):
    assert evaluation.histogram_entropy(spark.range(9).select(F.lit(2.0).alias("v")), "v").first()[0] == 0


def plain_chain(values, k, seed, steps, first, last, schedule, neighbours, band=50):
    """Annealing over a plain list; places are ranks."""
    import math

    order_ = sorted(range(len(values)), key=lambda i: (-values[i], i))
    energy = [-values[i] for i in order_]
    if neighbours == "random":
        dice = random.Random(seed)
        draws, walk = [dice.randrange(len(values)) for _ in range(steps)], random.Random(seed + 1)
    else:
        walk = random.Random(seed)
    at = walk.randrange(len(values))
    seen = set()
    for i in range(steps):
        heat = first * (last / first) ** (i / steps) if schedule == "exponential" else first + (last - first) * i / steps
        to = draws[i] if neighbours == "random" else min(len(values) - 1, max(0, at + walk.randint(-band, band)))
        if energy[to] <= energy[at] or walk.random() < math.exp(-(energy[to] - energy[at]) / heat):
            at = to
        seen.add(at)
    best = sorted(seen)[:k]
    best += [p for p in range(len(values)) if p not in seen][: k - len(best)]
    return [order_[p] for p in best], len(seen)


@pytest.mark.parametrize("neighbours, schedule", [("score_band", "exponential"), ("random", "linear")])
def test_annealing_against_a_plain_chain(spark, neighbours, schedule):
    values = [random.Random(i).random() for i in range(300)]
    rows = spark.createDataFrame(list(enumerate(values)), "id long, prediction double")
    for n in (1, 9):
        got = acquisition.anneal(rows.repartition(n), 25, 5, 200, 1.0, 0.01, neighbours=neighbours, schedule=schedule).collect()
        want, seen = plain_chain(values, 25, 5, 200, 1.0, 0.01, schedule, neighbours)
        assert sorted(r["id"] for r in got) == sorted(want) and all(abs(r["acquisition_score"] - values[r["id"]]) < 1e-12 for r in got)
    near = spark.createDataFrame([(i, [(i + 1) % 300, (i + 7) % 300]) for i in range(300)], "id long, near array<long>")
    assert acquisition.anneal(rows, 12, 5, 20, neighbours=near).count() == 12
    with pytest.raises(AcquisitionError):
        acquisition.anneal(rows, 12, 5, first=0.1, last=1.0)


def test_registry_and_guards(spark):
    rows = spark.createDataFrame([(i, float(i), 1.0 if i else 0.0) for i in range(20)], "id long, prediction double, uncertainty double")
    assert set(acquisition.REGISTRY) == {"greedy", "random", "topk", "ucb", "ei", "pi", "thompson", "entropy", "simulated_annealing"}
    assert ids(acquisition.acquisition("greedy").select(rows, 2, "lower")) == [0, 1]
    with pytest.warns(EngineWarning):
        acquisition.acquisition("entropy").select(rows, 2)
    for bad in (lambda: acquisition.acquisition("x"), lambda: acquisition.acquisition("ei").select(rows, 2), lambda: acquisition.acquisition("ucb").select(rows.drop("uncertainty"), 2), lambda: acquisition.acquisition("ei").select(rows, 2, best=1.0, xi=-1.0)):
        with pytest.raises(AcquisitionError):
            bad()
    for value in (-1.0, float("nan"), float("inf")):
        with pytest.raises(AcquisitionError):
            checks.uncertainty(rows.withColumn("uncertainty", F.lit(value)))
    for c, value in (("prediction", None), ("prediction", float("nan")), ("uncertainty", float("inf"))):
        with pytest.raises(LearnerError):
            checks.predictions(rows.withColumn(c, F.lit(value).cast("double")))
    assert checks.predictions(rows).count() == 20
    topk = acquisition.acquisition("topk")
    assert topk.shortlist_size(1000, 10) == 50 and acquisition.acquisition("ucb").shortlist_size(1000, 10) == 10
    short = acquisition.choose(rows, acquisition.greedy(), topk.shortlist_size(20, 2, k_fraction=0.5))
    assert sorted(ids(topk.finalize(short, 2, 7))) == sorted(ids(topk.select(rows, 2, seed=7, k_fraction=0.5)))
    assert acquisition.batch_size(1000, 0.0101, 5000) == 11 and acquisition.batch_size(10, 0.01, 0) == 0
    assert acquisition.cycle_seed(42, 1) != acquisition.cycle_seed(42, 2)


def test_states_are_validated(spark):
    master = pool.master_table(spark.range(4))
    assert checks.master(master).count() == 4
    for bad in (master.unionByName(master), master.withColumn("status", F.lit("lost")), master.withColumn("target", F.lit(1.0))):
        with pytest.raises(InputError):
            checks.master(bad)
    with pytest.raises(InputError):
        checks.master(master.drop("status"))
    with pytest.raises(InputError):
        checks.target_type(spark.createDataFrame([(True,)], "y boolean"), "y")
    with pytest.raises(InputError):
        checks.unique(spark.createDataFrame([(1,), (1,)], "k int"), "k")


def test_first_row_keeps_whole_rows(spark):
    rows = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), ("b", 2, "z")], "k string, place int, v string").repartition(3)
    assert sorted(map(tuple, pool.first_row(rows, "k", "place").select("k", "v").collect())) == [("a", "y"), ("b", "z")]


def test_percentile_in_both_directions(spark):
    rows = spark.createDataFrame([(i, float(i)) for i in range(10)], "id long, target double")
    best = spark.createDataFrame([(9,)], "id long")
    assert evaluation.selected_percentile(rows, best).first()[0] == 100 and evaluation.selected_percentile(rows, best, direction="lower").first()[0] == 10


def test_neighbours_by_blocks(spark, monkeypatch):
    dice = random.Random(3)
    sets = [[dice.randint(0, 1) for _ in range(24)] for _ in range(120)]
    rows = spark.createDataFrame(list(enumerate(sets)), "id long, vector array<int>")
    def sim(a, b):
        both, either = sum(x & y for x, y in zip(a, b)), sum(x | y for x, y in zip(a, b))
        return both / either if either else 1.0
    want = {i: sorted(((-sim(sets[i], sets[j]), j) for j in range(120) if j != i))[:4] for i in range(0, 120, 10)}
    for blocks in ((4096, 8192), (5, 17)):
        monkeypatch.setattr(neighbours, "QUERIES", blocks[0])
        monkeypatch.setattr(neighbours, "ROWS", blocks[1])
        got = neighbours.nearest(rows.where("id % 10 = 0"), rows, 4).collect()
        assert {(r["id"], r["place"], r["neighbour"]) for r in got} == {(i, p + 1, j) for i, w in want.items() for p, (_, j) in enumerate(w)}


def test_knn_style_calibration_edges(spark):
    rows = spark.createDataFrame([(i, float(i), 0.0, 1.0) for i in range(5)], "id long, target double, prediction double, uncertainty double")
    assert calibration.ause(rows).first()[0] is None
    assert calibration.order_statistic(rows, "target", 0.99).first()[0] == 4.0
    with pytest.raises(ValueError):
        calibration.order_statistic(rows, "target", 1.0)


def test_mean_tanimoto_takes_all_vectors(spark):
    dice = random.Random(8)
    sets = [sorted(dice.sample(range(40), dice.randint(0, 20))) for _ in range(900)]
    rows = spark.createDataFrame(list(enumerate(sets)), "id long, b array<int>")
    for n in (0, 1, 11, 45, 60, 900):
        every = [1.0 if not x | y else len(x & y) / len(x | y) for i, x in enumerate(map(set, sets[:n])) for y in map(set, sets[:i])]
        some = rows.where(F.col("id") < n)
        mean, pairs = evaluation.mean_tanimoto(some).first()
        if n <= 60:
            assert pairs == len(every) and (mean is None if n < 2 else abs(mean - sum(every) / pairs) < 2e-6)
        else:
            assert 1000 <= pairs <= 100_000 and abs(mean - sum(every) / len(every)) < 0.015
            assert (mean, pairs) == tuple(evaluation.mean_tanimoto(some.repartition(9)).first())


def test_run_aggregates_pass_over_nulls(spark):
    """As SQL's arg_max and its filter on the best do."""
    rows = spark.createDataFrame([(1, 1, None, 1.0), (1, 2, None, None), (2, 1, 5.0, 2.0), (2, 2, 5.0, 3.0), (2, 3, None, None)], "run_id long, cycle long, metric double, cost double")
    got = {r["run_id"]: r for r in analytics.run_aggregates(rows, "metric", ["cost"]).collect()}
    names = ("avg_metric", "std_metric", "best", "best_cycle", "final_metric", "final_cost", "avg_cost", "total_cycles")
    assert [got[1][c] for c in names] == [None, None, None, None, None, 1.0, 1.0, 2]
    assert [got[2][c] for c in names] == [5.0, 0.0, 5.0, 1, 5.0, 3.0, 2.5, 3]
