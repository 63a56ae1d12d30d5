import json
import os

import pytest
from pyspark.sql import functions as F

from prospectra.sources import pools, sinks
from prospectra.streaming import arrivals


def test_csv_pool_names_and_numbers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("smiles,x\nCC,1\nCO,2\nC,3\n")
    got = pools.read_pool(spark, f"{tmp_path}/a.csv").orderBy("x").collect()
    assert [(r["ID"], r["SMILES"]) for r in got] == [("compound_0", "CC"), ("compound_1", "CO"), ("compound_2", "C")]
    named = pools.read_csv_pool(spark, f"{tmp_path}/a.csv", name="x", schema="smiles string, x string")
    assert sorted(r["ID"] for r in named.collect()) == ["1", "2", "3"]
    (tmp_path / "b.csv").write_text("y,x\n1,2\n")
    with pytest.raises(ValueError):
        pools.read_pool(spark, f"{tmp_path}/b.csv")
    with pytest.raises(ValueError):
        pools.pool_format("a.docx")


def test_numbers_run_over_partitions(spark):
    got = pools.numbered(spark.range(0, 1000, 1, 7), "n").collect()
    assert all(r["id"] == r["n"] for r in got) and len(got) == 1000
    assert pools.numbered(spark.range(0), "n").count() == 0


def test_smi_and_sdf(spark, tmp_path):
    (tmp_path / "a.smi").write_text("SMILES\tName\nCC\tethane\n\tnone\nC\tmethane\n")
    assert sorted(map(tuple, pools.read_pool(spark, f"{tmp_path}/a.smi").select("ID", "SMILES").collect())) == [("ethane", "CC"), ("methane", "C")]
    mol = "{}\n  tool\n\n  0  0\nM  END\n> <Activity>\n{}\n\n> <note>\none\ntwo\n\n$$$$\n"
    (tmp_path / "a.sdf").write_text(mol.format("first", 1.5) + mol.format("", 2.5))
    got = {r["ID"]: r for r in pools.read_pool(spark, f"{tmp_path}/a.sdf").collect()}
    assert set(got) == {"first", "compound_1"}
    assert got["first"]["Activity"] == "1.5" and got["first"]["note"] == "one\ntwo" and got["first"]["molblock"].endswith("M  END")


def test_formats_and_columns(spark):
    assert sinks.output_format("auto", 1_000_000, "x") == "csv" and sinks.output_format("auto", 1_000_001, "x") == "parquet"
    assert sinks.output_format("parquet", 5, "cycle_metrics") == "csv"
    df = spark.createDataFrame([(1, 2, 3, 4)], "z int, b int, a int, c int")
    assert sinks.ordered_columns(df, [["c"], ["missing", "z"]]).columns == ["c", "z", "a", "b"]


def test_results_and_cycles(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "ID string, prediction double")
    paths = sinks.write_results(spark, str(tmp_path), {"compounds_final": df, "cycle_metrics": df}, {"seed": 1}, "parquet")
    assert spark.read.parquet(paths["compounds_final"]).count() == 2 and paths["cycle_metrics"].endswith(".csv")
    assert json.load(open(tmp_path / "config.json"))["config"] == {"seed": 1}
    sinks.publish(df.limit(1), paths["compounds_final"])
    assert pools.read_results(spark, f"{tmp_path}/compounds_final").count() == 1
    assert pools.read_results(spark, f"{tmp_path}/cycle_metrics").count() == 2
    assert not [x for x in os.listdir(tmp_path) if ".tmp" in x]
    for n in (1, 12):
        sinks.write_predictions(df, f"{tmp_path}/p/cycle_{n}.parquet")
    cycles = pools.read_cycles(spark, f"{tmp_path}/p", "*.parquet")
    assert {(r["cycle"], r["ID"]) for r in cycles.collect()} == {(1, "a"), (1, "b"), (12, "a"), (12, "b")}
    assert dict(pools.read_predictions(spark, f"{tmp_path}/p/cycle_1.parquet").dtypes)["prediction"] == "float"


def test_migration(spark, tmp_path):
    wide = spark.createDataFrame([("a", 1.0, None), ("b", 2.0, 3.0)], "ID string, prediction_cycle_0 double, prediction_cycle_2 double")
    assert sinks.migrate(spark, wide, str(tmp_path)) == 3
    got = spark.read.parquet(f"{tmp_path}/cycles").select("ID", "cycle", "prediction").collect()
    assert {tuple(r) for r in got} == {("a", 0, 1.0), ("b", 0, 2.0), ("b", 2, 3.0)}


def test_row_groups_are_exact(spark, tmp_path):
    import pyarrow.parquet as pq

    sinks.write_predictions(spark.range(0, 2500, 1, 1).selectExpr("id AS ID", "id * 0.5D AS prediction"), f"{tmp_path}/p.parquet", rows=1000, group=500)
    files = sorted(str(x) for x in (tmp_path / "p.parquet").glob("*.parquet"))
    metas = [pq.ParquetFile(f).metadata for f in files]
    sizes = [[m.row_group(i).num_rows for i in range(m.num_row_groups)] for m in metas]
    assert sorted(sum(s) for s in sizes) == [500, 1000, 1000] and all(g == 500 for s in sizes for g in s)


def test_meta_and_comments(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "n int, t string")
    sinks.write_commented(df, f"{tmp_path}/m.csv", {"seed": 4, "name": "x: y"})
    assert sinks.read_meta(spark, f"{tmp_path}/m.csv") == {"seed": 4, "name": "x: y"}
    assert sorted(map(tuple, pools.read_commented_csv(spark, f"{tmp_path}/m.csv", "n int, t string").collect())) == [(1, "a,b"), (2, None)]
    sinks.write_meta(spark, f"{tmp_path}/t.parquet", {"rows": 2})
    assert sinks.read_meta(spark, f"{tmp_path}/t.parquet") == {"rows": 2}
    with pytest.raises(ValueError):
        sinks.write_commented(spark.range(5), f"{tmp_path}/x.csv", {}, rows=3)


def test_batch_migration(spark, tmp_path):
    for n in (1, 2):
        spark.createDataFrame([("a", 1.0 * n)], "ID string, prediction_cycle_0 double").write.option("header", True).csv(f"{tmp_path}/w{n}.csv")
    got = sinks.migrate_all(spark, {f"{tmp_path}/w{n}.csv": f"{tmp_path}/o{n}" for n in (1, 2, 3)})
    assert got[f"{tmp_path}/w1.csv"] == 1 and got[f"{tmp_path}/w2.csv"] == 1 and isinstance(got[f"{tmp_path}/w3.csv"], str)


def test_structures_by_a_toolkit(spark, tmp_path):
    (tmp_path / "a.smi").write_text("SMILES\tName\nCC\tone\nC(\ttwo\n")
    assert [r["ID"] for r in pools.read_smi_pool(spark, f"{tmp_path}/a.smi", lambda c: ~F.contains(c, F.lit("("))).collect()] == ["one"]
    (tmp_path / "a.sdf").write_text("m\n  t\n\n  0  0\nM  END\n$$$$\n")
    assert pools.read_sdf_pool(spark, f"{tmp_path}/a.sdf", [], convert=lambda c: F.lit("CC")).first()["SMILES"] == "CC"


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id AS ID", "id AS prediction", "id AS other").write.parquet(f"{tmp_path}/p.parquet")
    plan = pools.pick_ids(spark.read.parquet(f"{tmp_path}/p.parquet").where("prediction > 5"), spark.range(3).toDF("ID"), ["prediction"])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(prediction,5)" in plan and "other" not in plan


def test_stream_agrees_with_the_whole_table(spark, tmp_path):
    # Not at the epoch: a first watermark is 0, and rows at or before it are late. The last row is far ahead, so that all windows before it close.
    rows = spark.range(100).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 600 + 472222 * 3600).alias("ts"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("event_type"), F.col("id").cast("double").alias("value"))
    last = rows.limit(1).select(F.lit(1000).cast("long").alias("event_id"), F.timestamp_seconds(F.lit(473000 * 3600)).alias("ts"), "event_type", "value")
    rows.union(rows.limit(5)).union(last).coalesce(1).write.parquet(f"{tmp_path}/in/events.parquet")
    whole = arrivals.windowed(arrivals.first_seen(arrivals.arrivals(spark, f"{tmp_path}/in", stream=False)))
    live = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in/events.parquet")
    arrivals.drain(arrivals.windowed(arrivals.first_seen(arrivals.timely(live, "0 seconds"))), f"{tmp_path}/out", f"{tmp_path}/state")
    got, want = ({tuple(r) for r in x.collect()} for x in (spark.read.parquet(f"{tmp_path}/out"), whole))
    open_window = max(want)  # that of the last row: the watermark hasn't passed it
    assert got == want - {open_window} and len(got) > 30
