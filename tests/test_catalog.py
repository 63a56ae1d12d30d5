import glob
import math
import os
import random
from decimal import ROUND_HALF_UP, Decimal

import pytest

from prospectra.plans import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    out = pytest.importorskip("duckdb").connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        out.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return out


def same(a, b):
    if isinstance(a, bool) or isinstance(b, bool) or isinstance(a, str) or a is None or b is None or isinstance(a, list):
        return a == b
    a, b = float(a), float(b)
    return a == b or math.isnan(a) and math.isnan(b) or abs(a - b) <= 1e-6 * max(1, abs(b))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_against_duckdb(spark, db, name):
    """Every query with SQL gives the rows of its SQL."""
    rows = catalog.QUERIES[name](spark, FOLDER)
    names = sorted(rows.columns)
    relation = db.sql(catalog.ORACLE_SQL[name])
    assert sorted(relation.columns) == names
    at = [relation.columns.index(c) for c in names]
    key = lambda r: tuple((x is None, f"{x:.3f}" if isinstance(x, float) else str(x)) for x in r)
    got = sorted((tuple(r) for r in rows.select(*(f"`{c}`" for c in names)).collect()), key=key)
    want = sorted((tuple(r[i] for i in at) for r in relation.fetchall()), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(map(same, a, b)), (a, b)


def test_no_limit_grows_with_the_pool(spark):
    """Pruning and ranks plan as ranges, not as a limit that holds a share of the pool."""
    for name in ("prune_score_high", "prune_stats", "discovery_rates", "uq_ence"):
        plan = catalog.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "TakeOrderedAndProject" not in plan and "CartesianProduct" not in plan
    assert "TakeOrderedAndProject" in catalog.QUERIES["acq_greedy_high"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


def test_run_aggregates_in_any_order_of_rows(spark, tmp_path):
    """Means of 32 prices that end in 5 at the seventh decimal: sums of doubles fall to either side, by the order of rows."""
    prices = {}
    for k in range(40):
        draw = random.Random(k)
        cents = [draw.randrange(90000, 10500000) for _ in range(31)]
        cents.append(draw.randrange(45000, 5000000) * 2 + 1 - sum(cents) % 2)
        prices[k] = cents
    want = {k: float((Decimal(sum(v)) / 3200).quantize(Decimal("1e-6"), ROUND_HALF_UP)) for k, v in prices.items()}
    for order in (1, -1):
        rows = [(k, 1, 1.0, c / 100) for k, v in prices.items() for c in v[::order]]
        spark.createDataFrame(rows, "l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double").coalesce(1).write.parquet(f"{tmp_path}/{order}/lineitem.parquet")
        got = catalog.QUERIES["run_aggregates"](spark, f"{tmp_path}/{order}").collect()
        for c in ("avg_metric", "best", "final_metric"):
            assert {r["run_id"]: r[c] for r in got} == want
