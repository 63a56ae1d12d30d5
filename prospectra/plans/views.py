"""The pools that queries work on, from the given tables, and the same as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def cand(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("target"), (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("activity"))


def pred(spark: SparkSession, d: str) -> DataFrame:
    return cand(spark, d).selectExpr("id", "target", "activity", "target * 0.8D + ((id * 7919) % 10007) * 5.0D AS prediction", "1 + ((id * 104729) % 997) / 10.0D AS uncertainty")


def master(spark: SparkSession, d: str) -> DataFrame:
    return cand(spark, d).selectExpr(
        "id", "CASE WHEN id % 10 < 2 THEN 'labeled' WHEN id % 10 = 2 THEN 'pruned' ELSE 'unlabeled' END AS status",
        "CASE WHEN id % 10 < 2 THEN id % 3 END AS labeled_cycle", "CASE WHEN id % 10 < 2 THEN id % 3 END AS selected_cycle",
        "CASE WHEN id % 10 = 2 THEN id % 3 END AS pruned_cycle", "CASE WHEN id % 10 < 2 THEN target END AS target",
    )


def selected(spark: SparkSession, d: str) -> DataFrame:
    return pred(spark, d).where("id % 10 < 2").select("id")


def runs(spark: SparkSession, d: str, mean: Callable = F.avg) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("run_id"), F.col("l_linenumber").cast("bigint").alias("cycle")).agg(mean("l_extendedprice").alias("metric"), F.sum("l_quantity").alias("cost"), F.count("*").alias("n"))


def manifest(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    s = table(spark, d, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    return s.select(F.col("s_suppkey").alias("run_id"), F.col("n_name").alias("family"), F.col("r_name").alias("design"))


def text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").selectExpr("doc_id", "lang", "source", "concat(lang, ':', source) AS scaffold", "n_chars")


SQL = {
    "cand": "SELECT o_orderkey AS id, o_totalprice AS target, CAST(o_orderpriority = '1-URGENT' AS INT) AS activity FROM orders",
    "pred": "SELECT id, target, activity, target * 0.8::DOUBLE + ((id * 7919) % 10007) * 5.0::DOUBLE AS prediction, 1 + ((id * 104729) % 997) / 10.0::DOUBLE AS uncertainty FROM cand",
    "master": "SELECT id, CASE WHEN id % 10 < 2 THEN 'labeled' WHEN id % 10 = 2 THEN 'pruned' ELSE 'unlabeled' END AS status, CASE WHEN id % 10 < 2 THEN id % 3 END AS labeled_cycle, CASE WHEN id % 10 < 2 THEN id % 3 END AS selected_cycle, CASE WHEN id % 10 = 2 THEN id % 3 END AS pruned_cycle, CASE WHEN id % 10 < 2 THEN target END AS target FROM cand",
    "selected": "SELECT id FROM cand WHERE id % 10 < 2",
    "runs": "SELECT l_suppkey AS run_id, l_linenumber::BIGINT AS cycle, avg(l_extendedprice) AS metric, sum(l_quantity) AS cost, count(*) AS n FROM lineitem GROUP BY ALL",
    "manifest": "SELECT s_suppkey AS run_id, n_name AS family, r_name AS design FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "text": "SELECT doc_id, lang, source, concat(lang, ':', source) AS scaffold, n_chars FROM documents",
}


def sql(query: str) -> str:
    """The query with the views in front of it, before its own WITH."""
    views = "WITH " + ", ".join(f"{k} AS ({v})" for k, v in SQL.items())
    return f"{views}, {query[5:]}" if query.startswith("WITH ") else f"{views} {query}"
