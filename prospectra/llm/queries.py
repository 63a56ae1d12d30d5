"""The queries op1 to op10 over whole tables, and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import language, licences, mixing, near, packing, pages, quality, repeats, rules, vectors

#: Shares of sources; the others have the rest together.
WEIGHTS = {"src0": 0.2, "src1": 0.1, "src2": 0.1}
REST = 0.6


def remainder(key: str = "doc_id") -> Column:
    """crc32 of the key as text, modulo 5; null keys as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(5))


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(C.read(spark, sf_dir, "documents"), WEIGHTS, REST)


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(C.read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, C.read(spark, sf_dir, "labels").where(remainder() != 0))
    return quality.classify(docs, model).select("doc_id", (remainder() == 0).alias("held_out"), "score", "predicted")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language.score(C.read(spark, sf_dir, "documents").select("doc_id", "text"), remainder() != 1)
    return out.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(C.read(spark, sf_dir, "documents"), tokenizer())


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_scan(C.read(spark, sf_dir, "documents"))


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.quality_rules(C.read(spark, sf_dir, "documents").select("doc_id", "text"), trusted(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr_score")


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.jaccard_join(C.read(spark, sf_dir, "documents"))


def op9_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(C.read(spark, sf_dir, "pages"))


def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_dedup(C.read(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_mixture, op2_repeats, op3_quality, op4_language, op5_packing, op6_licences, op7_rules, op8_jaccard, op9_pages, op10_vectors)}


def mixture_sql() -> str:
    named = ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in WEIGHTS.items())
    return f"""
WITH named(s, w) AS (VALUES {named}),
stats AS (SELECT coalesce(source, '') AS s, count(*) AS n FROM documents GROUP BY 1),
joined AS (SELECT stats.s, n, w FROM stats LEFT JOIN named ON stats.s = named.s),
whole AS (SELECT sum(n) AS total, coalesce(sum(n) FILTER (w IS NULL), 0) AS others, coalesce(sum(w), 0) AS weight FROM joined),
means AS (SELECT s, (coalesce(w, {REST} * n / greatest(others, 1)) / (weight + CASE WHEN others > 0 THEN {REST} ELSE 0 END)) * total / n AS mean FROM joined, whole),
pmf AS (SELECT s, k, exp(k * ln(mean) - mean - lgamma(k + 1)) AS p FROM means, range(0, 200) r(k) WHERE mean > 0),
cdf AS (SELECT s, k, sum(p) OVER (PARTITION BY s ORDER BY k) AS c FROM pmf),
u AS (SELECT *, ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents),
ns AS (SELECT doc_id, any_value(u.u) AS u0, count(*) AS k FROM u JOIN cdf ON cdf.s = coalesce(u.source, '') AND cdf.c <= u.u GROUP BY doc_id)
SELECT d.*, copy, md5(concat_ws(':', '{mixing.SEED}', coalesce(d.doc_id::VARCHAR, ''), copy::VARCHAR)) AS mix_key
FROM documents d JOIN ns ON d.doc_id = ns.doc_id, LATERAL (SELECT unnest(range(0, ns.k)) AS copy)"""


ORACLE_SQL = {"op1_mixture": mixture_sql(), "op6_licences": licences.licence_sql()}
