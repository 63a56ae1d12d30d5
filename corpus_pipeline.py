"""From raw documents to packed sequences: five stages, each over all that its predecessor kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir). Rows go through in a struct of all their columns, so
that extra columns of any name come out as they went in. SQL can't express the stages (a 64-bit hash that SQL lacks, a
tokenizer): tests hold them against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospectra.llm import common as C
from prospectra.llm import mixing, near, packing, queries, repeats, rules


def whole(docs: DataFrame, *names: str) -> DataFrame:
    return docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("__row"), *(docs[c] for c in names))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the likelihood ratio reject go."""
    return rules.quality_rules(whole(docs, "doc_id", "text"), queries.trusted(spark, sf_dir)).where("kept").select("__row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest doc_id."""
    return near.deduplicate(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that occur again go, wherever they do; the documents stay, n_chars follows the text."""
    out = repeats.remove_repeats(whole(docs, "text"), length=repeats.WORDS, gram=repeats.WORD_GRAM, words=True).select("__row", "text")
    new = {"text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)}
    return out.select(*(new.get(c, F.col(f"__row.`{c}`")).alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source gets its share by Poisson replication; copies are rows with the same doc_id."""
    return mixing.mix(whole(docs, "doc_id", "source"), queries.WEIGHTS, queries.REST).select("__row.*")


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens."""
    return packing.pack(docs, queries.tokenizer())


STAGES = [
    ("quality_rules", keep_quality),
    ("near_copies", drop_near_copies),
    ("repeats", drop_repeats),
    ("mixture", mix_sources),
    ("packing", pack_windows),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = C.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
