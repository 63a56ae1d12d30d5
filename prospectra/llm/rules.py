"""Operator 7, quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Every text gives hashed features: its words and its pairs of neighbouring words, case kept. Words and pairs have buckets of
their own, so that the many rare pairs don't drown the words that they share a bucket with. Two multinomials over the buckets,
of the trusted documents and of all documents, give a log ratio for each bucket; a document's score is the mean over its
features, and a document is kept if its score reaches a fixed threshold and it doesn't fail the base rules. No Python runs on
executors. The number of buckets follows the counted distinct words (FILL of them a bucket), so that word buckets are as full
on large inputs as on small ones; pairs are rarer, and their ratios tend to 0 as their buckets fill.

Null and empty texts have no words, fail the base rules and score 0. Rows with the same key count as rows of their own. Very
long texts are read whole; their arrays must fit in a task. An empty table gives an empty result. Without trusted rows all
ratios are 0 and only base rules decide. Other columns come out as they went in; one that has the name of a result column
raises an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Least number of buckets of words, and distinct words that a bucket has at most, on average. Pairs have as many buckets.
BUCKETS = 1 << 16
FILL = 64
#: Buckets up to which their ratios are an array that goes with each task; beyond, features are joined with them.
ARRAY = 1 << 21
THRESHOLD = -0.2
#: Pseudo-count of a bucket.
SMOOTH = 3.0
#: Trusted keys that are sent to every executor at most (a number each); beyond, texts are joined with them.
KEYS = 1_000_000
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr_score", "kept")
SYMBOLS = "#*$%&|<>"


def stay() -> Column:
    """Always 0, which the optimizer can't know: filters on a result must not be pushed below the columns that hold its arrays,
    or lambdas would compute whole arrays again for each element."""
    return F.floor(F.rand(0))


def after(array: str, n: int) -> Column:
    return F.slice(array, n + 1, F.greatest(F.size(array), F.lit(1)))


def after_of(array: Column) -> Column:
    return F.slice(array, 2, F.greatest(F.size(array), F.lit(1)))


#: Bits of the place of a window in a text, beside the rest of its hash, while windows are sorted.
PLACE = 26


def hashed(docs: DataFrame, text: Column) -> DataFrame:
    """Adds __split (the text split at each white space), __h (even hashes of its words) and __p (odd ones of pairs of neighbours).

    Each array is a column of its own: inside a lambda Spark would compute it again for each element.
    """
    out = docs.withColumn("__split", C.spaced(text))
    out = out.withColumn("__h", F.transform(F.array_remove("__split", ""), lambda x: F.xxhash64(x).bitwiseAND(F.lit(-2))))
    pairs = F.zip_with("__h", after("__h", 1), lambda a, b: F.xxhash64(a, b).bitwiseOR(F.lit(1)))
    return out.withColumn("__p", F.slice(pairs, 1, F.greatest(F.size("__h") - 1, F.lit(0))))


def repeat_words(docs: DataFrame, to: str) -> DataFrame:
    """Adds the number of words that lie in a three-word window found twice or more in the text, the first one included; needs hashed()."""
    n = F.greatest(F.size("__h") - 2, F.lit(0))
    out = docs.withColumn("__win", F.slice(F.zip_with("__p", after("__h", 2), lambda p, c: F.xxhash64(p, c)), 1, n))
    # Sorted by the high bits of the hash, then place, in one number; equal windows are neighbours then.
    places = F.lit((1 << PLACE) - 1)
    packed = F.transform("__win", lambda h, i: h.bitwiseAND(F.bitwise_not(places)).bitwiseOR(i))
    out = out.withColumn("__sort", F.when(F.size(F.array_distinct("__win")) < F.size("__win"), F.sort_array(packed)))
    full = lambda x: F.get("__win", x.bitwiseAND(places).cast("int"))
    place = lambda x: x.bitwiseAND(places).cast("int")
    # Two windows that share the high bits only may stand between equal ones (-1): such texts are sorted by the whole hash.
    high = lambda a, b: a.bitwiseXOR(b).bitwiseAND(F.bitwise_not(places)) == 0
    pair = F.zip_with("__sort", after("__sort", 1), lambda a, b: F.when(full(a) == full(b), F.array(place(a), place(b))).when(high(a, b), F.array(F.lit(-1))))
    inside = lambda pairs: F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull()))))
    out = out.withColumn("__at", inside(pair))
    whole = F.sort_array(F.transform("__win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    slow = F.zip_with(whole, after_of(whole), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    at = F.when((F.get("__at", 0) < 0) | (F.size("__win") >= 1 << PLACE), inside(slow)).otherwise(F.col("__at"))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    total = F.aggregate(at, start, lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(3), p - s["last"])).alias("n")), lambda s: s["n"])
    return out.withColumn(to, F.coalesce(total, F.lit(0)).cast("long") + stay()).drop("__win", "__sort", "__at")


def base_rules(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed; needs hashed()."""
    t = C.clean(text)
    out = docs.withColumn("__l", F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(C.SPACE))) > 0))
    p = lambda x: f"{prefix}{x}"
    out = out.withColumns({
        p("n_words"): F.size("__h").cast("long"),
        p("word_chars"): (F.length(t) - F.size("__split") + 1).cast("long"),
        p("n_symbols"): (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        p("n_dup_lines"): (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
    })
    out = repeat_words(out, p("n_repeat_words"))
    return out.withColumn(p("base_failed"), (F.col(p("n_words")) < 50) | (100 * F.col(p("n_repeat_words")) > 50 * F.col(p("n_words")))).drop("__l")


def bucket(h: Column, buckets: int) -> Column:
    """The low bits of a feature's hash: even buckets are those of words, odd ones those of pairs. buckets, of each kind, must be a power of two."""
    if buckets & (buckets - 1):
        raise ValueError("buckets must be a power of two")
    return h.bitwiseAND(F.lit(2 * buckets - 1)).cast("int")


#: One in so many hashes is counted to tell how many words there are.
SHARE = 64


def fitting(docs: DataFrame, text: str = "text") -> int:
    """The least power of two, BUCKETS or more, that leaves a bucket FILL distinct words or fewer.

    Distinct words are counted among those of a part of the hashes, over all texts (by a count that errs by about 2 %).
    """
    some = hashed(docs.select(C.clean(text).alias("__t")), F.col("__t")).select(F.explode(F.filter("__h", lambda h: h.bitwiseAND(F.lit(2 * SHARE - 1)) == 0)).alias("h"))
    n = SHARE * some.agg(F.approx_count_distinct("h", 0.02)).first()[0]
    out = BUCKETS
    while out * FILL < n:
        out *= 2
    return out


def ratios(docs: DataFrame, trusted: DataFrame, text: str = "text", key: str = "doc_id", buckets: int = BUCKETS) -> DataFrame:
    """(b, ratio): for each bucket with features log(p(bucket | trusted) / p(bucket | all)), from counts over all rows."""
    ids = trusted.select(F.col(key).alias("__key")).where("__key is not null").distinct()
    flagged = docs.select(F.col(key).alias("__key"), C.clean(text).alias("__t")).join(C.small(ids.withColumn("__good", F.lit(1)), KEYS), "__key", "left")
    grams = hashed(flagged, F.col("__t")).select("__good", F.explode(F.concat("__h", "__p")).alias("h"))
    counts = C.written(grams.groupBy(bucket(F.col("h"), buckets).alias("b")).agg(F.count("*").alias("raw"), F.count("__good").alias("good")), "buckets", rows=2 * buckets)
    raw, good = counts.agg(F.sum("raw"), F.sum("good")).first()
    # Both counts are drawn towards the share of trusted words by the same pseudo-count, so that what is rare says little.
    log = F.log((F.col("good") + SMOOTH) / (F.col("raw") * ((good or 0) / (raw or 1)) + SMOOTH))
    return counts.select("b", (log if good else F.lit(0.0)).cast("float").alias("ratio"))


def with_array(out: DataFrame, table: DataFrame, buckets: int) -> DataFrame:
    """Adds llr_score, ratios being an array from a subquery; needs hashed()."""
    got = table.toArrow()
    every = np.zeros(2 * buckets, np.float32)
    every[got["b"].to_numpy()] = got["ratio"].to_numpy()
    lists = pa.ListArray.from_arrays(pa.array([0, 2 * buckets], pa.int32()), pa.array(every))
    # One use of the subquery only: the optimizer then moves it into the lambda, and the array is in no row.
    out = out.withColumn("__all", F.concat("__h", "__p"))
    out = out.withColumn("__table", out.sparkSession.createDataFrame(pa.table({"ratio": lists})).coalesce(1).scalar())
    total = F.aggregate("__all", F.lit(0.0), lambda s, h: s + F.get("__table", bucket(h, buckets)))
    return out.withColumn("llr_score", total / F.greatest(F.size("__all"), F.lit(1)) + stay()).drop("__all", "__table")


def with_join(out: DataFrame, table: DataFrame, text: str, buckets: int) -> DataFrame:
    """The same by joins, for any number of buckets; rows are written first, so that their numbers hold."""
    out = C.written(out.drop("__split", "__h", "__p").withColumn("__row", F.monotonically_increasing_id()), "rows")
    each = hashed(out.select("__row", C.clean(text).alias("__t")), F.col("__t")).select("__row", F.explode(F.concat("__h", "__p")).alias("h")).select("__row", bucket(F.col("h"), buckets).alias("b"))
    each = each.groupBy("__row", "b").agg(F.count("*").alias("n")).join(table, "b")
    means = each.groupBy("__row").agg((F.sum(F.col("n") * F.col("ratio")) / F.sum("n")).alias("llr_score"))
    return out.join(means, "__row", "left").withColumn("llr_score", F.coalesce("llr_score", F.lit(0.0))).drop("__row")


def quality_rules(docs: DataFrame, trusted: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD, buckets: int | None = None) -> DataFrame:
    """All columns of docs with the base rules' columns, llr_score and kept. trusted: has the keys of trusted documents. buckets: a power of two, or as many as fit the features."""
    C.refuse(docs, *RESULTS)
    buckets = buckets or fitting(docs, text)
    table = ratios(docs, trusted, text, key, buckets)
    out = base_rules(hashed(docs, C.clean(text)), text)
    out = with_array(out, table, buckets) if buckets <= ARRAY else with_join(out, table, text, buckets)
    return out.drop("__split", "__h", "__p").withColumn("kept", ~F.col("base_failed") & (F.col("llr_score") >= threshold))
