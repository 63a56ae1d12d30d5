"""What the operators of this subpackage share: reading, text columns, shared tables, connected components."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship  # noqa: F401

#: Rows that a table may have at most to be sent to every executor (ids and a few numbers a row).
BROADCAST_ROWS = 2_000
SPACE = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset, it becomes a temporary folder where all run in one process, and an error on a cluster."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        got = "file://" + tempfile.mkdtemp(prefix="prospectra-")
        spark.conf.set("spark.checkpoint.dir", got)
    return got


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:  # the session has ended
        return
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


#: Rows of a file of a small table.
FILE_ROWS = 50_000


def written(df: DataFrame, what: str, batch: int | None = None, rows: int | None = None) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends there, and a lost executor loses nothing.

    batch: rows that travel to a Python worker at a time, where rows are large. rows: about how many there are, where they
    are few or small, so that they go to as many files as they fill and not to one for each partition.
    Results are lazy and may read these tables at any time, so they go when the Python process ends normally.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    usual = spark.conf.get(BATCH)
    df = df if rows is None else df.coalesce(1 + rows // FILE_ROWS)
    try:
        if batch:
            spark.conf.set(BATCH, str(batch))
        df.write.option("compression", "zstd").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    finally:
        spark.conf.set(BATCH, usual)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of a task's batches that gives freed memory back to the system at its end: Python workers wait for the next task."""

    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            import ctypes

            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return task


def refuse(docs: DataFrame, *names: str) -> None:
    """Stops if the input has columns of these names: the result has its own."""
    if clash := set(names) & set(docs.columns):
        raise ValueError(f"columns of the input have names of the result: {', '.join(sorted(clash))}")


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Marks a table for broadcast if a count shows that it has no more than so many rows (BROADCAST_ROWS); else for a join
    that shuffles, whatever its bytes: so that plans, and what they cost, don't change with the size of the input."""
    most = BROADCAST_ROWS if rows is None else rows
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df.hint("merge")


#: Bits of a sieve for each key, and at most: 64 in each row of the table that is sent to every executor.
SIEVE, SIEVE_MOST = 16, 2**24


def sieved(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that may have keys of the table: all that do, and at most about one in SIEVE of the others (more where the table
    has over SIEVE_MOST / SIEVE rows). Which bits of a hash the table's keys set is sent to every executor."""
    bits = min(SIEVE_MOST, 1 << (SIEVE * table.count()).bit_length())
    at = F.pmod(F.xxhash64(*keys), F.lit(bits))
    word, bit = F.shiftright(at, 6), F.pmod(at, F.lit(64)).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    sieve = table.select(word.alias("__word"), one.alias("__bits")).groupBy("__word").agg(F.bit_or("__bits").alias("__bits"))
    return rows.join(F.broadcast(sieve), (word == F.col("__word")) & (F.getbit("__bits", bit) == 1), "left_semi")


def with_few(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Large rows (texts) joined with a table that has the keys of few of them; the others pass through no shuffle, whatever the
    table's size. The table is read four times, so it should be a written one."""
    if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), keys)
    return sieved(rows, table, keys).join(table.hint("merge"), keys)


def clean(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def spaced(text: Column) -> Column:
    """Array of the text split at each white space character (x20, x09-x0D); consecutive ones give empty strings."""
    for c in SPACE[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.split(text, " ")


def words(text: Column) -> Column:
    """Array of the words [^\\x20\\x09-\\x0D]+; empty for blank texts. Split at a single plain sign, which needs no regular expression."""
    return F.array_remove(spaced(text), "")


#: Edges from which a node's edges count as too many for one task, and such nodes at most.
HUB, HUBS = 1000, 50_000


def with_least(edges: DataFrame, low: DataFrame, n: int) -> DataFrame:
    """edges (u, v) with m of low (u, m, d: edges of u). Edges of a hub stay where they are: at most HUBS nodes have
    more than 2 * n / HUBS of n edges and their mirrored ones, and these are sent to every executor."""
    top = max(HUB, 2 * n // HUBS)
    hubs = low.where(F.col("d") > top).select("u", F.col("m").alias("hub"))
    marked = edges.join(F.broadcast(hubs), "u", "left")
    rest = marked.where("hub is null").select("u", "v").join(low.where(F.col("d") <= top).select("u", "m"), "u")
    return rest.select("u", "v", "m").unionByName(marked.where("hub is not null").select("u", "v", F.col("hub").alias("m")))


def spread(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, n: int) -> DataFrame:
    """rows joined with a table that has their keys once each and, in weight, how many of the n rows have the key. Keys of many
    rows, at most HUBS, are sent to every executor, so that their rows meet in no task."""
    top = max(HUB, n // HUBS)
    hot = table.where(F.col(weight) > top)
    usual = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(table.where(F.col(weight) <= top).hint("merge"), keys)
    return usual.unionByName(rows.join(F.broadcast(hot), keys))


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 50) -> DataFrame:
    """(id, component): for each id of an edge, the smallest id that links reach.

    Alternates large-star and small-star (Kiveris et al. 2014); each round writes a table in the shared folder.
    Nothing is collected but the count of edges that a round changed. Groups are reduced by min() and never
    gathered into an array, and the edges of a star's centre with millions of leaves meet in no task.
    """
    edges = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    now = written(edges.distinct(), "edges", rows=edges.count())
    before, n = None, now.count()
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("d"))
        large = with_least(both, low, n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d"))
        star = with_least(down, low, n).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = written(star.where("u <> v").distinct(), "edges", rows=n)
        n, total = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, total) == before:
            break
        before = (n, total)
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    return now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component").unionByName(
        now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
