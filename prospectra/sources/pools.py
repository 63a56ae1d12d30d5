"""Readers of candidate pools and of per-cycle tables.

A pool has a string column ID and a column SMILES (the structure as text), and whatever else the file holds. Readers are
lazy and split files across tasks; IDs that a file lacks are numbered in the order of partitions (of one file: its order).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = {".csv": "csv", ".txt": "csv", ".tsv": "csv", ".sdf": "sdf", ".sd": "sdf", ".sdf.gz": "sdf", ".smi": "smi", ".smiles": "smi"}
RECORD_END = "$$$$"


def pool_format(path: str) -> str:
    """csv, sdf or smi by the extension; others raise."""
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    for ending in sorted(FORMATS, key=len, reverse=True):
        if name.endswith(ending):
            return FORMATS[ending]
    raise ValueError(f"unsupported pool format: {name}; supported are {', '.join(FORMATS)}")


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Adds a column with 0, 1, 2, ... in the order of partitions and rows; one pass counts the partitions' rows."""
    rows = df.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__at"))
    counts = rows.groupBy("__part").agg(F.count("*").alias("n")).orderBy("__part").collect()  # a row for each partition
    before, total = [], 0
    for r in counts:
        before.append((r["__part"], total))
        total += r["n"]
    start = F.broadcast(df.sparkSession.createDataFrame(before, "__part int, __before long"))
    # The lower 33 bits of the id count within the partition.
    place = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(start, "__part", "left").withColumn(name, F.col("__before") + place).drop("__part", "__at", "__before")


def standard_columns(df: DataFrame, structure: str | None = None, identifier: str | None = None, name: str | None = None) -> DataFrame:
    """Renames the columns to ID and SMILES; without an ID the name column serves, and without that compound_0, compound_1, ..."""
    if structure and structure in df.columns:
        df = df.withColumnRenamed(structure, "SMILES")
    elif "SMILES" not in df.columns:
        for other in ("smiles", "Smiles"):
            if other in df.columns:
                df = df.withColumnRenamed(other, "SMILES")
                break
    if "SMILES" not in df.columns:
        raise ValueError(f"no structure column; the columns are {', '.join(df.columns)}")
    if identifier and identifier in df.columns:
        return df.withColumnRenamed(identifier, "ID")
    if "ID" in df.columns:
        return df
    if name and name in df.columns:
        return df.withColumnRenamed(name, "ID")
    return numbered(df, "__n").withColumn("ID", F.concat(F.lit("compound_"), F.col("__n").cast("string"))).drop("__n")


def read_csv_pool(spark: SparkSession, path: str, structure: str | None = None, identifier: str | None = None, name: str | None = None, schema: str | None = None) -> DataFrame:
    """Comma-separated, with a header. A schema saves the pass that infers types."""
    reader = spark.read.option("header", True)
    raw = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return standard_columns(raw, structure, identifier, name)


def read_smi_pool(spark: SparkSession, path: str, valid: Callable[[Column], Column] | None = None) -> DataFrame:
    """Tab-separated structure and name after a header line; lines without a structure are skipped, and those that `valid` (a toolkit's test) refuses."""
    raw = spark.read.option("header", True).option("sep", "\t").csv(path)
    first, *rest = raw.columns
    out = raw.where(F.length(F.trim(F.col(f"`{first}`"))) > 0).withColumnRenamed(first, "SMILES")
    out = out.where(valid(F.col("SMILES"))) if valid else out
    if rest:
        return out.withColumnRenamed(rest[0], "ID")
    return standard_columns(out)


def read_sdf_pool(spark: SparkSession, path: str, properties: list[str] | None = None, identifier: str | None = None, convert: Callable[[Column], Column] | None = None) -> DataFrame:
    """Records up to $$$$: the molblock, its title, and the data items as columns.

    Without `properties` one pass finds the names. SMILES is that item, if the file has it, or what `convert` (a toolkit's
    function, as a pandas UDF) makes of the molblock; records that it can't convert are skipped.
    """
    raw = spark.read.option("lineSep", RECORD_END).text(path)
    block = F.regexp_replace(F.regexp_replace("value", "\r\n?", "\n"), "^\n", "")
    raw = raw.select(block.alias("__b")).where(F.length(F.trim(F.translate("__b", "\n", " "))) > 0)
    names = F.regexp_extract_all("__b", F.lit(r"(?m)^>[^\n]*<([^>\n]+)>[^\n]*\n"), F.lit(1))
    values = F.regexp_extract_all("__b", F.lit(r"(?m)^>[^\n]*<[^>\n]+>[^\n]*\n((?:[^\n]+\n?)*)"), F.lit(1))
    trimmed = F.transform(values, lambda v: F.rtrim(v, F.lit("\n")))
    # A name that a record repeats keeps its last value.
    items = F.aggregate(F.arrays_zip(names.alias("k"), trimmed.alias("v")), F.expr("map_from_arrays(cast(array() AS array<string>), cast(array() AS array<string>))"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != x["k"]), F.create_map(x["k"], x["v"])))
    rows = raw.select(F.trim(F.split_part("__b", F.lit("\n"), F.lit(1))).alias("title"), F.regexp_extract("__b", r"(?s)^(.*?M  END)", 1).alias("molblock"), items.alias("__items"))
    if properties is None:
        found = rows.select(F.explode(F.map_keys("__items")).alias("k")).distinct().orderBy("k").collect()  # names of columns
        properties = [r["k"] for r in found]
    out = rows.select("title", "molblock", *(F.try_element_at("__items", F.lit(p)).alias(p) for p in properties))
    if convert:
        out = out.withColumn("SMILES", convert(F.col("molblock"))).where("SMILES IS NOT NULL")
    if identifier and identifier in properties:
        return out.withColumnRenamed(identifier, "ID")
    if "ID" in properties:
        return out
    own = numbered(out, "__n")
    return own.withColumn("ID", F.when(F.col("title") != "", F.col("title")).otherwise(F.concat(F.lit("compound_"), F.col("__n").cast("string")))).drop("__n")


def read_pool(spark: SparkSession, path: str, structure: str | None = None, identifier: str | None = None, name: str | None = None) -> DataFrame:
    """A pool in any of the formats."""
    kind = pool_format(path)
    if kind == "csv":
        return read_csv_pool(spark, path, structure, identifier, name)
    return read_sdf_pool(spark, path, identifier=identifier) if kind == "sdf" else read_smi_pool(spark, path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """One cycle's predictions, with prediction and uncertainty as 32-bit floats."""
    out = spark.read.parquet(path)
    return out.withColumns({c: F.col(c).cast("float") for c in ("prediction", "uncertainty") if c in out.columns})


def read_cycles(spark: SparkSession, folder: str, pattern: str = "cycle_*.parquet") -> DataFrame:
    """All cycles' predictions, with the cycle taken from the file names."""
    out = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).parquet(folder)
    return out.withColumn("cycle", F.regexp_extract(F.col("_metadata.file_path"), r"cycle_(\d+)", 1).cast("int"))


def pick_ids(df: DataFrame, ids: DataFrame, columns: list[str], key: str = "ID") -> DataFrame:
    """Rows whose key is among the ids; the scan reads only the key and these columns."""
    return df.select(key, *(c for c in columns if c != key)).join(ids.select(key).distinct(), key, "left_semi")


def read_commented_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header after lines that begin with #."""
    reader = spark.read.option("header", True).option("comment", "#")
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_results(spark: SparkSession, stem: str) -> DataFrame:
    """A result table by its path without extension: Parquet if there is one, else CSV."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{stem}.parquet")
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.read.parquet(f"{stem}.parquet")
    return read_commented_csv(spark, f"{stem}.csv")
