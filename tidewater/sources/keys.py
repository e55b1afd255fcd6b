"""Lists of recordings and their labels, from folders, tables, databases and files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import columns as C


def from_folder(spark: SparkSession, path: str, default: bool | None = None, glob: str = "*.{bin,wav}") -> DataFrame:
    """(source_file, raining) of the files under a path; the label is in their names. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select(F.col("path").alias("source_file"), C.label_from_path("path", default).alias("raining"))


def from_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("source_file string, raining boolean").csv(path, header=True).where("source_file IS NOT NULL")


def from_query(spark: SparkSession, sql: str, jdbc: dict[str, str] | None = None) -> DataFrame:
    """A query's rows, from the session's tables or a database; in time order if there is a time."""
    df = spark.read.format("jdbc").options(**jdbc, query=sql).load() if jdbc else spark.sql(sql)
    return df.orderBy("time") if "time" in df.columns else df


def from_list(spark: SparkSession, keys: Sequence[str], labels: DataFrame | None = None) -> DataFrame:
    """Keys with their labels; without labels raining is null, and keys that have none are left out."""
    df = spark.createDataFrame([(k,) for k in keys], "source_file string")
    return df.join(labels.select("source_file", "raining"), "source_file") if labels is not None else df.withColumn("raining", F.lit(None).cast("boolean"))


def discover(spark: SparkSession, kind: str, most: int | None = None, **options) -> DataFrame:  # noqa: ANN003
    """Keys by kind of input (folder, csv, query, list); the first ``most`` by name."""
    makers = {"folder": from_folder, "csv": from_csv, "query": from_query, "list": from_list}
    if kind not in makers:
        raise ValueError(f"unknown input {kind!r}; one of {', '.join(makers)}")
    if most is not None and most < 0:
        raise ValueError("the number of files can't be negative")
    df = makers[kind](spark, **options)
    return df if most is None else df.orderBy("source_file").limit(most)
