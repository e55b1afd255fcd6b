"""Joins, set operations and upserts of keys, labels, results and states."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A side of a join is sent to every task only up to this many rows, counted first.
SENT_ROWS = 100_000


def small(df: DataFrame, rows: int = SENT_ROWS) -> DataFrame:
    """The table, marked to be sent to every task if it has few rows; else joined by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def unprocessed(keys: DataFrame, done: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys not yet done."""
    return keys.join(done.select(*on), list(on), "left_anti")


def wanted(rows: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return rows.join(keys.select(*on), list(on), "left_semi")


def first_source(sources: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """One row per key, from the first of the sources that has it."""
    ranked = None
    for k, df in enumerate(sources):
        df = df.withColumn("source_rank", F.lit(k))
        ranked = df if ranked is None else ranked.unionByName(df, allowMissingColumns=True)
    first = ranked.groupBy(*key).agg(F.min("source_rank").alias("source_rank"))
    return ranked.join(first, [*key, "source_rank"])


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Old rows without a new one, and the new rows; for tables that can't merge in place."""
    return old.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new, allowMissingColumns=True)


def interval_join(rows: DataFrame, spans: DataFrame, key: Sequence[str], at: str, start: str, end: str, bucket: str = "1 day") -> DataFrame:
    """Rows with every span of their key that holds their time, both ends included.

    Spans are listed under each time bucket that they touch, so the join is one on equal keys and buckets,
    and a key with many rows is spread over its buckets.
    """
    seconds = F.lit(_seconds(bucket))
    of = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / seconds)
    dealt = spans.withColumn("bucket_no", F.explode(F.sequence(of(start), of(end))))
    return rows.withColumn("bucket_no", of(at)).join(dealt, [*key, "bucket_no"]).where(F.col(at).between(F.col(start), F.col(end))).drop("bucket_no")


def _seconds(bucket: str) -> int:
    n, unit = bucket.split()
    return int(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]


def parameter_grid(spark, grid: Mapping[str, Sequence[object]]) -> DataFrame:  # noqa: ANN001
    """All combinations of the values of each parameter, and a hash that names the combination."""
    out = None
    for name, values in grid.items():
        one = spark.createDataFrame([(v,) for v in values], [name])
        out = one if out is None else out.crossJoin(one)
    names = sorted(grid)
    return out.withColumn("param_hash", F.sha2(F.to_json(F.struct(*[F.col(n) for n in names])), 256))


def band_table(spark, bands: Sequence[tuple[str, float, float]]) -> DataFrame:  # noqa: ANN001
    return spark.createDataFrame(list(bands), "band string, low double, high double")


def in_bands(bins: DataFrame, bands: DataFrame, hz: str = "hz", width: float = 100.0) -> DataFrame:
    """Bins with each band that holds them: low included, high not, but for the last band's.

    Bands are listed under each stretch of ``width`` that they touch, so the join is one on equal stretches,
    which Spark plans by the sizes it knows.
    """
    last = bands.agg(F.max("high").alias("last"))
    of = lambda c: F.floor(F.col(c) / width)
    dealt = bands.crossJoin(F.broadcast(last)).withColumn("stretch_no", F.explode(F.sequence(of("low"), of("high"))))  # last is one row
    inside = (F.col(hz) >= F.col("low")) & ((F.col(hz) < F.col("high")) | ((F.col("high") == F.col("last")) & (F.col(hz) == F.col("high"))))
    return bins.withColumn("stretch_no", of(hz)).join(dealt, "stretch_no").where(inside).drop("last", "stretch_no")


def latest(df: DataFrame, key: Sequence[str], by: Sequence[Column]) -> DataFrame:
    """The first row of each key by the order given."""
    name = "row_no"
    while name in df.columns:
        name += "_"
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*by))).where(F.col(name) == 1).drop(name)
