"""Minute histograms of drop energies, event-time windows and energy codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.columns import DROP_BINS, drop_bin


def minute(at: Column) -> Column:
    return F.date_trunc("minute", at)


def drop_histogram(frames: DataFrame, key: Sequence[str], at: str, energy: str, every: str = "minute") -> DataFrame:
    """Counts per key, interval (named by its right edge) and bin; counts are summed before the shuffle."""
    edge = F.date_trunc(every, F.col(at)) + F.expr(f"INTERVAL 1 {every}")
    return frames.withColumn("bin", drop_bin(energy)).where("bin IS NOT NULL").groupBy(*key, edge.alias("until"), "bin").agg(F.count("*").alias("n"))


def wide_histogram(counts: DataFrame, key: Sequence[str], bins: int = DROP_BINS) -> DataFrame:
    """One array of all bins per group, zeros where nothing fell."""
    return counts.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m")).select(*key, F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.coalesce(F.col("m")[k], F.lit(0))).alias("histogram"))


def mode_of_slots(rows: DataFrame, key: Sequence[str], slot: Column, value: str) -> DataFrame:
    """The most frequent value of each slot, the least of equal ones."""
    counts = rows.groupBy(*key, slot.alias("slot"), value).agg(F.count("*").alias("n"))
    best = F.max(F.struct(F.col("n"), (-F.col(value)).alias("back")))
    return counts.groupBy(*key, "slot").agg(best.alias("b")).select(*key, "slot", (-F.col("b.back")).alias(value), F.col("b.n").alias("n"))


def nonzero_frequencies(rows: DataFrame, value: str) -> DataFrame:
    """How often each value other than 0 occurs."""
    return rows.where(F.col(value) != 0).groupBy(value).agg(F.count("*").alias("n"))


def nonzero_mean(value: str) -> Column:
    return F.coalesce(F.avg(F.expr(f"nullif({value}, 0)")), F.lit(0.0))


def top_modes_mean(rows: DataFrame, key: Sequence[str], value: str, k: int = 3) -> DataFrame:
    """Mean of the k most frequent values other than 0, weighed by their counts; of equal counts the least value first."""
    counts = rows.where(F.col(value) != 0).groupBy(*key, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*key).orderBy(F.desc("n"), value)
    top = counts.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    return top.groupBy(*key).agg((F.sum(F.col(value) * F.col("n")) / F.sum("n")).alias("mean"))


def width_histogram(rows: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts in equal bins; values outside fall in bins 0 and bins + 1."""
    return rows.groupBy(F.width_bucket(value, F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))


def occupancy(bins: DataFrame, key: Sequence[str], value: str, hit: str) -> DataFrame:
    """Mean, spread, median, 90th percentile and greatest value by group and class; 0 for a class without rows."""
    out = []
    for name, when in (("rain", F.col(hit)), ("other", ~F.col(hit))):
        x = F.when(when, F.col(value))
        for stat, f in (("mean", F.avg), ("std", F.stddev_pop), ("p50", lambda c: F.percentile(c, 0.5)), ("p90", lambda c: F.percentile(c, 0.9)), ("max", F.max)):
            out.append(F.coalesce(f(x), F.lit(0.0)).alias(f"{name}_{stat}"))
    return bins.groupBy(*key).agg(*out)
