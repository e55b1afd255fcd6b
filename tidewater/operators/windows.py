"""Ordered operators over the frames of a clip or device, as window expressions.

Every function takes the partition and order columns by name and gives a Column, so several of them
share one sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Names = Sequence[str]


def _ordered(key: Names, order: Names):  # noqa: ANN202
    return Window.partitionBy(*key).orderBy(*order)


def flux(value: str, key: Names, order: Names, lag: int = 2) -> Column:
    """Positive change against the value ``lag`` rows before; 0 for the first rows."""
    return F.greatest(F.col(value) - F.lag(value, lag).over(_ordered(key, order)), F.lit(0.0))


def moving_average(value: str, key: Names, order: Names, n: int) -> Column:
    return F.avg(value).over(_ordered(key, order).rowsBetween(1 - n, 0))


def causal_median(value: str, key: Names, order: Names, n: int) -> Column:
    """Median of the last n values, n made odd."""
    n += 1 - n % 2
    return F.percentile(value, 0.5).over(_ordered(key, order).rowsBetween(1 - n, 0))


def low_quantile(value: str, key: Names, order: Names, n: int, q: float) -> Column:
    return F.percentile(value, q).over(_ordered(key, order).rowsBetween(1 - n, 0))


def lowest_mean(value: str, key: Names, order: Names, around: int, share: int = 6) -> Column:
    """Mean of the lowest max(3, min(n, around / share)) of the values at most ``around`` rows away."""
    near = F.array_sort(F.collect_list(value).over(_ordered(key, order).rowsBetween(-around, around)))
    k = F.greatest(F.lit(3), F.least(F.size(near), F.lit(around // share)))
    low = F.slice(near, F.lit(1), k)
    return F.aggregate(low, F.lit(0.0), lambda a, v: a + v) / F.size(low)


def signal_to_noise(value: str, key: Names, order: Names, around: int, zero: float | None = 1.0) -> Column:
    """Value over its local mean; a local mean of 0 or less counts as a fifth of the greatest value, a value of 0 as ``zero`` if given."""
    local = lowest_mean(value, key, order, around)
    most = F.max(value).over(Window.partitionBy(*key))
    level = F.col(value) if zero is None else F.when(F.col(value) == 0, F.lit(zero)).otherwise(F.col(value))
    return level / F.when(local <= 0, most / 5).otherwise(local)


def min_neighbour(value: str, key: Names, order: Names, around: int) -> Column:
    """Least value at most ``around`` rows away, not counting the first and last row; 0 if there is none."""
    w = _ordered(key, order)
    inner = F.when((F.row_number().over(w) > 1) & F.lead(F.lit(1)).over(w).isNotNull(), F.col(value))
    return inner


def with_min_neighbour(df: DataFrame, value: str, key: Names, order: Names, around: int, name: str) -> DataFrame:
    marked = df.withColumn("__inner", min_neighbour(value, key, order, around))
    return marked.withColumn(name, F.coalesce(F.min("__inner").over(_ordered(key, order).rowsBetween(-around, around)), F.lit(0.0))).drop("__inner")


def rise_ratio(value: str, key: Names, order: Names) -> Column:
    """Value over the lesser of the two before it; 1 for the first row."""
    w = _ordered(key, order)
    before = F.least(F.lag(value, 1).over(w), F.lag(value, 2).over(w))
    return F.coalesce(F.col(value) / (before + 1e-12), F.lit(1.0))


def local_peak(value: str, key: Names, order: Names) -> Column:
    """Whether a value is above both neighbours; never for the first and last row."""
    w = _ordered(key, order)
    return F.coalesce((F.col(value) > F.lag(value).over(w)) & (F.col(value) > F.lead(value).over(w)), F.lit(False))


def capped_peaks(value: Column, is_peak: Column, threshold: float, cap: float = 1.5) -> Column:
    """Peaks above a threshold, held to ``cap`` times it; everything else 0."""
    return F.when(is_peak & (value > threshold), F.least(value, F.lit(cap * threshold))).otherwise(F.lit(0.0))


def align(df: DataFrame, spine: DataFrame, key: Names, fill: Sequence[str]) -> DataFrame:
    """A row for every row of the spine; missing features are 0."""
    return spine.join(df, list(key), "left").fillna(0.0, list(fill))


def top_k(df: DataFrame, key: Names, by: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each key by the order given; Spark keeps no more than k a key before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*by))).where(F.col("rank") <= k)
