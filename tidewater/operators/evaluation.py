"""Predictions against labels: clip metrics, confusion counts, rates and lists of errors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clip_metrics(frames: DataFrame, key: Sequence[str], hit: Column, confidence: Column, least: int) -> DataFrame:
    """Per clip: frames, hits, their share, the decision and its confidence.

    A clip is positive with ``least`` hits; its confidence is the greater of the median confidence of the
    hits and hits / (2 * least) held in [0, 1].
    """
    out = frames.groupBy(*key).agg(F.count("*").alias("n_frames"), F.count_if(hit).alias("n_hits"), F.percentile(F.when(hit, confidence), 0.5).alias("hit_confidence"))
    reach = F.least(F.col("n_hits") / F.lit(2.0 * least), F.lit(1.0))
    return out.withColumn("hit_share", F.col("n_hits") / F.col("n_frames")).withColumn("is_positive", F.col("n_hits") >= least).withColumn("confidence", F.greatest(F.coalesce("hit_confidence", F.lit(0.0)), reach)).drop("hit_confidence")


def confusion(rows: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts of each outcome, accuracy and rates. Rows without a prediction are not errors, and are counted as such too."""
    a, p = F.col(actual), F.col(predicted)
    out = rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(a & p).alias("tp"),
        F.count_if(~a & ~p).alias("tn"),
        F.count_if(~a & p).alias("fp"),
        F.count_if(a & ~p).alias("fn"),
        F.count_if(p.isNull()).alias("unclassified"),
    )
    return (
        out.withColumn("accuracy", 1 - (F.col("fp") + F.col("fn")) / F.col("n"))
        .withColumn("tpr", F.expr("try_divide(tp, tp + fn)"))
        .withColumn("tnr", F.expr("try_divide(tn, tn + fp)"))
    )


def outcomes(rows: DataFrame, uid: str, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """The uids of each outcome, in order; for result files of bounded groups."""
    a, p = F.col(actual), F.col(predicted)
    ids = lambda when: F.array_sort(F.collect_list(F.when(when, F.col(uid))))
    return rows.groupBy(*by).agg(ids(a & p).alias("tp_ids"), ids(~a & ~p).alias("tn_ids"), ids(~a & p).alias("fp_ids"), ids(a & ~p).alias("fn_ids"))


def errors(rows: DataFrame, actual: str, predicted: str, kind: str) -> DataFrame:
    """False negatives ('fn') or false positives ('fp')."""
    a, p = F.col(actual), F.col(predicted)
    return rows.where(a & ~p if kind == "fn" else ~a & p)


def tri_state(drops: str, threshold: float = 0) -> Column:
    """True above the threshold, false from 0 to it, null below 0."""
    return F.when(F.col(drops) > threshold, F.lit(True)).when(F.col(drops) >= 0, F.lit(False))


def combined_decision(positive: str, drops: str, peaks: str, drops_low: int = 3, drops_high: int = 50, peaks_low: int = 9, peaks_high: int = 30) -> Column:
    """A negative clip with many drops or peaks turns positive; a positive one with few turns negative."""
    p, d, k = F.col(positive), F.col(drops), F.col(peaks)
    return F.when(~p & ((d > drops_high) | (k > peaks_high)), F.lit(True)).when(p & ((k < peaks_low) | (d < drops_low)), F.lit(False)).otherwise(p)


def with_states(results: DataFrame, states: DataFrame, key: str, threshold: int) -> DataFrame:
    """Results with their detector state; a missing prediction is drops > threshold, missing features are NaN."""
    joined = results.join(states, key, "left")
    features = [f.name for f in states.schema.fields if f.name != key and f.dataType.typeName() in ("double", "float")]
    return joined.withColumn("predicted", F.coalesce("predicted", F.col("drops") > threshold)).withColumns({f: F.coalesce(F.col(f), F.lit(float("nan"))) for f in features})
