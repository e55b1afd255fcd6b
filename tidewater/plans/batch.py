"""From keys to results: a chain of processors over clips, label evaluation, grid search, incremental histograms."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import detectors as D
from tidewater.functions.columns import weighted_sum
from tidewater.operators import evaluation, relational
from tidewater.operators.detectors import minute_rows, per_clip

Run = Callable[[np.ndarray, Mapping[str, float]], Mapping[str, float]]


@dataclass(frozen=True)
class Processor:
    """A named step: samples and parameters to metrics. Keys that start with set_ change parameters of later steps."""

    name: str
    run: Run
    metrics: tuple[str, ...]


_last: tuple[np.ndarray, D.FrameConfig, dict[str, np.ndarray]] | None = None


def _frames(x: np.ndarray, config: D.FrameConfig) -> dict[str, np.ndarray]:
    """The frames of the clip at hand, classified once for all processors of one configuration."""
    global _last
    if _last is None or _last[0] is not x or _last[1] != config:
        _last = (x, config, D.classify_frames(x, config))
    return _last[2]


def rain_processor(config: D.FrameConfig = D.FrameConfig()) -> Processor:
    def run(x: np.ndarray, params: Mapping[str, float]) -> dict[str, float]:
        s = D.clip_summary(_frames(x, config), int(params.get("least_frames", config.least_frames)))
        return {"rain_drops": s["rain_frames"], "rain_share": s["rain_share"], "confidence": s["confidence"]}

    return Processor("rain", run, ("rain_drops", "rain_share", "confidence"))


def noise_processor(config: D.FrameConfig = D.FrameConfig()) -> Processor:
    def run(x: np.ndarray, params: Mapping[str, float]) -> dict[str, float]:
        frames = _frames(x, config)
        noise = 10 * np.log10(D.suppress(frames, len(x), config)["noise"].mean(axis=1) + 1e-12)
        return {"floor_mean_db": float(noise.mean()), "floor_median_db": float(np.median(noise)), "rain_share": float((frames["frame_class"] == D.RAIN).mean())}

    return Processor("noise", run, ("floor_mean_db", "floor_median_db", "rain_share"))


def novelty_processor(config: D.NoveltyConfig = D.NoveltyConfig()) -> Processor:
    def run(x: np.ndarray, params: Mapping[str, float]) -> dict[str, float]:
        return {k: float(v) for k, v in D.novelty_clip(x, config).items()}

    return Processor("novelty", run, ("drops", "pulses", "base_hz", "is_rain"))


def process(clips: DataFrame, processors: Sequence[Processor], params: Mapping[str, float] | None = None, threshold: float = 0, decides: str = "rain__rain_drops", key: str = "source_file") -> DataFrame:
    """All processors over every clip in one task, and prediction and mismatch against ``raining``.

    clips: key, clip and, if known, raining and error. Metrics are named <processor>__<metric>. Clips that
    could not be loaded or processed stay, with nulls and the reason. Labels pass through the task beside their
    clip, so nothing is shuffled, and rows of equal key stay apart.
    """
    if len({p.name for p in processors}) != len(processors):
        raise ValueError("processors need names of their own")
    base = dict(params or {})

    def kernel(x: np.ndarray) -> dict:
        out, now = {}, dict(base)
        for p in processors:
            found = p.run(x, now)
            now |= {k[4:]: v for k, v in found.items() if k.startswith("set_")}
            out |= {f"{p.name}__{m}": float(found[m]) for m in p.metrics}
        return out

    names = [f"{p.name}__{m}" for p in processors for m in p.metrics]
    source = clips.withColumnRenamed("error", "load_error") if "error" in clips.columns else clips
    keep = [c for c in ("raining", "load_error") if c in source.columns]
    made = per_clip(source, kernel, [(n, pa.float64(), "double") for n in names], key, keep=keep)
    if "load_error" in keep:
        made = made.withColumn("error", F.coalesce("load_error", "error")).drop("load_error")
    if "raining" in keep and decides in names:
        made = made.withColumn("predicted", F.col(decides) > threshold).withColumn("mismatch", F.col("predicted") != F.col("raining"))
    return made


def grid_search(spark: SparkSession, clips: DataFrame, grid: Mapping[str, Sequence[object]], classify: Callable[[np.ndarray, Mapping[str, object]], bool | None], done: DataFrame | None = None, key: str = "source_file") -> DataFrame:
    """Outcome counts, rates and parameters of every combination not yet done.

    Combinations are few; each clip is read once and tried with all of them in its own task, and only the
    decisions are shuffled.
    """
    points = relational.parameter_grid(spark, grid)
    if done is not None:
        points = relational.unprocessed(points, done, ["param_hash"])
    rows = [r.asDict() for r in points.collect()]
    if not rows:
        return points.limit(0)

    def kernel(x: np.ndarray) -> dict:
        return {"decisions": [classify(x, {k: v for k, v in r.items() if k != "param_hash"}) for r in rows]}

    made = per_clip(clips, kernel, [("decisions", pa.list_(pa.bool_()), "array<boolean>")], key, keep=["raining"])
    made = made.select(key, "raining", F.posexplode("decisions").alias("point", "predicted"))
    scored = evaluation.confusion(made, "raining", "predicted", ["point"])
    names = spark.createDataFrame([(i, *[r[k] for k in points.columns]) for i, r in enumerate(rows)], ["point", *points.columns])
    return scored.join(relational.small(names), "point").drop("point")


def incremental_histograms(existing: DataFrame, clips: DataFrame, key: str = "source_file") -> DataFrame:
    """Minute histograms of the clips that have none yet, with their weighted sum, beside the existing ones."""
    new = minute_rows(relational.unprocessed(clips, existing, [key]), key=key)
    new = new.withColumn("weighted_dsd_sum", F.round(weighted_sum("dsd"), 6))
    return existing.unionByName(new.select(*existing.columns))
