"""The stateful operators on streams: the same folds with kept state, and telemetry by event time."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewater.functions import detectors as D


class QuantileBaseline(StatefulProcessor):
    """The causal quantile tracker of each device, over rows (key, ts, value) in any number of batches.

    Rows of a batch are put in order; those older than the last one done are late, and are counted but not used.
    """

    def __init__(self, q: float = 0.2, window: int = 30, floor: float = 1.0):
        self.q, self.window, self.floor = q, max(3, window), floor

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("tracker", "baseline double, scale double, last timestamp, late long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        b, s, last, late = self.state.get() if self.state.exists() else (None, None, None, 0)
        eta = min(max(2 / (self.window + 1), 1e-4), 1.0)
        alpha = min(max(1 - eta, 0.0), 0.9999)
        out = []
        for ts, event, x in zip(pdf["ts"], pdf["event_id"], pdf["value"], strict=True):
            if last is not None and ts < pd.Timestamp(last):
                late += 1
                continue
            if b is None:
                b, s = max(x, self.floor), max(abs(x), self.floor)
            out.append((key[0], event, b))
            s = alpha * s + (1 - alpha) * abs(x - b)
            step = eta * max(s, self.floor)
            b = max(b + (self.q * step if x >= b else -(1 - self.q) * step), self.floor)
            last = ts
        if last is not None:
            self.state.update((float(b), float(s), pd.Timestamp(last).to_pydatetime(), int(late)))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "baseline"])

    def close(self) -> None:
        pass


class BandNoise(StatefulProcessor):
    """The band noise estimator of each device, over rows (key, frame_no, samples) of whole frames."""

    def __init__(self, config: D.BandConfig = D.BandConfig()):
        self.config = config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("estimator", "state string, next long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("frame_no")
        state, following = D.BandState(), 0
        if self.state.exists():
            text, following = self.state.get()
            kept = json.loads(text)
            kept["buffer"] = [tuple(x) for x in kept["buffer"]]
            kept["before_db"] = tuple(kept["before_db"]) if kept["before_db"] else None
            state = D.BandState(**kept)
        out = []
        for number, samples in zip(pdf["frame_no"], pdf["samples"], strict=True):
            if number < following:
                continue
            made, state = D.band_noise_frame(samples, state, self.config)
            out.append((key[0], int(number), made["energy"], made["noise"], made["gain"]))
            following = int(number) + 1
        self.state.update((json.dumps(asdict(state)), following))
        yield pd.DataFrame(out, columns=["device", "frame_no", "energy", "noise", "gain"])

    def close(self) -> None:
        pass


def baseline_stream(frames: DataFrame, processor: QuantileBaseline | None = None, key: str = "user_id") -> DataFrame:
    return frames.groupBy(key).transformWithStateInPandas(processor or QuantileBaseline(), "user_id long, event_id long, baseline double", "Append", "none")


def band_noise_stream(frames: DataFrame, processor: BandNoise | None = None) -> DataFrame:
    return frames.groupBy("device").transformWithStateInPandas(processor or BandNoise(), "device string, frame_no long, energy double, noise double, gain double", "Append", "none")


def telemetry(frames: DataFrame, every: str = "1 minute", late: str = "10 minutes", key: str = "user_id") -> DataFrame:
    """Counts and sums per device and interval, read once when the watermark has passed; works on tables too."""
    rows = frames.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return rows.groupBy(key, F.window("at", every).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("most")).select(key, F.col("w.end").alias("until"), "n", "total", "most")
