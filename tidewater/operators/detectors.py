"""Detectors over clips: one Arrow kernel from samples to frames or metrics, the rest as columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions import detectors as D

Kernel = Callable[[np.ndarray], dict]


def per_clip(clips: DataFrame, kernel: Kernel, fields: Sequence[tuple[str, pa.DataType, str]], key: str = "source_file", clip: str = "clip", keep: Sequence[str] = ()) -> DataFrame:
    """(key, kept columns..., fields..., error): the kernel's result for each clip; one that fails has nulls and says why. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, errors = [], []
            for x in b.column(1):
                row, error = {}, None
                if x.is_valid:
                    try:
                        row = kernel(np.asarray(x.values, float))
                    except (ValueError, ArithmeticError, np.linalg.LinAlgError) as e:
                        error = f"{type(e).__name__}: {e}"
                rows.append(row)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], *[pa.array([r.get(n) for r in rows], t) for n, t, _ in fields], pa.array(errors, pa.string())], names=[key, *keep, *[f[0] for f in fields], "error"])

    kinds = dict(clips.dtypes)
    return clips.select(key, F.col(clip).cast("array<double>"), *keep).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in (key, *keep)) + ", " + ", ".join(f"{n} {s}" for n, _, s in fields) + ", error string")


def _list(t: pa.DataType) -> pa.DataType:
    return pa.list_(t)


def rain_frames(clips: DataFrame, config: D.FrameConfig = D.FrameConfig(), confirm: bool = False, key: str = "source_file") -> DataFrame:
    """Per clip: arrays of frame times, classes, confidences and fluxes, and the confirmed drops if asked for."""

    def kernel(x: np.ndarray) -> dict:
        f = D.classify_frames(x, config)
        out = {"times": f["time"], "frame_class": f["frame_class"], "rain_conf": f["rain_conf"], "noise_conf": f["noise_conf"], "total_flux": f["total_flux"], "mode_flux": f["mode_flux"].T.tolist()}
        if confirm:
            out["confirmed"], out["drops"] = D.confirm_frames(x, f["frame_class"] == D.RAIN, config.rate, config.n_fft, config.hop)
        return out

    d = pa.float64()
    fields = [("times", _list(d), "array<double>"), ("frame_class", _list(pa.int8()), "array<tinyint>"), ("rain_conf", _list(d), "array<double>"), ("noise_conf", _list(d), "array<double>"), ("total_flux", _list(d), "array<double>"), ("mode_flux", _list(_list(d)), "array<array<double>>")]
    fields += [("confirmed", _list(pa.bool_()), "array<boolean>"), ("drops", _list(pa.int64()), "array<bigint>")]
    return per_clip(clips, kernel, fields, key)


def exploded(states: DataFrame, key: str = "source_file", every: int = 1) -> DataFrame:
    """A row per frame, or every few."""
    rows = states.select(key, F.posexplode(F.arrays_zip("times", "frame_class", "rain_conf", "noise_conf", "total_flux")).alias("frame", "x"))
    return rows.where(F.col("frame") % every == 0).select(key, "frame", "x.*")


def rain_metrics(states: DataFrame, least: int = 1, key: str = "source_file") -> DataFrame:
    """Per clip: rain frames, their share, the decision and its confidence, from the arrays alone."""
    hits = F.size(F.filter("frame_class", lambda c: c == D.RAIN))
    sure = F.array_sort(F.transform(F.filter(F.arrays_zip("frame_class", "rain_conf"), lambda z: z.frame_class == D.RAIN), lambda z: z.rain_conf))
    n = F.size(sure)
    median = F.when(n > 0, (F.get(sure, F.floor((n - 1) / 2).cast("int")) + F.get(sure, F.floor(n / 2).cast("int"))) / 2).otherwise(F.lit(0.0))
    out = states.select(key, F.size("frame_class").alias("n_frames"), hits.alias("rain_frames"), median.alias("median"))
    return out.select(key, "n_frames", "rain_frames", (F.col("rain_frames") / F.greatest("n_frames", F.lit(1))).alias("rain_share"), (F.col("rain_frames") >= least).alias("is_rain"), F.greatest("median", F.least(F.lit(1.0), F.col("rain_frames") / (2.0 * least))).alias("confidence"))


def cleaned(clips: DataFrame, config: D.FrameConfig = D.FrameConfig(), key: str = "source_file") -> DataFrame:
    """Per clip: the signal with noise suppressed, and the mean noise level and gain."""

    def kernel(x: np.ndarray) -> dict:
        g = D.suppress(D.classify_frames(x, config), len(x), config)
        return {"clean": g["clean"], "noise_db": float(10 * np.log10(g["noise"].mean() + 1e-12)), "mean_gain": float(g["gain"].mean())}

    return per_clip(clips, kernel, [("clean", _list(pa.float64()), "array<double>"), ("noise_db", pa.float64(), "double"), ("mean_gain", pa.float64(), "double")], key)


_BAND = [("energy", "double"), ("loud", "double"), ("noise", "double"), ("gain", "double"), ("clean", "double"), ("rain_subframes", "bigint"), ("jump", "boolean"), ("dry_energy", "double"), ("noise_share", "double"), ("buffered", "bigint"), ("since_update", "bigint"), ("q", "double")]


def band_noise(clips: DataFrame, config: D.BandConfig = D.BandConfig(), key: str = "source_file") -> DataFrame:
    """A row per whole frame of each clip, with the estimator's outputs."""
    arrow = {"double": pa.float64(), "bigint": pa.int64(), "boolean": pa.bool_()}
    struct = pa.struct([(n, arrow[t]) for n, t in _BAND])
    frames = per_clip(clips, lambda x: {"frames": D.band_noise(x, config)[0]}, [("frames", _list(struct), f"array<struct<{', '.join(f'{n}: {t}' for n, t in _BAND)}>>")], key)
    return frames.select(key, F.posexplode("frames").alias("frame", "x")).select(key, "frame", "x.*")


def band_noise_summary(frames: DataFrame, key: Sequence[str], warm_up: int = 10) -> DataFrame:
    """Telemetry of a clip or report interval: sums, means by count, shares, least buffer and underflows."""
    wet = F.col("rain_subframes") > 0
    return frames.groupBy(*key).agg(
        F.count("*").alias("frames"),
        F.count_if(wet).alias("rain_frames"),
        F.sum("energy").alias("total_energy"),
        F.sum("noise_share").alias("noise_energy"),
        F.sum(F.col("energy") - F.col("dry_energy")).alias("rain_energy"),
        F.min("buffered").alias("least_buffered"),
        F.count_if(F.col("buffered") < warm_up).alias("underflows"),
        F.median("gain").alias("median_gain"),
        F.median("noise").alias("median_noise"),
    ).withColumn("total_energy_mean", F.col("total_energy") / F.greatest("frames", F.lit(1))).withColumn("rain_energy_mean", F.col("rain_energy") / F.greatest("rain_frames", F.lit(1))).withColumn("noise_energy_mean", F.col("noise_energy") / F.greatest(F.col("frames") - F.col("rain_frames"), F.lit(1)))


def minute_rows(clips: DataFrame, start: str = "time", rate: int = 11162, key: str = "source_file") -> DataFrame:
    """(key, until, dsd, peaks, codes) per minute of each clip, named by the minute's right edge."""
    spread = clips.withColumn("second", F.unix_seconds(F.col(start)) % 60)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, minutes, rows = [], [], []
            for i, (x, second) in enumerate(zip(b.column(1), b.column(2).to_pylist(), strict=True)):
                if x.is_valid:
                    for m, h in enumerate(D.minute_histograms(np.asarray(x.values, float), float(second or 0), rate)[0]):
                        at.append(i)
                        minutes.append(m)
                        rows.append(h.astype(np.int64))
            own = [b.column(c).take(pa.array(at, pa.int64())) for c in (0, 3)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(minutes, pa.int64()), pa.array(rows, pa.list_(pa.int64()))], names=["k", "s", "m", "h"])

    kinds = dict(clips.dtypes)
    rows = spread.select(F.col(key).alias("k"), F.col("clip").cast("array<double>"), "second", F.col(start).alias("s")).mapInArrow(run, f"k {kinds[key]}, s {kinds[start]}, m bigint, h array<bigint>")
    edge = F.date_trunc("minute", F.col("s")) + F.make_interval(mins=(F.col("m") + 1).cast("int"))
    return rows.select(F.col("k").alias(key), edge.alias("until"), F.slice("h", 1, 32).alias("dsd"), F.slice("h", 33, 30).alias("peaks"), F.slice("h", 63, 38).alias("codes"))


def novelty_metrics(clips: DataFrame, config: D.NoveltyConfig = D.NoveltyConfig(), key: str = "source_file") -> DataFrame:
    """Per clip: drops, pulses, base frequency of the last part and the decision."""
    return per_clip(clips, lambda x: D.novelty_clip(x, config), [("drops", pa.int64(), "bigint"), ("pulses", pa.int64(), "bigint"), ("base_hz", pa.float64(), "double"), ("is_rain", pa.bool_(), "boolean")], key)


def config_name(config: object) -> str:
    from tidewater.sources.sinks import param_hash

    return param_hash(asdict(config))


# -- features -----------------------------------------------------------------------------------------

TD_FIELDS = ("time", "crest", "kurtosis", "block_crest", "block_width", "post_pre", "rise_time", "fall_time", "rise_slope", "fall_slope", "peak_level", "energy", "soft_score", "soft_label")
SPECTRAL_FIELDS = ("centroid", "bandwidth", "low_ratio", "rain_ratio", *(f"mode_ratio_{i}" for i in range(5)), "mode_entropy", "mode_std", "mode_max", "flatness", "rolloff", "dominant", "energy", *(f"cepstrum_{i}" for i in range(5)))


def _frame_rows(clips: DataFrame, names: Sequence[str], make: Kernel, key: str) -> DataFrame:
    """A row per frame from a kernel that gives one array per name."""
    d = pa.float64()
    wide = per_clip(clips, lambda x: {n: np.asarray(v, float) for n, v in make(x).items()}, [(n, _list(d), "array<double>") for n in names], key)
    return wide.select(key, F.posexplode(F.arrays_zip(*names)).alias("frame", "x")).select(key, "frame", "x.*")


def td_features(clips: DataFrame, rate: float = 11162, frame: int = 256, hop: int = 128, mode: str = "default", key: str = "source_file") -> DataFrame:
    from tidewater.functions import features

    return _frame_rows(clips, TD_FIELDS, lambda x: {k: v for k, v in features.td_features(x, rate, frame, hop, mode).items() if k in TD_FIELDS}, key)


def _power(x: np.ndarray, config: D.FrameConfig) -> tuple[np.ndarray, np.ndarray]:
    from tidewater.functions import dsp

    power = np.abs(dsp.stft(x, config.n_fft, config.hop)) ** 2
    return power, np.arange(power.shape[1]) * config.rate / config.n_fft


def spectral_features(clips: DataFrame, config: D.FrameConfig = D.FrameConfig(), key: str = "source_file") -> DataFrame:
    from tidewater.functions import features

    return _frame_rows(clips, SPECTRAL_FIELDS, lambda x: features.spectral_features(*_power(x, config), band=config.band), key)


def occupancy(clips: DataFrame, config: D.FrameConfig = D.FrameConfig(), key: str = "source_file") -> DataFrame:
    """A row per clip and band: statistics of log power and power share over rain frames and the others."""
    from tidewater.functions import features

    stats = [f"{k}_{v}_{s}" for k in ("rain", "other") for v in ("log", "share") for s in ("mean", "std", "p50", "p90", "max")]
    struct = pa.struct([("band", pa.string()), *((s, pa.float64()) for s in stats)])

    def kernel(x: np.ndarray) -> dict:
        return {"bands": features.occupancy(*_power(x, config), D.classify_frames(x, config)["frame_class"])}

    made = per_clip(clips, kernel, [("bands", _list(struct), f"array<struct<band: string, {', '.join(f'{s}: double' for s in stats)}>>")], key)
    return made.select(key, F.explode("bands").alias("x")).select(key, "x.*")


def energy_pulses(clips: DataFrame, rate: float = 11162, key: str = "source_file") -> DataFrame:
    """A row per pulse, the strongest of a clip first."""
    from tidewater.functions import features

    names = ("time_ms", "start_ms", "end_ms", "rise_ms", "decay_ms", "energy")
    struct = pa.struct([(n, pa.float64()) for n in names])
    made = per_clip(clips, lambda x: {"pulses": features.energy_pulses(x, rate)}, [("pulses", _list(struct), f"array<struct<{', '.join(f'{n}: double' for n in names)}>>")], key)
    return made.select(key, F.posexplode("pulses").alias("rank", "x")).select(key, "rank", "x.*")
