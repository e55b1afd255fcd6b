"""Recordings as rows: the device's binary container, WAV files and raw samples."""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import columns as C
from tidewater.functions import dsp

# The container's header, little-endian, 40 bytes.
MAGIC = b"\xad\xfb\xca\xde"
HEADER = struct.Struct("<4sIIBBBBfff10s2s")
DEFAULT_RATE, DEFAULT_DEPTH = 11162, 16

SCHEMA = (
    "source_file string, device_id string, time timestamp, latitude double, longitude double, altitude double, sample_rate int, channels int, "
    "bit_depth int, endianness int, version int, format string, duration double, signal array<smallint>, error string"
)
_FIELDS = [f.strip().split(" ")[0] for f in SCHEMA.split(",")]

Decoder = Callable[[bytes], np.ndarray]


def pack_header(time: int, rate: int, channels: int = 1, depth: int = 16, big: bool = False, version: int = 0, place: tuple[float, float, float] = (0.0, 0.0, 0.0), device: str = "") -> bytes:
    return HEADER.pack(MAGIC, time, rate, channels, depth, int(big), version, *place, device.encode()[:10], b"\0\0")


def decode(path: str, content: bytes, compressed: Decoder | None = None) -> dict:
    """One file as a row; what can't be decoded has a null signal and says why in ``error``.

    Bytes without the container's mark are raw 16-bit samples. A bit depth of 0 means 16, a partial last
    sample is dropped. Compressed payloads need a decoder, which takes their bytes and gives samples.
    """
    row = dict.fromkeys(_FIELDS) | {"source_file": path, "sample_rate": DEFAULT_RATE, "channels": 1, "bit_depth": DEFAULT_DEPTH, "endianness": 0, "version": 0, "format": "pcm"}
    try:
        if path.lower().endswith(".wav"):
            with wave.open(io.BytesIO(content)) as f:
                if f.getsampwidth() != 2:
                    raise ValueError(f"samples of {8 * f.getsampwidth()} bits")
                row |= {"sample_rate": f.getframerate(), "channels": f.getnchannels(), "format": "wav"}
                signal = np.frombuffer(f.readframes(f.getnframes()), "<i2")
        else:
            payload = content
            if content[:4] == MAGIC and len(content) >= HEADER.size:
                _, time, rate, channels, depth, end, version, lat, long, alt, device, _ = HEADER.unpack_from(content)
                payload = content[HEADER.size :]
                row |= {"time": datetime.fromtimestamp(time, timezone.utc), "sample_rate": rate, "channels": channels, "bit_depth": depth or 16, "endianness": end, "version": version}
                row |= {"latitude": lat, "longitude": long, "altitude": alt, "device_id": device.split(b"\0")[0].decode(errors="replace"), "format": "alac" if version else "pcm"}
            if row["version"]:
                if compressed is None:
                    raise ValueError("a compressed payload, and no decoder")
                signal = compressed(payload)
            elif row["bit_depth"] != 16:
                raise ValueError(f"samples of {row['bit_depth']} bits")
            else:
                signal = np.frombuffer(payload[: len(payload) // 2 * 2], ">i2" if row["endianness"] else "<i2")
        row["signal"] = signal.astype(np.int16)
        row["duration"] = round(len(signal) / max(1, row["channels"]) / max(1, row["sample_rate"]), 2)
    except (ValueError, wave.Error, EOFError, struct.error) as e:
        row["error"] = f"{type(e).__name__}: {e}"
    return row


_TYPES = [pa.string(), pa.string(), pa.timestamp("us", "UTC"), *[pa.float64()] * 3, *[pa.int32()] * 5, pa.string(), pa.float64(), pa.list_(pa.int16()), pa.string()]


def read_recordings(spark: SparkSession, path: str, glob: str = "*.{bin,wav}", compressed: Decoder | None = None) -> DataFrame:
    """Every recording under a path, one row each (see SCHEMA); no shuffle, one file in memory at a time."""
    return decoded(_files(spark, path, glob), compressed)


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)


def decoded(files: DataFrame, compressed: Decoder | None = None) -> DataFrame:
    """Recordings of a table of (path, content), wherever the contents come from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                row = decode(name, content.as_py(), compressed)
                yield pa.RecordBatch.from_arrays([pa.array([row[k]], t) for k, t in zip(_FIELDS, _TYPES, strict=True)], names=_FIELDS)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def headers(spark: SparkSession, path: str, glob: str = "*.bin") -> DataFrame:
    """Header fields alone: the first bytes of each file go to Python, and the duration follows from its length."""
    files = _files(spark, path, glob).select("path", F.substring("content", 1, HEADER.size).alias("content"), F.length("content").alias("bytes"))
    rows = decoded(files.select("path", "content"), lambda _: np.empty(0, np.int16)).drop("signal", "error", "duration")
    size = files.select(F.col("path").alias("source_file"), "bytes")
    return rows.join(size, "source_file").withColumn("duration", _duration("bytes")).drop("bytes")


def _duration(size: str) -> F.Column:
    """Seconds of an uncompressed file of so many bytes, to two digits; null for compressed ones."""
    samples = F.floor((F.col(size) - F.when(F.col("time").isNotNull(), HEADER.size).otherwise(0)) / 2)
    return F.when(F.col("version") == 0, F.bround(samples / F.greatest("channels", F.lit(1)) / F.greatest("sample_rate", F.lit(1)), 2))


def to_clips(recordings: DataFrame, rate: int = DEFAULT_RATE, seconds: float = 10.0, scale: float = C.PCM_SCALE) -> DataFrame:
    """(source_file, clip): float samples, channels averaged, resampled, cut to one length.

    Recordings that are too short or could not be decoded stay, with a null clip and the reason in error.
    """
    n = int(rate * seconds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, clips, errors = [], [], []
            for name, own, channels, signal, error in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                clip = None
                if signal is not None and error is None:
                    x = np.asarray(signal, float) / scale
                    if (channels or 1) > 1:
                        x = x[: len(x) // channels * channels].reshape(-1, channels).mean(axis=1)
                    x = np.clip(dsp.resample(x, own or rate, rate), -1, 1)
                    clip, error = (x[:n], None) if len(x) >= n else (None, f"{len(x)} samples, {n} wanted")
                names.append(name)
                clips.append(clip)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(clips, pa.list_(pa.float64())), pa.array(errors, pa.string())], names=["source_file", "clip", "error"])

    return recordings.select("source_file", "sample_rate", "channels", "signal", "error").mapInArrow(run, "source_file string, clip array<double>, error string")


def write_wav(path: str, signal: np.ndarray, rate: int = DEFAULT_RATE) -> None:
    with wave.open(path, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(np.asarray(signal, "<i2").tobytes())


def with_key_fields(df: DataFrame, key: str = "source_file") -> DataFrame:
    """Device, location and time from object keys of either layout."""
    return df.withColumn("device_id", C.key_device(key)).withColumn("location", C.key_location(key)).withColumn("time", C.key_time(key))


def device_keys(keys: DataFrame, device: str, start: str, end: str) -> DataFrame:
    """Keys of a device from start to end, both included; of equal times the last key stays."""
    w = keys.transform(with_key_fields).where((F.col("device_id") == device) & F.col("time").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    return w.groupBy("device_id", "time").agg(F.max("source_file").alias("source_file"))
