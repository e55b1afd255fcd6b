"""Column expressions: scalar conversions, predicates and array features that stay in generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Name = str | Column

# Scales, thresholds and bins that results depend on.
PCM_SCALE = 32767.0
PCM_SCALE_POWER_OF_TWO = 32768.0
DROP_BASE, DROP_STEP, DROP_THRESHOLD, DROP_BINS = 1.13, 0.6, 0.6, 32
FFT_CODE_SCALE, FFT_CODE_OFFSET, FFT_CODE_MOST = 25.0, 2.719, 255
TINY = 1e-12


def col(x: Name) -> Column:
    return F.col(x) if isinstance(x, str) else x


# -- samples ------------------------------------------------------------------------------------------


def to_float(signal: Name, scale: float = PCM_SCALE) -> Column:
    """16-bit samples as doubles."""
    return F.transform(col(signal), lambda x: x.cast("double") / scale)


def clipped(signal: Name) -> Column:
    """Float samples held in [-1, 1]."""
    return F.transform(col(signal), lambda x: F.greatest(F.least(x.cast("double"), F.lit(1.0)), F.lit(-1.0)))


def fixed_length(signal: Name, n: int) -> Column:
    """The first n samples; null for a shorter signal."""
    return F.when(F.size(col(signal)) >= n, F.slice(col(signal), 1, n))


def frames(signal: Name, length: int, hop: int) -> Column:
    """Overlapping frames; empty for a signal shorter than one frame."""
    count = F.floor((F.size(col(signal)) - length) / hop).cast("int")
    whole = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(0))), lambda t: F.slice(col(signal), t * hop + 1, length))
    return F.when(F.size(col(signal)) >= length, whole).otherwise(F.slice(whole, 1, 0))


def total(x: Name, f=lambda v: v) -> Column:  # noqa: ANN001
    return F.aggregate(col(x), F.lit(0.0), lambda a, v: a + f(v.cast("double")))


def mean(x: Name, f=lambda v: v) -> Column:  # noqa: ANN001
    return total(x, f) / F.size(col(x))


def energy(x: Name) -> Column:
    return total(x, lambda v: v * v)


def peak(x: Name) -> Column:
    return F.array_max(F.transform(col(x), lambda v: F.abs(v.cast("double"))))


def crest(x: Name) -> Column:
    """Peak over root mean square."""
    return peak(x) / (F.sqrt(mean(x, lambda v: v * v)) + TINY)


def peak_to_mean(x: Name) -> Column:
    return peak(x) / (mean(x, F.abs) + TINY)


def peak_to_median(x: Name) -> Column:
    s, n = F.array_sort(F.transform(col(x), lambda v: F.abs(v.cast("double")))), F.size(col(x))
    middle = (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor(n / 2).cast("int") + 1)) / 2
    return peak(x) / (middle + TINY)


def kurtosis(x: Name) -> Column:
    """Population excess kurtosis; null for constant input."""
    m = mean(x)
    m2 = F.aggregate(col(x), F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b")), lambda s, v: F.struct((s.a + F.pow(v.cast("double") - m, 2)).alias("a"), (s.b + F.pow(v.cast("double") - m, 4)).alias("b")))
    n = F.size(col(x))
    return F.when(m2.a > 0, n * m2.b / (m2.a * m2.a) - 3)


def pearson_kurtosis(g2: Name, n: Name) -> Column:
    """Unbiased kurtosis with 3 for a normal distribution, from the population excess; 0 under four values."""
    g, k = col(g2), col(n)
    return F.when(k < 4, F.lit(0.0)).otherwise(((k + 1) * g + 6) * (k - 1) / ((k - 2) * (k - 3)) + 3)


# -- spectra ------------------------------------------------------------------------------------------


def hz_to_bin(hz: Name | float, rate: float, n_fft: int) -> Column:
    """Nearest bin, halves to even, held in [0, n / 2]."""
    f = F.lit(hz) if isinstance(hz, (int, float)) else col(hz)
    return F.greatest(F.least(F.bround(f * n_fft / rate).cast("int"), F.lit(n_fft // 2)), F.lit(0))


def db_to_ratio(db: Name) -> Column:
    return F.pow(F.lit(10.0), col(db) / 10)


def ratio_to_db(x: Name, eps: float = TINY) -> Column:
    return 10 * F.log10(col(x) + eps)


def band_sum(spectrum: Name, low: int, high: int) -> Column:
    """Sum over an inclusive range of bins, counted from 0."""
    return total(F.slice(col(spectrum), low + 1, high - low + 1))


def only_band(spectrum: Name, low: int, high: int) -> Column:
    """Zero outside the range."""
    return F.transform(col(spectrum), lambda x, i: F.when(i.between(low, high), x).otherwise(F.lit(0.0)))


def without_band(spectrum: Name, low: int, high: int) -> Column:
    return F.transform(col(spectrum), lambda x, i: F.when(i.between(low, high), F.lit(0.0)).otherwise(x))


def centroid(spectrum: Name, bin_hz: float) -> Column:
    weighted = F.aggregate(F.transform(col(spectrum), lambda p, i: p * i * bin_hz), F.lit(0.0), lambda a, v: a + v)
    return weighted / (total(spectrum) + TINY)


def bandwidth(spectrum: Name, bin_hz: float) -> Column:
    c = centroid(spectrum, bin_hz)
    spread = F.aggregate(F.transform(col(spectrum), lambda p, i: p * F.pow(i * bin_hz - c, 2)), F.lit(0.0), lambda a, v: a + v)
    return F.sqrt(spread / (total(spectrum) + TINY))


def flatness(spectrum: Name) -> Column:
    """Geometric over arithmetic mean."""
    return F.exp(mean(spectrum, lambda p: F.log(p + TINY))) / (mean(spectrum) + TINY)


def entropy(spectrum: Name) -> Column:
    """Entropy of the normalised spectrum, as a share of its most."""
    s = total(spectrum) + TINY
    return -total(spectrum, lambda p: p / s * F.log(p / s + TINY)) / F.log(F.size(col(spectrum)).cast("double"))


def running_sum(x: Name) -> Column:
    """Cumulative sums, in one pass."""
    start = F.struct(F.lit(0.0).alias("s"), F.array().cast("array<double>").alias("a"))
    return F.aggregate(col(x), start, lambda acc, v: F.struct((acc.s + v.cast("double")).alias("s"), F.concat(acc.a, F.array(acc.s + v.cast("double"))).alias("a")), lambda acc: acc.a)


def rolloff_bin(spectrum: Name, share: float = 0.85) -> Column:
    """First bin at which the running sum reaches a share of the whole."""
    limit = share * total(spectrum)
    return F.size(F.filter(running_sum(spectrum), lambda c: c < limit))


def argmax(x: Name) -> Column:
    """Place of the first greatest value, from 0."""
    return (F.array_position(col(x), F.array_max(col(x))) - 1).cast("int")


# -- drop-size histogram ------------------------------------------------------------------------------


def drop_bin(e: Name) -> Column:
    """Bin of a drop's energy on a logarithmic scale; null at or under the threshold."""
    k = F.floor(F.log(1 + (col(e) - DROP_THRESHOLD) * DROP_STEP) / F.log(F.lit(DROP_BASE)))
    return F.when(col(e) > DROP_THRESHOLD, F.greatest(F.least(k, F.lit(DROP_BINS - 1)), F.lit(0)).cast("int"))


def bin_energy(k: Name) -> Column:
    """The energy at which a bin begins."""
    return (F.pow(F.lit(DROP_BASE), col(k).cast("double")) - 1) / DROP_STEP + DROP_THRESHOLD


def weighted_sum(histogram: Name, weights: Sequence[float] | None = None) -> Column:
    """Sum of a histogram's counts, each weighed by its bin's energy or the weight given."""
    if weights is None:
        return F.aggregate(F.transform(col(histogram), lambda n, k: n * bin_energy(k)), F.lit(0.0), lambda a, v: a + v)
    return F.aggregate(F.zip_with(col(histogram), F.array(*[F.lit(float(w)) for w in weights]), lambda n, w: n * w), F.lit(0.0), lambda a, v: a + v)


def fft_code(x: Name) -> Column:
    """Accumulated magnitude as one byte on a logarithmic scale."""
    return F.least(F.lit(FFT_CODE_MOST), F.floor(FFT_CODE_SCALE * F.log(col(x) + FFT_CODE_OFFSET))).cast("int")


def rain_rate(x: Name, a: float, b: float, c: float) -> Column:
    """Rational model of rain rate by weighted sum."""
    return a * col(x) / (b + c * col(x))


# -- names --------------------------------------------------------------------------------------------


def label_from_path(path: Name, default: bool | None = None) -> Column:
    p = F.lower(col(path))
    return F.when(p.contains("true"), F.lit(True)).when(p.contains("false"), F.lit(False)).otherwise(F.lit(default).cast("boolean"))


def uid(*parts: Name) -> Column:
    return F.sha2(F.concat(*[col(p).cast("string") for p in parts]), 256)


def namespaced(prefix: str, names: Sequence[str]) -> list[Column]:
    return [F.col(n).alias(f"{prefix}__{n}") for n in names]


def key_device(key: Name) -> Column:
    """Device of an object key, for both layouts; other roots raise an error."""
    parts = F.split(col(key), "/")
    return F.when(parts[0].isin("audio", "raw_audio"), parts[1]).otherwise(F.raise_error(F.concat(F.lit("unknown key layout: "), col(key))))


def key_location(key: Name) -> Column:
    parts = F.split(col(key), "/")
    return F.when(parts[0] == "audio", parts[2])


def key_time(key: Name) -> Column:
    """Unix seconds in the short layout; YYYYMMDD_HH_MM_SS at the head of the file's name in the long one."""
    parts = F.split(col(key), "/")
    return F.when(parts[0] == "audio", F.timestamp_seconds(parts[3].cast("long"))).otherwise(F.to_timestamp(F.substring(parts[5], 1, 17), "yyyyMMdd_HH_mm_ss"))
