"""Spectra of arrays by an Arrow kernel; rows of equal length are transformed together."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType

from tidewater.functions.columns import col


def _power(x: np.ndarray) -> np.ndarray:
    s = np.fft.rfft(x, axis=1)
    return s.real**2 + s.imag**2


@pandas_udf(ArrayType(DoubleType()))
def _power_spectrum(signals: pd.Series) -> pd.Series:
    out = pd.Series([None] * len(signals), dtype=object)
    sizes = signals.map(lambda s: -1 if s is None else len(s))
    for n, rows in sizes.groupby(sizes).groups.items():
        if n > 0:
            made = _power(np.stack([np.asarray(signals[i], float) for i in rows]))
            for i, row in zip(rows, made, strict=True):
                out[i] = row
    return out


def power_spectrum(signal: str | Column) -> Column:
    """Squared magnitudes of the n / 2 + 1 lowest frequencies; null for a null or empty signal."""
    return _power_spectrum(F.transform(col(signal), lambda x: x.cast("double")))
