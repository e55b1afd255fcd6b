"""Sequential estimators over ordered frames.

A stream of frames is dealt by key and sorted (Spark spills what memory can't hold); a kernel walks through it
with the state of one key in memory, whatever the stream's length. The values of one key depend on one
another in order, so a key is one task's work; streams that never end use kept state (tidewater.streaming).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Step = Callable[[float], float]


def walk(df: DataFrame, key: Sequence[str], order: Sequence[str], value: str, make: Callable[[], Step], name: str) -> DataFrame:
    """(key, order, i, name): what each key's own step makes of its values in order; i counts from 1.

    A null value is passed as NaN.
    """
    rows = df.select(*key, *order, F.col(value).cast("double").alias("__x")).repartition(*key).sortWithinPartitions(*key, *order)
    names = [*key, *order, "i", name]
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes[:-1]) + f", i bigint, `{name}` double"
    k = len(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        step: Step = make()
        i = 0
        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in range(k)), strict=True))
            made, count = np.empty(b.num_rows), np.empty(b.num_rows, np.int64)
            for r, (own, x) in enumerate(zip(keys, b.column(b.num_columns - 1).to_numpy(zero_copy_only=False).tolist(), strict=True)):
                if own != now:
                    now, step, i = own, make(), 0
                i += 1
                made[r], count[r] = step(x), i
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(count), pa.array(made)], names=names)

    return rows.mapInArrow(run, schema)


def quantile_baseline(q: float, window: int, floor: float) -> Callable[[], Step]:
    """Causal stochastic quantile: each value's baseline comes from the values before it.

    The step follows a running scale of the error; the baseline is never under the floor.
    """
    window = max(3, window)
    eta = min(max(2 / (window + 1), 1e-4), 1.0)
    alpha = min(max(1 - eta, 0.0), 0.9999)

    def make() -> Step:
        state: list[float] = []

        def step(x: float) -> float:
            if not state:
                state[:] = max(x, floor), max(abs(x), floor)
            b, s = state
            s = alpha * s + (1 - alpha) * abs(x - b)
            move = eta * max(s, floor)
            state[:] = max(b + (q * move if x >= b else -(1 - q) * move), floor), s
            return b

        return step

    return make


def asymmetric_average(up: float = 0.6, down: float = 0.95) -> Callable[[], Step]:
    """Exponential average that follows rises and falls at different rates; never above the value itself."""

    def make() -> Step:
        state: list[float] = []

        def step(x: float) -> float:
            if state:
                keep = up if x > state[0] else down
                x = min(x, keep * state[0] + (1 - keep) * x)
            state[:] = [x]
            return x

        return step

    return make


def with_hold_mask(df: DataFrame, value: str, key: Sequence[str], order: Sequence[str], rise: float, hold: int, name: str) -> DataFrame:
    """1 where a value exceeds the one before by ``rise``, and for ``hold`` values after; one window of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    hit = F.coalesce((F.col(value) - F.lag(value).over(w) >= rise).cast("double"), F.lit(0.0))
    return df.withColumn(name, hit).withColumn(name, F.max(name).over(w.rowsBetween(-hold, 0)))


def with_duty_cycle(df: DataFrame, value: str, key: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """1 for each minute that is analysed in full: the minute before was positive; the first is not."""
    before = F.lag(F.col(value) > 0).over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn(name, F.coalesce(before, F.lit(False)).cast("double"))
