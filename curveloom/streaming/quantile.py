"""Online quantile per key in three words of state (the published Frugal-2U rule), for batches and streams."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_MASK = (1 << 64) - 1


def _draw(n: int, seed: int) -> float:
    """Reproducible number in 0 .. 1 for the n-th item."""
    x = (n * 0x9E3779B97F4A7C15 + seed * 0xBF58476D1CE4E5B9 + 1) & _MASK
    x ^= x >> 31
    x = x * 0x94D049BB133111EB & _MASK
    return (x ^ x >> 29) / 2**64


def follow(state: tuple[int, int, int, int], values: np.ndarray, q: float, seed: int = 0, linear: bool = False) -> tuple[int, int, int, int]:
    """New ``(estimate, step, sign, count)`` after the values, which move the estimate by growing steps in one direction and by small ones on a turn.
    On a turn downwards a step above 1 is damped to 1; on a turn upwards only one below -1 is, so that a large step goes on."""
    m, step, sign, n = state
    for s in values.tolist():
        if n == 0:
            m, n = s, 1
            continue
        r, n = _draw(n, seed), n + 1
        grow = max(1, abs(step) // 4) if linear else 1
        if s > m and r > 1 - q:
            step += grow if sign > 0 else -grow
            m += step if step > 0 else 1
            if m > s:
                step, m = step + s - m, s
            if sign < 0 and step < -1:
                step = 1
            sign = 1
        elif s < m and r > q:
            step += grow if sign < 0 else -grow
            m -= step if step > 0 else 1
            if m < s:
                step, m = step + m - s, s
            if sign > 0 and step > 1:
                step = 1
            sign = -1
    return int(m), int(step), int(sign), int(n)


def batch_quantile(rows: DataFrame, key: str, value: str, order: str, q: float) -> DataFrame:
    """``(key, estimate, n)`` of one pass in ``order`` over each key's values. Sequential by definition: a key is one task, whose values pass in batches. Nulls are left out."""
    kind = rows.schema[key].dataType
    x = rows.where(f"{value} is not null and {key} is not null").select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(value).cast("long").alias("v"))

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = (0, 1, 1, 0)
        for b in batches:
            state = follow(state, b["v"].to_numpy(zero_copy_only=False), q)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], b["k"].type), pa.array([state[0]], pa.int64()), pa.array([state[3]], pa.int64())], names=["k", "estimate", "n"])

    out = x.repartition("k").sortWithinPartitions("k", "o").groupBy("k").applyInArrow(run, f"k {kind.simpleString()}, estimate bigint, n bigint")
    return out.withColumnRenamed("k", key)


#: Values up to which a shuffled estimate is the order statistic itself, and values its start is taken from.
EXACT, START = 100, 21


def shuffled_quantile(rows: DataFrame, key: str, value: str, id: str, q: float, seed: int = 0) -> DataFrame:
    """``(key, estimate, n)`` independent of the order of rows: below ``EXACT`` values the value of rank ceil(q * n), else the online estimate over the values in
    random order (a keyed hash of ``id``), started from the same rank among the first ``START``. Nulls are left out; no rows give no rows. A key's values pass its task in batches."""
    kind = rows.schema[key].dataType
    x = rows.where(f"{value} is not null and {key} is not null").select(F.col(key).alias("k"), F.xxhash64(F.lit(seed), F.col(id)).alias("draw"), F.col(value).cast("long").alias("v"))

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, state, n = [], None, 0
        rank = lambda v: int(sorted(v)[max(0, -int(-q * len(v) // 1) - 1)])
        for b in batches:
            v = b["v"].to_numpy(zero_copy_only=False)
            n += len(v)
            if state is None:
                first += v.tolist()
                if len(first) < EXACT:
                    continue
                state, v = (rank(first[:START]), 1, 1, 1), np.array(first)
            state = follow(state, v, q, seed)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], b["k"].type), pa.array([rank(first) if state is None else state[0]], pa.int64()), pa.array([n], pa.int64())], names=["k", "estimate", "n"])

    out = x.repartition("k").sortWithinPartitions("k", "draw").groupBy("k").applyInArrow(run, f"k {kind.simpleString()}, estimate bigint, n bigint")
    return out.withColumnRenamed("k", key)


def stream_quantile(stream: DataFrame, key: str, value: str, q: float) -> DataFrame:
    """The same on a stream: ``(key, estimate, n)`` whenever a key gets values; the state is (estimate, step, sign, count)."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else (0, 1, 1, 0)
        for b in batches:
            now = follow(now, b[value].dropna().to_numpy(), q)
        state.update(now)
        yield pd.DataFrame({key: [k[0]], "estimate": [now[0]], "n": [now[3]]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.select(key, value).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, estimate bigint, n bigint", "m bigint, step bigint, sign bigint, n bigint", "update", GroupStateTimeout.NoTimeout)
