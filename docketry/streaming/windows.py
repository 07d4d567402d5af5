"""The same window aggregates for batch and for streams, and keyed state over ordered rows."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _watermarked(df: DataFrame, time: str, late: str | None) -> DataFrame:
    """df as it is, or with a watermark, which needs a timestamp with a time zone."""
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if late else df


def tumbling(df: DataFrame, time: str, size: str, *keys: str, late: str | None = None) -> DataFrame:
    rows = _watermarked(df, time, late)
    out = rows.groupBy(F.window(time, size), *keys).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), *keys, "n", F.col("total").cast("double").alias("total"))


def sliding(df: DataFrame, time: str, size: str, step: str, *keys: str, late: str | None = None) -> DataFrame:
    rows = _watermarked(df, time, late)
    return rows.groupBy(F.window(time, size, step), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), *keys, "n")


def session_counts(df: DataFrame, time: str, gap: str, *keys: str, late: str | None = None) -> DataFrame:
    rows = _watermarked(df, time, late)
    out = rows.groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("session_window.start").alias("session_start"), *keys, "n")


def first_in_watermark(df: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """Drops repeats of a key that arrive within the watermark."""
    return _watermarked(df, time, late).dropDuplicatesWithinWatermark(keys)


def last_values(df: DataFrame, key: str, time: str, value: str, timeout_ms: int = 600_000) -> DataFrame:
    """Streams the latest value of each key with the number of rows seen, in keyed state."""

    def step(k: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, at, last = state.get if state.exists else (0, 0, "")
        for frame in frames:
            frame = frame.sort_values(time)
            seen += len(frame)
            stamp = int(frame[time].iloc[-1].value)
            if stamp >= at:
                at, last = stamp, str(frame[value].iloc[-1])
        state.update((seen, at, last))
        state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame({key: [k[0]], "seen": [seen], "last": [last]})

    kind = dict(df.dtypes)[key]
    return df.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, seen bigint, last string", "seen bigint, at bigint, last string", "update", GroupStateTimeout.ProcessingTimeTimeout)
