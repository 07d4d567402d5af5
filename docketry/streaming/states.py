"""Keyed state over ordered rows: page types that carry on, job attempts, heartbeats, rate limits.

Each has a batch form, which windows or a grouped map express, and page types
have a streaming twin that keeps the same state.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

UNKNOWN = "unknown"


class PageTyping:
    """State: type and confidence of the last page that was detected as itself.

    A page with a type of its own sets the state. An unknown page that continues
    inherits it, with 0.85 of its confidence, kept between 0.55 and 0.85. A page
    that starts afresh stays unknown, and the state stays for later pages.
    """

    def __init__(self, kind: str = "", confidence: float = 0.0):
        self.kind, self.confidence = kind, confidence

    def step(self, kind: str, confidence: float, fresh: bool) -> tuple[str, float, str]:
        if kind != UNKNOWN:
            self.kind, self.confidence = kind, confidence
            return kind, confidence, "detected"
        if self.kind and not fresh:
            return self.kind, round(min(0.85, max(0.55, self.confidence * 0.85)), 3), "inherited"
        return UNKNOWN, 0.0, UNKNOWN


def typed_pages(df: DataFrame, document: str, order: list[str], kind: str, confidence: str, fresh: str) -> DataFrame:
    """document, order columns, final_type, final_confidence, method of each page, in one window a document."""
    w = Window.partitionBy(document).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = F.col(kind) != UNKNOWN
    last = F.last(F.when(own, F.struct(F.col(kind).alias("k"), F.col(confidence).alias("c"))), True).over(w)
    takes = ~own & last.isNotNull() & ~F.col(fresh)
    most, least = F.lit("0.85").cast("decimal(10,6)"), F.lit("0.55").cast("decimal(10,6)")
    passed = F.round(F.least(most, F.greatest(least, (last["c"].cast("decimal(6,4)") * F.lit("0.85").cast("decimal(3,2)")).cast("decimal(10,6)"))), 3).cast("double")
    return df.select(
        document, *order,
        F.when(own, F.col(kind)).when(takes, last["k"]).otherwise(UNKNOWN).alias("final_type"),
        F.when(own, F.col(confidence)).when(takes, passed).otherwise(0.0).alias("final_confidence"),
        F.when(own, "detected").when(takes, "inherited").otherwise(UNKNOWN).alias("method"),
    )


def typed_page_stream(df: DataFrame, document: str, order: str, kind: str, confidence: str, fresh: str) -> DataFrame:
    """The same over a stream whose pages of a document arrive in order: state is the last detected page."""
    key_type, order_type = dict(df.dtypes)[document], dict(df.dtypes)[order]

    def run(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        typing = PageTyping(*(state.get if state.exists else ("", 0.0)))
        for frame in frames:
            frame = frame.sort_values(order)
            out = [typing.step(k, c, f) for k, c, f in zip(frame[kind], frame[confidence], frame[fresh], strict=True)]
            yield pd.DataFrame({document: key[0], order: frame[order].to_numpy(), "final_type": [x[0] for x in out], "final_confidence": [x[1] for x in out], "method": [x[2] for x in out]})
        state.update((typing.kind, float(typing.confidence)))

    schema = f"{document} {key_type}, {order} {order_type}, final_type string, final_confidence double, method string"
    return df.groupBy(document).applyInPandasWithState(run, schema, "kind string, confidence double", "append", GroupStateTimeout.NoTimeout)


def job_attempts(events: DataFrame, job: str, order: list[str], failed: Column, most: int = 3, waits: tuple[int, ...] = (30, 120)) -> DataFrame:
    """Each event with the attempt it ends and what follows: DONE, RETRY with the wait in seconds, or DEAD."""
    w = Window.partitionBy(job).orderBy(*order)
    rows = events.withColumn("attempt", (F.coalesce(F.sum(failed.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1).cast("bigint"))
    wait = F.element_at(F.array(*[F.lit(x) for x in waits]), F.least(F.col("attempt"), F.lit(len(waits))).cast("int"))
    rows = rows.withColumn("next", F.when(~failed, "DONE").when(F.col("attempt") >= most, "DEAD").otherwise("RETRY"))
    return rows.withColumn("wait_seconds", F.when(F.col("next") == "RETRY", wait))


def rate_limited(events: DataFrame, who: str, time: str, order: list[str], most: int, seconds: int) -> DataFrame:
    """Events with the number of the same key's in the last `seconds` before, and whether they are let in."""
    at = F.unix_micros(F.col(time).cast("timestamp"))
    w = Window.partitionBy(who).orderBy("_at").rangeBetween(-seconds * 1_000_000 + 1, -1)
    rows = events.withColumn("_at", at).withColumn("recent", F.count("*").over(w))
    return rows.withColumn("allowed", F.col("recent") < most).drop("_at")


def stale_keys(beats: DataFrame, key: str, time: str, now: Column, seconds: int) -> DataFrame:
    """Keys whose last beat is more than `seconds` before now."""
    last = beats.groupBy(key).agg(F.max(time).alias("last_beat"))
    late = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_beat").cast("timestamp"))) / 1e6
    return last.withColumn("late_seconds", F.round(late, 3)).withColumn("stale", F.col("late_seconds") > seconds)
