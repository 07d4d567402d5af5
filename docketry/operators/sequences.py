"""Windows over ordered rows: smoothing, islands, carrying forward, sampling, interval coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sandwich(df: DataFrame, key: str, order: list[str], value: str, unknown: str) -> DataFrame:
    """An unknown value between two equal ones becomes theirs (column smoothed)."""
    w = Window.partitionBy(key).orderBy(*order)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    fill = (F.col(value) == unknown) & (before == after) & (before != unknown)
    return df.withColumn("smoothed", F.when(fill, before).otherwise(F.col(value)))


def two_gap(df: DataFrame, key: str, order: list[str], value: str, unknown: str) -> DataFrame:
    """Two unknown values between equal ones become theirs (column filled)."""
    w = Window.partitionBy(key).orderBy(*order)
    b1, b2, a1, a2 = F.lag(value).over(w), F.lag(value, 2).over(w), F.lead(value).over(w), F.lead(value, 2).over(w)
    v = F.col(value)
    first = (v == unknown) & (a1 == unknown) & (b1 == a2) & (b1 != unknown)
    second = (v == unknown) & (b1 == unknown) & (b2 == a1) & (a1 != unknown)
    return df.withColumn("filled", F.when(first, b1).when(second, a1).otherwise(v))


def islands(df: DataFrame, key: str, order: list[str], value: str, wall: Column | None = None) -> DataFrame:
    """Numbers runs of equal values (column island); a true wall starts a new run."""
    w = Window.partitionBy(key).orderBy(*order)
    change = F.lag(value).over(w).isNull() | (F.lag(value).over(w) != F.col(value))
    change = change | wall if wall is not None else change
    return df.withColumn("_change", change.cast("int")).withColumn("island", F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_change")


def carried(df: DataFrame, key: str, order: list[str], value: Column, default: str) -> DataFrame:
    """The last non-null value so far (column carried)."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("carried", F.coalesce(F.last(value, True).over(w), F.lit(default)))


def complete_sequence(df: DataFrame, key: str, number: str) -> DataFrame:
    """Whether the numbers of each key are 0..n-1 or 1..n, each once."""
    rows = df.groupBy(key).agg(F.count("*").alias("n"), F.min(number).alias("low"), F.max(number).alias("high"), F.countDistinct(number).alias("d"))
    return rows.select(key, "n", ((F.col("n") == F.col("d")) & (F.col("high") - F.col("low") + 1 == F.col("n")) & (F.col("low") <= 1)).alias("complete"))


def budget_sample(df: DataFrame, key: str, order: list[str], front: int, tail: int, middle: int) -> DataFrame:
    """The first `front`, the last `tail` and `middle` evenly spaced rows of each key."""
    w = Window.partitionBy(key)
    rows = df.withColumn("pos", F.row_number().over(w.orderBy(*order)).cast("bigint")).withColumn("total", F.count("*").over(w))
    inner = F.col("total") - front - tail
    at = F.col("pos") - front - 1
    even = F.floor((at + 1) * middle / inner) > F.floor(at * middle / inner)
    return rows.where((F.col("pos") <= front) | (F.col("pos") > F.col("total") - tail) | (inner <= middle) | even)


def within_budget(df: DataFrame, key: str, order: list[str], uses: Column, budget: int) -> DataFrame:
    """Rows while the running count of `uses` is at most the budget."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(uses.cast("int")).over(w)).where(F.col("used") <= budget)


def merged_intervals(df: DataFrame, key: str, start: str, end: str, touch_days: int = 1) -> DataFrame:
    """Date ranges that overlap or touch, merged."""
    w = Window.partitionBy(key).orderBy(start, end)
    latest = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.withColumn("_new", (latest.isNull() | (F.col(start) > F.date_add(latest, touch_days))).cast("int"))
    rows = rows.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "_run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_run")


def running_offset(df: DataFrame, key: str, order: list[str], size: str) -> DataFrame:
    """First and last place of each row when rows are laid end to end."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("last_place", F.sum(size).over(w))
    return rows.withColumn("first_place", F.col("last_place") - F.col(size) + 1)


def sessions(df: DataFrame, key: str, time: str, order: list[str], gap_minutes: int) -> DataFrame:
    """Numbers sessions: a gap of more than gap_minutes starts a new one (column session)."""
    w = Window.partitionBy(key).orderBy(time, *order)
    at = F.unix_micros(F.col(time).cast("timestamp"))
    gap = at - F.lag(at).over(w)
    new = (gap.isNull() | (gap > gap_minutes * 60_000_000)).cast("int")
    return df.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
