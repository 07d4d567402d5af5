"""Joins that are more than an equality: latest, as-of, range, band, unique and scored matches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key: aggregated before the shuffle, so a hot key costs one row a task."""
    others = [c for c in df.columns if c not in keys]
    rows = df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_row"))
    return rows.select(*keys, *[F.col("_row")[c].alias(c) for c in others])


def newest_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The n first rows of each key in the order given; Spark keeps n a task before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def asof_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """Each left row with the last right row of its key at or before its time, by one window over the union."""
    lhs = left.withColumn("_t", F.col(left_time)).withColumn("_side", F.lit(1))
    rhs = right.select(F.col(key), F.col(right_time).alias("_t"), F.struct(F.col(right_time), *values).alias("_value")).withColumn("_side", F.lit(0))
    both = lhs.unionByName(rhs, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_value", F.last("_value", True).over(w)).where("_side = 1")
    return both.select(*left.columns, F.col("_value")[right_time].alias(f"asof_{right_time}"), *[F.col("_value")[v].alias(f"asof_{v}") for v in values])


def range_join(points: DataFrame, ranges: DataFrame, point: str, start: str, end: str, width: int, keys: list[str] | None = None) -> DataFrame:
    """points with every range that holds them, by equality on cells of `width`, then the exact test."""
    keys = keys or []
    lhs = points.withColumn("_cell", F.floor(F.col(point) / width))
    rhs = ranges.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    return lhs.join(rhs, [*keys, "_cell"]).where((F.col(point) >= F.col(start)) & (F.col(point) <= F.col(end))).drop("_cell")


def band_nearest(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, back: int, value: str) -> DataFrame:
    """The value of the nearest right row at most `back` before the left row, in its key."""
    lhs = left.withColumn("_at", F.col(left_at).cast("long")).withColumn("_side", F.lit(1))
    rhs = right.select(F.col(key), F.col(right_at).cast("long").alias("_at"), F.struct(F.col(right_at).cast("long").alias("at"), F.col(value).alias("value")).alias("_v")).withColumn("_side", F.lit(0))
    both = lhs.unionByName(rhs, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_at").rangeBetween(-back, 0)
    both = both.withColumn("_best", F.max("_v").over(w)).where("_side = 1")
    return both.select(*left.columns, F.col("_best.at").alias("near_at"), F.col("_best.value").alias("near_value"))


def effective_lookup(facts: DataFrame, rules: DataFrame, when: str, start: str, end: str, fits: Callable[[Column], Column] | None = None, most: int = 10_000) -> DataFrame:
    """facts with the rules in force at a time (a row each, one without where none is), their number and lookup: NO_RULE, ONE or AMBIGUOUS.

    The rules, at most `most` of them (checked), travel as one broadcast array that
    each fact filters, so facts are neither shuffled nor sorted. fits compares
    a rule, as a struct, with columns of the fact.
    """
    table = _bounded(rules, most).agg(F.collect_list(F.struct(*rules.columns)).alias("_rules"))

    def live(r: Column) -> Column:
        inside = (r[start].isNull() | (r[start] <= F.col(when))) & (r[end].isNull() | (F.col(when) <= r[end]))
        return inside if fits is None else inside & fits(r)

    rows = facts.crossJoin(F.broadcast(table)).withColumn("_rules", F.filter("_rules", live)).withColumn("matches", F.size("_rules").cast("bigint"))
    rows = rows.withColumn("lookup", F.when(F.col("matches") == 0, "NO_RULE").when(F.col("matches") == 1, "ONE").otherwise("AMBIGUOUS"))
    return rows.select(*facts.columns, F.explode_outer("_rules").alias("_r"), "matches", "lookup").select(*facts.columns, "_r.*", "matches", "lookup")


def unique_owner(values: DataFrame, owners: DataFrame, key: str, owner: str) -> DataFrame:
    """values with the owner of their key if exactly one owner has it."""
    single = owners.groupBy(key).agg(F.min(owner).alias(owner), F.max(owner).alias("_other")).where(F.col(owner) == F.col("_other")).drop("_other")
    return values.join(single, key, "left")


def scored_match(pairs: DataFrame, item: str, candidate: str, score: Column) -> DataFrame:
    """The candidate with the strictly best score of each item; a tie has no winner."""
    scored = pairs.withColumn("score", score).groupBy(item, candidate).agg(F.max("score").alias("score"))
    best = scored.groupBy(item).agg(F.max("score").alias("best"))
    top = scored.join(best, item).where("score = best and best > 0").groupBy(item, "best").agg(F.min(candidate).alias("_c"), F.count("*").alias("ties"))
    return top.select(item, F.when(F.col("ties") == 1, F.col("_c")).alias("winner"), "best", "ties")


def anchor_mismatch(obs: DataFrame, group: list[str], rank: list[Column], value: str, order: str) -> DataFrame:
    """The first observation of each group that disagrees with its best-ranked one."""
    anchor = F.first(F.struct(F.col(value), F.col(order))).over(Window.partitionBy(*group).orderBy(*rank))
    rows = obs.withColumn("_a", anchor).where(F.col(value) != F.col("_a")[value])
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(order))).where("_n = 1")
    return first.select(*group, F.col("_a")[value].alias("anchor_value"), F.col(value).alias("found_value"), F.col(order).alias("found_at"))


def with_rules(rows: DataFrame, rules: DataFrame, most: int = 10_000) -> DataFrame:
    """Every row with every rule; rules must be a short table (at most `most` rows, checked when the query runs)."""
    return rows.crossJoin(F.broadcast(_bounded(rules, most)))


def _bounded(rules: DataFrame, most: int) -> DataFrame:
    """rules, which fail when they are read if there are more than `most`."""
    short = rules.limit(most + 1)
    size = short.agg(F.count("*").alias("_n")).where(F.assert_true(F.col("_n") <= most, f"more than {most} rules").isNull())
    return short.crossJoin(F.broadcast(size)).drop("_n")  # size is one row
