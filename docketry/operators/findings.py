"""Findings: rules over rows, first-wins dedupe, rank, collapse, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.operators.relational import with_rules


def severity_rank(c: Column) -> Column:
    return F.when(c == "HIGH", 0).when(c == "MEDIUM", 1).when(c == "LOW", 2).otherwise(3)


def term_findings(rows: DataFrame, rules: DataFrame, text: str) -> DataFrame:
    """A finding for each row and rule (rule_id, severity, term) whose term the text holds."""
    return with_rules(rows, rules).where(F.contains(F.col(text), F.col("term")))


def first_wins(df: DataFrame, key: list[str], ordinal: list[str]) -> DataFrame:
    """Of each key the row that comes first."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*ordinal))).where("_n = 1").drop("_n")


def ranked(df: DataFrame, group: str, severity: str, *ties: str) -> DataFrame:
    """Place of each finding by severity, then ties with null last."""
    order = [severity_rank(F.col(severity)), *[F.col(t).asc_nulls_last() for t in ties]]
    return df.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def collapsed(df: DataFrame, bucket: list[str], page: str, severity: str) -> DataFrame:
    """One row a bucket: count, worst severity, sorted distinct pages."""
    worst = F.min(severity_rank(F.col(severity)))
    return df.groupBy(*bucket).agg(
        F.count("*").alias("occurrences"),
        F.element_at(F.array(*[F.lit(x) for x in ("HIGH", "MEDIUM", "LOW", "OTHER")]), worst + 1).alias("severity"),
        F.array_join(F.array_sort(F.collect_set(page)).cast("array<string>"), ",").alias("pages"),
    )


def file_severity(count: Column) -> Column:
    return F.when(count >= 50, "CRITICAL").when(count >= 30, "HIGH").when(count >= 10, "MEDIUM").when(count >= 1, "LOW").otherwise("NONE")


def reviewer_status(high: Column, total: Column, unclear: Column) -> Column:
    """FULL_MANUAL where most is unclear, HIGH_RISK with any high finding, else LIMITED or CLEAN."""
    limit = F.greatest(F.lit(8), F.floor(total / 3))
    return F.when(unclear >= limit, "FULL_MANUAL").when(high > 0, "HIGH_RISK").when(total > 0, "LIMITED").otherwise("CLEAN")


def recommendation(high: Column, medium: Column) -> Column:
    return F.when(high > 0, "MANUAL REVIEW").when(medium > 0, "SEND BACK TO BRANCH").otherwise("APPROVE")


def suppressed(cross: DataFrame, trusted: DataFrame, keys: list[str]) -> DataFrame:
    """Cross findings without a trusted finding of the same keys."""
    return cross.join(trusted.select(*keys), keys, "left_anti")


def required_missing(subjects: DataFrame, rules: DataFrame, counts: DataFrame, subject: str, item: str) -> DataFrame:
    """Subjects x rules (item, min_count) with fewer items than wanted."""
    wanted = with_rules(subjects, rules)
    return wanted.join(counts, [subject, item], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint")).where(F.col("n") < F.col("min_count"))


def reconciled(pairs: DataFrame, key: str, trusted: str, found: str, tolerance: Column) -> DataFrame:
    """MATCH, MATCH_WITH_CONFLICTS, MISMATCH, NOT_OBSERVED or NOT_CHECKABLE for each key."""
    rows = pairs.groupBy(key).agg(
        F.max(F.col(trusted)).alias("trusted"),
        F.count(F.col(found)).alias("observed"),
        F.sum(F.when(tolerance, 1).otherwise(0)).alias("good"),
    )
    status = (
        F.when(F.col("trusted").isNull(), "NOT_CHECKABLE")
        .when(F.col("observed") == 0, "NOT_OBSERVED")
        .when(F.col("good") == F.col("observed"), "MATCH")
        .when(F.col("good") > 0, "MATCH_WITH_CONFLICTS")
        .otherwise("MISMATCH")
    )
    return rows.select(key, "observed", status.alias("status"))
