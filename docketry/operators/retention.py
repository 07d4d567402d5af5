"""What may be deleted: candidate sets by age, number and state, each a DataFrame of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Jobs that will not go on, and what of a case's objects may go with it.
TERMINAL = ("completed", "failed")
SOURCE_PURPOSES = ("source", "manifest", "normalized_pdf", "page_preview")
KEPT_ACTIONS = ("decision_recorded", "decision_undone", "user_created", "job_cancelled")


def job_inputs(inputs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Inputs of completed jobs."""
    return inputs.join(jobs.where("status = 'completed'").select("job_id"), "job_id", "left_semi")


def stale_jobs(jobs: DataFrame, keep: int = 3) -> DataFrame:
    """Jobs that are done, but for the newest `keep` of each case."""
    w = Window.partitionBy("app").orderBy(F.desc("job_id"))
    return jobs.where(F.col("status").isin(*TERMINAL)).withColumn("_n", F.row_number().over(w)).where(F.col("_n") > keep).drop("_n")


def older(rows: DataFrame, time: str, cutoff: Column) -> DataFrame:
    return rows.where(F.col(time) < cutoff)


def old_audit(log: DataFrame, time: str, cutoff: Column) -> DataFrame:
    """Entries past the window that are of no action that is always kept."""
    return older(log, time, cutoff).where(~F.col("action").isin(*KEPT_ACTIONS))


def to_archive(cases: DataFrame, cutoff: Column) -> DataFrame:
    return cases.where((F.col("created_at") < cutoff) & F.col("archived_at").isNull())


def source_objects(refs: DataFrame, cases: DataFrame, jobs: DataFrame, cutoff: Column) -> DataFrame:
    """Source objects of cases that are archived or due, none of whose jobs may resume; keys that leave their folder are never taken."""
    due = cases.where(F.col("archived_at").isNotNull() | (F.col("created_at") < cutoff))
    idle = due.join(jobs.where(~F.col("status").isin(*TERMINAL)).select("app"), "app", "left_anti").select("app")
    safe = ~F.col("storage_key").startswith("/") & ~F.contains("storage_key", F.lit(".."))
    return refs.where(F.col("purpose").isin(*SOURCE_PURPOSES) & safe).join(idle, "app", "left_semi")


def old_exports(refs: DataFrame, cutoff: Column) -> DataFrame:
    """Exports past their own age; times written with a T or with a space count alike, others are kept."""
    made = F.coalesce(F.try_to_timestamp("created_text", F.lit("yyyy-MM-dd'T'HH:mm:ss")), F.try_to_timestamp("created_text", F.lit("yyyy-MM-dd HH:mm:ss")))
    return refs.where(F.col("purpose") == "ocr_export").where(made < cutoff)
