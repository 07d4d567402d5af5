"""Repayment schedules: rows out of page text, arithmetic, continued pages, fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_AMOUNT = "([0-9][0-9,]*(?:[.][0-9]{1,2})?)"
#: number, opening balance, instalment, principal, interest, closing balance on one line.
ROW = "(?m)^[ ]*([0-9]{1,3})[ ]+" + "[ ]+".join([_AMOUNT] * 5) + "[ ]*$"
FIELDS = ("opening_balance", "emi", "principal", "interest", "closing_balance")


def schedule_rows(pages: DataFrame, text: str) -> DataFrame:
    """A row for each line of numbers, with the differences that its arithmetic leaves."""
    groups = [F.regexp_extract_all(F.col(text), F.lit(ROW), F.lit(k + 1)) for k in range(6)]
    rows = pages.withColumn("_r", F.explode(F.arrays_zip(*[g.alias(f"g{k}") for k, g in enumerate(groups)])))
    amounts = [F.regexp_replace(F.col("_r")[f"g{k + 1}"], ",", "").cast("decimal(18,2)").alias(f) for k, f in enumerate(FIELDS)]
    rows = rows.select(*[c for c in pages.columns if c != text], F.col("_r.g0").cast("int").alias("installment_number"), *amounts)
    slack = F.greatest(F.lit(1), F.col("emi") * F.lit("0.0001").cast("decimal(6,4)"))
    rows = rows.withColumn("component_difference", F.col("emi") - F.col("principal") - F.col("interest")).withColumn("balance_difference", F.col("opening_balance") - F.col("principal") - F.col("closing_balance"))
    return rows.withColumn("component_valid", F.abs("component_difference") <= slack).withColumn("balance_valid", F.abs("balance_difference") <= slack)


def schedules(rows: DataFrame, document: str, page: str, most_gap: int = 2) -> DataFrame:
    """Numbers schedules (column schedule): a page gap above most_gap, or a number that does not follow, starts another."""
    w = Window.partitionBy(document).orderBy(page, "installment_number")
    fresh = F.lag(page).over(w).isNull() | (F.col(page) - F.lag(page).over(w) > most_gap) | (F.col("installment_number") != F.lag("installment_number").over(w) + 1)
    return rows.withColumn("_new", fresh.cast("int")).withColumn("schedule", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Numbers, usual instalment (the most frequent, else the median), whether complete and settled, and a fingerprint."""
    counts = rows.groupBy(*keys, "emi").agg(F.count("*").alias("times"))
    modes = counts.groupBy(*keys).agg(F.max_by("emi", F.struct("times", -F.col("emi"))).alias("mode"), F.max("times").alias("times"))
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("installment_number").alias("first_number"), F.max("installment_number").alias("last_number"), F.countDistinct("installment_number").alias("numbers"),
        F.median(F.col("emi").cast("double")).alias("median"), F.sum("emi").alias("total"), F.max_by("closing_balance", "installment_number").alias("closing"),
    )
    out = out.join(modes, keys)
    complete = (F.col("n") == F.col("numbers")) & (F.col("first_number") == 1) & (F.col("last_number") == F.col("n")) & (F.abs("closing") <= 1)
    usual = F.when(F.col("times") > 1, F.col("mode").cast("double")).otherwise(F.col("median"))
    return out.select(*keys, "n", usual.alias("usual_emi"), complete.alias("complete"), F.sha2(F.concat_ws("|", "first_number", "last_number", "n", "total"), 256).alias("fingerprint"))


def mismatches(found: DataFrame, trusted: DataFrame, key: str) -> DataFrame:
    """REPAYMENT_SCHEDULE_EMI_MISMATCH and ..._INSTALLMENT_COUNT_MISMATCH against trusted (key, emi, tenure)."""
    rows = found.join(trusted, key)
    emi = F.when(F.abs(F.col("usual_emi") - F.col("emi")) > F.greatest(F.lit(1.0), F.abs("emi") * 1e-4), "REPAYMENT_SCHEDULE_EMI_MISMATCH")
    count = F.when(F.col("complete") & (F.col("n") != F.col("tenure")), "REPAYMENT_SCHEDULE_INSTALLMENT_COUNT_MISMATCH")
    return rows.select(key, F.explode(F.array_compact(F.array(emi, count))).alias("rule_id"))
