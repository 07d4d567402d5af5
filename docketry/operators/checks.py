"""Checks over observations: matches, dates, periods, statuses, counts, trusted and cross-document values.

Blank means unknown and passes unless a check says otherwise. Every operator
takes column names and returns finding rows with a status of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import dates
from docketry.operators import relational


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")), F.lit("")) == ""


def field_mismatches(observed: DataFrame, expected: DataFrame, keys: list[str], found: str, wanted: str, order: str, matches: Column) -> DataFrame:
    """The first observation of each key that does not match what is expected of it; blanks on either side pass."""
    rows = observed.join(expected, keys).where(~blank(F.col(found)) & ~blank(F.col(wanted)) & ~F.coalesce(matches, F.lit(False)))
    first = rows.groupBy(*keys).agg(F.min(F.struct(F.col(order), F.col(found), F.col(wanted))).alias("_r"))
    return first.select(*keys, "_r.*")


def date_check(df: DataFrame, key: str, date: str, anchor: Column, max_months: int) -> DataFrame:
    """Newest date of each key against the anchor: MISSING, FUTURE, OLD or OK; a day over a month counts as one more."""
    rows = df.groupBy(key).agg(F.max(date).alias("newest"))
    age = dates.age_in_months(F.col("newest"), anchor)
    status = F.when(F.col("newest").isNull(), "MISSING").when(F.col("newest") > anchor, "FUTURE").when(age > max_months, "OLD").otherwise("OK")
    return rows.select(key, "newest", age.alias("age"), status.alias("status"))


def period_check(df: DataFrame, owner: str, account: str, date: str, anchor: Column, months: int) -> DataFrame:
    """Whether any account of an owner has entries in each of the `months` complete months before the anchor."""
    first, last = dates.months_before(anchor, months)
    wanted = dates.month_set(first, last)
    covered = df.groupBy(owner, account).agg(F.collect_set(F.when(F.col(date).between(first, last), F.date_format(date, "yyyy-MM"))).alias("covered"))
    gaps = covered.withColumn("gap", F.size(F.array_except(wanted, F.col("covered"))))
    return gaps.groupBy(owner).agg(F.min("gap").cast("bigint").alias("months_missing"), F.count_if(F.col("gap") == 0).alias("full_accounts")).withColumn("passes", F.col("months_missing") == 0)


def status_check(df: DataFrame, key: str, passes: Column) -> DataFrame:
    """PASS if any row passes, FAIL if all known ones fail, else UNVERIFIABLE."""
    rows = df.groupBy(key).agg(F.bool_or(passes).alias("any_pass"), F.count(passes).alias("known"))
    return rows.select(key, "known", F.when(F.col("any_pass"), "PASS").when(F.col("known") > 0, "FAIL").otherwise("UNVERIFIABLE").alias("status"))


def distinct_count_check(df: DataFrame, key: str, item: Column, least: int) -> DataFrame:
    """Keys with fewer than `least` distinct items."""
    return df.groupBy(key).agg(F.countDistinct(item).alias("distinct_items")).where(F.col("distinct_items") < least)


def trusted_mismatches(observed: DataFrame, trusted: DataFrame, person: str, field: str, value: str, trusted_value: str, matches: Column) -> DataFrame:
    """Observed values that differ from the trusted one, with the single other person who has that value, if one does."""
    wrong = observed.join(trusted, [person, field]).where(~blank(F.col(value)) & ~F.coalesce(matches, F.lit(False)))
    owners = trusted.select(F.col(field), F.col(trusted_value).alias(value), F.col(person).alias("_owner"))
    owners = owners.groupBy(field, value).agg(F.min("_owner").alias("belongs_to"), F.max("_owner").alias("_last")).where("belongs_to = _last").drop("_last")
    return wrong.join(owners, [field, value], "left")


def cross_mismatches(observed: DataFrame, group: list[str], rank: list[Column], value: str, order: str) -> DataFrame:
    return relational.anchor_mismatch(observed.where(~blank(F.col(value))), group, rank, value, order)


def one_finding_a_page(findings: DataFrame, page: list[str], confidence: str, least: float, rule: str) -> DataFrame:
    """Field findings of a page of low confidence give way to a single LOW_CONFIDENCE_PAGE."""
    low = F.col(confidence) < least
    clear, unclear = findings.where(~F.coalesce(low, F.lit(False))), findings.where(low)
    return clear.select(*page, rule).unionByName(unclear.select(*page).distinct().withColumn(rule, F.lit("LOW_CONFIDENCE_PAGE")))


def qualified_absences(missing: DataFrame, candidates: DataFrame, coverage: DataFrame, keys: list[str]) -> DataFrame:
    """MISSING where nothing comes near; REVIEW_REQUIRED where candidate pages or unread pages leave doubt."""
    rows = missing.join(candidates.groupBy(*keys).agg(F.count("*").alias("candidate_pages")), keys, "left")
    rows = rows.join(coverage.groupBy(keys[0]).agg(F.count("*").alias("unread_pages")), keys[0], "left")
    rows = rows.fillna(0, ["candidate_pages", "unread_pages"])
    return rows.withColumn("status", F.when((F.col("candidate_pages") > 0) | (F.col("unread_pages") > 0), "REVIEW_REQUIRED").otherwise("MISSING"))


def cascade(items: DataFrame, case: str, request: str, done: Column) -> DataFrame:
    """Requests with nothing outstanding, and cases whose requests are all resolved."""
    requests = items.groupBy(case, request).agg(F.bool_and(done).alias("resolved"))
    return requests.groupBy(case).agg(F.count("*").alias("requests"), F.count_if("resolved").alias("resolved"), F.bool_and("resolved").alias("ready"))


def scored_types(pages: DataFrame, rules: DataFrame, page: str, text: str, most: int = 5) -> DataFrame:
    """The best types of each page by a rule table.

    rules: type, priority, heading, keywords, required, negative (arrays of
    lower-case terms but for heading, a term). 0.6 for the heading in the first 80
    characters, up to 0.3 for two or more keywords, 0.25 for a required term; a negative
    term, or none of the required ones, rules a type out.
    """
    body = F.col("_low")

    def hits(c: str) -> Column:
        return F.size(F.filter(F.col(c), lambda t: F.contains(body, t)))

    low = pages.select(page, F.explode(F.array(F.lower(text))).alias("_low"))  # the explode holds it, so that no term lowers the text again
    rows = relational.with_rules(low, rules).where((hits("negative") == 0) & ((F.size("required") == 0) | (hits("required") > 0)))
    score = F.when(F.contains(F.substring(body, 1, 80), F.col("heading")), 0.6).otherwise(0.0) + 0.3 * F.least(F.lit(1.0), hits("keywords") / 2) + F.when(hits("required") > 0, 0.25).otherwise(0.0)
    rows = rows.withColumn("score", F.round(score, 3)).where("score > 0")
    place = F.row_number().over(Window.partitionBy(page).orderBy(F.desc("score"), "priority", "type"))
    return rows.withColumn("place", place.cast("bigint")).where(F.col("place") <= most).select(page, "type", "score", "place")
