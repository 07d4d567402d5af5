"""Work lists, review summaries and report views over cases, jobs and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import compare, text
from docketry.operators.findings import severity_rank

#: States and the rules that warn of processing, not of the business.
ACTIVE_PROGRESS, ACTIVE_JOBS = ("processing", "queued"), ("queued", "running", "retrying")
DONE = ("verified", "verified_with_override", "accepted")
PROCESSING_RULES = ("UNCLASSIFIED_PAGE", "LOW_OCR_CONFIDENCE", "UNREADABLE_PAGE", "PAGE_PROCESSING_ERROR", "OCR_BUDGET_PARTIAL_SCAN", "DOCUMENT_NOT_READABLE", "AUTO_OWNER_UNRESOLVED", "AUTO_OWNER_LOW_CONFIDENCE", "AUTO_DOCUMENT_TYPE_LOW_CONFIDENCE", "TRUSTED_PERSON_SCOPE_MISSING")


def workflow_state(state: Column, status: Column, progress: Column, job: Column) -> Column:
    """processing while anything runs; else the tracked state, or what the case's status stands for."""
    low = F.lower(F.coalesce(status, F.lit("")))
    running = F.coalesce(progress.isin(*ACTIVE_PROGRESS), F.lit(False)) | F.coalesce(job.isin(*ACTIVE_JOBS), F.lit(False))
    told = F.when(low.isin(*DONE), "completed").when(low == "incomplete", "waiting_documents").when(low.isin("needs_review", "clean", "failed"), "ready").otherwise("not_ready")
    return F.when(running, "processing").otherwise(F.coalesce(state, told))


def next_action(state: Column, owner: Column, user: Column) -> Column:
    return (
        F.when(state == "processing", "Wait for processing")
        .when(state == "waiting_documents", "Review documents")
        .when(F.coalesce(owner == user, F.lit(False)), "Resume review")
        .when(state == "ready", "Claim and review")
        .when(state == "completed", "Outcome recorded")
        .otherwise("Waiting for processing")
    )


def in_view(view: str, state: Column, owner: Column, user: Column) -> Column:
    """Whether a case belongs to a view of the work list."""
    views = {
        "all": F.lit(True),
        "ready": (state == "ready") & owner.isNull(),
        "mine": (state == "ready") & F.coalesce(owner == user, F.lit(False)),
        "waiting": state == "waiting_documents",
        "completed": state == "completed",
        "processing": state == "processing",
    }
    if view not in views:
        raise ValueError(f"unknown view {view}")
    return views[view]


def warns_of_processing(rule: Column) -> Column:
    base = F.regexp_replace(rule, "_SUMMARY$", "")
    return base.isin(*PROCESSING_RULES) | base.startswith("PAGE_PROCESSING_")


def dismissible(rule: Column, verdict: Column, confidence: Column, expected: Column, found: Column, quote: Column, page_text: Column) -> Column:
    """Whether an assessment may dismiss a finding: sure, an identity mismatch, both values the same but for writing, and the quote on the page."""

    def norm(c: Column) -> Column:
        return F.when(rule.contains("PAN") | rule.contains("AADHAAR"), F.lower(F.regexp_replace(c, "[\\s-]", ""))).otherwise(text.normalised(c))

    named = rule.contains("MISMATCH") & (rule.contains("NAME") | rule.contains("PAN") | rule.contains("AADHAAR"))
    shape = F.when(rule.contains("PAN"), norm(found).rlike("^[a-z]{5}[0-9]{4}[a-z]$")).when(rule.contains("AADHAAR"), norm(found).rlike("^[2-9][0-9]{11}$")).otherwise(True)
    there = ~compare.blank(quote) & F.contains(norm(quote), norm(found)) & F.contains(text.normalised(page_text), text.normalised(quote))
    return F.coalesce(confidence.between(0.98, 1) & (verdict == "possible_false_positive") & named & ~compare.blank(expected) & ~compare.blank(found) & (norm(expected) == norm(found)) & shape & there, F.lit(False))


def decision_reasons(action: Column, complete: Column, high_exceptions: Column, open_tasks: Column, open_high: Column, rationale: Column, reasons: Column, message: Column) -> Column:
    """What forbids a decision, as an array of codes; none allows it."""
    none = compare.blank(rationale)
    return F.array_compact(
        F.array(
            F.when(~complete, "PROCESSING"),
            F.when((action == "ACCEPT") & (high_exceptions > 0), "HIGH_EXCEPTION"),
            F.when((action == "ACCEPT") & (open_tasks > 0), "OPEN_TASKS"),
            F.when((action == "OVERRIDE") & (open_high > 0), "OPEN_HIGH_TASKS"),
            F.when(action.isin("ACCEPT", "OVERRIDE") & none, "NO_RATIONALE"),
            F.when((action == "REQUEST_DOCS") & (reasons == 0), "NO_REASON"),
            F.when((action == "REQUEST_DOCS") & compare.blank(message), "NO_MESSAGE"),
        )
    )


def scoped(people: DataFrame, case: list[str], scope: str) -> DataFrame:
    """The people of each case that a rule is about; banking rules fall back to all where none is chosen."""
    role = F.lower(F.trim(F.coalesce(F.col("role"), F.lit(""))))
    guarantor = role.isin("guarantor", "gtr")
    if scope == "each_person":
        return people
    if scope == "each_borrower":
        return people.where(~guarantor)
    if scope == "pdc_people":
        return people.where(guarantor | ((role == "coapplicant") & (F.coalesce(F.col("income_earner"), F.lit(False)) | F.lower("gender").isin("female", "f"))))
    if scope != "banking_people":
        raise ValueError(f"unknown scope {scope}")
    chosen = (F.col("person") == "p0") | role.isin("applicant", "primary", "primary_applicant") | F.coalesce(F.col("income_earner"), F.lit(False))
    any_ = F.max(chosen.cast("int")).over(Window.partitionBy(*case))
    return people.withColumns({"_c": chosen, "_any": any_}).where((F.col("_any") == 0) | F.col("_c")).drop("_c", "_any")


def grouped_findings(findings: DataFrame, case: list[str], code: str, order: str) -> DataFrame:
    """One finding a case and code: that of the worst severity (the first of equals) with all pages and how many there are."""
    first = F.min_by(F.struct("severity", "expected_value", "found_value", "document_type"), F.struct(severity_rank(F.col("severity")), F.col(order)))
    rows = findings.groupBy(*case, code).agg(first.alias("_f"), F.array_sort(F.collect_set("page_number")).alias("pages"), F.count("*").alias("findings"))
    return rows.select(*case, code, "_f.*", "pages", "findings")


def overflow_by_page(grouped: DataFrame, case: list[str], code: str, shown: int = 5) -> DataFrame:
    """The pages of findings beyond the first `shown` of a case, with the codes to look for."""
    w = Window.partitionBy(*case).orderBy(severity_rank(F.col("severity")), code)
    rest = grouped.withColumn("_n", F.row_number().over(w)).where(F.col("_n") > shown)
    rows = rest.select(*case, code, F.explode("pages").alias("page_number"))
    return rows.groupBy(*case, "page_number").agg(F.array_join(F.array_sort(F.collect_set(code)), ", ").alias("codes"))


def matrix_rows(observed: DataFrame, keys: list[str], value: str, matches: str, page: str) -> DataFrame:
    """A row a key: the first value, its pages, and match, attention (some differ) or mismatch (all do)."""
    return observed.groupBy(*keys).agg(
        F.min_by(value, page).alias("extracted"), F.array_join(F.array_sort(F.collect_set(page)), ",").alias("pages"),
        F.when(~F.bool_or(matches), "mismatch").when(~F.bool_and(matches) | (F.countDistinct(value) > 1), "attention").otherwise("match").alias("status"),
    )


def relation_nodes(people: DataFrame, case: list[str]) -> DataFrame:
    """People and their fathers as nodes, one a name and case: p1, c1.., f1.., with role and relation."""
    own = people.select(*case, F.lower(F.trim("applicant_name")).alias("key"), F.col("person").alias("_o"), F.when(F.col("person") == "p0", 0).otherwise(1).alias("_rank"), F.when(F.col("person") == "p0", "primary").when(F.col("role") == "guarantor", "guarantor").otherwise("co_applicant").alias("role"), F.col("relationship").alias("relation"))
    kin = people.where(~compare.blank(F.col("father_name"))).select(*case, F.lower(F.trim("father_name")).alias("key"), F.col("person").alias("_o"), F.lit(2).alias("_rank"), F.lit("family_member").alias("role"), F.lit("father").alias("relation"))
    rows = own.unionByName(kin).groupBy(*case, "key").agg(F.min_by(F.struct("role", "relation", "_o"), F.struct("_rank", "_o")).alias("_n"))
    rows = rows.select(*case, "key", "_n.*")
    kind = F.when(F.col("role") == "primary", "p").when(F.col("role") == "family_member", "f").otherwise("c")
    n = F.row_number().over(Window.partitionBy(*case, "_k").orderBy("_o", "key"))
    return rows.withColumn("_k", kind).withColumn("node", F.concat("_k", n.cast("string"))).select(*case, "node", F.col("key").alias("name"), "role", "relation")


def document_summaries(pages: DataFrame, flagged: DataFrame, case: list[str], kind: str) -> DataFrame:
    """A row a case and type: range of pages, the first, and Flagged where a finding points to one."""
    marks = flagged.select(*case, "page_number", F.lit(True).alias("_bad")).distinct()
    rows = pages.join(marks, [*case, "page_number"], "left").groupBy(*case, kind).agg(F.min("page_number").alias("first_page"), F.max("page_number").alias("last_page"), F.count("*").alias("pages"), F.bool_or(F.coalesce("_bad", F.lit(False))).alias("_f"))
    span = F.when(F.col("pages") > 1, F.concat_ws("-", "first_page", "last_page")).otherwise(F.col("first_page").cast("string"))
    return rows.select(*case, kind, "first_page", span.alias("range"), F.when(F.col("_f"), "Flagged").otherwise("Extracted").alias("status"))


def evidence_pages(findings: DataFrame, pages: DataFrame, case: list[str], finding: str, most: int = 12) -> DataFrame:
    """For each finding the best pages to look at: its own, those of its type, those that hold a word of the type.

    Ordered so, then by page; the rest is counted in `omitted`. Joined on the
    case; findings have document_type and page_number, pages page_number, kind and body.
    """
    rows = findings.join(pages.withColumnRenamed("page_number", "page"), case)
    words = F.filter(text.tokens(F.col("document_type")), lambda t: ~t.isin("document", "documents", "report", "form", "letter", "and", "or"))
    padded = F.concat(F.lit(" "), text.normalised(F.col("body")), F.lit(" "))
    rows = rows.withColumns({"direct": F.coalesce(F.col("page") == F.col("page_number"), F.lit(False)), "same_type": F.lower("kind") == F.lower("document_type"), "_words": words, "_body": padded})
    rows = rows.withColumn("hits", F.size(F.filter("_words", lambda t: F.contains(F.col("_body"), F.concat(F.lit(" "), t, F.lit(" "))))))
    rows = rows.where("direct or same_type or hits > 0")
    w = Window.partitionBy(*case, finding)
    rows = rows.withColumn("place", F.row_number().over(w.orderBy(F.desc("direct"), F.desc("hits"), F.desc("same_type"), "page"))).withColumn("omitted", F.greatest(F.lit(0), F.count("*").over(w) - most))
    return rows.where(F.col("place") <= most)


def excerpts(body: Column, needle: Column, before: int = 150, size: int = 800) -> Column:
    """The head of a text and, where the needle stands further on, the window around it."""
    at = F.instr(F.lower(body), F.lower(needle))
    start = F.greatest(F.lit(1), at - before)
    return F.when((at > 0) & (start > 1), F.array(F.substring(body, 1, size), F.substring(body, start, F.lit(size)))).otherwise(F.array(F.substring(body, 1, size)))


def preview(items: Column, most: int = 8) -> Column:
    """The first items, and how many more there are."""
    head = F.array_join(F.slice(items, 1, most), ", ")
    return F.when(F.size(items) > most, F.concat(head, F.lit(" +"), (F.size(items) - most).cast("string"), F.lit(" more"))).otherwise(head)


def eta_seconds(status: Column, done: Column, total: Column, started: Column, now: Column) -> Column:
    """Seconds that the rest takes at the pace so far; 0 when nothing runs, null when none is done."""
    elapsed = F.greatest(F.lit(1.0), (F.unix_micros(now) - F.unix_micros(started)) / 1e6)
    return F.when(status != "processing", F.lit(0)).when((done > 0) & (total > 0), F.round(elapsed / done * F.greatest(F.lit(0), total - done)).cast("bigint"))


def pretty_bytes(c: Column) -> Column:
    for_unit = F.when(c < 10240, F.concat(c.cast("string"), F.lit(" bytes")))
    for power, unit in ((1, "kB"), (2, "MB"), (3, "GB"), (4, "TB")):
        part = F.round(c / 1024**power).cast("bigint")
        for_unit = for_unit.when((part < 10240) | F.lit(unit == "TB"), F.concat(part.cast("string"), F.lit(f" {unit}")))
    return for_unit


def merged_first_wins(sources: list[DataFrame], key: Column, order: str) -> DataFrame:
    """Rows of several tables in one, of each key the first: an earlier table, then the order."""
    parts = [df.withColumn("_s", F.lit(k)) for k, df in enumerate(sources)]
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    w = Window.partitionBy("_k").orderBy("_s", order)
    return rows.withColumn("_k", key).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_k", "_n", "_s")


def physical_evidence(pages: DataFrame, keys: list[str], numbers: str) -> DataFrame:
    """How many items the pages show: distinct numbers where there are any, else pages."""
    rows = pages.select(*keys, F.explode_outer(numbers).alias("_n"), F.col("page_number"))
    out = rows.groupBy(*keys).agg(F.countDistinct(F.nullif(F.trim("_n"), F.lit(""))).alias("_d"), F.countDistinct("page_number").alias("pages"))
    return out.select(*keys, F.when(F.col("_d") > 0, F.col("_d")).otherwise(F.col("pages")).alias("count"), F.when(F.col("_d") > 0, "cheque(s)").otherwise("page(s)").alias("unit"))
