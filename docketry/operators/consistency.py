"""Consistency findings of a case: addresses, relations, names on forms, bureau scores, languages, affidavits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions import compare, people, text


def address_anchor(observed: DataFrame, case: list[str], anchor: Column, rank: list[Column], value: str, order: str, matches: Column) -> DataFrame:
    """Observations that disagree with the best-ranked anchor of their case (AADHAAR_ADDRESS_MISMATCH).

    The anchor is one row a case, aggregated before it is joined; matches compares
    columns anchor_value and value.
    """
    best = observed.where(anchor).groupBy(*case).agg(F.max_by(F.struct(F.col(value).alias("anchor_value"), F.col(order).alias("anchor_at")), F.struct(*rank)).alias("_a")).select(*case, "_a.*")
    return observed.join(best, case).where((F.col(order) != F.col("anchor_at")) & ~F.coalesce(matches, F.lit(False)))


def relation_findings(relations: DataFrame, people_of: DataFrame, case: list[str]) -> DataFrame:
    """RELATIONSHIP_QUALIFIER_MISMATCH and RELATIONSHIP_NAME_REVIEW.

    relations: case, person, page_number, qualifier, related. people_of: case,
    person, relationship, applicant_name. A son or daughter is `of` the primary
    person, a wife `wife of`; a father or mother is the one that the primary's own paper names.
    """
    primary = people_of.where("person = 'p0'").select(*case, F.col("applicant_name").alias("primary_name"))
    own = relations.where("person = 'p0'").groupBy(*case).agg(F.min_by("related", "page_number").alias("primary_related"))
    known = people_of.groupBy(*case).agg(F.collect_set("applicant_name").alias("names"))
    rows = relations.join(people_of.select(*case, "person", F.lower("relationship").alias("declared"), "applicant_name"), [*case, "person"]).join(primary, case, "left").join(own, case, "left").join(known, case)
    q = F.lower("qualifier")

    def same(a: str, b: str) -> Column:
        return F.coalesce(compare.person_score(F.col(a), F.col(b)) >= 85, F.lit(False))

    good = (
        F.when((F.col("declared") == "father") & F.col("primary_related").isNotNull(), same("primary_related", "applicant_name"))
        .when((F.col("declared") == "mother") & F.col("primary_related").isNotNull(), F.when(q == "w/o", same("primary_related", "related")).otherwise(same("primary_related", "applicant_name")))
        .when(F.col("declared").isin("son", "daughter"), q.isin("s/o", "d/o") & same("related", "primary_name"))
        .when(F.col("declared") == "wife", (q == "w/o") & same("related", "primary_name"))
        .otherwise(True)
    )
    named = F.exists("names", lambda n: compare.person_score(n, F.col("related")) >= 85)
    rules = F.array_compact(F.array(F.when(~good, F.lit("RELATIONSHIP_QUALIFIER_MISMATCH")), F.when(~named & F.col("declared").isin("wife", "husband", "son", "daughter"), F.lit("RELATIONSHIP_NAME_REVIEW"))))
    severity = F.when(F.col("rule_id") == "RELATIONSHIP_NAME_REVIEW", "LOW").otherwise("HIGH")
    return rows.select(*case, "person", "page_number", F.explode(rules).alias("rule_id")).withColumn("severity", severity)


def missing_names(pages: DataFrame, people_of: DataFrame, case: list[str], form: Column, name: str, body: str, near: int = 8) -> DataFrame:
    """People of a case with a form that shows their name neither in its fields nor, on or near its pages, in the text (APPLICATION_NAME_MISMATCH).

    Pages near a form are found by equality on cells of page numbers; a form whose names
    are all rejected is a gap of the extraction, and its case has no finding.
    """
    forms = pages.where(form)
    cells = forms.select(*case, F.col("page_number").alias("_f"), F.explode(F.sequence(F.floor((F.col("page_number") - near) / near), F.floor((F.col("page_number") + near) / near))).alias("_cell"))
    close = pages.withColumn("_cell", F.floor(F.col("page_number") / near)).join(cells, [*case, "_cell"]).where(F.abs(F.col("page_number") - F.col("_f")) <= near)
    texts = close.select(*case, text.compact(F.col(body)).alias("_body")).distinct()
    valid = F.col(name).isNotNull() & people.name_reject_reason(F.col(name)).isNull()
    state = forms.groupBy(*case).agg(F.min("page_number").alias("page_number"), F.collect_set(F.when(valid, F.col(name))).alias("names"), F.bool_or(F.col(name).isNotNull() & ~valid).alias("noise"))
    wanted = people_of.where(~compare.blank(F.col("applicant_name"))).select(*case, "person", "applicant_name")
    seen = wanted.withColumn("_n", text.compact(F.col("applicant_name"))).join(texts, case).where(F.contains("_body", F.col("_n"))).select(*case, "person").distinct()
    rows = wanted.join(state, case).join(seen, [*case, "person"], "left_anti")
    rows = rows.where(~F.exists("names", lambda n: compare.person_score(F.col("applicant_name"), n) >= 85)).where((F.size("names") > 0) | ~F.col("noise"))
    return rows.select(*case, "person", "page_number", F.coalesce(F.nullif(F.array_join(F.array_sort("names"), ", "), F.lit("")), F.lit("Name not extracted")).alias("found_value"))


def scoreless(pages: DataFrame, group: list[str], score: Column, body: str, order: str = "page_number") -> DataFrame:
    """Groups of bureau pages without a score of 0 or 300 to 900 and without the words that say there is none, if a page shows a score or its table (BUREAU_SCORE_MISSING)."""
    value = compare.number(score)
    low = F.lower(body)
    said = low.rlike("no (?:credit )?(?:history|score)|score not available|not scored")
    table = low.rlike("\\b(?:crif|cibil|credit\\s+information|credit\\s+report)\\b") & low.rlike("\\bscore\\b") & low.rlike("score name|range|crif hm score")
    rows = pages.withColumns({"_ok": F.coalesce((value == 0) | value.between(300, 900), F.lit(False)), "_said": said, "_shown": ~compare.blank(score), "_table": table, "_score": score.cast("string")})
    out = rows.groupBy(*group).agg(F.bool_or(F.col("_ok") | F.col("_said")).alias("_good"), F.min_by(F.struct(order, "_score"), F.when(F.col("_shown"), F.col(order))).alias("_p"), F.min(F.when(F.col("_table"), F.col(order))).alias("_t"))
    out = out.where(~F.col("_good") & (F.col("_p").isNotNull() | F.col("_t").isNotNull()))
    return out.select(*group, F.coalesce(F.col("_p")[order], F.col("_t")).alias(order), F.coalesce(F.col("_p._score"), F.lit("Blank score table")).alias("found_value"))


def second_language_missing(pages: DataFrame, case: list[str], form: Column, body: str, least: int = 20) -> DataFrame:
    """Cases whose form pages show one script only (APPLICATION_SECOND_LANGUAGE_MISSING); a script counts from `least` characters on."""
    counts = [F.sum(F.regexp_count(F.col(body), F.lit(chars))).alias(name) for name, chars in text.SCRIPTS.items()]
    rows = pages.where(form).groupBy(*case).agg(F.min("page_number").alias("page_number"), *counts)
    seen = F.array_compact(F.array(*[F.when(F.col(name) >= least, F.lit(name)) for name in text.SCRIPTS]))
    return rows.withColumn("scripts", F.array_join(seen, ",")).where(F.size(seen) == 1).select(*case, "page_number", "scripts")


def affidavits_missing(findings: DataFrame, pages: DataFrame, case: list[str], kind: str = "document_type", body: str = "body") -> DataFrame:
    """People with a name or birth date that differs and no declaration of theirs that speaks of it (IDENTITY_AFFIDAVIT_MISSING)."""
    rules = ("TRUSTED_APPLICANT_NAME_MISMATCH", "APPLICATION_NAME_MISMATCH", "TRUSTED_DATE_OF_BIRTH_MISMATCH")
    what = F.when(F.contains("rule_id", F.lit("DATE_OF_BIRTH")), "DOB").otherwise("name")
    rows = findings.where(F.col("rule_id").isin(*rules) & F.col("severity").isin("HIGH", "MEDIUM")).groupBy(*case, "person").agg(F.array_join(F.array_sort(F.collect_set(what)), " and ").alias("differs"), F.min("page_number").alias("page_number"))
    told = F.lower(kind).rlike("affidavit|declaration") & F.lower(body).rlike("dual name|also known as|alias|mismatch|one and the same person|correct name")
    return rows.join(pages.where(told).select(*case, "person").distinct(), [*case, "person"], "left_anti")


def supporting_page(observed: DataFrame, pages: DataFrame, case: list[str], value: str, within: int = 12) -> DataFrame:
    """observed with support: its own page if that shows the value, else the first page of its source document (without one, of its type within so many pages) that does, else its own.

    Joined on case and source document, or on case and type; both sides carry page_number.
    """
    other = pages.select(*case, F.col("source_document_id").alias("_d"), F.col("document_type").alias("_t"), F.col("page_number").alias("_p"), text.compact(F.col("body")).alias("_body"))
    rows = observed.withColumn("_v", text.compact(F.col(value)))
    key = F.coalesce(F.concat(F.lit("d"), F.col("source_document_id")), F.concat(F.lit("t"), F.col("document_type")))
    left = rows.withColumn("_k", key)
    right = other.withColumn("_k", F.explode(F.array_compact(F.array(F.concat(F.lit("d"), F.col("_d")), F.concat(F.lit("t"), F.col("_t"))))))
    near = F.col("source_document_id").isNotNull() | (F.abs(F.col("page_number") - F.col("_p")) <= within)
    keep = observed.columns
    found = left.join(right, [*case, "_k"]).where(near & (F.col("_v") != "") & F.contains("_body", F.col("_v")))
    own = F.when(F.col("_p") == F.col("page_number"), -1).otherwise(F.col("_p"))
    first = found.groupBy(*case, "page_number", value).agg(F.min_by("_p", own).alias("_s"))
    return observed.join(first, [*case, "page_number", value], "left").withColumn("support", F.coalesce("_s", "page_number")).select(*keep, "support")
