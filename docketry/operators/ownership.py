"""Whose page is it: identity observations, scored against the people of a case."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions import compare, text

#: How much a matching field tells.
WEIGHTS = {"aadhaar_number": 8, "pan_number": 8, "account_number": 8, "phone_number": 5, "date_of_birth": 5, "applicant_name": 6, "pin_code": 2, "address": 1}
RELATION = 4
#: Other names of the fields.
ALIASES = {
    "borrower_name": "applicant_name", "account_holder_name": "applicant_name", "customer_name": "applicant_name", "dob": "date_of_birth", "pan": "pan_number", "aadhaar": "aadhaar_number", "aadhaar_last4": "aadhaar_number",
    "bank_account_number": "account_number", "account_no": "account_number", "phone": "phone_number", "mobile_number": "phone_number", "pincode": "pin_code",
}
#: What of these is found in plain text.
HARVESTED = {"pan_number": f"\\b({text.PAN})\\b", "phone_number": "\\b([6-9][0-9]{9})\\b", "aadhaar_number": "(?i)\\baadhaar(?:\\s+(?:number|no\\.?))?\\s*[:#-]?\\s*(?:[x*]{2,4}[\\s-]*){1,3}([0-9]{4})\\b"}


def observations(pages: DataFrame, keys: list[str], fields: str, body: str) -> DataFrame:
    """(keys, field, value): the page's fields under their usual names, and identifiers in its text, each once.

    fields is a map column; keys with a leading underscore are private and left out.
    """
    cells = pages.select(*keys, F.explode(F.map_entries(F.map_filter(fields, lambda k, v: ~k.startswith("_") & ~compare.blank(v)))).alias("_c"))
    named = cells.select(*keys, text.canonical_field(F.col("_c.key"), ALIASES).alias("field"), F.trim("_c.value").alias("value"))

    def held(field: str, pattern: str) -> Column:
        source = F.upper(body) if field == "pan_number" else F.col(body)
        return F.transform(F.regexp_extract_all(source, F.lit(pattern), F.lit(1)), lambda x: F.struct(F.lit(field).alias("field"), x.alias("value")))

    found = F.flatten(F.array(*[held(f, p) for f, p in HARVESTED.items()]))
    told = pages.select(*keys, F.explode(found).alias("_c")).select(*keys, "_c.*")
    return named.where(F.col("field").isin(*WEIGHTS)).unionByName(told).distinct()


def weight(field: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair]), field), F.lit(0))


def scores(observed: DataFrame, trusted: DataFrame, case: list[str], page: list[str], person: str = "person", relations: bool = True) -> DataFrame:
    """(page, person, score, evidence): weights of the fields of a page that match the person's.

    observed has case, page, field, value; trusted has case, person, field,
    trusted_value. All values of a case are sent to one task, as they are, and all that follows, up to
    owners, stays there. A value that many pages of a case show is compared once, with the trusted values of its
    field, which are a row a case: of the people of one case, and of the pages with one value, there are few.
    """
    whole = F.col("field").isin(*[f for f in compare.EXACT if f not in ("aadhaar_number", "aadhaar_last4", "account_number")])
    known = [F.col(c).isNotNull() for c in (*case, "field")]
    parts = int(observed.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number of its own, as few bytes are long work here
    o = observed.where(~compare.blank(F.col("value"))).where(functools.reduce(operator.and_, known)).select(*case, *page, "field", "value").repartition(parts, *case)
    o = o.groupBy(*case, "field", "value").agg(F.collect_list(F.struct(*page)).alias("_pages"))
    t = trusted.where(~compare.blank(F.col("trusted_value"))).where(functools.reduce(operator.and_, known)).select(*case, person, "field", "trusted_value").repartition(parts, *case)
    t = t.groupBy(*case, "field").agg(F.collect_list(F.struct(F.col(person), compare.prepared(F.col("field"), F.col("trusted_value"), relations).alias("_t"))).alias("_l"))
    t = t.groupBy(*case).agg(F.map_from_entries(F.collect_list(F.struct("field", "_l"))).alias("_m"))
    met = o.join(t, case).select(*case, "_pages", "field", F.try_element_at("_m", F.col("field")).alias("_l"), compare.prepared(F.col("field"), F.col("value"), relations).alias("_o")).where("_l is not null")
    pairs = met.select(*case, "_pages", "field", "_o", F.explode("_l").alias("_p")).select(*case, "_pages", F.col(f"_p.{person}").alias(person), "field", "_o", F.col("_p._t").alias("_t"))
    alike = F.when(whole, F.col("_o.letters") == F.col("_t.letters")).otherwise(compare.agree(F.col("field"), F.col("_t"), F.col("_o"), relations=relations))
    told = pairs.where(alike).select(*case, person, "field", F.explode("_pages").alias("_page")).select(*case, person, "field", *[F.col(f"_page.{c}").alias(c) for c in page])
    told = told.groupBy(*case, *page, person).agg(F.array_sort(F.collect_set("field")).alias("evidence"))
    score = sum((F.when(F.array_contains("evidence", f), w).otherwise(0) for f, w in WEIGHTS.items()), F.lit(0))
    return told.select(*case, *page, person, score.cast("bigint").alias("score"), "evidence")


def with_relations(scored: DataFrame, relations: DataFrame, keys: list[str], person: str = "person") -> DataFrame:
    """scores with those of relations (keys, person) added where a page's relation names one person only."""
    single = relations.groupBy(*keys).agg(F.min(person).alias(person), F.max(person).alias("_other")).where(F.col(person) == F.col("_other")).drop("_other")
    more = single.select(*keys, person, F.lit(RELATION).cast("bigint").alias("score"), F.array(F.lit("relationship")).alias("evidence"))
    both = scored.select(*keys, person, "score", "evidence").unionByName(more)
    return both.groupBy(*keys, person).agg(F.sum("score").alias("score"), F.array_sort(F.flatten(F.collect_list("evidence"))).alias("evidence"))


def owners(scored: DataFrame, keys: list[str], person: str = "person") -> DataFrame:
    """(keys, owner, best, second, confidence, evidence): the person with the strictly highest score; a tie has none.

    The people of one case are few, so their scores of a page fit in a list.
    """
    ranked = F.sort_array(F.collect_list(F.struct(F.col("score"), F.col(person).alias("who"), F.col("evidence"))), asc=False)
    rows = scored.groupBy(*keys).agg(ranked.alias("_r")).select(*keys, F.col("_r")[0].alias("_a"), F.coalesce(F.try_element_at("_r", F.lit(2))["score"], F.lit(0)).alias("second"))
    won = F.col("_a.score") > F.col("second")
    confidence = F.when(won, F.round(F.least(F.lit(1.0), 0.45 + F.col("_a.score") / 12), 3)).otherwise(0.0)
    return rows.select(*keys, F.when(won, F.col("_a.who")).alias("owner"), F.col("_a.score").alias("best"), "second", confidence.alias("confidence"), F.when(won, F.col("_a.evidence")).otherwise(F.array().cast("array<string>")).alias("evidence"))


def findings(pages: DataFrame, owned: DataFrame, keys: list[str], scoped: Column, least: float = 0.65) -> DataFrame:
    """AUTO_OWNER_UNRESOLVED for pages that ask for an owner and have none, AUTO_OWNER_LOW_CONFIDENCE for weak ones."""
    rows = pages.where(scoped).join(owned.select(*keys, "owner", "confidence"), keys, "left")
    rule = F.when(F.col("owner").isNull(), "AUTO_OWNER_UNRESOLVED").when(F.col("confidence") < least, "AUTO_OWNER_LOW_CONFIDENCE")
    return rows.withColumn("rule_id", rule).where("rule_id is not null").select(*keys, "rule_id", F.lit("LOW").alias("severity"), F.lit("MANUAL_REVIEW_REQUIRED").alias("status"))


def votes(rows: DataFrame, keys: list[str], choices: list[str]) -> DataFrame:
    """(keys, rows, and of each choice a struct (winner, votes)): the value with most votes, ties to the first by name; null values do not vote.

    Rows are sent once for all choices, counted before.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("choice"), F.col(c).alias("value")) for c in choices]))
    counted = rows.select(*keys, cells.alias("_c")).select(*keys, "_c.*").groupBy(*keys, "choice", "value").agg(F.count("*").alias("votes"))
    voted = {c: F.min(F.when((F.col("choice") == c) & F.col("value").isNotNull(), F.struct((-F.col("votes")).alias("less"), F.col("value").alias("winner")))) for c in choices}
    best = counted.groupBy(*keys).agg(F.sum(F.when(F.col("choice") == choices[0], F.col("votes"))).alias("rows"), *[v.alias(f"_{c}") for c, v in voted.items()])
    return best.select(*keys, "rows", *[F.struct(F.col(f"_{c}.winner").alias("winner"), F.coalesce(-F.col(f"_{c}.less"), F.lit(0)).alias("votes")).alias(c) for c in choices])


def merged_records(records: DataFrame, case: list[str], ids: list[str], order: str, values: list[str]) -> DataFrame:
    """Records of one person merged: the key is the first identifier of `ids` that is there; of each value the first non-blank by order."""
    key = F.coalesce(*[F.when(~compare.blank(F.col(c)), F.concat(F.lit(f"{c}:"), text.compact(F.col(c)))) for c in ids])
    rows = records.withColumn("identity", key).where("identity is not null")
    return rows.groupBy(*case, "identity").agg(F.count("*").alias("records"), *[F.min_by(F.col(v), F.when(~compare.blank(F.col(v)), F.col(order))).alias(v) for v in values])


def seen_people(people: DataFrame, pages: DataFrame, case: list[str], fields: list[str], body: str) -> DataFrame:
    """(case, person, field, page_number): trusted values that stand in a page's text as they are, marks and case apart."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), text.compact(F.col(f)).alias("v")) for f in fields]))
    wanted = people.select(*case, "person", cells.alias("_c")).select(*case, "person", "_c.*").where("length(v) >= 4")
    rows = pages.select(*case, "page_number", text.compact(F.col(body)).alias("_body")).join(wanted, case).where(F.contains("_body", F.col("v")))
    return rows.select(*case, "person", "field", "page_number").distinct()
