"""Mapped verification: documents that a manifest maps to persons and pages, against the trusted values of those persons."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions import compare, text

#: Types whose fragments are one document of a person, of which any may show a value.
TOGETHER = ("sanction letter", "cam", "kfs", "loan agreement", "facility agreement", "application form", "aadhaar", "pan", "pan card")
#: Fields whose difference weighs most; text quality below which nothing is compared.
WEIGHTY, LEAST_OCR = ("aadhaar_number", "pan_number"), 0.55


def _firsts(rows: Column, *key: str) -> Column:
    """The least of the structs of each key, in order; the structs begin with the fields of the key."""

    def of(x: Column) -> Column:
        return F.struct(*[x[k].alias(k) for k in key])

    return compare.once(F.sort_array(rows), lambda s: F.filter(s, lambda x, i: (i == 0) | ~of(x).eqNullSafe(of(F.get(s, i - 1)))))


def _told(person: Column, page: Column, rule: Column | str, severity: Column | str, field: Column | None = None) -> Column:
    rule, severity = (F.lit(x) if isinstance(x, str) else x for x in (rule, severity))
    return F.struct(person.alias("person"), page.alias("page_number"), (F.lit(None) if field is None else field).cast("string").alias("field"), rule.alias("rule_id"), severity.alias("severity"))


def _poor(ocr: Column) -> Column:
    return F.coalesce(ocr < LEAST_OCR, F.lit(False))


def _of_pages(rows: Column) -> Column:
    """Findings on the pages of a unit that are not there or cannot be read."""
    beyond = _firsts(F.transform(F.filter(rows, lambda r: ~r["_there"]), lambda r: F.struct(r["person"].alias("person"), r["page_number"].alias("page_number"))), "person", "page_number")
    documents = F.transform(F.filter(rows, lambda r: r["_there"]), lambda r: F.struct(r["document"].alias("document"), r["person"].alias("person"), (~r["_read"]).alias("_unread"), r["page_number"].alias("page_number")))
    unread = F.filter(_firsts(documents, "document", "person"), lambda d: d["_unread"])
    return F.concat(
        F.transform(beyond, lambda r: _told(r["person"], r["page_number"], "PAGE_OUT_OF_RANGE", "HIGH")),
        F.transform(unread, lambda r: _told(r["person"], r["page_number"], "DOCUMENT_NOT_READABLE", "HIGH")),
    )


def _of_field(field: Column, people: Column, expected: Column, seen: Column) -> Column:
    """Findings of a unit on one field: people are all trusted values of the case, expected those of the unit's persons, seen what its pages show."""
    name, key = F.upper(field), ("_any", "person", "_k")

    def absent(weak: Column) -> Column:
        def rule(e: Column) -> Column:
            none = F.when(_poor(e["_ocr"]), _told(e["person"], e["page_number"], "LOW_CONFIDENCE_PAGE", "LOW")).otherwise(_told(e["person"], e["page_number"], F.concat(name, F.lit("_NOT_FOUND")), "MEDIUM", field))
            return F.when(weak.isNotNull(), _told(e["person"], weak, F.concat(name, F.lit("_EXTRACTION_UNRELIABLE")), "LOW", field)).otherwise(none)

        return F.transform(expected, rule)

    def compared(v: Column) -> Column:
        same = compare.once(compare.prepared(field, v["value"]), lambda o: F.exists(expected, lambda e: compare.agree(field, e["_t"], o)))
        return F.struct(*[v[k].alias(k) for k in key], F.struct(v["page_number"].alias("page_number"), v["value"].alias("value"), v["_ocr"].alias("_ocr")).alias("_first"), (~same).alias("_wrong"))

    def differs(values: Column) -> Column:
        """Values (key, first place, whether wrong): equal but for case and blanks, they are one, right if one of them is."""
        right = F.transform(_firsts(F.transform(values, lambda v: F.struct(*[v[k].alias(k) for k in key], v["_wrong"].alias("_wrong"))), *key), lambda v: v["_wrong"])
        one = F.zip_with(_firsts(values, *key), right, lambda v, w: F.struct(v["_any"].alias("_any"), v["person"].alias("person"), v["_first"].alias("_first"), v["_k"].alias("_k"), w.alias("_wrong")))
        return compare.once(one, lambda found: compare.once(F.array_min(F.transform(F.filter(found, lambda v: v["_wrong"]), lambda v: F.struct(v["_first"].alias("_first"), v["_k"].alias("_k")))), lambda least: wrong(found, F.exists(found, lambda v: ~v["_wrong"]), least)))

    def wrong(found: Column, right: Column, least: Column) -> Column:
        def rule(v: Column) -> Column:
            k, first = text.compact(v["_first"]["value"]), v["_first"]
            other = F.coalesce(F.exists(people, lambda p: (p["_k"] == k) & ~p["person"].eqNullSafe(v["person"])), F.lit(False))
            sure = compare.once(other, lambda o: _told(v["person"], first["page_number"], F.when(o, "INDEX_MAPPING_SUSPECTED").otherwise(F.concat(name, F.lit("_MISMATCH"))), F.when(o | field.isin(*WEIGHTY), "HIGH").otherwise("MEDIUM"), field))
            return F.when(_poor(first["_ocr"]), _told(v["person"], first["page_number"], "LOW_CONFIDENCE_PAGE", "LOW")).otherwise(sure)

        return F.transform(F.filter(found, lambda v: v["_wrong"] & (~v["_any"] | (~right & (v["_k"] == least["_k"])))), rule)

    def judged(sure: Column) -> Column:
        weak = F.array_min(F.transform(F.filter(seen, lambda v: ~v["_sure"]), lambda v: v["page_number"]))
        return F.when(F.size(sure) == 0, compare.once(weak, absent)).otherwise(compare.once(F.transform(_firsts(sure, *key, "value"), compared), differs))

    return F.when(F.size(expected) > 0, compare.once(F.filter(seen, lambda v: v["_sure"]), judged)).otherwise(F.array())


def _of_values(rows: Column, known: Column, unit: Column) -> Column:
    """Findings on the values that the readable pages of a unit show, against trusted ones."""
    read = F.filter(rows, lambda r: r["_read"])
    persons = _firsts(F.transform(read, lambda r: F.struct(*[r[c].alias(c) for c in ("_any", "person", "page_number", "_ocr")])), "_any", "person")

    def shown(r: Column) -> Column:
        return F.transform(r["_values"], lambda v: F.struct(v["field"].alias("field"), r["_any"].alias("_any"), r["person"].alias("person"), F.upper(F.trim(v["value"])).alias("_k"), v["value"].alias("value"), r["page_number"].alias("page_number"), r["_ocr"].alias("_ocr"), v["_sure"].alias("_sure")))

    def expected(persons: Column, people: Column) -> Column:
        def trusted(u: Column) -> Column:
            return F.transform(F.filter(people, lambda p: ~p["_t"]["blank"] & (p["person"] == u["person"])), lambda p: F.struct(u["_any"].alias("_any"), u["person"].alias("person"), u["page_number"].alias("page_number"), u["_ocr"].alias("_ocr"), p["_t"].alias("_t")))

        return F.flatten(F.transform(persons, trusted))

    def all_fields(persons: Column, seen: Column) -> Column:
        return F.flatten(F.transform(known, lambda f: compare.once(expected(persons, f["_people"]), lambda e: compare.once(F.filter(seen, lambda v: v["field"] == f["field"]), lambda s: _of_field(f["field"], f["_people"], e, s)))))

    def low_once(found: Column) -> Column:
        return F.concat(F.filter(found, lambda x: ~x["rule_id"].eqNullSafe("LOW_CONFIDENCE_PAGE")), _firsts(F.filter(found, lambda x: x["rule_id"] == "LOW_CONFIDENCE_PAGE"), "person", "page_number"))

    seen = F.flatten(F.transform(F.filter(read, lambda r: unit.isNotNull()), shown))
    return compare.once(compare.once(persons, lambda p: compare.once(seen, lambda s: all_fields(p, s))), low_once)


def findings(mappings: DataFrame, pages: DataFrame, observed: DataFrame, trusted: DataFrame, case: list[str]) -> DataFrame:
    """(case, unit, person, page_number, field, rule_id, severity) by eight rules.

    mappings: case, document, person, document_type, required and a page_number,
    null for a document that has none. pages: case, page_number, is_readable, ocr_confidence.
    observed: case, page_number, field, value, reliable. trusted: case,
    person, field, trusted_value.

    DOCUMENT_MISSING: a required document without a page. PAGE_OUT_OF_RANGE: a
    mapped page that is not there. DOCUMENT_NOT_READABLE: none of a document's pages can be
    read. For each expected field of what can be read: <FIELD>_EXTRACTION_UNRELIABLE
    where all that was seen is unreliable, LOW_CONFIDENCE_PAGE (once a page and unit)
    where the text is too poor to tell, <FIELD>_NOT_FOUND, INDEX_MAPPING_SUSPECTED
    where a wrong value is another's of the case, else <FIELD>_MISMATCH. A unit is a document, of which every
    distinct value must be right, or all of a person's documents of a type of
    TOGETHER, of which one right value is enough and only the first wrong one is told.

    Mapped pages, pages and values of a case are sent to one task, once, and so are its trusted values, and all that
    follows stays there. What is mapped into one unit is a list, and so are the trusted values of a case, as its people are few.
    """
    kind = F.lower(F.trim("document_type"))
    rows = mappings.withColumn("_any", kind.isin(*TOGETHER)).withColumn("_kind", F.when(F.col("_any"), kind))
    unit = F.when(F.col("_any"), F.concat(F.lit("t:"), F.col("person"), F.lit(":"), F.col("_kind"))).otherwise(F.concat(F.lit("d:"), F.col("document").cast("string")))
    parts = int(mappings.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number of its own, as few bytes are long work here
    known = functools.reduce(operator.and_, [F.col(c).isNotNull() for c in case])
    placed = known & F.col("page_number").isNotNull()

    mapped = rows.where("page_number is not null").select(*case, "page_number", F.struct("person", "document", "_any", "_kind").alias("_map"))
    there = pages.where(placed).select(*case, "page_number", F.struct(F.coalesce("is_readable", F.lit(True)).alias("_readable"), F.col("ocr_confidence").alias("_ocr")).alias("_page"))
    shown = observed.where(placed & F.col("field").isNotNull() & ~compare.blank(F.col("value"))).select(*case, "page_number", F.struct("field", "value", F.coalesce("reliable", F.lit(False)).alias("_sure")).alias("_value"))
    sent = mapped.unionByName(there, allowMissingColumns=True).unionByName(shown, allowMissingColumns=True).repartition(parts, *case)
    met = sent.groupBy(*case, "page_number").agg(*[F.collect_set(c).alias(f"{c}s") for c in ("_map", "_page", "_value")])
    ocr = F.sort_array(F.transform(F.filter("_pages", lambda p: p["_readable"]), lambda p: p["_ocr"]))
    met = met.select(*case, "page_number", (F.size("_pages") > 0).alias("_there"), ocr.alias("_ocr"), "_values", F.explode("_maps").alias("_map")).select(*case, "page_number", "_there", "_ocr", "_values", "_map.*")
    row = F.struct("document", "person", "_any", "page_number", "_there", (F.size("_ocr") > 0).alias("_read"), F.try_element_at("_ocr", F.lit(1)).alias("_ocr"), F.when(F.size("_ocr") > 0, F.col("_values")).otherwise(F.array()).alias("_values"))
    units = met.groupBy(*case, unit.alias("unit")).agg(F.collect_list(row).alias("_rows"))

    held = trusted.where(known & F.col("person").isNotNull() & F.col("trusted_value").isNotNull()).select(*case, "person", "field", "trusted_value").repartition(parts, *case)
    value = F.col("trusted_value")
    held = held.groupBy(*case, "field").agg(F.collect_list(F.struct("person", text.compact(value).alias("_k"), compare.prepared(F.col("field"), value).alias("_t"))).alias("_people"))
    held = held.groupBy(*case).agg(F.collect_list(F.struct("field", "_people")).alias("_known"))

    found = F.concat(_of_pages(F.col("_rows")), F.when(F.col("_known").isNotNull(), _of_values(F.col("_rows"), F.col("_known"), F.col("unit"))).otherwise(F.array()))
    told = units.join(held, case, "left").select(*case, "unit", F.explode(found).alias("_f")).select(*case, "unit", "_f.*")
    missing = rows.where("page_number is null and required").select(*case, unit.alias("unit"), "person", "page_number", F.lit(None).cast("string").alias("field"), F.lit("DOCUMENT_MISSING").alias("rule_id"), F.lit("HIGH").alias("severity"))
    return missing.unionByName(told)
