"""Queries on who owns a page, and on what its fields tell against trusted values, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import compare, text
from docketry.operators import mapped, ownership
from docketry.plans import casefile

_CASE, _PAGE = ["app"], ["page_number"]


def _trusted(spark: SparkSession, sf: str) -> DataFrame:
    return casefile.unpivoted(casefile.people(spark, sf), ["app", "person"], casefile.TRUSTED, "trusted_value")


def _observed(spark: SparkSession, sf: str, *keep: str) -> DataFrame:
    return casefile.unpivoted(casefile.pages(spark, sf), ["app", "page_number", *keep], casefile.FIELDS)


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    return ownership.scores(_observed(spark, sf), _trusted(spark, sf), _CASE, _PAGE, relations=False)


def page_owner_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Score and evidence of each person of the case for each page."""
    return _scores(spark, sf).select("app", "page_number", "person", "score", F.array_join("evidence", ",").alias("evidence"))


def page_owners(spark: SparkSession, sf: str) -> DataFrame:
    """The owner of each page, if one person scores best."""
    rows = ownership.owners(_scores(spark, sf), [*_CASE, *_PAGE])
    return rows.select("app", "page_number", "owner", "best", F.col("second").cast("bigint").alias("second"), "confidence", F.array_join("evidence", ",").alias("evidence"))


def owner_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Identity pages without an owner, or with a weak one."""
    owned = ownership.owners(_scores(spark, sf), [*_CASE, *_PAGE])
    scoped = F.col("document_type").isin("PAN", "Aadhaar", "Bank Statement", "Passbook", "Cheque")
    return ownership.findings(casefile.pages(spark, sf).select("app", "page_number", "document_type"), owned, [*_CASE, *_PAGE], scoped).select("app", "page_number", "rule_id", "severity")


def source_document_votes(spark: SparkSession, sf: str) -> DataFrame:
    """Type and owner of each source document by its pages' votes."""
    pages = casefile.pages(spark, sf).select("app", "page_number", "source_document_id", F.nullif("document_type", F.lit("Unknown")).alias("document_type"))
    owned = ownership.owners(_scores(spark, sf), [*_CASE, *_PAGE]).select("app", "page_number", "owner")
    rows, keys = pages.join(owned, ["app", "page_number"], "left"), ["app", "source_document_id"]
    known = F.col("app").isNotNull() & F.col("source_document_id").isNotNull()
    rows = ownership.votes(rows.select(*keys, *[F.when(known, F.col(c)).alias(c) for c in ("document_type", "owner")]), keys, ["document_type", "owner"])
    of_type, of_owner = F.col("document_type"), F.col("owner")
    return rows.select(*keys, F.col("rows").alias("pages"), F.coalesce(of_type["winner"], F.lit("Unknown")).alias("document_type"), of_type["votes"].alias("type_votes"), of_owner["winner"].alias("owner"), of_owner["votes"].alias("owner_votes"))


def _compared(spark: SparkSession, sf: str) -> DataFrame:
    """Observations of pages against the trusted values of the person that they are filed under."""
    observed = _observed(spark, sf, "subject", "document_type", "classification_confidence").withColumnRenamed("subject", "person")
    rows = observed.withColumn("_o", compare.prepared(F.col("field"), F.col("value"))).join(_trusted(spark, sf).withColumn("_t", compare.prepared(F.col("field"), F.col("trusted_value"))), ["app", "person", "field"])
    clear = F.col("classification_confidence") >= 0.6
    same = compare.agree(F.col("field"), F.col("_t"), F.col("_o"))
    status = F.when(~clear, "EXTRACTION_UNRELIABLE").when(same, "MATCH").otherwise("MISMATCH")
    return rows.withColumn("status", status).drop("_o", "_t")


def mapped_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Field mismatches, unreliable fields, and fields that no page of a person shows, with who else has a wrong value."""
    rows = _compared(spark, sf)
    key = F.when(F.col("field").isin("phone_number", "pin_code"), text.digits(F.col("value"))).otherwise(F.upper(F.trim("value")))
    owner = _trusted(spark, sf).select("app", "field", F.upper(F.trim("trusted_value")).alias("_k"), F.col("person").alias("_p"))
    owner = owner.groupBy("app", "field", "_k").agg(F.min("_p").alias("_p"))
    wrong = rows.where("status <> 'MATCH'").withColumn("_k", key).join(owner, ["app", "field", "_k"], "left")
    found = wrong.select("app", "person", "field", "page_number", F.concat(F.upper("field"), F.lit("_"), F.col("status")).alias("rule_id"), F.when((F.col("status") == "MISMATCH") & (F.col("_p") != F.col("person")), F.col("_p")).alias("matched_person"))
    seen = _observed(spark, sf, "subject").select("app", F.col("subject").alias("person"), "field").distinct()
    none = _trusted(spark, sf).join(seen, ["app", "person", "field"], "left_anti")
    none = none.select("app", "person", "field", F.lit(None).cast("bigint").alias("page_number"), F.concat(F.upper("field"), F.lit("_NOT_FOUND")).alias("rule_id"), F.lit(None).cast("string").alias("matched_person"))
    return found.unionByName(none)


_FIELDS4 = ("pan_number", "phone_number", "applicant_name", "pin_code")
#: Documents are the pages of a type of a person in a source; some map a page that is not there, and each person should have a title deed.
_MAPPED = {"app": "app", "document": "concat(source_document_id, '/', subject, '/', document_type)", "person": "subject", "document_type": "document_type", "required": "true", "page_number": "page_number"}


def mapped_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Findings on the documents that a manifest maps to persons and pages, by eight rules."""
    pages, people = casefile.pages(spark, sf), casefile.people(spark, sf)
    maps = pages.selectExpr(*[f"{e} AS {n}" for n, e in _MAPPED.items()])
    far = pages.where("page_number % 50 = 0").selectExpr(*[f"{'page_number + 100000000' if n == 'page_number' else e} AS {n}" for n, e in _MAPPED.items()])
    deeds = people.selectExpr("app", "concat('deed/', person) AS document", "person", "'Title Deed' AS document_type", "income_earner AS required", "CAST(NULL AS BIGINT) AS page_number")
    seen = casefile.unpivoted(pages, ["app", "page_number", "classification_confidence"], _FIELDS4).withColumn("reliable", (F.col("value") != "Name") & (F.col("classification_confidence") >= 0.3))
    trusted = casefile.unpivoted(people, ["app", "person"], _FIELDS4, "trusted_value")
    return mapped.findings(maps.unionByName(far).unionByName(deeds), pages.select("app", "page_number", "is_readable", "ocr_confidence"), seen, trusted, ["app"])


def people_document_status(spark: SparkSession, sf: str) -> DataFrame:
    """Status of each person and document type, and of each person over all types."""
    pages = casefile.pages(spark, sf).select("app", F.col("subject").alias("person"), "document_type", "page_number")
    seen = _compared(spark, sf).where("status <> 'EXTRACTION_UNRELIABLE'").groupBy("app", "person", "document_type").agg(F.count("*").alias("observations"), F.count_if(F.col("status") == "MISMATCH").alias("anomalies"))
    rows = pages.groupBy("app", "person", "document_type").agg(F.count("*").alias("pages")).join(seen, ["app", "person", "document_type"], "left").fillna(0, ["observations", "anomalies"])
    rows = rows.withColumn("status", F.when(F.col("anomalies") > 0, "NEEDS_REVIEW").when(F.col("observations") > 0, "MATCH").otherwise("NOT_CHECKED"))
    whole = rows.groupBy("app", "person").agg(F.bool_or(F.col("status") == "NEEDS_REVIEW").alias("_r"), F.bool_and(F.col("status") == "MATCH").alias("_m"))
    whole = whole.select("app", "person", F.when(F.col("_r"), "NEEDS_REVIEW").when(F.col("_m"), "MATCH").otherwise("NOT_CHECKED").alias("person_status"))
    return rows.join(whole, ["app", "person"])


def verification_report(spark: SparkSession, sf: str) -> DataFrame:
    """For each case and field: how many of the people match, and whether any needs review: no match, a mismatch, or no match on a page of a confidence of 0.75."""
    rows = _compared(spark, sf).groupBy("app", "person", "field").agg(F.bool_or(F.col("status") == "MATCH").alias("ok"), F.bool_or(F.col("status") == "MISMATCH").alias("bad"), F.max(F.when(F.col("status") == "MATCH", F.col("classification_confidence"))).alias("sure"))
    per = rows.groupBy("app", "field").agg(F.count("*").alias("people"), F.count_if("ok").alias("matched"), F.bool_or(~F.col("ok") | F.col("bad") | (F.coalesce("sure", F.lit(0.0)) < 0.75)).alias("needs_review"))
    return per.withColumn("match_percentage", F.round(100 * F.col("matched") / F.col("people"), 1))


def merged_person_records(spark: SparkSession, sf: str) -> DataFrame:
    """Fields of pages merged into persons by the best identifier that a page shows."""
    pages = casefile.pages(spark, sf).select("app", "page_number", "pan_number", "phone_number", "account_number", "date_of_birth", "pin_code")
    return ownership.merged_records(pages, ["app"], ["pan_number", "account_number", "phone_number"], "page_number", ["pan_number", "phone_number", "date_of_birth", "pin_code"])


def typed_comparisons(spark: SparkSession, sf: str) -> DataFrame:
    """How observations of each field agree with the trusted value of the page's person."""
    rows = _observed(spark, sf, "subject").withColumnRenamed("subject", "person").join(_trusted(spark, sf), ["app", "person", "field"])
    return rows.select("page_number", "field", compare.matches(F.col("field"), F.col("trusted_value"), F.col("value")).alias("same"))


QUERIES = {f.__name__: f for f in (page_owner_scores, page_owners, owner_findings, source_document_votes, mapped_findings, mapped_documents, people_document_status, verification_report, merged_person_records, typed_comparisons)}

_TITLES = ", ".join(f"'{t}'" for t in compare.TITLES)


def _words(c: str) -> str:
    low = f"regexp_replace(lower({c}), '([a-z])({compare.ENDINGS})\\b', '\\1 \\2', 'g')"
    return f"list_filter(regexp_extract_all({low}, '[a-z]+'), lambda w: w NOT IN ({_TITLES}))"


def _distinct(c: str) -> str:
    """list_distinct that keeps the order."""
    return f"list_filter({c}, lambda w, i: list_position({c}, w) = i)"


def _compact(c: str) -> str:
    return f"regexp_replace(lower({c}), '[^a-z0-9]', '', 'g')"


#: Score of two names by the same tiers, over columns u and v of their words.
_NAME = """CASE WHEN len(u) = 0 OR len(v) = 0 THEN 0 WHEN (len(u) = len(v) AND len(list_intersect(u, v)) = len(u)) OR array_to_string(u, '') = array_to_string(v, '') THEN 100
    WHEN (len(u) <= len(v) AND u = v[1:len(u)]) OR (len(v) < len(u) AND v = u[1:len(v)]) THEN 95
    WHEN length(array_to_string(u, '')) >= 4 AND (contains(array_to_string(u, ''), array_to_string(v, '')) OR contains(array_to_string(v, ''), array_to_string(u, ''))) THEN 90
    ELSE round(100 * (1 - levenshtein(array_to_string(list_sort(u), ' '), array_to_string(list_sort(v), ' ')) / greatest(length(array_to_string(list_sort(u), ' ')), length(array_to_string(list_sort(v), ' ')))::DOUBLE), 1) END"""
_ADDR = f"list_distinct(regexp_extract_all(lower({{0}}), '[a-z0-9]+'))"
_TELL = "list_filter({0}, lambda w: NOT list_contains([" + ", ".join(f"'{t}'" for t in compare.COMMON_PLACES) + "], w) AND length(w) >= 3 AND NOT regexp_full_match(w, '[1-8][0-9]{{5}}'))"
#: The made addresses name a unit only at their beginning, and a PIN code only at their end.
_UNIT = "regexp_replace(regexp_extract(lower({0}), '^\\s*([a-z]\\s*[-/]?\\s*[0-9]{{1,5}}[a-z]?)\\b', 1), '[^a-z0-9]', '', 'g')"
_PINS = "regexp_extract({0}, '\\b[1-8][0-9]{{5}}\\b')"


def _pairs(source: str) -> str:
    """source (field, t: trusted, v: value, ...) with same: whether they agree."""
    addr = f"""(CASE WHEN {_UNIT.format("t")} <> '' AND {_UNIT.format("x")} <> '' AND {_UNIT.format("t")} <> {_UNIT.format("x")} THEN false
        WHEN least(len(a), len(b)) >= 2 AND len(list_intersect(a, b)) = least(len(a), len(b)) THEN true
        WHEN {_PINS.format("t")} <> '' AND {_PINS.format("t")} = {_PINS.format("x")} AND len(list_intersect(a, b)) >= 5 AND len(list_intersect(a, b)) >= 0.75 * least(len(a), len(b)) THEN true
        WHEN {_UNIT.format("t")} <> '' AND {_UNIT.format("t")} = {_UNIT.format("x")} AND len({_TELL.format("list_intersect(a, b)")}) >= 2 THEN true
        WHEN {_PINS.format("t")} <> '' AND {_PINS.format("t")} = {_PINS.format("x")} AND len({_TELL.format("list_intersect(a, b)")}) >= 2 THEN true
        WHEN len(list_intersect(a, b)) >= 0.7 * len(list_distinct(list_concat(a, b))) THEN true
        ELSE 1 - levenshtein({_compact("t")}, {_compact("x")}) / greatest(length({_compact("t")}), length({_compact("x")}))::DOUBLE >= 0.82 END)"""
    ct, cx = _compact("t"), _compact("x")
    masked = "(regexp_full_match(regexp_replace(t, '[ -]', '', 'g'), '[xX*#•]+[0-9]{4}') OR regexp_full_match(regexp_replace(x, '[ -]', '', 'g'), '[xX*#•]+[0-9]{4}'))"
    return f"""w AS (SELECT *, {_distinct(_words("t"))} AS u, {_distinct(_words("x"))} AS v, {_ADDR.format("t")} AS a, {_ADDR.format("x")} AS b FROM {source}),
    m AS (SELECT *, CASE WHEN trim(t) = '' OR trim(x) = '' THEN true WHEN field = 'applicant_name' THEN {_NAME} >= 85 WHEN field = 'address' THEN {addr}
        WHEN field = 'date_of_birth' AND TRY_CAST(t AS DATE) IS NOT NULL AND TRY_CAST(x AS DATE) IS NOT NULL THEN TRY_CAST(t AS DATE) = TRY_CAST(x AS DATE)
        WHEN field = 'account_number' THEN {ct} = {cx} OR (length({ct}) >= 4 AND length({cx}) >= 4 AND (least(length({ct}), length({cx})) = 4 OR {masked}) AND right({ct}, 4) = right({cx}, 4))
        WHEN field IN ('pan_number', 'phone_number', 'pin_code') THEN {ct} = {cx}
        ELSE 1 - levenshtein({ct}, {cx}) / greatest(length({ct}), length({cx}))::DOUBLE >= 0.88 END AS same FROM w)"""


_T = casefile.unpivoted_sql("trusted", "people", ["app", "person"], casefile.TRUSTED, "t")
_W = "CASE field " + " ".join(f"WHEN '{f}' THEN {w}" for f, w in ownership.WEIGHTS.items()) + " END"
_SCORED = f"""{casefile.PEOPLE_SQL}, {casefile.PAGES_SQL}, {_T}, {casefile.unpivoted_sql("observed", "pages", ["app", "page_number"], casefile.FIELDS, "x")},
    joined AS (SELECT app, page_number, person, field, t, x FROM observed JOIN trusted USING (app, field)), {_pairs("joined")},
    told AS (SELECT DISTINCT app, page_number, person, field FROM m WHERE same),
    scores AS (SELECT app, page_number, person, CAST(sum({_W}) AS BIGINT) AS score, string_agg(field, ',' ORDER BY field) AS evidence FROM told GROUP BY ALL)"""
_OWNERS = f"""{_SCORED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY app, page_number ORDER BY score DESC, person DESC) AS place, coalesce(lead(score) OVER (PARTITION BY app, page_number ORDER BY score DESC, person DESC), 0) AS second FROM scores),
    owners AS (SELECT app, page_number, CASE WHEN score > second THEN person END AS owner, score AS best, second, CASE WHEN score > second THEN round(least(1.0::DOUBLE, 0.45::DOUBLE + score / 12::DOUBLE), 3) ELSE 0 END AS confidence,
               CASE WHEN score > second THEN evidence ELSE '' END AS evidence FROM ranked WHERE place = 1)"""
_COMPARED = f"""{casefile.PEOPLE_SQL}, {casefile.PAGES_SQL}, {_T}, {casefile.unpivoted_sql("observed", "pages", ["app", "page_number", "subject AS person", "document_type", "classification_confidence"], casefile.FIELDS, "x")},
    joined AS (SELECT app, page_number, person, document_type, classification_confidence, field, t, x FROM observed JOIN trusted USING (app, person, field)), {_pairs("joined")},
    c AS (SELECT *, CASE WHEN classification_confidence < 0.6 THEN 'EXTRACTION_UNRELIABLE' WHEN same THEN 'MATCH' ELSE 'MISMATCH' END AS status FROM m)"""
ORACLE_SQL = {
    "page_owner_scores": f"WITH {_SCORED} SELECT * FROM scores",
    "page_owners": f"WITH {_OWNERS} SELECT * FROM owners",
    "owner_findings": f"""
        WITH {_OWNERS} SELECT p.app, p.page_number, CASE WHEN owner IS NULL THEN 'AUTO_OWNER_UNRESOLVED' ELSE 'AUTO_OWNER_LOW_CONFIDENCE' END AS rule_id, 'LOW' AS severity
        FROM pages p LEFT JOIN owners o ON p.app = o.app AND p.page_number = o.page_number
        WHERE document_type IN ('PAN', 'Aadhaar', 'Bank Statement', 'Passbook', 'Cheque') AND (owner IS NULL OR confidence < 0.65)""",
    "source_document_votes": f"""
        WITH {_OWNERS}, r AS (SELECT p.app, source_document_id AS d, nullif(document_type, 'Unknown') AS ty, owner FROM pages p LEFT JOIN owners o ON p.app = o.app AND p.page_number = o.page_number),
        ty AS (SELECT app, d, ty, count(*) AS n FROM r WHERE ty IS NOT NULL GROUP BY app, d, ty QUALIFY row_number() OVER (PARTITION BY app, d ORDER BY count(*) DESC, ty) = 1),
        ow AS (SELECT app, d, owner, count(*) AS n FROM r WHERE owner IS NOT NULL GROUP BY app, d, owner QUALIFY row_number() OVER (PARTITION BY app, d ORDER BY count(*) DESC, owner) = 1)
        SELECT g.app, g.d AS source_document_id, g.pages, coalesce(ty.ty, 'Unknown') AS document_type, coalesce(ty.n, 0) AS type_votes, ow.owner, coalesce(ow.n, 0) AS owner_votes
        FROM (SELECT app, d, count(*) AS pages FROM r GROUP BY ALL) g LEFT JOIN ty ON g.app = ty.app AND g.d = ty.d LEFT JOIN ow ON g.app = ow.app AND g.d = ow.d""",
    "mapped_findings": f"""
        WITH {_COMPARED}, o AS (SELECT app, field, upper(trim(t)) AS k, min(person) AS p FROM trusted GROUP BY ALL)
        SELECT c.app, c.person, c.field, page_number, upper(c.field) || '_' || status AS rule_id, CASE WHEN status = 'MISMATCH' AND p <> c.person THEN p END AS matched_person
        FROM c LEFT JOIN o ON c.app = o.app AND c.field = o.field AND o.k = CASE WHEN c.field IN ('phone_number', 'pin_code') THEN regexp_replace(x, '[^0-9]', '', 'g') ELSE upper(trim(x)) END WHERE status <> 'MATCH'
        UNION ALL SELECT app, person, field, NULL, upper(field) || '_NOT_FOUND', NULL FROM trusted t WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.app = t.app AND c.person = t.person AND c.field = t.field)""",
    "mapped_documents": f"""
        WITH {casefile.PEOPLE_SQL}, {casefile.PAGES_SQL}, {casefile.unpivoted_sql("trusted", "people", ["app", "person"], _FIELDS4, "t")}, {casefile.unpivoted_sql("observed", "pages", ["app", "page_number", "classification_confidence"], _FIELDS4, "x")},
        maps AS (SELECT {casefile.columns(_MAPPED)} FROM pages UNION ALL SELECT {casefile.columns(_MAPPED | {"page_number": "page_number + 100000000"})} FROM pages WHERE page_number % 50 = 0
            UNION ALL SELECT app, 'deed/' || person, person, 'Title Deed', income_earner, NULL FROM people),
        r AS (SELECT m.*, lower(m.document_type) IN ({", ".join(repr(x) for x in mapped.TOGETHER)}) AS anyone, CASE WHEN lower(m.document_type) IN ({", ".join(repr(x) for x in mapped.TOGETHER)}) THEN 't:' || m.person || ':' || lower(m.document_type) ELSE 'd:' || m.document END AS unit,
            p.page_number IS NOT NULL AS there, p.is_readable AS readable, p.ocr_confidence AS ocr FROM maps m LEFT JOIN pages p ON m.app = p.app AND m.page_number = p.page_number),
        legible AS (SELECT DISTINCT app, unit, anyone, person, page_number, ocr FROM r WHERE there AND readable), units AS (SELECT app, unit, anyone, person, min(page_number) AS page_number, arg_min(coalesce(ocr, 1.0::DOUBLE), page_number) AS ocr FROM legible GROUP BY ALL),
        expected AS (SELECT u.*, field, t FROM units u JOIN trusted USING (app, person)), seen AS (SELECT l.*, field, x, x <> 'Name' AND classification_confidence >= 0.3 AS reliable FROM legible l JOIN observed o ON l.app = o.app AND l.page_number = o.page_number WHERE trim(x) <> ''),
        none AS (SELECT e.*, (SELECT min(s.page_number) FROM seen s WHERE s.app = e.app AND s.unit = e.unit AND s.field = e.field AND NOT reliable) AS weak FROM expected e WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.app = e.app AND s.unit = e.unit AND s.field = e.field AND reliable)),
        joined AS (SELECT s.app, s.unit, s.anyone, s.person, s.page_number, s.ocr, s.field, e.t, s.x FROM seen s JOIN expected e ON s.app = e.app AND s.unit = e.unit AND s.field = e.field WHERE reliable), {_pairs("joined")},
        v AS (SELECT app, unit, anyone, person, field, upper(trim(x)) AS k, min({{'page_number': page_number, 'x': x, 'ocr': ocr}}) AS f, bool_or(same) AS same FROM m GROUP BY ALL),
        q AS (SELECT *, bool_or(same) OVER (PARTITION BY app, unit, field) AS good, row_number() OVER (PARTITION BY app, unit, field, same ORDER BY f, k) AS no FROM v),
        wrong AS (SELECT *, coalesce(f.ocr < 0.55, false) AS poor, EXISTS (SELECT 1 FROM trusted o WHERE o.app = q.app AND o.field = q.field AND o.person <> q.person AND {_compact("o.t")} = {_compact("q.f.x")}) AS theirs FROM q WHERE NOT same AND (NOT anyone OR (NOT good AND no = 1)))
        SELECT app, unit, person, page_number, NULL AS field, 'DOCUMENT_MISSING' AS rule_id, 'HIGH' AS severity FROM r WHERE page_number IS NULL AND required
        UNION ALL SELECT DISTINCT app, unit, person, page_number, NULL, 'PAGE_OUT_OF_RANGE', 'HIGH' FROM r WHERE page_number IS NOT NULL AND NOT there
        UNION ALL SELECT app, unit, person, min(page_number), NULL, 'DOCUMENT_NOT_READABLE', 'HIGH' FROM r WHERE there GROUP BY app, document, unit, person HAVING NOT bool_or(readable)
        UNION ALL SELECT app, unit, person, coalesce(weak, page_number), field, upper(field) || CASE WHEN weak IS NOT NULL THEN '_EXTRACTION_UNRELIABLE' ELSE '_NOT_FOUND' END, CASE WHEN weak IS NOT NULL THEN 'LOW' ELSE 'MEDIUM' END FROM none WHERE weak IS NOT NULL OR ocr >= 0.55
        UNION ALL SELECT app, unit, person, f.page_number, field, CASE WHEN theirs THEN 'INDEX_MAPPING_SUSPECTED' ELSE upper(field) || '_MISMATCH' END, CASE WHEN theirs OR field = 'pan_number' THEN 'HIGH' ELSE 'MEDIUM' END FROM wrong WHERE NOT poor
        UNION ALL SELECT DISTINCT app, unit, person, page_number, NULL, 'LOW_CONFIDENCE_PAGE', 'LOW' FROM (SELECT app, unit, person, page_number FROM none WHERE weak IS NULL AND ocr < 0.55 UNION ALL SELECT app, unit, person, f.page_number FROM wrong WHERE poor)""",
    "people_document_status": f"""
        WITH {_COMPARED}, s AS (SELECT app, person, document_type, count(*) AS observations, count(*) FILTER (status = 'MISMATCH') AS anomalies FROM c WHERE status <> 'EXTRACTION_UNRELIABLE' GROUP BY ALL),
        r AS (SELECT p.app, p.person, p.document_type, pages, coalesce(observations, 0) AS observations, coalesce(anomalies, 0) AS anomalies,
                     CASE WHEN anomalies > 0 THEN 'NEEDS_REVIEW' WHEN observations > 0 THEN 'MATCH' ELSE 'NOT_CHECKED' END AS status
              FROM (SELECT app, subject AS person, document_type, count(*) AS pages FROM pages GROUP BY ALL) p LEFT JOIN s ON p.app = s.app AND p.person = s.person AND p.document_type = s.document_type)
        SELECT *, CASE WHEN bool_or(status = 'NEEDS_REVIEW') OVER w THEN 'NEEDS_REVIEW' WHEN bool_and(status = 'MATCH') OVER w THEN 'MATCH' ELSE 'NOT_CHECKED' END AS person_status FROM r WINDOW w AS (PARTITION BY app, person)""",
    "verification_report": f"""
        WITH {_COMPARED}, r AS (SELECT app, person, field, bool_or(status = 'MATCH') AS ok, bool_or(status = 'MISMATCH') AS bad, max(classification_confidence) FILTER (status = 'MATCH') AS sure FROM c GROUP BY ALL)
        SELECT app, field, count(*) AS people, count(*) FILTER (ok) AS matched, bool_or(NOT ok OR bad OR coalesce(sure, 0) < 0.75) AS needs_review, round(100 * count(*) FILTER (ok) / count(*)::DOUBLE, 1) AS match_percentage FROM r GROUP BY ALL""",
    "merged_person_records": f"""
        WITH {casefile.PAGES_SQL}, r AS (SELECT *, coalesce('pan_number:' || {_compact("pan_number")}, 'account_number:' || {_compact("account_number")}, 'phone_number:' || {_compact("phone_number")}) AS identity FROM pages)
        SELECT app, identity, count(*) AS records, arg_min(pan_number, page_number) FILTER (pan_number IS NOT NULL) AS pan_number, arg_min(phone_number, page_number) FILTER (phone_number IS NOT NULL) AS phone_number,
               arg_min(date_of_birth, page_number) FILTER (date_of_birth IS NOT NULL) AS date_of_birth, arg_min(pin_code, page_number) FILTER (pin_code IS NOT NULL) AS pin_code
        FROM r WHERE identity IS NOT NULL GROUP BY ALL""",
    "typed_comparisons": f"WITH {_COMPARED} SELECT page_number, field, same FROM c",
}
