"""Queries on consistency findings of case files, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import compare, text
from docketry.operators import consistency, gates
from docketry.plans import casefile
from docketry.plans.ownership_queries import _NAME, _compact, _distinct, _pairs, _words
from docketry.sources.tables import load

_O = "o_orderkey"
#: Pages with a text of their own, which says what the page shows, and now and then more.
_RELATED = f"CASE WHEN {_O} % 8 < 4 THEN {casefile.name(casefile.PAGES['app'] + ' * 4 + 121')} WHEN {_O} % 8 < 6 THEN {casefile.name('o_custkey + 3')} ELSE 'kishan rathod' END"
MORE = {
    **casefile.PAGES,
    "qualifier": casefile.word("S/O D/O W/O C/O", f"{_O} * 3"),
    "related": _RELATED,
    "body": f"concat(coalesce({casefile.PAGES['applicant_name']}, ''), ' ', coalesce({casefile.PAGES['address']}, ''), ' ', coalesce({casefile.PAGES['pan_number']}, ''), CASE {_O} % 9 WHEN 1 THEN ' CIBIL credit report score name range' WHEN 2 THEN ' score not available' WHEN 3 THEN ' declaration: one and the same person' WHEN 4 THEN ' आवेदक का नाम और पता तथा हस्ताक्षर' WHEN 5 THEN concat(' ', {casefile.name('o_custkey + 1')}) ELSE ' applicant and co-applicant details of the borrower' END)",
    "kind": f"CASE WHEN {_O} % 5 = 3 THEN 'Affidavit' ELSE 'Other' END",
}


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").selectExpr(*[f"{e} AS {n}" for n, e in MORE.items()])


def address_anchor_mismatches(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses of a person that differ from the longest on an identity paper of theirs."""
    rows = casefile.pages(spark, sf).select("app", F.col("subject").alias("person"), "page_number", "document_type", F.col("address").alias("value")).where("value is not null")
    found = consistency.address_anchor(rows, ["app", "person"], F.col("document_type").isin("Aadhaar", "PAN", "Utility Bill"), [F.length("value"), -F.col("page_number")], "value", "page_number", compare.same_address(F.col("anchor_value"), F.col("value")))
    return found.select("app", "person", "page_number", "anchor_at")


def relationship_findings(spark: SparkSession, sf: str) -> DataFrame:
    rows = _pages(spark, sf).where("document_type = 'Aadhaar'").select("app", F.col("subject").alias("person"), "page_number", "qualifier", "related")
    return consistency.relation_findings(rows, casefile.people(spark, sf), ["app"])


def application_name_findings(spark: SparkSession, sf: str) -> DataFrame:
    return consistency.missing_names(_pages(spark, sf), casefile.people(spark, sf), ["app"], F.col("document_type") == "Application Form", "applicant_name", "body", 600)


def bureau_score_findings(spark: SparkSession, sf: str) -> DataFrame:
    pages = _pages(spark, sf).where(F.col("document_type").isin("CIBIL Report", "CRIF Report"))
    return consistency.scoreless(pages, ["app", "document_type", "subject"], F.col("credit_score"), "body")


def second_language_findings(spark: SparkSession, sf: str) -> DataFrame:
    return consistency.second_language_missing(_pages(spark, sf), ["app"], F.col("document_type") == "Application Form", "body")


def _trusted_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Values of pages that differ from the trusted ones of the page's person and belong to no one else of the case."""
    fields = ("applicant_name", "date_of_birth", "pan_number")
    seen = casefile.unpivoted(casefile.pages(spark, sf), ["app", "subject", "page_number"], fields).withColumnRenamed("subject", "person")
    trusted = casefile.unpivoted(casefile.people(spark, sf), ["app", "person"], fields, "trusted_value")
    wrong = seen.where(~gates.garbage(F.col("field"), F.col("value"))).withColumn("_v", text.compact(F.col("value"))).join(trusted, ["app", "person", "field"]).where(~compare.matches(F.col("field"), F.col("trusted_value"), F.col("value")))
    theirs = trusted.select("app", "field", F.col("person").alias("_p"), text.compact(F.col("trusted_value")).alias("_v"))
    wrong = wrong.join(theirs, (wrong["app"] == theirs["app"]) & (wrong["field"] == theirs["field"]) & (wrong["_v"] == theirs["_v"]) & (wrong["person"] != theirs["_p"]), "left_anti")
    return wrong.select("app", "person", "field", "page_number", F.concat(F.lit("TRUSTED_"), F.upper("field"), F.lit("_MISMATCH")).alias("rule_id"), F.when(F.col("field") == "date_of_birth", "MEDIUM").otherwise("HIGH").alias("severity"))


def trusted_value_findings(spark: SparkSession, sf: str) -> DataFrame:
    return _trusted_findings(spark, sf)


def affidavit_findings(spark: SparkSession, sf: str) -> DataFrame:
    pages = _pages(spark, sf).select("app", F.col("subject").alias("person"), "kind", "body")
    return consistency.affidavits_missing(_trusted_findings(spark, sf), pages, ["app"], "kind").select("app", "person", "differs", "page_number")


def supporting_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Where the PAN of a page stands in text: there, in its source document, or not."""
    pages = _pages(spark, sf).withColumn("source_document_id", F.when(F.col("page_number") % 2 == 0, F.expr("concat('d', CAST(CAST(floor(page_number / 6000) AS BIGINT) AS STRING))")))
    rows = casefile.people(spark, sf).select("app", F.col("pan_number").alias("value")).join(pages, "app").select("app", "page_number", "source_document_id", "document_type", "value")
    return consistency.supporting_page(rows, pages, ["app"], "value", 4000).select("app", "page_number", "value", "support")


def nearby_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages within 600 numbers of a form of their case, by cells of numbers."""
    pages = casefile.pages(spark, sf).select("app", "page_number", "document_type")
    cells = pages.where("document_type = 'Application Form'").select("app", F.col("page_number").alias("f"), F.explode(F.sequence(F.floor(F.expr("(page_number - 600) / 600")), F.floor(F.expr("(page_number + 600) / 600")))).alias("cell"))
    rows = pages.withColumn("cell", F.floor(F.expr("page_number / 600"))).join(cells, ["app", "cell"]).where("abs(page_number - f) <= 600")
    return rows.select("app", "page_number").distinct()


def address_variant_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Observed addresses that agree with any address of the case's people."""
    seen = casefile.pages(spark, sf).select("app", "page_number", F.col("address").alias("value")).where("value is not null")
    known = casefile.people(spark, sf).groupBy("app").agg(F.collect_set("address").alias("variants"))
    rows = seen.join(known, "app", "left")
    return rows.select("page_number", F.coalesce(F.exists("variants", lambda a: compare.same_address(a, F.col("value"))), F.lit(False)).alias("any_match"))


def evidence_of_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Findings with what their page is and how well it was read."""
    pages = casefile.pages(spark, sf).select("page_number", "document_type", "page_type", "ocr_confidence")
    return _trusted_findings(spark, sf).join(pages, "page_number", "left").groupBy("rule_id", "document_type", "page_type").agg(F.count("*").alias("n"), F.round(F.min("ocr_confidence"), 4).alias("least_ocr"))


QUERIES = {
    f.__name__: f
    for f in (
        address_anchor_mismatches, relationship_findings, application_name_findings, bureau_score_findings, second_language_findings, trusted_value_findings, affidavit_findings, supporting_pages,
        nearby_pages, address_variant_matches, evidence_of_findings,
    )
}

_MORE_SQL = f"pages AS (SELECT {casefile.columns(MORE)} FROM orders)"


def _same(a: str, b: str) -> str:
    """Whether two names score 85 or more."""
    u, v = _distinct(_words(a)), _distinct(_words(b))
    return f"(SELECT {_NAME} FROM (SELECT {u} AS u, {v} AS v)) >= 85"


def _addresses(source: str) -> str:
    """m: source (t, x, ...) with same for addresses."""
    return _pairs(f"(SELECT *, 'address' AS field FROM {source})")


_BARE = "trim(regexp_replace(lower(applicant_name), '[^\\p{L}\\p{N}\\p{M}]+', ' ', 'g'))"
_VALID = f"(applicant_name IS NOT NULL AND NOT regexp_matches(applicant_name, '[0-9]') AND length({_BARE}) >= 3)"
_F3 = ("applicant_name", "date_of_birth", "pan_number")
_TRUSTED = f"""{casefile.PEOPLE_SQL}, {_MORE_SQL}, {casefile.unpivoted_sql("trusted", "people", ["app", "person"], _F3, "t")}, {casefile.unpivoted_sql("observed", "pages", ["app", "page_number", "subject AS person"], _F3, "x")},
    joined AS (SELECT app, page_number, person, field, t, x FROM observed JOIN trusted USING (app, person, field) WHERE NOT (x = 'Name' OR x LIKE 'XX%')), {_pairs("joined")},
    tf AS (SELECT app, person, field, page_number, 'TRUSTED_' || upper(field) || '_MISMATCH' AS rule_id, CASE WHEN field = 'date_of_birth' THEN 'MEDIUM' ELSE 'HIGH' END AS severity FROM m WHERE NOT same
        AND NOT EXISTS (SELECT 1 FROM trusted o WHERE o.app = m.app AND o.field = m.field AND o.person <> m.person AND {_compact("o.t")} = {_compact("m.x")}))"""
ORACLE_SQL = {
    "address_anchor_mismatches": f"""
        WITH {casefile.PAGES_SQL}, o AS (SELECT app, subject AS person, page_number, document_type, address AS x FROM pages WHERE address IS NOT NULL),
        b AS (SELECT app, person, x AS t, page_number AS anchor_at FROM o WHERE document_type IN ('Aadhaar', 'PAN', 'Utility Bill') QUALIFY row_number() OVER (PARTITION BY app, person ORDER BY length(x) DESC, page_number) = 1),
        j AS (SELECT o.app, o.person, page_number, anchor_at, t, x FROM o JOIN b ON o.app = b.app AND o.person = b.person WHERE page_number <> anchor_at), {_addresses("j")}
        SELECT app, person, page_number, anchor_at FROM m WHERE NOT same""",
    "relationship_findings": f"""
        WITH {casefile.PEOPLE_SQL}, {_MORE_SQL}, r AS (SELECT app, subject AS person, page_number, lower(qualifier) AS q, related FROM pages WHERE document_type = 'Aadhaar'),
        own AS (SELECT app, arg_min(related, page_number) AS primary_related FROM r WHERE person = 'p0' GROUP BY 1), pr AS (SELECT app, applicant_name AS primary_name FROM people WHERE person = 'p0'),
        j AS (SELECT r.*, p.relationship AS d, p.applicant_name, primary_name, primary_related FROM r JOIN people p ON r.app = p.app AND r.person = p.person LEFT JOIN pr ON r.app = pr.app LEFT JOIN own ON r.app = own.app),
        g AS (SELECT *, CASE WHEN d = 'father' AND primary_related IS NOT NULL THEN {_same("primary_related", "applicant_name")} WHEN d = 'son' THEN q IN ('s/o', 'd/o') AND {_same("related", "primary_name")} WHEN d = 'wife' THEN q = 'w/o' AND {_same("related", "primary_name")} ELSE true END AS good FROM j),
        n AS (SELECT DISTINCT g.app, g.page_number FROM g JOIN people k ON g.app = k.app WHERE {_same("k.applicant_name", "g.related")})
        SELECT app, person, page_number, 'RELATIONSHIP_QUALIFIER_MISMATCH' AS rule_id, 'HIGH' AS severity FROM g WHERE NOT coalesce(good, false)
        UNION ALL SELECT app, person, page_number, 'RELATIONSHIP_NAME_REVIEW', 'LOW' FROM g WHERE d IN ('wife', 'son') AND NOT EXISTS (SELECT 1 FROM n WHERE n.app = g.app AND n.page_number = g.page_number)""",
    "application_name_findings": f"""
        WITH {casefile.PEOPLE_SQL}, {_MORE_SQL}, f AS (SELECT * FROM pages WHERE document_type = 'Application Form'),
        c AS (SELECT DISTINCT p.app, p.page_number, {_compact("p.body")} AS b FROM pages p JOIN f ON p.app = f.app AND abs(p.page_number - f.page_number) <= 600),
        s AS (SELECT app, min(page_number) AS page_number, string_agg(DISTINCT applicant_name, ', ' ORDER BY applicant_name) FILTER ({_VALID}) AS names, bool_or(applicant_name IS NOT NULL AND NOT {_VALID}) AS noise FROM f GROUP BY 1)
        SELECT k.app, person, s.page_number, coalesce(names, 'Name not extracted') AS found_value FROM people k JOIN s ON k.app = s.app
        WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.app = k.app AND contains(c.b, {_compact("k.applicant_name")}))
          AND NOT EXISTS (SELECT 1 FROM f WHERE f.app = k.app AND {_VALID.replace("applicant_name", "f.applicant_name")} AND {_same("k.applicant_name", "f.applicant_name")}) AND (names IS NOT NULL OR NOT noise)""",
    "bureau_score_findings": f"""
        WITH {_MORE_SQL}, p AS (SELECT *, TRY_CAST(regexp_replace(credit_score, '[^0-9.-]', '', 'g') AS DOUBLE) AS v FROM pages WHERE document_type IN ('CIBIL Report', 'CRIF Report'))
        SELECT app, document_type, subject, coalesce(min(page_number) FILTER (credit_score IS NOT NULL), min(page_number) FILTER (body LIKE '%score name%')) AS page_number,
               coalesce(arg_min(credit_score, page_number) FILTER (credit_score IS NOT NULL), 'Blank score table') AS found_value FROM p GROUP BY ALL
        HAVING NOT bool_or(coalesce(v = 0 OR v BETWEEN 300 AND 900, false) OR body LIKE '%score not available%') AND (count(credit_score) > 0 OR count(*) FILTER (body LIKE '%score name%') > 0)""",
    "second_language_findings": f"""
        WITH {_MORE_SQL}, c AS (SELECT app, min(page_number) AS page_number, sum(len(regexp_extract_all(body, '[A-Za-zÀ-ɏ]'))) AS l, sum(len(regexp_extract_all(body, '[ऀ-ॿ]'))) AS d FROM pages WHERE document_type = 'Application Form' GROUP BY 1)
        SELECT app, page_number, CASE WHEN l >= 20 THEN 'latin' ELSE 'devanagari' END AS scripts FROM c WHERE (l >= 20) <> (d >= 20)""",
    "trusted_value_findings": f"WITH {_TRUSTED} SELECT * FROM tf",
    "affidavit_findings": f"""
        WITH {_TRUSTED}, g AS (SELECT app, person, string_agg(DISTINCT CASE WHEN rule_id LIKE '%DATE_OF_BIRTH%' THEN 'DOB' ELSE 'name' END, ' and ' ORDER BY CASE WHEN rule_id LIKE '%DATE_OF_BIRTH%' THEN 'DOB' ELSE 'name' END) AS differs, min(page_number) AS page_number FROM tf WHERE field <> 'pan_number' GROUP BY 1, 2)
        SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE p.app = g.app AND p.subject = g.person AND kind = 'Affidavit' AND body LIKE '%one and the same person%')""",
    "supporting_pages": f"""
        WITH {casefile.PEOPLE_SQL}, {_MORE_SQL}, p AS (SELECT app, page_number, document_type, {_compact("body")} AS b, CASE WHEN page_number % 2 = 0 THEN 'd' || CAST(CAST(floor(page_number / 6000) AS BIGINT) AS VARCHAR) END AS d FROM pages),
        o AS (SELECT p.app, page_number, document_type, d, pan_number AS value FROM people k JOIN p ON k.app = p.app)
        SELECT o.app, o.page_number, o.value, coalesce(arg_min(p.page_number, CASE WHEN p.page_number = o.page_number THEN -1 ELSE p.page_number END), o.page_number) AS support
        FROM o LEFT JOIN p ON p.app = o.app AND contains(p.b, lower(o.value)) AND ((o.d IS NOT NULL AND p.d = o.d) OR (o.d IS NULL AND p.document_type = o.document_type AND abs(p.page_number - o.page_number) <= 4000)) GROUP BY o.app, o.page_number, o.value""",
    "nearby_pages": f"""
        WITH {casefile.PAGES_SQL} SELECT app, page_number FROM pages p WHERE EXISTS (SELECT 1 FROM pages f WHERE f.app = p.app AND f.document_type = 'Application Form' AND abs(f.page_number - p.page_number) <= 600)""",
    "address_variant_matches": f"""
        WITH {casefile.PEOPLE_SQL}, {casefile.PAGES_SQL}, j AS (SELECT page_number, p.address AS x, k.address AS t FROM pages p LEFT JOIN people k ON p.app = k.app WHERE p.address IS NOT NULL), {_addresses("j")}
        SELECT page_number, coalesce(bool_or(same AND t IS NOT NULL), false) AS any_match FROM m GROUP BY 1""",
    "evidence_of_findings": f"""
        WITH {_TRUSTED} SELECT rule_id, document_type, page_type, count(*) AS n, round(min(ocr_confidence), 4) AS least_ocr FROM tf JOIN pages USING (page_number) GROUP BY ALL""",
}
