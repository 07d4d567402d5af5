"""Queries on gates, identifiers, names and addresses, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import compare, identifiers
from docketry.operators import gates
from docketry.plans import casefile
from docketry.plans.ownership_queries import _NAME, _compact, _distinct, _words
from docketry.sources.tables import load

#: Types that may carry a field.
_ALLOWED = {"pan_number": ("pan", "bank statement", "application form", "cibil report"), "applicant_name": ("pan", "aadhaar", "bank statement", "application form", "passbook", "cheque"), "credit_score": None}
_BODY = "CASE o_orderkey % 6 WHEN 0 THEN 'Income Tax Department ABCPD1234F' WHEN 1 THEN 'Statement of account, opening balance' WHEN 2 THEN 'CIBIL credit report score 712' WHEN 3 THEN 'savings bank passbook' WHEN 4 THEN 'pay or bearer cheque' ELSE 'Aadhaar of the holder' END"
_FIELD_CONFIDENCE = "CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_orderkey * 3 % 100 AS DOUBLE) / 100 END"
_MORE = {**casefile.PAGES, "body": _BODY, "field_confidence": _FIELD_CONFIDENCE, "identity_ok": "o_orderkey % 19 <> 0"}


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").selectExpr(*[f"{e} AS {n}" for n, e in _MORE.items()])


def page_eligibility(spark: SparkSession, sf: str) -> DataFrame:
    """For each page and field whether the page may carry it."""
    rows = casefile.pages(spark, sf)
    cells = F.array(*[F.struct(F.lit(f).alias("field"), (F.array(*[F.lit(t) for t in types]) if types else F.lit(None).cast("array<string>")).alias("allowed")) for f, types in _ALLOWED.items()])
    rows = rows.withColumn("_c", F.explode(cells)).select("*", "_c.*")
    return rows.select("page_number", "field", gates.eligible(F.col("allowed")).alias("eligible"))


def garbage_values(spark: SparkSession, sf: str) -> DataFrame:
    """Observed values, and whether each is none."""
    rows = casefile.unpivoted(casefile.pages(spark, sf), ["page_number"], casefile.FIELDS)
    return rows.select("page_number", "field", "value", gates.garbage(F.col("field"), F.col("value")).alias("garbage"), gates.suspicious(F.col("field"), F.col("value")).alias("suspicious"))


def meanings(spark: SparkSession, sf: str) -> DataFrame:
    """Observations whose field means in its document what it says."""
    rows = casefile.unpivoted(casefile.pages(spark, sf), ["page_number", "document_type"], casefile.FIELDS)
    return rows.groupBy("document_type", "field").agg(F.count_if(gates.means_the_same(F.col("document_type"), F.col("field"))).alias("valid"), F.count("*").alias("n"))


def reliable_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Observations that are safe to compare."""
    rows = casefile.unpivoted(_pages(spark, sf), ["page_number", "document_type", "body", "field_confidence", "identity_ok"], casefile.FIELDS)
    ok = gates.reliable(F.col("document_type"), F.col("field"), F.col("value"), F.col("body"), F.col("field_confidence"), F.col("identity_ok"))
    return rows.where(ok).select("page_number", "field")


def confident_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages that by themselves satisfy the demand for a bank statement or a PAN card, and those that may."""
    rows = _pages(spark, sf).withColumn("wanted", F.explode(F.array(F.lit("Bank Statement"), F.lit("PAN"))))
    made = []
    for wanted in ("Bank Statement", "PAN"):
        sure = gates.confident_match(F.col("document_type"), wanted, F.col("is_readable"), F.lit("done"), F.col("classification_confidence"), F.col("ocr_confidence"), F.col("body"))
        made.append(rows.where(F.col("wanted") == wanted).where(gates.candidate(F.col("document_type"), wanted)).select("page_number", "wanted", sure.alias("confident")))
    return made[0].unionAll(made[1])


def nulled_assignments(spark: SparkSession, sf: str) -> DataFrame:
    """Fields of each page after labels and non-names are set to null, and what they were."""
    fields = F.map_filter(F.create_map(*[x for f in ("applicant_name", "address", "pin_code") for x in (F.lit(f), F.col(f))]), lambda k, v: v.isNotNull())
    rows = casefile.pages(spark, sf).select("page_number", gates.without_suspicious(fields).alias("r")).where(F.size("r.changes") > 0)
    return rows.select("page_number", F.array_join(F.array_sort(F.map_keys("r.changes")), ",").alias("changed"), F.try_element_at("r.fields", F.lit("applicant_name")).alias("applicant_name"), F.try_element_at("r.changes", F.lit("address")).alias("was_address"))


_VALUES = "CASE c_custkey % 8 WHEN 0 THEN concat('ABCDE', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'), 'F') WHEN 1 THEN CAST(919000000000 + c_custkey AS STRING) WHEN 2 THEN CAST(234500000000 + c_custkey AS STRING) WHEN 3 THEN concat('HDFC0', lpad(CAST(c_custkey AS STRING), 6, '0')) WHEN 4 THEN CAST(300000 + c_custkey AS STRING) WHEN 5 THEN concat('ABC', lpad(CAST(c_custkey AS STRING), 7, '0')) WHEN 6 THEN concat('GJ01 2015', lpad(CAST(c_custkey AS STRING), 7, '0')) ELSE concat('a.b', CAST(c_custkey AS STRING), '@mail.org') END"


def identifier_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Which identifiers a value may be."""
    rows = load(spark, sf, "customer").selectExpr("c_custkey", f"{_VALUES} AS value")
    return rows.select("c_custkey", F.array_join(gates.identifier_reasons(F.col("value")), ",").alias("kinds"), identifiers.aadhaar(F.col("value")).alias("aadhaar"))


_HINDI = "CASE c_custkey % 4 WHEN 0 THEN 'राम कुमार' WHEN 1 THEN 'પટેલ' WHEN 2 THEN 'Asha ९' ELSE c_name END"


def romanised_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names in Latin letters."""
    rows = load(spark, sf, "customer").selectExpr("c_custkey", f"{_HINDI} AS name")
    return rows.groupBy(F.when(F.col("name").startswith("Customer"), "other").otherwise(identifiers.romanised(F.col("name"))).alias("latin")).agg(F.count("*").alias("n"))


_VARIANT = f"CASE c_custkey % 7 WHEN 0 THEN {casefile.name('c_custkey')} WHEN 1 THEN concat({casefile.word(casefile.LAST, 'floor(c_custkey / 12)')}, ' ', {casefile.word(casefile.FIRST, 'c_custkey')}) WHEN 2 THEN {casefile.word(casefile.FIRST, 'c_custkey')} WHEN 3 THEN concat(substr({casefile.word(casefile.FIRST, 'c_custkey')}, 1, 1), ' ', {casefile.word(casefile.LAST, 'floor(c_custkey / 12)')}) WHEN 4 THEN concat('Shri ', {casefile.name('c_custkey')}, 'lal') WHEN 5 THEN concat({casefile.name('c_custkey')}, ' ', {casefile.word(casefile.FIRST, 'c_custkey + 7')}) ELSE {casefile.name('c_custkey + 5')} END"


def person_name_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Variants of names against the names, and whether a relative explains what is more."""
    rows = load(spark, sf, "customer").selectExpr("c_custkey", f"{casefile.name('c_custkey')} AS t", f"{casefile.name('c_custkey + 7')} AS father", f"{_VARIANT} AS x")
    return rows.select("c_custkey", compare.person_score(F.col("t"), F.col("x")).alias("score"), compare.names_with_relatives(F.col("x"), F.col("t"), F.col("father")).alias("same_person"))


_ADDRESS = f"CASE c_custkey % 8 WHEN 0 THEN {casefile.address('c_custkey')} WHEN 1 THEN {casefile.address('c_custkey + 1')} WHEN 2 THEN concat('lake road ', {casefile.pin('c_custkey')}) WHEN 3 THEN concat('near the mill maninagar east ahmedabad ', {casefile.pin('c_custkey')}) WHEN 4 THEN concat('S/O: Mohan Patel B-', CAST(100 + c_custkey % 50 AS STRING), ' lake road maninagar') WHEN 5 THEN 'plot 7 hill street surat' WHEN 6 THEN concat('lake road ward maninagr ahmedabad ', {casefile.pin('c_custkey')}) ELSE '' END"


def address_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Why variants of an address are the address or not."""
    rows = load(spark, sf, "customer").selectExpr("c_custkey % 8 AS variant", f"{casefile.address('c_custkey')} AS t", f"{_ADDRESS} AS x").where("x <> ''")
    return rows.groupBy("variant", compare.address_kind(F.col("t"), F.col("x")).alias("kind")).agg(F.count("*").alias("n"))


def relation_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    """Relation marks before names, compared with those of another writing."""
    k = F.col("c_custkey") % 4
    a = F.when(k == 0, "S/O: Mohan Patel").when(k == 1, "W/O Ravi").when(k == 2, "D / O - Kiran Shah").otherwise("Mohan Patel")
    b = F.when(k == 0, "S/O Mohn Patel, B-4 lake road 380001").when(k == 1, "s/o ravi").when(k == 2, "do kiran").otherwise("S/O Mohan Patel")
    rows = load(spark, sf, "customer").select(a.alias("a"), b.alias("b"))
    parts = compare.relation_prefix(F.col("a"))
    return rows.groupBy("a", parts["mark"].alias("mark"), parts["name"].alias("name"), compare.same_relation(F.col("a"), F.col("b")).alias("same")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (page_eligibility, garbage_values, meanings, reliable_fields, confident_pages, nulled_assignments, identifier_kinds, romanised_names, person_name_scores, address_kinds, relation_prefixes)}

_MORE_SQL = f"pages AS (SELECT {casefile.columns(_MORE)} FROM orders)"
_OBS = casefile.unpivoted_sql("o", "pages", ["page_number", "document_type"], casefile.FIELDS)
_NORM = "trim(regexp_replace(lower(value), '[^\\p{L}\\p{N}\\p{M}]+', ' ', 'g'))"
_BARE = f"trim(regexp_replace(' ' || {_NORM} || ' ', '( (mr|mrs|ms|miss|shri|smt|dr|kumari))+ ', ' ', 'g'))"
_REJECT = f"(trim(value) = '' OR regexp_matches(value, '[0-9]') OR regexp_matches(value, '@|https?:|www[.]') OR length({_BARE}) < 3 OR length({_BARE}) > 60 OR len(string_split({_BARE}, ' ')) > 6 OR regexp_matches({_BARE}, '\\b(bank|limited|ltd|branch|account|address|statement)\\b'))"
_SUSPICIOUS = f"({_NORM} <> '' AND ({_NORM} IN ({', '.join(repr(x) for x in gates.LABELS)}) OR (field = 'applicant_name' AND {_REJECT}) OR (field = 'address' AND regexp_full_match({_NORM}, '(landmark|locality|city|district|pin ?code| )+'))))"
_ANCHORED = """CASE WHEN document_type = 'PAN' AND field IN ('applicant_name', 'date_of_birth', 'pan_number') THEN body LIKE '%Income Tax%' WHEN document_type = 'Bank Statement' AND field IN ('applicant_name', 'account_number') THEN body LIKE 'Statement of account%'
    WHEN document_type = 'Passbook' AND field IN ('applicant_name', 'account_number') THEN body LIKE '%passbook%' WHEN document_type = 'Cheque' AND field IN ('applicant_name', 'account_number') THEN body LIKE '%cheque%'
    WHEN document_type IN ('CRIF Report', 'CIBIL Report') AND field IN ('credit_score', 'applicant_name') THEN body LIKE '%CIBIL%' ELSE true END"""
_SET = "CASE field WHEN 'pan_number' THEN ['pan', 'bank statement', 'application form', 'cibil report'] WHEN 'applicant_name' THEN ['pan', 'aadhaar', 'bank statement', 'application form', 'passbook', 'cheque'] END"
ORACLE_SQL = {
    "page_eligibility": f"""
        WITH {casefile.PAGES_SQL}, f AS (SELECT *, {_SET} AS allowed, lower(document_type) AS d FROM pages, (VALUES ('pan_number'), ('applicant_name'), ('credit_score')) v(field))
        SELECT page_number, field, triage NOT IN ('photo', 'blank') AND is_readable AND CASE WHEN ocr_confidence IS NULL THEN page_type = 'digital' ELSE ocr_confidence >= 0.55 END
          AND (allowed IS NULL OR (list_contains(allowed, d) AND CASE WHEN detection_method = 'inherited' THEN d IN ('bank statement', 'passbook', 'cibil report', 'crif report', 'application form', 'loan agreement') ELSE classification_confidence >= 0.5 END)) AS eligible FROM f""",
    "garbage_values": f"""
        WITH {casefile.PAGES_SQL}, {_OBS}
        SELECT page_number, field, value, {_SUSPICIOUS} AS suspicious, {_SUSPICIOUS} OR trim(value) = '' OR CASE field WHEN 'applicant_name' THEN length(regexp_replace(value, '[^a-zA-Z]', '', 'g')) < 3 OR lower(value) = 'name'
            WHEN 'date_of_birth' THEN value LIKE 'XX%' OR NOT regexp_matches(value, '[0-9]') WHEN 'address' THEN length(regexp_replace(value, '[^a-zA-Z]', '', 'g')) < 6 OR regexp_full_match(lower(value), '(landmark|locality|city|district|pin *code|/)+')
            WHEN 'pin_code' THEN NOT regexp_full_match(regexp_replace(value, '[^0-9]', '', 'g'), '[1-9][0-9]{{5}}') WHEN 'credit_score' THEN NOT regexp_full_match(regexp_replace(value, '[^0-9]', '', 'g'), '0|[3-9][0-9]{{2}}') ELSE false END AS garbage FROM o""",
    "meanings": f"""
        WITH {casefile.PAGES_SQL}, {_OBS} SELECT document_type, field, count(*) FILTER (NOT (document_type IN ('CRIF Report', 'CIBIL Report') AND field = 'phone_number')) AS valid, count(*) AS n FROM o GROUP BY ALL""",
    "reliable_fields": f"""
        WITH {_MORE_SQL}, {casefile.unpivoted_sql("o", "pages", ["page_number", "document_type", "body", "field_confidence", "identity_ok"], casefile.FIELDS)}
        SELECT page_number, field FROM o WHERE trim(value) <> '' AND (field <> 'applicant_name' OR NOT {_REJECT}) AND (field NOT IN ('applicant_name', 'pan_number', 'date_of_birth') OR identity_ok) AND {_ANCHORED}
          AND coalesce(field_confidence >= CASE WHEN field IN ('applicant_name', 'pan_number', 'date_of_birth') THEN 0.65 ELSE 0.6 END, true)""",
    "confident_pages": f"""
        WITH {_MORE_SQL} SELECT page_number, document_type AS wanted, is_readable AND classification_confidence >= 0.65 AND coalesce(ocr_confidence >= 0.55, true)
          AND CASE document_type WHEN 'PAN' THEN body LIKE '%Income Tax%' ELSE body LIKE 'Statement of account%' END AS confident FROM pages WHERE document_type IN ('PAN', 'Bank Statement')""",
    "nulled_assignments": f"""
        WITH {casefile.PAGES_SQL}, {casefile.unpivoted_sql("o", "pages", ["page_number"], ("applicant_name", "address", "pin_code"))}, s AS (SELECT *, {_SUSPICIOUS} AS bad FROM o)
        SELECT page_number, string_agg(field, ',' ORDER BY field) FILTER (bad) AS changed, max(value) FILTER (field = 'applicant_name' AND NOT bad) AS applicant_name, max(value) FILTER (field = 'address' AND bad) AS was_address FROM s GROUP BY 1 HAVING bool_or(bad)""",
    "identifier_kinds": f"""
        WITH v AS (SELECT c_custkey, {_VALUES} AS value FROM customer), b AS (SELECT *, upper(replace(value, ' ', '')) AS u FROM v),
        k AS (SELECT c_custkey, u, CASE WHEN regexp_full_match(u, '[0-9]{{12}}') AND NOT regexp_full_match(u, '91[6-9][0-9]{{9}}') THEN u END AS aadhaar, value FROM b)
        SELECT c_custkey, aadhaar, array_to_string(list_filter([CASE WHEN aadhaar IS NOT NULL THEN 'aadhaar' END, CASE WHEN value LIKE '%@%' THEN 'email' END, CASE WHEN regexp_full_match(u, '[A-Z]{{4}}0[A-Z0-9]{{6}}') THEN 'ifsc' END,
          CASE WHEN regexp_full_match(u, '[A-Z]{{2}}[0-9]{{13}}') THEN 'licence' END, CASE WHEN regexp_full_match(u, '[A-Z]{{5}}[0-9]{{4}}[A-Z]') THEN 'pan' END, CASE WHEN regexp_full_match(u, '[1-9][0-9]{{5}}') THEN 'pin_code' END,
          CASE WHEN regexp_full_match(u, '[A-Z]{{3}}[0-9]{{7}}') THEN 'voter' END], lambda x: x IS NOT NULL), ',') AS kinds FROM k""",
    "romanised_names": "SELECT CASE c_custkey % 4 WHEN 0 THEN 'raam kumaar' WHEN 1 THEN 'ptel' WHEN 2 THEN 'Asha 9' ELSE 'other' END AS latin, count(*) AS n FROM customer GROUP BY 1",
    "person_name_scores": f"""
        WITH s AS (SELECT c_custkey, {casefile.name("c_custkey")} AS t, {casefile.name("c_custkey + 7")} AS father, {_VARIANT} AS x FROM customer),
        w AS (SELECT *, {_distinct(_words("t"))} AS u, {_distinct(_words("x"))} AS v, {_distinct(_words("father"))} AS r FROM s),
        p AS (SELECT *, {_NAME} AS tier, list_filter(v, lambda y: length(y) = 1) AS one, list_filter(v, lambda y: NOT list_contains(u, y)) AS extra FROM w),
        q AS (SELECT *, CASE WHEN tier < 100 AND len(one) > 0 AND len(v) <= len(u) AND one = list_transform(u[1:len(one)], lambda y: y[1]) AND len(list_filter(v, lambda y: length(y) > 1 AND NOT list_contains(u, y))) = 0 THEN 95 ELSE tier END AS score FROM p)
        SELECT c_custkey, CAST(score AS DOUBLE) AS score, score >= 85 OR (len(u) > 0 AND len(list_intersect(u, v)) = len(u) AND len(extra) > 0
          AND len(list_filter(extra, lambda y: len(list_filter(r, lambda z: 1 - levenshtein(y, z) / greatest(length(y), length(z))::DOUBLE >= 0.75)) > 0)) = len(extra)) AS same_person FROM q""",
    "relation_prefixes": """
        SELECT CASE c_custkey % 4 WHEN 0 THEN 'S/O: Mohan Patel' WHEN 1 THEN 'W/O Ravi' WHEN 2 THEN 'D / O - Kiran Shah' ELSE 'Mohan Patel' END AS a, CASE c_custkey % 4 WHEN 0 THEN 'so' WHEN 1 THEN 'wo' WHEN 2 THEN 'do' END AS mark,
               CASE c_custkey % 4 WHEN 0 THEN 'mohan patel' WHEN 1 THEN 'ravi' WHEN 2 THEN 'kiran shah' END AS name, c_custkey % 4 IN (0, 2) AS same, count(*) AS n FROM customer GROUP BY ALL""",
}
_U, _X = "regexp_replace(regexp_extract(lower({0}), '^\\s*([a-z]\\s*[-/]?\\s*[0-9]{{1,5}}[a-z]?)\\b', 1), '[^a-z0-9]', '', 'g')", "regexp_extract({0}, '\\b[1-8][0-9]{{5}}\\b')"
_MARKED = "regexp_replace(lower({0}), '\\b([swdc])\\s*/\\s*o\\b', '\\1o', 'g')"
_COMMON = "[" + ", ".join(f"'{t}'" for t in compare.COMMON_PLACES) + "]"
ORACLE_SQL["address_kinds"] = f"""
    WITH s AS (SELECT c_custkey % 8 AS variant, {casefile.address("c_custkey")} AS t, {_ADDRESS} AS x FROM customer), w AS (SELECT *, list_distinct(regexp_extract_all({_MARKED.format("t")}, '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all({_MARKED.format("x")}, '[a-z0-9]+')) AS b FROM s WHERE x <> ''),
    h AS (SELECT *, list_intersect(a, b) AS c, least(len(a), len(b)) AS z, {_U.format("t")} AS ut, {_U.format("x")} AS ux, {_X.format("t")} AS pt, {_X.format("x")} AS px FROM w),
    g AS (SELECT *, list_filter(c, lambda y: NOT list_contains({_COMMON}, y) AND length(y) >= 3 AND NOT regexp_full_match(y, '[1-8][0-9]{{5}}')) AS own FROM h),
    l AS (SELECT *, list_filter(a, lambda y: NOT list_contains({_COMMON}, y) AND NOT list_contains(own, y) AND length(y) >= 3 AND NOT regexp_full_match(y, '[0-9]+')) AS p, list_filter(b, lambda y: NOT list_contains({_COMMON}, y) AND NOT list_contains(own, y) AND length(y) >= 3 AND NOT regexp_full_match(y, '[0-9]+')) AS q FROM g),
    k AS (SELECT *, len(list_filter(p, lambda y: len(list_filter(q, lambda o: 1 - levenshtein(y, o) / greatest(length(y), length(o))::DOUBLE >= 0.78)) > 0)) AS near FROM l)
    SELECT variant, CASE WHEN ut <> '' AND ux <> '' AND ut <> ux THEN 'UNIT_CONFLICT' WHEN z >= 2 AND len(c) = z THEN 'SUBSET' WHEN pt <> '' AND pt = px AND len(c) >= 5 AND len(c) >= 0.75 * z THEN 'PIN_WORDS'
           WHEN ut <> '' AND ut = ux AND len(own) >= 2 THEN 'UNIT_PLACE' WHEN pt <> '' AND pt = px AND len(own) + near >= 2 THEN 'PIN_PLACE' WHEN len(c) >= 0.7 * len(list_distinct(list_concat(a, b))) THEN 'WORDS'
           WHEN 1 - levenshtein({_compact("t")}, {_compact("x")}) / greatest(length({_compact("t")}), length({_compact("x")}))::DOUBLE >= 0.82 THEN 'SIMILAR' ELSE 'DIFFERENT' END AS kind, count(*) AS n FROM k GROUP BY ALL"""
