"""Queries on texts, identifiers, rules and findings, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.functions import conditions, text
from docketry.operators import containment, findings, relational
from docketry.sources.tables import load, page_kind

_RULES = [("R_NAV", "MEDIUM", "the"), ("R_TION", "LOW", "tion"), ("R_SCUM", "HIGH", "scum"), ("R_PIPE", "LOW", " | "), ("R_EMAIL", "HIGH", "@"), ("R_LICENSE", "MEDIUM", "license")]


def _rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_RULES, "rule_id string, severity string, term string")


def rule_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: rules over documents, ranked findings and the status of each document."""
    docs = load(spark, sf, "documents").select("doc_id", F.lower("text").alias("body"))
    found = findings.term_findings(docs, _rules(spark), "body").select("doc_id", "rule_id", "severity")
    ranked = findings.ranked(findings.first_wins(found, ["doc_id", "rule_id"], ["severity"]), "doc_id", "severity", "rule_id")
    w = Window.partitionBy("doc_id")
    high, total = F.count_if(F.col("severity") == "HIGH").over(w), F.count("*").over(w)
    status = findings.reviewer_status(high, total, F.count_if(F.col("severity") == "LOW").over(w))
    return ranked.select("doc_id", "rule_id", "severity", F.col("place").cast("bigint").alias("place"), status.alias("status"))


def collapsed_findings(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").select("doc_id", "source", "lang", F.lower("text").alias("body"))
    found = findings.term_findings(docs, _rules(spark), "body").withColumn("page", F.pmod("doc_id", F.lit(7)))
    return findings.collapsed(found, ["source", "rule_id"], "page", "severity")


def severity_recommendation(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").select("source", F.lower("text").alias("body"))
    found = findings.term_findings(docs, _rules(spark), "body").where("rule_id in ('R_SCUM', 'R_EMAIL', 'R_LICENSE')")
    rows = found.groupBy("source").agg(*[F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("HIGH", "MEDIUM")])
    return rows.select("source", "high", "medium", findings.recommendation(F.col("high"), F.col("medium")).alias("recommendation"), findings.file_severity(F.col("high") + F.col("medium")).alias("grade"))


def required_roles_missing(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations with fewer turns of a role than wanted."""
    turns = load(spark, sf, "conversations")
    rules = spark.createDataFrame([("system", 1), ("user", 2), ("assistant", 2)], "role string, min_count bigint")
    counts = turns.groupBy("conv_id", "role").agg(F.count("*").alias("n"))
    return findings.required_missing(turns.select("conv_id").distinct(), rules, counts, "conv_id", "role").select("conv_id", "role", "n", "min_count")


def suppressed_cross_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a low rule, unless a high one was found in them."""
    docs = load(spark, sf, "documents").select("doc_id", F.lower("text").alias("body"))
    found = findings.term_findings(docs, _rules(spark), "body")
    return findings.suppressed(found.where("severity = 'LOW'").select("doc_id", "rule_id"), found.where("severity = 'HIGH'"), ["doc_id"])


def tri_state_applicability(spark: SparkSession, sf: str) -> DataFrame:
    """A condition over labels that only some documents have: true, false or unknown."""
    rule = {"any": [{"all": [{"field": "quality", "eq": 1}, {"field": "n_chars", "gt": 1000}]}, {"not": {"field": "toxic", "eq": 0}}]}
    docs = load(spark, sf, "documents").join(load(spark, sf, "labels"), "doc_id", "left")
    state = conditions.condition(rule)
    return docs.select("doc_id", F.when(state, "applies").when(~state, "does_not_apply").otherwise("unknown").alias("state"))


def exact_duplicate_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The first document with the same normal form, for those of 120 characters or more."""
    docs = load(spark, sf, "documents").select("doc_id", text.normalised(F.col("text")).alias("norm")).where("length(norm) >= 120")
    docs = docs.select("doc_id", F.sha2("norm", 256).alias("print"))
    first = docs.groupBy("print").agg(F.min("doc_id").alias("canonical"), F.count("*").alias("copies"))
    return docs.join(first, "print").where("copies > 1").select("doc_id", "canonical", "copies")


def benchmark_containment(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold eight consecutive words of a benchmark passage, wherever they stand in it."""
    return containment.shared_passages(load(spark, sf, "documents").select("doc_id", "text"), "doc_id", load(spark, sf, "benchmark").select("item_id", "text"), "item_id", "text")


def script_profile(spark: SparkSession, sf: str) -> DataFrame:
    counts = text.script_counts(F.col("text"))
    rows = load(spark, sf, "documents").select("doc_id", F.explode(counts).alias("script", "n")).where("n >= 3")
    return rows.select("doc_id", "script", F.col("n").cast("bigint").alias("n"))


def pattern_harvest(spark: SparkSession, sf: str) -> DataFrame:
    found = text.harvest(F.col("text"), text.EMAIL, None)
    return load(spark, sf, "documents").select("doc_id", F.size(found).cast("bigint").alias("n"), F.array_join(found, ",").alias("emails")).where("n > 0")


def masked_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    key = F.lpad(F.col("c_custkey").cast("string"), 12, "4")
    return load(spark, sf, "customer").select("c_custkey", text.masked(key).alias("masked"), text.masked(F.col("c_custkey").cast("string")).alias("short"), text.identifier_matches(text.masked(key), key).alias("same"))


def identifier_checks(spark: SparkSession, sf: str) -> DataFrame:
    made = F.concat(F.lit("ABCDE"), F.lpad(F.pmod("c_custkey", F.lit(10000)).cast("string"), 4, "0"), F.when(F.col("c_custkey") % 3 == 0, "f").otherwise("F"))
    return load(spark, sf, "customer").select(
        "c_custkey", made.rlike(f"^{text.PAN}$").alias("valid"), text.phone(F.concat(F.lit("+91-0"), F.lpad(F.col("c_custkey").cast("string"), 10, "9"))).alias("phone"), text.repaired_digits(F.lit("l2O4SB")).alias("repaired")
    )


def html_title_and_links(spark: SparkSession, sf: str) -> DataFrame:
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return load(spark, sf, "pages").select("page_id", title.alias("title"), F.regexp_count("html", F.lit('href="')).cast("bigint").alias("links"), F.length(text.clean_text(F.col("html"))).cast("bigint").alias("bare_length"))


def url_parts(spark: SparkSession, sf: str) -> DataFrame:
    url = F.col("url")
    return load(spark, sf, "pages").select(
        "page_id", F.regexp_extract(url, "^([a-z]+)://", 1).alias("scheme"), F.regexp_extract(url, "^[a-z]+://([^/?#]+)", 1).alias("host"), F.regexp_extract(url, "^[a-z]+://[^/?#]+/([a-z]{2})/", 1).alias("lang")
    )


def json_props(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return load(spark, sf, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


def relevance_by_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Term hits a document and the best three sources of each language."""
    terms = ["the", "und", "que", "des", "los"]
    padded = F.explode(F.array(F.concat(F.lit(" "), text.normalised(F.col("text")), F.lit(" "))))  # held, so that no term takes the normal form again
    hits = F.size(F.filter(F.array(*[F.lit(f" {t} ") for t in terms]), lambda t: F.contains("padded", t)))
    rows = load(spark, sf, "documents").select("lang", "source", padded.alias("padded")).select("lang", "source", hits.alias("hits")).groupBy("lang", "source").agg(F.sum("hits").alias("hits"))
    return relational.newest_n(rows, ["lang"], [F.desc("hits"), F.col("source")], 3).withColumn("rank", F.col("rank").cast("bigint"))


def page_triage(spark: SparkSession, sf: str) -> DataFrame:
    """Kind of each document by its characters and lines."""
    size, lines = F.length("text"), F.size(F.split("text", "\n"))
    kind = F.when(size < 50, "blank").when(lines * 40 > size, "table").when(size > 8000, "long").otherwise("printed")
    return load(spark, sf, "documents").groupBy(kind.alias("kind"), page_kind(F.col("text")).alias("layer")).agg(F.count("*").alias("n"))


def name_match_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """Tiers of names made from customers against the supplier of the same number, null where there is none; name_match_best scores the names themselves."""
    number = F.regexp_extract("c_name", "([0-9]+)$", 1)
    k = F.col("c_custkey") % 5
    name = F.when(k == 0, F.concat(F.lit("Party "), number)).when(k == 1, F.concat(number, F.lit(" Party"))).when(k == 2, "Party").when(k == 3, F.concat(F.lit("The Party "), number)).otherwise(F.concat(F.lit("Other "), number))
    c = load(spark, sf, "customer").select(number.alias("number"), name.alias("x"))
    s = load(spark, sf, "supplier").select(F.regexp_extract("s_name", "([0-9]+)$", 1).alias("number"), F.regexp_replace("s_name", "Supplier#", "PARTY-").alias("y"))
    return c.join(s, "number", "left").groupBy(F.when(F.col("y").isNotNull(), text.name_score(F.col("x"), F.col("y"))).alias("score")).agg(F.count("*").alias("n"))


def name_match_best(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's best-scored supplier name of all (the first of equal scores); none, with score 0, where no name scores.

    Distinct normal forms are compared. A score above 0 takes a shared word or
    a form that begins the other, so pairs are found by words and by beginnings.
    """
    customers = load(spark, sf, "customer").select("c_custkey", text.normalised(F.col("c_name")).alias("x"))
    xs = customers.select("x").where("x <> ''").distinct()
    ys = load(spark, sf, "supplier").select("s_name", text.normalised(F.col("s_name")).alias("y")).where("y <> ''").groupBy("y").agg(F.min("s_name").alias("s_name"))

    def words(c: str) -> F.Column:
        return F.explode(text.tokens(F.col(c))).alias("key")

    def beginnings(c: str) -> F.Column:
        return F.explode(F.transform(F.sequence(F.lit(1), F.length(c)), lambda k: F.substring(F.col(c), F.lit(1), k))).alias("key")

    kinds = ((words("x"), words("y")), (beginnings("x"), F.col("y").alias("key")), (F.col("x").alias("key"), beginnings("y")))
    pairs = [xs.select("x", a).join(ys.select("y", "s_name", b), "key").select("x", "y", "s_name") for a, b in kinds]
    scored = pairs[0].unionAll(pairs[1]).unionAll(pairs[2]).distinct().withColumn("score", text.name_score(F.col("x"), F.col("y"))).where("score > 0")
    best = scored.groupBy("x").agg(F.min(F.struct((-F.col("score")).alias("less"), F.col("s_name"))).alias("best"))
    return customers.join(best, "x", "left").select("c_custkey", F.col("best.s_name").alias("s_name"), F.coalesce(-F.col("best.less"), F.lit(0.0)).alias("score"))


def status_polarity(spark: SparkSession, sf: str) -> DataFrame:
    """Rejected terms beat accepted ones."""
    passes = text.status_passes(F.concat_ws(" ", "event_type", F.when(F.col("value") > 80, "rejected")), ["click", "purchase"], ["reject"])
    return load(spark, sf, "events").groupBy("event_type", passes.alias("passes")).agg(F.count("*").alias("n"))


def quality_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Flags of each document, one row a flag."""
    t = F.col("text")
    flags = F.array_compact(F.array(F.when(F.length(t) < 200, "SHORT"), F.when(F.upper(t) == t, "ALL_CAPS"), F.when(F.contains(t, F.lit("|")), "TABLE"), F.when(F.contains(t, F.lit("@")), "CONTACT")))
    return load(spark, sf, "documents").select("doc_id", F.explode(flags).alias("flag"))


QUERIES = {
    f.__name__: f
    for f in (
        rule_findings, collapsed_findings, severity_recommendation, required_roles_missing, suppressed_cross_findings, tri_state_applicability, exact_duplicate_texts, benchmark_containment,
        script_profile, pattern_harvest, masked_identifiers, identifier_checks, html_title_and_links, url_parts, json_props, relevance_by_terms, page_triage, name_match_tiers, name_match_best,
        status_polarity, quality_flags,
    )
}

_R = "r(rule_id, severity, term) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in _RULES) + ")"
_F = f"{_R}, f AS (SELECT d.*, r.rule_id, r.severity FROM documents d JOIN r ON contains(lower(d.text), r.term))"
_SEV = "CASE severity WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'LOW' THEN 2 ELSE 3 END"
_NORM = r"trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}\p{{M}}]+', ' ', 'g'))"
ORACLE_SQL = {
    "rule_findings": f"""
        WITH {_F}, g AS (SELECT doc_id, rule_id, severity, count(*) FILTER (severity = 'HIGH') OVER d AS h, count(*) OVER d AS t, count(*) FILTER (severity = 'LOW') OVER d AS l FROM f WINDOW d AS (PARTITION BY doc_id))
        SELECT doc_id, rule_id, severity, row_number() OVER (PARTITION BY doc_id ORDER BY {_SEV}, rule_id) AS place,
               CASE WHEN l >= greatest(8, t // 3) THEN 'FULL_MANUAL' WHEN h > 0 THEN 'HIGH_RISK' WHEN t > 0 THEN 'LIMITED' ELSE 'CLEAN' END AS status FROM g""",
    "collapsed_findings": f"""
        WITH {_F} SELECT source, rule_id, count(*) AS occurrences, (['HIGH', 'MEDIUM', 'LOW', 'OTHER'])[min({_SEV}) + 1] AS severity,
               string_agg(DISTINCT CAST(doc_id % 7 AS VARCHAR), ',' ORDER BY CAST(doc_id % 7 AS VARCHAR)) AS pages FROM f GROUP BY 1, 2""",
    "severity_recommendation": f"""
        WITH {_F}, g AS (SELECT source, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium FROM f WHERE rule_id IN ('R_SCUM', 'R_EMAIL', 'R_LICENSE') GROUP BY 1)
        SELECT source, high, medium, CASE WHEN high > 0 THEN 'MANUAL REVIEW' WHEN medium > 0 THEN 'SEND BACK TO BRANCH' ELSE 'APPROVE' END AS recommendation,
               CASE WHEN high + medium >= 50 THEN 'CRITICAL' WHEN high + medium >= 30 THEN 'HIGH' WHEN high + medium >= 10 THEN 'MEDIUM' WHEN high + medium >= 1 THEN 'LOW' ELSE 'NONE' END AS grade FROM g""",
    "required_roles_missing": """
        WITH r(role, min_count) AS (VALUES ('system', 1::BIGINT), ('user', 2), ('assistant', 2)), s AS (SELECT DISTINCT conv_id FROM conversations), c AS (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY 1, 2)
        SELECT s.conv_id, r.role, coalesce(n, 0) AS n, min_count FROM s CROSS JOIN r LEFT JOIN c ON c.conv_id = s.conv_id AND c.role = r.role WHERE coalesce(n, 0) < min_count""",
    "suppressed_cross_findings": f"WITH {_F} SELECT doc_id, rule_id FROM f WHERE severity = 'LOW' AND doc_id NOT IN (SELECT doc_id FROM f WHERE severity = 'HIGH')",
    "tri_state_applicability": """
        WITH s AS (SELECT d.doc_id, (quality = 1 AND n_chars > 1000) OR NOT (toxic = 0) AS state FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
        SELECT doc_id, CASE WHEN state THEN 'applies' WHEN NOT state THEN 'does_not_apply' ELSE 'unknown' END AS state FROM s""",
    "exact_duplicate_texts": f"""
        WITH n AS (SELECT doc_id, {_NORM.format("text")} AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS canonical, count(*) OVER w AS copies FROM n WHERE length(norm) >= 120 WINDOW w AS (PARTITION BY norm) QUALIFY copies > 1""",
    "benchmark_containment": f"""
        WITH b AS (SELECT item_id, string_split({_NORM.format("text")}, ' ') AS w FROM benchmark), d AS (SELECT doc_id, string_split({_NORM.format("text")}, ' ') AS w FROM documents),
        i AS (SELECT DISTINCT item_id, array_to_string(w[k:k+7], ' ') AS gram FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS k FROM b)),
        g AS (SELECT DISTINCT doc_id, array_to_string(w[k:k+7], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS k FROM d))
        SELECT DISTINCT doc_id, item_id FROM g JOIN i USING (gram)""",
    "script_profile": r"""
        WITH s AS (SELECT doc_id, unnest(['latin', 'devanagari', 'gujarati', 'cyrillic', 'greek']) AS script,
          unnest([len(regexp_extract_all(text, '[A-Za-zÀ-ɏ]')), len(regexp_extract_all(text, '[ऀ-ॿ]')), len(regexp_extract_all(text, '[઀-૿]')), len(regexp_extract_all(text, '[Ѐ-ӿ]')), len(regexp_extract_all(text, '[Ͱ-Ͽ]'))]) AS n FROM documents)
        SELECT doc_id, script, CAST(n AS BIGINT) AS n FROM s WHERE n >= 3""",
    "pattern_harvest": f"""
        WITH e AS (SELECT doc_id, unnest(regexp_extract_all(text, '{text.EMAIL}')) AS m, unnest(range(len(regexp_extract_all(text, '{text.EMAIL}')))) AS i FROM documents),
        d AS (SELECT doc_id, m, min(i) AS i FROM e GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p FROM d)
        SELECT doc_id, count(*) AS n, string_agg(m, ',' ORDER BY p) AS emails FROM k GROUP BY 1""",
    "masked_identifiers": """
        SELECT c_custkey, repeat('*', 8) || right(lpad(CAST(c_custkey AS VARCHAR), 12, '4'), 4) AS masked,
               CASE WHEN length(CAST(c_custkey AS VARCHAR)) <= 4 THEN repeat('*', length(CAST(c_custkey AS VARCHAR))) ELSE repeat('*', length(CAST(c_custkey AS VARCHAR)) - 4) || right(CAST(c_custkey AS VARCHAR), 4) END AS short,
               true AS same FROM customer""",
    "identifier_checks": """
        SELECT c_custkey, c_custkey % 3 <> 0 AS valid, lpad(CAST(c_custkey AS VARCHAR), 10, '9') AS phone, '120458' AS repaired FROM customer""",
    "html_title_and_links": """
        SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST((length(html) - length(replace(html, 'href="', ''))) / 6 AS BIGINT) AS links,
               CAST(length(regexp_replace(html, '<[^>]+>', '', 'g')) AS BIGINT) AS bare_length FROM pages""",
    "url_parts": """
        SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+/([a-z]{2})/', 1) AS lang FROM pages""",
    "json_props": "SELECT TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
    "relevance_by_terms": f"""
        WITH p AS (SELECT lang, source, ' ' || {_NORM.format("text")} || ' ' AS t FROM documents),
        h AS (SELECT lang, source, CAST(sum(contains(t, ' the ')::INT + contains(t, ' und ')::INT + contains(t, ' que ')::INT + contains(t, ' des ')::INT + contains(t, ' los ')::INT) AS BIGINT) AS hits FROM p GROUP BY 1, 2)
        SELECT lang, source, hits, row_number() OVER (PARTITION BY lang ORDER BY hits DESC, source) AS rank FROM h QUALIFY rank <= 3""",
    "page_triage": """
        SELECT CASE WHEN length(text) < 50 THEN 'blank' WHEN len(string_split(text, chr(10))) * 40 > length(text) THEN 'table' WHEN length(text) > 8000 THEN 'long' ELSE 'printed' END AS kind,
               CASE WHEN length(trim(text)) > 50 THEN 'digital' ELSE 'scanned' END AS layer, count(*) AS n FROM documents GROUP BY 1, 2""",
    "name_match_tiers": """
        SELECT CASE WHEN s_name IS NULL THEN NULL ELSE CASE c_custkey % 5 WHEN 0 THEN 100.0 WHEN 1 THEN 100.0 WHEN 2 THEN 95.0 WHEN 3 THEN 90.0 ELSE 33.33 END END::DOUBLE AS score, count(*) AS n
        FROM customer LEFT JOIN supplier ON right(c_name, 9) = right(s_name, 9) GROUP BY 1""",
    "name_match_best": f"""
        WITH c AS (SELECT c_custkey, {_NORM.format("c_name")} AS x FROM customer), s AS (SELECT {_NORM.format("s_name")} AS y, min(s_name) AS s_name FROM supplier GROUP BY 1),
        a AS (SELECT x, list_distinct(string_split(x, ' ')) AS u FROM (SELECT DISTINCT x FROM c) WHERE x <> ''), b AS (SELECT y, s_name, list_distinct(string_split(y, ' ')) AS v FROM s WHERE y <> ''),
        p AS (SELECT *, len(list_intersect(u, v)) AS n FROM a CROSS JOIN b),
        r AS (SELECT x, s_name, CASE WHEN x = y OR (n = len(u) AND n = len(v)) THEN 100 WHEN starts_with(x, y) OR starts_with(y, x) THEN 95 WHEN (n = len(u) OR n = len(v)) AND least(len(u), len(v)) >= 2 THEN 90
                     ELSE round(100 * (n / (len(u) + len(v) - n)::DOUBLE), 2) END::DOUBLE AS score FROM p),
        k AS (SELECT * FROM r WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY x ORDER BY score DESC, s_name) = 1)
        SELECT c_custkey, s_name, coalesce(score, 0)::DOUBLE AS score FROM c LEFT JOIN k USING (x)""",
    "status_polarity": """
        SELECT event_type, NOT (value > 80) AND (contains(event_type, 'click') OR contains(event_type, 'purchase')) AS passes, count(*) AS n FROM events GROUP BY 1, 2""",
    "quality_flags": """
        SELECT doc_id, unnest(list_filter([CASE WHEN length(text) < 200 THEN 'SHORT' END, CASE WHEN upper(text) = text THEN 'ALL_CAPS' END, CASE WHEN contains(text, '|') THEN 'TABLE' END,
               CASE WHEN contains(text, '@') THEN 'CONTACT' END], lambda x: x IS NOT NULL)) AS flag FROM documents""",
}
