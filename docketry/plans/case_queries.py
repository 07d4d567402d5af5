"""Queries on checks, layouts, schedules, keyed state, names and extracted fields, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import dates, extract, people, text
from docketry.operators import checks, layout, schedule
from docketry.sources.tables import load
from docketry.streaming import states

_TYPES = [
    ("notice", 1, "the", ["licen", "copyright"], ["licen"], []),
    ("prose", 2, "the", ["the", "and", "of"], [], [" | "]),
    ("table", 3, " | ", [" | ", "|"], [" | "], []),
    ("letter", 4, "der", ["der", "und", "ein"], [], ["the "]),
    ("contact", 5, "@", ["@", ".com", "http"], ["@"], []),
]


def registry_top_types(spark: SparkSession, sf: str) -> DataFrame:
    """The best five types of each document by a rule table."""
    rules = spark.createDataFrame(_TYPES, "type string, priority int, heading string, keywords array<string>, required array<string>, negative array<string>")
    return checks.scored_types(load(spark, sf, "documents").select("doc_id", "text"), rules, "doc_id", "text")


def period_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with orders of one priority in each of the twelve months before August 1995."""
    orders = load(spark, sf, "orders").select("o_custkey", "o_orderpriority", F.col("o_orderdate").cast("date").alias("day"))
    return checks.period_check(orders, "o_custkey", "o_orderpriority", "day", F.lit("1995-08-15").cast("date"), 12)


def document_age_check(spark: SparkSession, sf: str) -> DataFrame:
    """Age of each customer's newest order."""
    orders = load(spark, sf, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("day"))
    return checks.date_check(orders, "o_custkey", "day", F.lit("1998-07-01").cast("date"), 6)


def required_status_check(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with a finished order; orders in part delivered are unknown."""
    orders = load(spark, sf, "orders")
    passes = F.when(F.col("o_orderstatus") == "P", F.lit(None)).otherwise(F.col("o_orderstatus") == "F")
    return checks.status_check(orders, "o_custkey", passes)


def distinct_parts_check(spark: SparkSession, sf: str) -> DataFrame:
    return checks.distinct_count_check(load(spark, sf, "lineitem"), "l_orderkey", F.col("l_partkey"), 3)


def trusted_mismatch_owner(spark: SparkSession, sf: str) -> DataFrame:
    """Lines whose discount is not the trusted one of their supplier, with the supplier that has it."""
    lines = load(spark, sf, "lineitem").select(F.col("l_suppkey").alias("person"), F.lit("discount").alias("field"), F.col("l_discount").alias("value"), "l_orderkey", "l_linenumber")
    trusted = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("person"), F.lit("discount").alias("field"), F.round(F.col("s_acctbal").cast("decimal(12,2)") / 100000, 2).cast("double").alias("trusted_value"))
    rows = checks.trusted_mismatches(lines, trusted, "person", "field", "value", "trusted_value", F.abs(F.col("value") - F.col("trusted_value")) < 0.001)
    return rows.groupBy("person", "belongs_to").agg(F.count("*").alias("n"))


def field_mismatch_first(spark: SparkSession, sf: str) -> DataFrame:
    """The first line of an order that was not sold at its part's price within 1 %."""
    lines = load(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"))
    wanted = load(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    same = F.abs(F.col("unit_price") - F.col("p_retailprice")) <= 0.01 * F.col("p_retailprice")
    return checks.field_mismatches(lines, wanted, ["l_partkey"], "unit_price", "p_retailprice", "place", same)


def case_readiness(spark: SparkSession, sf: str) -> DataFrame:
    """Customers whose orders have no line left open."""
    lines = load(spark, sf, "lineitem").join(load(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return checks.cascade(lines, "o_custkey", "o_orderkey", F.col("l_linestatus") == "F")


def unreadable_page_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Findings of events; those of low value give way to one a user."""
    found = load(spark, sf, "events").select("user_id", F.concat(F.upper("event_type"), F.lit("_CHECK")).alias("rule_id"), "value")
    rows = checks.one_finding_a_page(found, ["user_id"], "value", 5.0, "rule_id")
    return rows.groupBy("user_id", "rule_id").agg(F.count("*").alias("n"))


def absence_review(spark: SparkSession, sf: str) -> DataFrame:
    """Customers without an urgent order: for review if some high one or an open one may stand for it."""
    orders = load(spark, sf, "orders").select(F.col("o_custkey").alias("cust"), "o_orderpriority", "o_orderstatus")
    missing = load(spark, sf, "customer").select(F.col("c_custkey").alias("cust")).join(orders.where("o_orderpriority = '1-URGENT'"), "cust", "left_anti")
    return checks.qualified_absences(missing, orders.where("o_orderpriority = '2-HIGH'"), orders.where("o_orderstatus = 'P'"), ["cust"])


def _words(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as words on pages: an order is a page, a line number a row of it."""
    lines = load(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("line"),
        F.explode(F.array(*[F.struct(F.lit(k).alias("no"), c.cast("string").alias("text")) for k, c in enumerate((F.col("l_returnflag"), F.col("l_partkey"), F.col("l_suppkey")))])).alias("w"),
    )
    x, y = 50.0 * F.col("w.no"), 20.0 * F.col("line")
    return lines.select("page", "line", F.col("w.no").alias("no"), F.col("w.text").alias("text"), x.alias("x0"), y.alias("y0"), (x + 30).alias("x1"), (y + 10).alias("y1")).distinct()


def lines_from_words(spark: SparkSession, sf: str) -> DataFrame:
    return layout.lines(_words(spark, sf), ["page"], ["line"], "no")


def values_right_of_labels(spark: SparkSession, sf: str) -> DataFrame:
    """What stands right of each R on its row."""
    words = _words(spark, sf)
    return layout.right_of(words.where("no > 0"), words.where("no = 0 and text = 'R'"), ["page"]).select("page", F.col("ly0").alias("y"), "value")


def repayment_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Schedules written as text, one page a customer, and read again."""
    months = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda k: F.concat_ws(" ", k, (7 - k) * 1000, F.lit("1,100.00"), F.lit(1000), F.when((F.col("c_custkey") % 7 == 0) & (k == 4), 90).otherwise(100), (6 - k) * 1000))
    pages = load(spark, sf, "customer").select("c_custkey", F.concat(F.lit("No Opening EMI Principal Interest Closing\n"), F.array_join(months, "\n")).alias("page_text"))
    rows = schedule.schedule_rows(pages, "page_text")
    return rows.groupBy("c_custkey").agg(F.count("*").alias("rows"), F.count_if("component_valid").alias("valid_parts"), F.count_if("balance_valid").alias("valid_balances"), F.sum("interest").cast("double").alias("interest"))


def page_typing(spark: SparkSession, sf: str) -> DataFrame:
    """Event types carried over low-valued events of a user; an error starts afresh."""
    kind = F.when(F.col("value") < 10, states.UNKNOWN).otherwise(F.col("event_type"))
    pages = load(spark, sf, "events").select("user_id", "ts", "event_id", kind.alias("kind"), F.least(F.lit(1.0), F.round(F.col("value").cast("decimal(10,2)"), 0).cast("double") / 100).alias("confidence"), (F.col("event_type") == "error").alias("fresh"))
    return states.typed_pages(pages, "user_id", ["ts", "event_id"], "kind", "confidence", "fresh").select("event_id", "final_type", F.round("final_confidence", 3).alias("final_confidence"), "method")


def job_attempts(spark: SparkSession, sf: str) -> DataFrame:
    """Attempts of each user's jobs, where an error is a failure."""
    rows = states.job_attempts(load(spark, sf, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error")
    return rows.select("event_id", "attempt", "next", F.col("wait_seconds").cast("bigint").alias("wait_seconds"))


def login_rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    """Events of a user let in while fewer than two came in the hour before."""
    return states.rate_limited(load(spark, sf, "events"), "user_id", "ts", ["event_id"], 2, 3600).select("event_id", "recent", "allowed")


def stale_heartbeats(spark: SparkSession, sf: str) -> DataFrame:
    return states.stale_keys(load(spark, sf, "events"), "user_id", "ts", F.lit("2024-02-15").cast("timestamp"), 14 * 86400)


def name_reject_reasons_all(spark: SparkSession, sf: str) -> DataFrame:
    """Reject reasons of names made from customers, and of the names of those that keep theirs."""
    c = F.col("c_custkey") % 6
    name = F.when(c == 0, "").when(c == 1, F.col("c_name")).when(c == 2, "Mr. A. B. Example").when(c == 3, "mail@x.org").when(c == 4, "Example Bank Limited").otherwise("Mr. Al")
    rows = load(spark, sf, "customer").select(people.bare_name(name).alias("bare"), people.name_reject_reason(name).alias("reason"))
    return rows.groupBy("bare", "reason").agg(F.count("*").alias("n"))


def name_reject_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Each name made from customers, with its reject reason and how many have it, those of reason DIGITS too."""
    return name_reject_reasons_all(spark, sf)


def address_match_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses made of customer keys, matched with a variant of themselves."""
    k = F.col("c_custkey")
    a = F.concat_ws(" ", k % 50, F.lit("Lake Rd, Old Town"), F.lit(411000) + k % 9)
    b = F.concat_ws(" ", (k + F.when(k % 4 == 0, 1).otherwise(0)) % 50, F.when(k % 3 == 0, "Lake Road").otherwise("Lake Road near the mill"), F.lit("Old Town"), F.lit(411000) + (k + k % 2) % 9)
    return load(spark, sf, "customer").groupBy(people.address_match(a, b).alias("kind")).agg(F.count("*").alias("n"))


def extracted_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Statement fields written as text and read again by type."""
    body = F.concat_ws("\n", F.concat(F.lit("Account Holder: "), F.col("c_name")), F.concat(F.lit("Account No: "), F.lpad(F.col("c_custkey").cast("string"), 12, "1")), F.lit("IFSC ABCD0123456"), F.lit("Period: 01/02/2024 to 31/03/2024"))
    found = extract.fields_of(F.when(F.col("c_custkey") % 2 == 0, "bank_statement").otherwise("other"), body)
    return load(spark, sf, "customer").select("c_custkey", F.try_element_at(found, F.lit("account_number")).alias("account_number"), F.try_element_at(found, F.lit("ifsc")).alias("ifsc"), F.try_element_at(found, F.lit("to_date")).alias("to_date"), F.size(found).cast("bigint").alias("fields"))


def names_by_words(spark: SparkSession, sf: str) -> DataFrame:
    """Part names of a brand that share a word and are alike: pairs of names, with how many parts have each."""
    names = load(spark, sf, "part").groupBy("p_brand", F.lower("p_name").alias("x")).agg(F.count("*").alias("n_x"))
    words = names.withColumn("word", F.explode(text.tokens(F.col("x"))))
    other = words.select("p_brand", "word", F.col("x").alias("y"), F.col("n_x").alias("n_y"))
    pairs = words.join(other, ["p_brand", "word"]).where("x < y").select("p_brand", "x", "y", "n_x", "n_y").distinct()
    return pairs.withColumn("similarity", F.round(text.edit_similarity(F.col("x"), F.col("y")), 6)).where("similarity >= 0.6")


def near_names(spark: SparkSession, sf: str) -> DataFrame:
    """Part names of a brand that are alike, with or without a shared word: all pairs of names, with how many parts have each."""
    names = load(spark, sf, "part").groupBy("p_brand", F.lower("p_name").alias("x")).agg(F.count("*").alias("n_x"))
    other = names.select("p_brand", F.col("x").alias("y"), F.col("n_x").alias("n_y"))
    pairs = names.join(other, "p_brand").where("x < y and least(length(x), length(y)) >= 0.59 * greatest(length(x), length(y))")
    return pairs.withColumn("similarity", F.round(text.edit_similarity(F.col("x"), F.col("y")), 6)).where("similarity >= 0.6").select("p_brand", "x", "y", "n_x", "n_y", "similarity")


def fuzzy_ratios(spark: SparkSession, sf: str) -> DataFrame:
    """Exact block ratios of part names against their type, by distinct pairs."""
    pairs = load(spark, sf, "part").select(F.lower("p_name").alias("a"), F.lower("p_type").alias("b")).distinct()
    return pairs.select("a", "b", F.round(people.sequence_ratio("a", "b"), 6).alias("ratio"), F.round(people.token_set_ratio("a", "b"), 4).alias("token_set"))


def complete_months(spark: SparkSession, sf: str) -> DataFrame:
    """Whole months from each order to a fixed day."""
    day = F.col("o_orderdate").cast("date")
    return load(spark, sf, "orders").groupBy(dates.whole_months(day, F.lit("1998-08-31").cast("date")).cast("bigint").alias("months")).agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        registry_top_types, period_coverage, document_age_check, required_status_check, distinct_parts_check, trusted_mismatch_owner, field_mismatch_first, case_readiness,
        unreadable_page_findings, absence_review, lines_from_words, values_right_of_labels, repayment_rows, page_typing, job_attempts, login_rate_limit, stale_heartbeats,
        name_reject_reasons, name_reject_reasons_all, address_match_kinds, extracted_fields, names_by_words, near_names, fuzzy_ratios, complete_months,
    )
}


def _list(terms: list[str]) -> str:
    return "[" + ", ".join(f"'{t}'" for t in terms) + "]::VARCHAR[]"


_RULES = ", ".join(f"('{a}', {b}, '{c}', {_list(d)}, {_list(e)}, {_list(f)})" for a, b, c, d, e, f in _TYPES)
_WORDS = """words AS (SELECT DISTINCT l_orderkey AS page, l_linenumber AS line, no, text, 50.0::DOUBLE * no AS x0, 20.0::DOUBLE * l_linenumber AS y0 FROM (
    SELECT l_orderkey, l_linenumber, unnest([0, 1, 2]) AS no, unnest([l_returnflag, CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)]) AS text FROM lineitem))"""
_AGE = """greatest(0, (1998 - year(newest)) * 12 + 7 - month(newest) - CASE WHEN 1 < day(newest) THEN 1 ELSE 0 END)"""
ORACLE_SQL = {
    "registry_top_types": f"""
        WITH r(type, priority, heading, keywords, required, negative) AS (VALUES {_RULES}), d AS (SELECT doc_id, lower(text) AS t FROM documents),
        h AS (SELECT doc_id, t, r.*, len(list_filter(keywords, lambda x: contains(t, x))) AS k, len(list_filter(required, lambda x: contains(t, x))) AS q, len(list_filter(negative, lambda x: contains(t, x))) AS n FROM d CROSS JOIN r),
        s AS (SELECT doc_id, type, priority, round(CASE WHEN contains(substr(t, 1, 80), heading) THEN 0.6::DOUBLE ELSE 0 END + 0.3::DOUBLE * least(1.0::DOUBLE, k / 2.0::DOUBLE) + CASE WHEN q > 0 THEN 0.25::DOUBLE ELSE 0 END, 3) AS score
              FROM h WHERE n = 0 AND (len(required) = 0 OR q > 0))
        SELECT doc_id, type, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, priority, type) AS place FROM s WHERE score > 0 QUALIFY place <= 5""",
    "period_coverage": """
        WITH m AS (SELECT o_custkey, o_orderpriority, count(DISTINCT CASE WHEN o_orderdate >= DATE '1994-08-01' AND o_orderdate < DATE '1995-08-01' THEN strftime(o_orderdate, '%Y-%m') END) AS c FROM orders GROUP BY 1, 2)
        SELECT o_custkey, min(12 - c) AS months_missing, count(*) FILTER (c = 12) AS full_accounts, min(12 - c) = 0 AS passes FROM m GROUP BY 1""",
    "document_age_check": f"""
        WITH n AS (SELECT o_custkey, max(CAST(o_orderdate AS DATE)) AS newest FROM orders GROUP BY 1), m AS (SELECT *, {_AGE} AS w FROM n),
        a AS (SELECT *, CAST(w + CASE WHEN newest + to_months(CAST(w AS INTEGER)) < DATE '1998-07-01' THEN 1 ELSE 0 END AS INTEGER) AS age FROM m)
        SELECT o_custkey, newest, age, CASE WHEN newest > DATE '1998-07-01' THEN 'FUTURE' WHEN age > 6 THEN 'OLD' ELSE 'OK' END AS status FROM a""",
    "required_status_check": """
        WITH s AS (SELECT o_custkey, bool_or(o_orderstatus = 'F') FILTER (o_orderstatus <> 'P') AS p, count(*) FILTER (o_orderstatus <> 'P') AS known FROM orders GROUP BY 1)
        SELECT o_custkey, known, CASE WHEN p THEN 'PASS' WHEN known > 0 THEN 'FAIL' ELSE 'UNVERIFIABLE' END AS status FROM s""",
    "distinct_parts_check": "SELECT l_orderkey, count(DISTINCT l_partkey) AS distinct_items FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) < 3",
    "trusted_mismatch_owner": """
        WITH t AS (SELECT s_suppkey AS person, CAST(round(CAST(s_acctbal AS DECIMAL(12,2)) / 100000.0::DOUBLE, 2) AS DOUBLE) AS v FROM supplier), o AS (SELECT v, min(person) AS belongs_to FROM t GROUP BY 1 HAVING count(*) = 1)
        SELECT l_suppkey AS person, belongs_to, count(*) AS n FROM lineitem JOIN t ON l_suppkey = person LEFT JOIN o ON l_discount = o.v WHERE NOT abs(l_discount - t.v) < 0.001 GROUP BY 1, 2""",
    "field_mismatch_first": """
        WITH l AS (SELECT l_partkey, l_orderkey * 10 + l_linenumber AS place, l_extendedprice / l_quantity AS unit_price, p_retailprice FROM lineitem JOIN part ON l_partkey = p_partkey)
        SELECT l_partkey, place, unit_price, p_retailprice FROM l WHERE NOT abs(unit_price - p_retailprice) <= 0.01::DOUBLE * p_retailprice
        QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY place, unit_price) = 1""",
    "case_readiness": """
        WITH r AS (SELECT o_custkey, o_orderkey, bool_and(l_linestatus = 'F') AS resolved FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
        SELECT o_custkey, count(*) AS requests, count(*) FILTER (resolved) AS resolved, bool_and(resolved) AS ready FROM r GROUP BY 1""",
    "unreadable_page_findings": """
        SELECT user_id, upper(event_type) || '_CHECK' AS rule_id, count(*) AS n FROM events WHERE NOT value < 5 GROUP BY 1, 2
        UNION ALL SELECT DISTINCT user_id, 'LOW_CONFIDENCE_PAGE', 1 FROM events WHERE value < 5""",
    "absence_review": """
        WITH m AS (SELECT c_custkey AS cust FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')),
        c AS (SELECT o_custkey, count(*) FILTER (o_orderpriority = '2-HIGH') AS a, count(*) FILTER (o_orderstatus = 'P') AS b FROM orders GROUP BY 1)
        SELECT cust, coalesce(a, 0) AS candidate_pages, coalesce(b, 0) AS unread_pages, CASE WHEN coalesce(a, 0) > 0 OR coalesce(b, 0) > 0 THEN 'REVIEW_REQUIRED' ELSE 'MISSING' END AS status
        FROM m LEFT JOIN c ON cust = o_custkey""",
    "lines_from_words": f"""
        WITH {_WORDS} SELECT page, line, string_agg(text, ' ' ORDER BY no, text) AS text, min(x0) AS x0, max(x0) + 30 AS x1, min(y0) AS y0, max(y0) + 10 AS y1 FROM words GROUP BY 1, 2""",
    "values_right_of_labels": f"""
        WITH {_WORDS} SELECT v.page, v.y0 AS y, string_agg(v.text, ' ' ORDER BY v.x0, v.text) AS value FROM words v JOIN words l ON l.page = v.page AND l.line = v.line AND l.no = 0 AND l.text = 'R'
        WHERE v.no > 0 GROUP BY 1, 2""",
    "repayment_rows": """
        SELECT c_custkey, 6::BIGINT AS rows, CASE WHEN c_custkey % 7 = 0 THEN 5 ELSE 6 END::BIGINT AS valid_parts, 6::BIGINT AS valid_balances, CASE WHEN c_custkey % 7 = 0 THEN 590.0 ELSE 600.0 END::DOUBLE AS interest FROM customer""",
    "page_typing": """
        WITH p AS (SELECT event_id, user_id, ts, event_type, CASE WHEN value < 10 THEN NULL ELSE event_type END AS kind, least(1.0::DOUBLE, round(CAST(value AS DECIMAL(10,2)), 0)::DOUBLE / 100) AS c FROM events),
        l AS (SELECT *, last_value(kind IGNORE NULLS) OVER w AS k, last_value(CASE WHEN kind IS NOT NULL THEN c END IGNORE NULLS) OVER w AS kc FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
        SELECT event_id, CASE WHEN kind IS NOT NULL THEN kind WHEN k IS NOT NULL AND event_type <> 'error' THEN k ELSE 'unknown' END AS final_type,
               round(CASE WHEN kind IS NOT NULL THEN c WHEN k IS NOT NULL AND event_type <> 'error' THEN CAST(round(least(CAST(0.85 AS DECIMAL(10,6)), greatest(CAST(0.55 AS DECIMAL(10,6)), CAST(CAST(kc AS DECIMAL(6,4)) * CAST(0.85 AS DECIMAL(3,2)) AS DECIMAL(10,6)))), 3) AS DOUBLE) ELSE 0 END, 3) AS final_confidence,
               CASE WHEN kind IS NOT NULL THEN 'detected' WHEN k IS NOT NULL AND event_type <> 'error' THEN 'inherited' ELSE 'unknown' END AS method FROM l""",
    "job_attempts": """
        WITH a AS (SELECT event_id, event_type, 1 + count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS attempt FROM events)
        SELECT event_id, attempt, CASE WHEN event_type <> 'error' THEN 'DONE' WHEN attempt >= 3 THEN 'DEAD' ELSE 'RETRY' END AS next,
               CASE WHEN event_type = 'error' AND attempt < 3 THEN CASE attempt WHEN 1 THEN 30 ELSE 120 END END::BIGINT AS wait_seconds FROM a""",
    "login_rate_limit": """
        SELECT event_id, count(*) OVER w AS recent, count(*) OVER w < 2 AS allowed FROM events
        WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND 1 PRECEDING)""",
    "stale_heartbeats": """
        SELECT user_id, max(ts) AS last_beat, round((epoch_us(TIMESTAMP '2024-02-15') - epoch_us(max(ts))) / 1e6::DOUBLE, 3) AS late_seconds,
               round((epoch_us(TIMESTAMP '2024-02-15') - epoch_us(max(ts))) / 1e6::DOUBLE, 3) > 14 * 86400 AS stale FROM events GROUP BY 1""",
    "name_reject_reasons": r"""
        SELECT CASE c_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN trim(regexp_replace(lower(c_name), '[^\p{L}\p{N}\p{M}]+', ' ', 'g')) WHEN 2 THEN 'a b example' WHEN 3 THEN 'mail x org' WHEN 4 THEN 'example bank limited' ELSE 'al' END AS bare,
               CASE c_custkey % 6 WHEN 0 THEN 'BLANK' WHEN 1 THEN 'DIGITS' WHEN 3 THEN 'CONTACT' WHEN 4 THEN 'ORGANISATION' WHEN 5 THEN 'SHORT' END AS reason, count(*) AS n FROM customer GROUP BY 1, 2""",
    "name_reject_reasons_all": r"""
        SELECT CASE c_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN trim(regexp_replace(lower(c_name), '[^\p{L}\p{N}\p{M}]+', ' ', 'g')) WHEN 2 THEN 'a b example' WHEN 3 THEN 'mail x org' WHEN 4 THEN 'example bank limited' ELSE 'al' END AS bare,
               CASE c_custkey % 6 WHEN 0 THEN 'BLANK' WHEN 1 THEN 'DIGITS' WHEN 3 THEN 'CONTACT' WHEN 4 THEN 'ORGANISATION' WHEN 5 THEN 'SHORT' END AS reason, count(*) AS n FROM customer GROUP BY 1, 2""",
    "address_match_kinds": """
        WITH s AS (SELECT concat_ws(' ', c_custkey % 50, 'lake rd old town', 411000 + c_custkey % 9) AS a, concat_ws(' ', (c_custkey + CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END) % 50, CASE WHEN c_custkey % 3 = 0 THEN 'lake road' ELSE 'lake road near the mill' END, 'old town', 411000 + (c_custkey + c_custkey % 2) % 9) AS b FROM customer),
        t AS (SELECT list_distinct(list_transform(string_split(a, ' '), lambda w: CASE w WHEN 'rd' THEN 'road' ELSE w END)) AS u, list_distinct(string_split(b, ' ')) AS v FROM s),
        k AS (SELECT *, len(list_intersect(u, v)) AS n, least(len(u), len(v)) AS z, list_filter(u, lambda w: regexp_full_match(w, '[0-9]{1,5}')) AS x, list_filter(v, lambda w: regexp_full_match(w, '[0-9]{1,5}')) AS y FROM t)
        SELECT CASE WHEN len(list_intersect(x, y)) = 0 THEN 'UNIT_CONFLICT' WHEN n = z THEN 'SUBSET' WHEN len(list_filter(list_intersect(u, v), lambda w: length(w) = 6 AND regexp_full_match(w, '[1-9][0-9]{5}'))) > 0 AND n >= 0.55 * z THEN 'PIN'
               WHEN n >= 0.7 * len(list_distinct(list_concat(u, v))) THEN 'SIMILAR' ELSE 'DIFFERENT' END AS kind, count(*) AS n FROM k GROUP BY 1""",
    "extracted_fields": """
        SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN lpad(CAST(c_custkey AS VARCHAR), 12, '1') END AS account_number, CASE WHEN c_custkey % 2 = 0 THEN 'ABCD0123456' END AS ifsc,
               CASE WHEN c_custkey % 2 = 0 THEN '31/03/2024' END AS to_date, CASE WHEN c_custkey % 2 = 0 THEN 5 ELSE 0 END::BIGINT AS fields FROM customer""",
    "names_by_words": """
        WITH n AS (SELECT p_brand, lower(p_name) AS x, count(*) AS c FROM part GROUP BY 1, 2), p AS (
          SELECT a.p_brand, a.x, b.x AS y, a.c AS n_x, b.c AS n_y, round(1 - levenshtein(a.x, b.x) / greatest(length(a.x), length(b.x))::DOUBLE, 6) AS similarity
          FROM n a JOIN n b ON a.p_brand = b.p_brand AND a.x < b.x AND len(list_intersect(string_split(a.x, ' '), string_split(b.x, ' '))) > 0)
        SELECT * FROM p WHERE similarity >= 0.6""",
    "near_names": """
        WITH n AS (SELECT p_brand, lower(p_name) AS x, count(*) AS c FROM part GROUP BY 1, 2), p AS (
          SELECT a.p_brand, a.x, b.x AS y, a.c AS n_x, b.c AS n_y, round(1 - levenshtein(a.x, b.x) / greatest(length(a.x), length(b.x))::DOUBLE, 6) AS similarity
          FROM n a JOIN n b ON a.p_brand = b.p_brand AND a.x < b.x)
        SELECT * FROM p WHERE similarity >= 0.6""",
    "complete_months": """
        SELECT CAST(greatest(0, (1998 - year(o_orderdate)) * 12 + 8 - month(o_orderdate) - CASE WHEN 31 < day(o_orderdate) THEN 1 ELSE 0 END) AS BIGINT) AS months, count(*) AS n FROM orders GROUP BY 1""",
}
