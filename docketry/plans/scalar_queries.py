"""Queries on written values: amounts, rates, files, answers, messages, boxes and checklists, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import dates, money, records
from docketry.operators import ownership, relational
from docketry.plans import casefile
from docketry.sources.tables import load

_K = "c_custkey"


def _made(spark: SparkSession, sf: str, source: str, **columns: str) -> DataFrame:
    return load(spark, sf, source).selectExpr(*[f"{e} AS {n}" for n, e in columns.items()])


def written_amounts(spark: SparkSession, sf: str) -> DataFrame:
    """Amounts as written, as digits."""
    rows = _made(spark, sf, "customer", k=_K, a=f"CASE {_K} % 4 WHEN 0 THEN concat('Rs. ', CAST({_K} AS STRING), ',000') WHEN 1 THEN concat(CAST({_K} AS STRING), '.5 lakh') WHEN 2 THEN concat('₹ ', CAST({_K} AS STRING), '.25') ELSE 'nil' END")
    return rows.select("k", money.amount_text(F.col("a")).alias("amount"))


def loan_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Months and rates out of a sentence."""
    rows = _made(spark, sf, "customer", k=_K, a=f"CASE {_K} % 4 WHEN 0 THEN concat('Tenure: ', CAST({_K} % 30 + 1 AS STRING), ' years, ROI ', CAST({_K} % 20 AS STRING), '.5 % p.a.') WHEN 1 THEN concat('loan term of ', CAST({_K} % 300 AS STRING), ' months at Apr 12, 2024') WHEN 2 THEN concat('dated 3 Apr 2024 APR is ', CAST({_K} % 9 AS STRING), '%') ELSE 'none' END")
    return rows.select("k", money.tenure_months(F.col("a")).alias("months"), money.rate_percent(F.col("a")).alias("rate"))


def model_costs(spark: SparkSession, sf: str) -> DataFrame:
    """Cost of calls by the model's name; events stand for calls."""
    rows = _made(spark, sf, "events", model="CASE event_type WHEN 'click' THEN 'large-1' WHEN 'view' THEN 'small-2' ELSE event_type END", a="CAST(event_id % 1000 AS BIGINT)", b="CAST(event_id % 300 AS BIGINT)")
    cost = money.model_cost(F.col("model"), F.col("a"), F.col("b"))
    return rows.groupBy("model").agg(F.count("*").alias("calls"), F.round(F.sum(cost.cast("decimal(18,6)")).cast("double"), 6).alias("usd"))


def duty_statuses(spark: SparkSession, sf: str) -> DataFrame:
    """Duty paid against duty owed, rounded up."""
    rows = _made(spark, sf, "orders", k="o_orderkey", base="CAST(o_totalprice AS DOUBLE)", paid="CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 3000 AS DOUBLE) END", rules="o_orderkey % 4")
    owed = money.duty(F.lit("percentage"), F.col("base"), F.lit(None).cast("double"), F.lit(0.5), F.lit(100), F.lit(2500), "ceil")
    return rows.groupBy(money.duty_status(F.col("paid"), owed, F.col("rules")).alias("status")).agg(F.count("*").alias("n"), F.round(F.sum(owed), 2).alias("owed"))


def file_name_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Type, role and person out of paths."""
    rows = _made(spark, sf, "customer", k=_K, p=f"concat('case/', {casefile.word('co-applicant guarantor Primary other', _K)}, '/', {casefile.word('PAN_card aadhaar-front Bank Statement scan', _K, ' ')}, '_', replace({casefile.name(_K)}, ' ', '_'), '.pdf')")
    facts = records.file_facts(F.col("p"))
    return rows.select("k", facts["type"].alias("type"), facts["role"].alias("role"), facts["person"].alias("person"), records.safe_name(F.concat(F.lit(" .a b/"), F.col("k").cast("string"), F.lit("?"))).alias("safe"))


def failure_classes(spark: SparkSession, sf: str) -> DataFrame:
    rows = _made(spark, sf, "orders", m=casefile.word("Read timed out|HTTP 429 quota|file not found|corrupt page|out of memory|503 unavailable|odd", "o_orderkey", "|"))
    return rows.groupBy(records.failure_class(F.col("m")).alias("failure")).agg(F.count("*").alias("n"))


def unmarked_words(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts without accents and punctuation."""
    return load(spark, sf, "documents").select("doc_id", records.unmarked(F.col("text")).alias("plain"))


def word_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Words with boxes in several shapes as one, with their mean confidence."""
    rows = _made(spark, sf, "customer", k=_K, w=f"CASE {_K} % 3 WHEN 0 THEN concat('[{{\"t\": \"a\", \"b\": [0.1, 0.2, 0.3, 0.4], \"c\": 0.5}}, {{\"text\": \" \"}}]') WHEN 1 THEN '[{{\"word\": \"b\", \"bbox\": [30, 20, 10, 40], \"conf\": 0.9}}, {{\"text\": \"c\", \"box\": [0, 0, 50, 50]}}]' ELSE 'no list' END".replace("{{", "{").replace("}}", "}"))
    rows = rows.withColumn("words", records.coerced_words(F.col("w")))
    first = F.get("words", F.lit(0))
    c = records.confidences(F.transform(F.col("words"), lambda x: x["c"]))
    return rows.select("k", F.size("words").cast("bigint").alias("n"), first["t"].alias("word"), F.round(records.scaled_box(first["b"], F.lit(100.0), F.lit(200.0))[1], 4).alias("y0"), c["mean"].alias("mean"), c["least"].alias("least"))


def nested_confidences(spark: SparkSession, sf: str) -> DataFrame:
    rows = _made(spark, sf, "customer", k=_K, p=f"concat('{{\"pages\": [{{\"confidence\": 0.', CAST({_K} % 9 + 1 AS STRING), ', \"blocks\": [{{\"confidence\": 0.5}}]}}], \"detectedLanguages\": [{{\"confidence\": 0.01}}]}}')".replace("{{", "{").replace("}}", "}"))
    return rows.select("k", records.nested_confidence(F.col("p")).alias("mean"))


def model_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Answers as JSON, fenced JSON or lines."""
    rows = _made(spark, sf, "customer", k=_K, a=f"CASE {_K} % 4 WHEN 0 THEN concat('{{\"verdict\": \"ok\", \"score\": ', CAST({_K} AS STRING), '}}') WHEN 1 THEN concat('Here it is:', chr(10), '```json', chr(10), '{{\"verdict\": \"no\"}}', chr(10), '```') WHEN 2 THEN concat('verdict: maybe', chr(10), 'score: 7') ELSE 'nothing' END".replace("{{", "{").replace("}}", "}"))
    found = records.answer(F.col("a"), "struct<verdict: string, score: string>")
    return rows.select("k", found["verdict"].alias("verdict"), found["score"].alias("score"))


def issue_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """Templates filled for the events of each user."""
    rows = load(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_set(F.dayofmonth("ts"))).alias("days"), F.count("*").cast("string").alias("n"))
    values = F.create_map(F.lit("count"), F.col("n"), F.lit("pages"), records.pages_phrase(F.col("days")))
    return rows.select("user_id", records.rendered(F.lit("{count} issues on {pages}{nothing}."), values).alias("sentence"))


def checklist_statuses(spark: SparkSession, sf: str) -> DataFrame:
    """Status of each case and kind of document, and how the header counts them."""
    pages = casefile.pages(spark, sf)
    wanted = F.explode(F.array(*[F.lit(t) for t in ("PAN", "Aadhaar", "Bank Statement", "Passbook")]))
    cases = casefile.people(spark, sf).select("app").distinct().withColumn("document_type", wanted)
    seen = pages.groupBy("app", "document_type").agg(F.count("*").alias("found"), F.count_if("is_readable").alias("readable"), F.count_if(F.col("is_readable") & (F.col("classification_confidence") >= 0.65)).alias("sure"))
    rows = cases.join(seen, ["app", "document_type"], "left").fillna(0, ["found", "readable", "sure"])
    status = records.checklist_status(F.col("found"), F.col("readable"), F.col("sure"), (F.col("document_type") != "Passbook") | (F.col("app") % 2 == 0))
    return rows.groupBy("document_type", status["status"].alias("status"), status["grade"].alias("grade")).agg(F.count("*").alias("n"))


def values_in_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """PAN of the block after a label, if the block has one only."""
    rows = _made(spark, sf, "customer", k=_K, b=f"concat('Form', chr(10), 'Applicant details', chr(10), 'PAN ', {casefile.pan(_K)}, chr(10), CASE WHEN {_K} % 3 = 0 THEN concat('also ', {casefile.pan(f'{_K} + 1')}, chr(10)) ELSE '' END, 'Signature', chr(10), {casefile.pan(f'{_K} + 2')})")
    return rows.select("k", records.block_value(F.col("b"), "applicant details", "[A-Z]{5}[0-9]{4}[A-Z]").alias("pan"))


def debtor_searches(spark: SparkSession, sf: str) -> DataFrame:
    rows = _made(spark, sf, "customer", k=_K, b=f"concat(CASE WHEN {_K} % 2 = 0 THEN 'Debtor Based Search' ELSE 'Asset Based Search' END, chr(10), 'Debtor Name: ', {casefile.name(_K)}, chr(10), 'pan - ', lower({casefile.pan(_K)}))")
    d = records.debtor(F.col("b"))
    return rows.select("k", d["debtor_based"].alias("debtor_based"), d["name"].alias("name"), d["pan"].alias("pan"))


def literal_person_values(spark: SparkSession, sf: str) -> DataFrame:
    """Trusted values of people that stand as they are in the text of a page of their case."""
    pages = casefile.pages(spark, sf).select("app", "page_number", F.concat_ws(" ", F.lit("text"), "applicant_name", "pan_number", "phone_number").alias("body"))
    return ownership.seen_people(casefile.people(spark, sf), pages, ["app"], ["applicant_name", "pan_number", "phone_number"], "body")


def recovered_fields(spark: SparkSession, sf: str) -> DataFrame:
    """People whose PAN no page shows, and the only page of theirs that holds it in its text, if one does."""
    people, pages = casefile.people(spark, sf), casefile.pages(spark, sf)
    shown = pages.where("pan_number is not null").select("app", F.col("pan_number")).distinct()
    none = people.join(shown, ["app", "pan_number"], "left_anti")
    texts = pages.select("app", "page_number", F.expr(casefile.pan("seen")).alias("body"))
    found = ownership.seen_people(none, texts, ["app"], ["pan_number"], "body")
    one = found.groupBy("app", "person").agg(F.min("page_number").alias("page_number"), F.countDistinct("page_number").alias("pages"))
    return none.select("app", "person").join(one, ["app", "person"], "left").select("app", "person", F.when(F.col("pages") == 1, F.col("page_number")).alias("page_number"), F.coalesce("pages", F.lit(0)).alias("pages"))


def sections_by_name(spark: SparkSession, sf: str) -> DataFrame:
    """Details of people and addresses on pages in one row a name, of which either may lack some."""
    key = F.regexp_replace(F.lower("applicant_name"), "[^a-z]", "")
    left = casefile.people(spark, sf).groupBy(key.alias("key")).agg(F.min("pan_number").alias("pan"))
    right = casefile.pages(spark, sf).where("applicant_name is not null and address is not null").groupBy(key.alias("key")).agg(F.min("address").alias("address"), F.min("page_number").alias("first"))
    return left.join(right, "key", "full_outer").select("key", "pan", "address", "first")


def newest_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of each customer's newest order."""
    jobs = relational.latest_by(load(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")])
    lines = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return lines.join(jobs, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "o_orderkey", "l_linenumber", "l_partkey")


def day_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Events of one day and of the ten days before, by bounds."""
    begin, end = dates.day_bounds(F.lit("2024-01-20"))
    ts = F.col("ts").cast("timestamp")
    rows = load(spark, sf, "events").select(F.when((ts >= begin) & (ts < end), "day").when((F.date_format(ts, "yyyy-MM-dd HH:mm:ss") >= dates.cutoff_text(begin, 10)) & (ts < begin), "before").alias("part"))
    return rows.where("part is not null").groupBy("part").agg(F.count("*").alias("n"))


def processing_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Findings about how pages were read, one a page, by the first rule that fits."""
    rule = (
        F.when(F.col("page_number") % 97 == 0, "PAGE_PROCESSING_ERROR")
        .when(~F.col("is_readable"), "UNREADABLE_PAGE")
        .when(F.col("ocr_confidence") < 0.55, "LOW_OCR_CONFIDENCE")
        .when(F.col("document_type") == "Unknown", "UNCLASSIFIED_PAGE")
        .when(F.col("classification_confidence") < 0.3, "AUTO_DOCUMENT_TYPE_LOW_CONFIDENCE")
        .when(F.col("triage") == "blank", "DOCUMENT_NOT_READABLE")
    )
    return casefile.pages(spark, sf).select(rule.alias("rule_id")).where("rule_id is not null").groupBy("rule_id").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        written_amounts, loan_terms, model_costs, duty_statuses, file_name_facts, failure_classes, unmarked_words, word_boxes, nested_confidences, model_answers, issue_sentences, checklist_statuses, values_in_blocks,
        debtor_searches, literal_person_values, recovered_fields, sections_by_name, newest_inputs, day_windows, processing_findings,
    )
}

_PLAIN = f"trim(regexp_replace(translate(lower(text), '{records.MARKED}', '{records.PLAIN}'), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+', ' ', 'g'))"
_SEEN = """seen AS (SELECT DISTINCT k.app, person, field, page_number FROM (SELECT app, person, unnest(['applicant_name', 'pan_number', 'phone_number']) AS field, unnest([replace(applicant_name, ' ', ''), lower(pan_number), phone_number]) AS v FROM people) k
    JOIN (SELECT app, page_number, regexp_replace(lower(concat_ws(' ', 'text', applicant_name, pan_number, phone_number)), '[^a-z0-9]', '', 'g') AS b FROM pages) p ON k.app = p.app AND contains(p.b, k.v))"""
ORACLE_SQL = {
    "written_amounts": "SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN CAST(c_custkey * 1000 AS VARCHAR) WHEN 1 THEN CAST(c_custkey * 100000 + 50000 AS VARCHAR) WHEN 2 THEN c_custkey || '.25' END AS amount FROM customer",
    "loan_terms": "SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN (c_custkey % 30 + 1) * 12 WHEN 1 THEN c_custkey % 300 END AS months, CAST(CASE c_custkey % 4 WHEN 0 THEN c_custkey % 20 + 0.5 WHEN 2 THEN c_custkey % 9 END AS DOUBLE) AS rate FROM customer",
    "model_costs": """
        WITH e AS (SELECT CASE event_type WHEN 'click' THEN 'large-1' WHEN 'view' THEN 'small-2' ELSE event_type END AS model, event_id % 1000 AS a, event_id % 300 AS b FROM events)
        SELECT model, count(*) AS calls, round(CAST(sum(CAST(round((a * CASE model WHEN 'large-1' THEN 5.0::DOUBLE WHEN 'small-2' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END + b * CASE model WHEN 'large-1' THEN 15.0::DOUBLE WHEN 'small-2' THEN 1.5::DOUBLE ELSE 3.0::DOUBLE END) / 1e6::DOUBLE, 6) AS DECIMAL(18,6))) AS DOUBLE), 6) AS usd FROM e GROUP BY 1""",
    "duty_statuses": """
        WITH o AS (SELECT CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 3000 END AS paid, o_orderkey % 4 AS rules, CAST(ceil(least(greatest(CAST(CAST(o_totalprice AS DECIMAL(18,4)) * CAST(0.5 AS DECIMAL(8,4)) / 100 AS DECIMAL(28,8)), 100), 2500)) AS DOUBLE) AS owed FROM orders)
        SELECT CASE WHEN rules = 0 THEN 'NO_RULE' WHEN rules > 1 THEN 'AMBIGUOUS' WHEN paid IS NULL THEN 'UNKNOWN' WHEN paid < owed THEN 'UNDERPAID' WHEN paid > owed THEN 'OVERPAID' ELSE 'COMPLIANT' END AS status, count(*) AS n, round(sum(owed), 2) AS owed FROM o GROUP BY 1""",
    "file_name_facts": f"""
        SELECT c_custkey AS k, CASE c_custkey % 5 WHEN 0 THEN 'PAN' WHEN 1 THEN 'Aadhaar' WHEN 2 THEN 'Bank Statement' WHEN 3 THEN 'Bank Statement' END AS type, CASE c_custkey % 4 WHEN 0 THEN 'coapplicant' WHEN 1 THEN 'guarantor' WHEN 2 THEN 'primary' END AS role,
               {casefile.name(_K)} AS person, 'a_b_' || c_custkey AS safe FROM customer""",
    "failure_classes": "SELECT ['TIMEOUT', 'QUOTA', 'MISSING_INPUT', 'BAD_INPUT', 'MEMORY', 'SERVICE', 'OTHER'][o_orderkey % 7 + 1] AS failure, count(*) AS n FROM orders GROUP BY 1",
    "unmarked_words": f"SELECT doc_id, {_PLAIN} AS plain FROM documents",
    "word_boxes": """
        SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 END::BIGINT AS n, CASE c_custkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS word, CAST(CASE c_custkey % 3 WHEN 0 THEN 0.2 WHEN 1 THEN 0.1 END AS DOUBLE) AS y0,
               CAST(CASE c_custkey % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 0.95 END AS DOUBLE) AS mean, CAST(CASE c_custkey % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 0.9 END AS DOUBLE) AS least FROM customer""",
    "nested_confidences": "SELECT c_custkey AS k, round(((c_custkey % 9 + 1) / 10::DOUBLE + 0.5::DOUBLE) / 2, 4) AS mean FROM customer",
    "model_answers": "SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'no' WHEN 2 THEN 'maybe' END AS verdict, CASE c_custkey % 4 WHEN 0 THEN CAST(c_custkey AS VARCHAR) WHEN 2 THEN '7' END AS score FROM customer",
    "issue_sentences": """
        WITH e AS (SELECT user_id, list_sort(list(DISTINCT day(ts))) AS d, count(*) AS n FROM events GROUP BY 1)
        SELECT user_id, n || ' issues on ' || CASE len(d) WHEN 1 THEN 'page ' || d[1] ELSE 'pages ' || array_to_string(d[1:len(d) - 1], ', ') || ' and ' || d[len(d)] END || '.' AS sentence FROM e""",
    "checklist_statuses": f"""
        WITH {casefile.PEOPLE_SQL}, {casefile.PAGES_SQL}, w AS (SELECT DISTINCT app, ty FROM people, (VALUES ('PAN'), ('Aadhaar'), ('Bank Statement'), ('Passbook')) v(ty)),
        s AS (SELECT app, document_type, count(*) AS f, count(*) FILTER (is_readable) AS r, count(*) FILTER (is_readable AND classification_confidence >= 0.65) AS c FROM pages GROUP BY ALL),
        j AS (SELECT ty AS document_type, CASE WHEN ty = 'Passbook' AND w.app % 2 <> 0 THEN 'NOT_APPLICABLE' WHEN f > 0 AND c > 0 THEN 'FOUND' WHEN f > 0 AND r = 0 THEN 'FOUND_UNREADABLE' WHEN f > 0 THEN 'REVIEW' ELSE 'MISSING' END AS status FROM w LEFT JOIN s ON w.app = s.app AND ty = document_type)
        SELECT document_type, status, CASE status WHEN 'MISSING' THEN 'high' WHEN 'REVIEW' THEN 'medium' WHEN 'FOUND_UNREADABLE' THEN 'medium' ELSE 'low' END AS grade, count(*) AS n FROM j GROUP BY ALL""",
    "values_in_blocks": f"SELECT c_custkey AS k, CASE WHEN c_custkey % 3 <> 0 THEN {casefile.pan(_K)} END AS pan FROM customer",
    "debtor_searches": f"SELECT c_custkey AS k, c_custkey % 2 = 0 AS debtor_based, {casefile.name(_K)} AS name, {casefile.pan(_K)} AS pan FROM customer",
    "literal_person_values": f"WITH {casefile.PEOPLE_SQL}, {casefile.PAGES_SQL}, {_SEEN} SELECT * FROM seen",
    "recovered_fields": f"""
        WITH {casefile.PEOPLE_SQL}, {casefile.PAGES_SQL}, n AS (SELECT app, person, pan_number FROM people k WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE p.app = k.app AND p.pan_number = k.pan_number)),
        f AS (SELECT n.app, person, p.page_number FROM n JOIN pages p ON p.app = n.app AND {casefile.pan("p.seen")} = n.pan_number)
        SELECT n.app, n.person, CASE WHEN count(DISTINCT page_number) = 1 THEN min(page_number) END AS page_number, count(DISTINCT page_number) AS pages FROM n LEFT JOIN f ON n.app = f.app AND n.person = f.person GROUP BY n.app, n.person""",
    "sections_by_name": f"""
        WITH {casefile.PEOPLE_SQL}, {casefile.PAGES_SQL}, l AS (SELECT regexp_replace(lower(applicant_name), '[^a-z]', '', 'g') AS key, min(pan_number) AS pan FROM people GROUP BY 1),
        r AS (SELECT regexp_replace(lower(applicant_name), '[^a-z]', '', 'g') AS key, min(address) AS address, min(page_number) AS first FROM pages WHERE applicant_name IS NOT NULL AND address IS NOT NULL GROUP BY 1)
        SELECT coalesce(l.key, r.key) AS key, pan, address, first FROM l FULL JOIN r ON l.key = r.key""",
    "newest_inputs": """
        WITH j AS (SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) SELECT o_custkey, o_orderkey, l_linenumber, l_partkey FROM j JOIN lineitem ON l_orderkey = o_orderkey""",
    "day_windows": """
        SELECT CASE WHEN ts >= TIMESTAMP '2024-01-20' THEN 'day' ELSE 'before' END AS part, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-21' GROUP BY 1""",
    "processing_findings": f"""
        WITH {casefile.PAGES_SQL}, r AS (SELECT CASE WHEN page_number % 97 = 0 THEN 'PAGE_PROCESSING_ERROR' WHEN NOT is_readable THEN 'UNREADABLE_PAGE' WHEN ocr_confidence < 0.55 THEN 'LOW_OCR_CONFIDENCE' WHEN document_type = 'Unknown' THEN 'UNCLASSIFIED_PAGE'
          WHEN classification_confidence < 0.3 THEN 'AUTO_DOCUMENT_TYPE_LOW_CONFIDENCE' WHEN triage = 'blank' THEN 'DOCUMENT_NOT_READABLE' END AS rule_id FROM pages) SELECT rule_id, count(*) AS n FROM r WHERE rule_id IS NOT NULL GROUP BY 1""",
}
