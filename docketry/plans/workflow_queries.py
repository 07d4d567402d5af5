"""Queries on work lists, review views, retention and loose inputs, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import dates
from docketry.operators import retention, workflow
from docketry.plans import casefile
from docketry.sources import payloads
from docketry.sources.tables import load

_K = "c_custkey"
CASES = {
    "app": _K,
    "state": f"CASE {_K} % 7 WHEN 0 THEN 'ready' WHEN 1 THEN 'waiting_documents' WHEN 2 THEN 'completed' END",
    "status": casefile.word("needs_review clean failed incomplete verified accepted draft", _K),
    "progress": f"CASE {_K} % 11 WHEN 0 THEN 'processing' WHEN 1 THEN 'completed' END",
    "job": f"CASE {_K} % 13 WHEN 0 THEN 'running' WHEN 1 THEN 'failed' END",
    "owner": f"CASE WHEN {_K} % 3 = 0 THEN {_K} % 5 END",
}
FINDINGS = {
    "app": "CAST(floor(o_custkey / 4) AS BIGINT)",
    "finding": "o_orderkey",
    "page_number": "o_orderkey % 40",
    "code": casefile.word("NAME PAN AGE SCORE ADDRESS LOAN STAMP", "floor(o_orderkey / 2)"),
    "severity": casefile.word("LOW HIGH MEDIUM LOW LOW", "floor(o_orderkey / 3)"),
    "rule_id": casefile.word("PAN_NUMBER_MISMATCH UNREADABLE_PAGE_SUMMARY TRUSTED_NAME_MISMATCH PAGE_PROCESSING_TIMEOUT AADHAAR_NUMBER_MISMATCH DATE_CHECK", "o_orderkey"),
    "expected_value": casefile.pan("o_custkey"),
    "found_value": f"CASE WHEN o_orderkey % 4 = 0 THEN concat(substr({casefile.pan('o_custkey')}, 1, 5), '-', lower(substr({casefile.pan('o_custkey')}, 6, 5))) ELSE {casefile.pan('o_custkey + 1')} END",
    "document_type": casefile.word("PAN Card|Bank Statement|Loan Form|Cheque", "o_orderkey", "|"),
}


def _made(spark: SparkSession, sf: str, source: str, columns: dict[str, str]) -> DataFrame:
    return load(spark, sf, source).selectExpr(*[f"{e} AS {n}" for n, e in columns.items()])


def case_workflow(spark: SparkSession, sf: str) -> DataFrame:
    """State and next action of each case for one user, and the views that it is in."""
    rows = _made(spark, sf, "customer", CASES).withColumn("s", workflow.workflow_state(F.col("state"), F.col("status"), F.col("progress"), F.col("job")))
    views = F.array_compact(F.array(*[F.when(workflow.in_view(v, F.col("s"), F.col("owner"), F.lit(3)), F.lit(v)) for v in ("all", "ready", "mine", "waiting", "completed", "processing")]))
    return rows.select("app", F.col("s").alias("workflow_state"), workflow.next_action(F.col("s"), F.col("owner"), F.lit(3)).alias("next_action"), F.array_join(views, ",").alias("views"))


def severity_split(spark: SparkSession, sf: str) -> DataFrame:
    """Findings about the business and about processing."""
    rows = _made(spark, sf, "orders", FINDINGS)
    return rows.groupBy("rule_id", workflow.warns_of_processing(F.col("rule_id")).alias("processing")).agg(F.count("*").alias("n"))


def dismissed_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Findings that a sure assessment may dismiss."""
    rows = _made(spark, sf, "orders", FINDINGS)
    sure, quote = F.when(F.col("finding") % 3 == 0, 0.99).otherwise(0.5), F.concat(F.lit("PAN "), F.col("found_value"))
    ok = workflow.dismissible(F.col("rule_id"), F.lit("possible_false_positive"), sure, F.col("expected_value"), F.col("found_value"), quote, F.concat(F.lit("card: "), quote))
    return rows.where(ok).select("finding")


def decision_checks(spark: SparkSession, sf: str) -> DataFrame:
    """What forbids the decision on each case."""
    k = F.col("c_custkey")
    action = F.element_at(F.array(F.lit("ACCEPT"), F.lit("OVERRIDE"), F.lit("REQUEST_DOCS")), (k % 3 + 1).cast("int"))
    why = workflow.decision_reasons(action, k % 5 != 0, k % 4, k % 2, k % 7, F.when(k % 6 != 0, "because"), k % 8, F.when(k % 9 != 0, "please send"))
    return load(spark, sf, "customer").select("c_custkey", action.alias("action"), F.array_join(why, ",").alias("reasons"), (F.size(why) == 0).alias("allowed"))


def people_in_scope(spark: SparkSession, sf: str) -> DataFrame:
    """How many people of all cases each kind of rule is about."""
    people = casefile.people(spark, sf)
    made = [workflow.scoped(people, ["app"], s).agg(F.count("*").alias("n")).select(F.lit(s).alias("scope"), "n") for s in ("each_person", "each_borrower", "pdc_people", "banking_people")]
    return made[0].unionAll(made[1]).unionAll(made[2]).unionAll(made[3])


def grouped_case_findings(spark: SparkSession, sf: str) -> DataFrame:
    """One finding a case and code, by the worst."""
    rows = workflow.grouped_findings(_made(spark, sf, "orders", FINDINGS), ["app"], "code", "finding")
    return rows.select("app", "code", "severity", "expected_value", "found_value", workflow.preview("pages").alias("pages"), "findings")


def overflow_pages(spark: SparkSession, sf: str) -> DataFrame:
    rows = workflow.grouped_findings(_made(spark, sf, "orders", FINDINGS), ["app"], "code", "finding")
    return workflow.overflow_by_page(rows, ["app"], "code", 3)


def comparison_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """For each supplier of a part the discounts seen, against the part's usual one."""
    lines = load(spark, sf, "lineitem").select("l_partkey", F.round("l_discount", 2).cast("string").alias("value"), F.col("l_orderkey").alias("page"), (F.col("l_discount") <= 0.05).alias("ok"))
    rows = lines.groupBy("l_partkey", "page").agg(F.min("value").alias("value"), F.bool_and("ok").alias("ok"))
    return workflow.matrix_rows(rows, ["l_partkey"], "value", "ok", "page").select("l_partkey", "extracted", "status")


def relationship_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return workflow.relation_nodes(casefile.people(spark, sf), ["app"])


def case_document_summaries(spark: SparkSession, sf: str) -> DataFrame:
    pages = casefile.pages(spark, sf).select("app", "page_number", "document_type")
    return workflow.document_summaries(pages, pages.where("page_number % 13 = 0"), ["app"], "document_type")


def finding_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """The best three pages of its case for each finding of a high severity."""
    pages = casefile.pages(spark, sf).withColumns({"app": F.floor(F.expr("(seen) / 4")), "kind": F.col("document_type"), "body": F.concat_ws(" ", F.lit("page of"), "document_type", "applicant_name")}).select("app", "page_number", "kind", "body")
    rows = workflow.evidence_pages(_made(spark, sf, "orders", FINDINGS).where("severity = 'HIGH'").select("app", "finding", "document_type", F.col("finding").alias("page_number")), pages, ["app"], "finding", 3)
    return rows.select("finding", "page", F.col("place").cast("bigint").alias("place"), F.col("hits").cast("bigint").alias("hits"), F.col("omitted").cast("bigint").alias("omitted"))


def review_items(spark: SparkSession, sf: str) -> DataFrame:
    """Items of two lists in one, the first list first."""
    a = load(spark, sf, "part").where("p_partkey % 3 = 0").selectExpr("p_partkey AS s_no", "p_name AS description", "'asked' AS reason")
    b = load(spark, sf, "part").selectExpr("p_partkey AS s_no", "p_type AS description", "CASE WHEN p_partkey % 2 = 0 THEN 'manual' END AS reason")
    b = b.withColumn("reason", F.coalesce("reason", F.lit("Physical-only, conditional, or system-status item; verify manually.")))
    return workflow.merged_first_wins([a, b], F.coalesce(F.col("s_no").cast("string"), F.col("description")), "description")


def request_waits(spark: SparkSession, sf: str) -> DataFrame:
    """Minutes that each customer's orders waited for their first receipt, rounds, and how many had several."""
    spans = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("b"))
    rows = load(spark, sf, "orders").join(spans, F.col("o_orderkey") == F.col("l_orderkey")).withColumn("m", dates.minutes_between(F.col("o_orderdate").cast("timestamp"), F.col("b").cast("timestamp")))
    per = rows.groupBy("o_custkey").agg(F.sum("m").alias("wait"), F.count("*").alias("rounds"))
    return per.agg(F.count("*").alias("cases"), F.count_if(F.col("rounds") > 1).alias("several"), F.sum("rounds").alias("rounds"), F.round(F.max("wait"), 3).alias("longest"))


def storage_by_case(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes of objects whose owner is a number."""
    rows = load(spark, sf, "documents").selectExpr("CASE WHEN doc_id % 5 = 0 THEN concat('x', CAST(doc_id AS STRING)) ELSE CAST(doc_id % 50 AS STRING) END AS owner_id", "n_chars * 1000 AS size")
    out = rows.where(F.col("owner_id").rlike("^[0-9]+$")).groupBy(F.col("owner_id").try_cast("bigint").alias("app")).agg(F.count("*").alias("objects"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    return out.select("app", "objects", "bytes", workflow.pretty_bytes(F.col("bytes")).alias("pretty"))


def progress_eta(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderstatus = 'O' THEN 'processing' ELSE 'done' END AS status", "o_orderkey % 10 AS done", "20 AS total", "CAST(o_orderdate AS TIMESTAMP) AS started")
    return rows.select("o_orderkey", workflow.eta_seconds(F.col("status"), F.col("done"), F.col("total"), F.col("started"), F.lit("1999-01-01").cast("timestamp")).alias("eta"))


def cheque_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Cheques shown by each customer's pages, or pages where none has a number."""
    rows = load(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("page_number"), F.when(F.col("o_custkey") % 2 == 0, F.array((F.col("o_orderkey") % 3).cast("string"), F.lit(""))).alias("numbers"))
    return workflow.physical_evidence(rows, ["o_custkey"], "numbers")


_NOW = "1997-01-01"
JOBS = {"app": "o_custkey", "job_id": "o_orderkey", "status": casefile.word("completed failed running completed queued", "o_orderkey")}


def retention_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many rows each of the seven retention rules would delete or archive."""
    cut = F.lit(_NOW).cast("timestamp")
    orders = load(spark, sf, "orders")
    jobs = _made(spark, sf, "orders", JOBS)
    cases = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("app")).agg(F.max("o_orderdate").alias("created_at"))
    cases = cases.withColumn("archived_at", F.when(F.col("app") % 5 == 0, F.col("created_at")))
    inputs = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("job_id"), "l_linenumber")
    refs = orders.selectExpr("o_custkey AS app", "o_orderkey AS ref", casefile.word("source manifest report ocr_export page_preview", "o_orderkey") + " AS purpose", "CASE WHEN o_orderkey % 17 = 0 THEN '../x' ELSE concat('k/', CAST(o_orderkey AS STRING)) END AS storage_key", "CASE WHEN o_orderkey % 3 = 0 THEN date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss\") WHEN o_orderkey % 3 = 1 THEN date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') ELSE 'unknown' END AS created_text")
    log = orders.selectExpr("o_orderdate AS at", casefile.word("decision_recorded page_viewed user_created job_started", "o_orderkey") + " AS action")
    made = {
        "job_inputs": retention.job_inputs(inputs, jobs), "stale_jobs": retention.stale_jobs(jobs), "telemetry": retention.older(load(spark, sf, "events"), "ts", F.lit("2024-02-01").cast("timestamp")), "audit_log": retention.old_audit(log, "at", cut),
        "to_archive": retention.to_archive(cases, cut), "source_objects": retention.source_objects(refs, cases, jobs, cut), "ocr_exports": retention.old_exports(refs, cut),
    }
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("rule"), "n") for name, df in made.items()]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionAll(more)
    return out


def manifest_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Problems of manifests made from customers, in both shapes."""
    people = F.when(F.col("c_custkey") % 2 == 0, '"people": {"primary": {}, "wife": {}}').otherwise('"reference_data": {"primary": {}, "wife": {}}')
    who = F.when(F.col("c_custkey") % 5 == 0, "uncle").otherwise("wife")
    entry = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit('"document_index": [{"person_id": "primary", "document_type": "PAN", "pages": [1, 2]}, {"person_id": "'), who, F.lit('", "document_type": "pan ", "pages": ['), (F.col("c_custkey") % 4).cast("string"), F.lit("]}]"))).otherwise(
        F.concat(F.lit('"documents": [{"applicant_role": "primary", "document_type": "PAN", "pages": [1, 2]}, {"applicant_role": "'), who, F.lit('", "document_type": "pan ", "pages": ['), (F.col("c_custkey") % 4).cast("string"), F.lit("]}]")))
    loan = F.when(F.col("c_custkey") % 7 != 0, F.concat(F.lit('"loan_id": "L'), F.col("c_custkey").cast("string"), F.lit('", '))).otherwise("")
    rows = load(spark, sf, "customer").select("c_custkey", F.concat(F.lit("{"), loan, people, F.lit(", "), entry, F.lit("}")).alias("body"))
    return payloads.manifest_problems(payloads.manifests(rows, "c_custkey", "body"), "c_custkey")


def flattened_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """JSON objects as dotted paths."""
    body = F.to_json(F.struct(F.col("c_custkey").alias("k"), F.struct(F.col("c_name").alias("name"), F.struct(F.col("c_mktsegment").alias("segment")).alias("of")).alias("person")))
    return payloads.flattened(load(spark, sf, "customer").select("c_custkey", body.alias("body")), "c_custkey", "body")


def dump_sections(spark: SparkSession, sf: str) -> DataFrame:
    """A named object out of dumps that are no JSON."""
    tail = F.when(F.col("c_custkey") % 4 == 0, '{"open": ').otherwise("}} ,,")
    body = F.concat(F.lit('garbage "kyc": {"name": "a } b", "id": {"n": '), F.col("c_custkey").cast("string"), tail)
    rows = load(spark, sf, "customer").select("c_custkey", payloads.section(body, "kyc").alias("found"))
    return rows.select("c_custkey", F.get_json_object("found", "$.id.n").cast("bigint").alias("n"), F.get_json_object("found", "$.name").alias("name"))


def sheet_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as sheets of cells, without empty rows and columns."""
    lines = load(spark, sf, "lineitem").selectExpr("l_orderkey AS sheet", "l_linenumber AS row", "l_returnflag AS a", "CASE WHEN l_linenumber = 2 THEN '' ELSE l_linestatus END AS b", "CASE WHEN l_orderkey % 3 = 0 THEN CAST(l_partkey AS STRING) END AS d")
    first = lines.groupBy("sheet", "row").agg(*[F.min(c).alias(c) for c in ("a", "b", "d")])
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("col"), c.alias("value")) for k, c in enumerate((F.col("a"), F.lit(" "), F.col("b"), F.col("d")), 1)]))
    return payloads.compact_cells(first.select("sheet", "row", cells.alias("c")).select("sheet", "row", "c.*"), ["sheet"])


def read_routes(spark: SparkSession, sf: str) -> DataFrame:
    """Which reader each page asks for."""
    pages = casefile.pages(spark, sf).withColumn("layout", F.when(F.col("page_number") % 6 == 0, "table").otherwise("text"))
    return payloads.route(pages, "ocr_confidence", "page_type", "layout").groupBy("route", "escalated").agg(F.count("*").alias("n"))


def text_snippets(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", payloads.snippet(F.col("text")).alias("head"))


def json_exports(spark: SparkSession, sf: str) -> DataFrame:
    """Exports in sections, read back."""
    rows = casefile.people(spark, sf).withColumn("father_name", F.when(F.col("k") % 3 != 0, F.col("father_name")))
    made = payloads.export_json(rows, "k", {"identity": ["applicant_name", "pan_number"], "family": ["father_name", "relationship"]})
    return made.select("k", F.get_json_object("payload", "$.identity.pan_number").alias("pan"), F.get_json_object("payload", "$.family.father_name").alias("father"), F.get_json_object("payload", "$.family.relationship").alias("relation"))


def reference_ages(spark: SparkSession, sf: str) -> DataFrame:
    """Age in years of each person at the first date of their case that can be read, if it is 18 to 100."""
    rows = casefile.people(spark, sf).select("k", dates.reference_date([F.lit("soon"), F.when(F.col("k") % 2 == 0, "2020-06-30"), F.lit("31/12/2019")], F.lit("2000-01-01").cast("date")).alias("at"), F.to_date("date_of_birth").alias("born"))
    return rows.select("k", "at", dates.age_in_years(F.col("born"), F.col("at")).alias("age"))


QUERIES = {
    f.__name__: f
    for f in (
        case_workflow, severity_split, dismissed_findings, decision_checks, people_in_scope, grouped_case_findings, overflow_pages, comparison_matrix, relationship_nodes, case_document_summaries, finding_evidence, review_items,
        request_waits, storage_by_case, progress_eta, cheque_counts, retention_counts, manifest_checks, flattened_payloads, dump_sections, sheet_lines, read_routes, text_snippets, json_exports, reference_ages,
    )
}

_CASES = f"c AS (SELECT {casefile.columns(CASES)} FROM customer)"
_FINDINGS = f"f AS (SELECT {casefile.columns(FINDINGS)} FROM orders)"
_SEV = "CASE severity WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'LOW' THEN 2 ELSE 3 END"
_GROUPED = f"""{_FINDINGS}, g AS (SELECT app, code, arg_min(severity, {_SEV} * 1000000000 + finding) AS severity, arg_min(expected_value, {_SEV} * 1000000000 + finding) AS expected_value, arg_min(found_value, {_SEV} * 1000000000 + finding) AS found_value,
    list_sort(list(DISTINCT page_number)) AS pages, count(*) AS findings FROM f GROUP BY ALL)"""
ORACLE_SQL = {
    "case_workflow": f"""
        WITH {_CASES}, s AS (SELECT *, CASE WHEN progress = 'processing' OR job = 'running' THEN 'processing' WHEN state IS NOT NULL THEN state WHEN status IN ('verified', 'accepted') THEN 'completed' WHEN status = 'incomplete' THEN 'waiting_documents' WHEN status IN ('needs_review', 'clean', 'failed') THEN 'ready' ELSE 'not_ready' END AS w FROM c)
        SELECT app, w AS workflow_state, CASE WHEN w = 'processing' THEN 'Wait for processing' WHEN w = 'waiting_documents' THEN 'Review documents' WHEN owner = 3 THEN 'Resume review' WHEN w = 'ready' THEN 'Claim and review' WHEN w = 'completed' THEN 'Outcome recorded' ELSE 'Waiting for processing' END AS next_action,
          array_to_string(list_filter(['all', CASE WHEN w = 'ready' AND owner IS NULL THEN 'ready' END, CASE WHEN w = 'ready' AND owner = 3 THEN 'mine' END, CASE WHEN w = 'waiting_documents' THEN 'waiting' END, CASE WHEN w = 'completed' THEN 'completed' END, CASE WHEN w = 'processing' THEN 'processing' END], lambda x: x IS NOT NULL), ',') AS views FROM s""",
    "severity_split": f"WITH {_FINDINGS} SELECT rule_id, rule_id IN ('UNREADABLE_PAGE_SUMMARY', 'PAGE_PROCESSING_TIMEOUT') AS processing, count(*) AS n FROM f GROUP BY ALL",
    "dismissed_findings": f"""
        WITH {_FINDINGS} SELECT finding FROM f WHERE finding % 3 = 0 AND finding % 4 = 0 AND (rule_id IN ('PAN_NUMBER_MISMATCH') OR (rule_id = 'TRUSTED_NAME_MISMATCH' AND false))""",
    "decision_checks": """
        WITH a AS (SELECT c_custkey AS k, ['ACCEPT', 'OVERRIDE', 'REQUEST_DOCS'][c_custkey % 3 + 1] AS action FROM customer),
        r AS (SELECT k, action, list_filter([CASE WHEN k % 5 = 0 THEN 'PROCESSING' END, CASE WHEN action = 'ACCEPT' AND k % 4 > 0 THEN 'HIGH_EXCEPTION' END, CASE WHEN action = 'ACCEPT' AND k % 2 > 0 THEN 'OPEN_TASKS' END, CASE WHEN action = 'OVERRIDE' AND k % 7 > 0 THEN 'OPEN_HIGH_TASKS' END,
          CASE WHEN action <> 'REQUEST_DOCS' AND k % 6 = 0 THEN 'NO_RATIONALE' END, CASE WHEN action = 'REQUEST_DOCS' AND k % 8 = 0 THEN 'NO_REASON' END, CASE WHEN action = 'REQUEST_DOCS' AND k % 9 = 0 THEN 'NO_MESSAGE' END], lambda x: x IS NOT NULL) AS why FROM a)
        SELECT k AS c_custkey, action, array_to_string(why, ',') AS reasons, len(why) = 0 AS allowed FROM r""",
    "people_in_scope": f"""
        WITH {casefile.PEOPLE_SQL}, b AS (SELECT *, person = 'p0' OR role = 'primary' OR income_earner AS chosen, bool_or(person = 'p0' OR role = 'primary' OR income_earner) OVER (PARTITION BY app) AS any_ FROM people)
        SELECT 'each_person' AS scope, count(*) AS n FROM people UNION ALL SELECT 'each_borrower', count(*) FROM people WHERE role <> 'guarantor'
        UNION ALL SELECT 'pdc_people', count(*) FROM people WHERE role = 'guarantor' OR (role = 'coapplicant' AND (income_earner OR gender = 'female')) UNION ALL SELECT 'banking_people', count(*) FROM b WHERE chosen OR NOT any_""",
    "grouped_case_findings": f"""
        WITH {_GROUPED} SELECT app, code, severity, expected_value, found_value, array_to_string(list_transform(pages[1:8], lambda x: CAST(x AS VARCHAR)), ', ') || CASE WHEN len(pages) > 8 THEN ' +' || (len(pages) - 8) || ' more' ELSE '' END AS pages, findings FROM g""",
    "overflow_pages": f"""
        WITH {_GROUPED}, o AS (SELECT app, code, unnest(pages) AS page_number FROM (SELECT *, row_number() OVER (PARTITION BY app ORDER BY {_SEV}, code) AS n FROM g) WHERE n > 3)
        SELECT app, page_number, string_agg(DISTINCT code, ', ' ORDER BY code) AS codes FROM o GROUP BY ALL""",
    "comparison_matrix": """
        WITH l AS (SELECT l_partkey, l_orderkey AS page, min(CAST(round(l_discount, 2) AS VARCHAR)) AS value, bool_and(l_discount <= 0.05::DOUBLE) AS ok FROM lineitem GROUP BY ALL)
        SELECT l_partkey, arg_min(value, page) AS extracted, CASE WHEN NOT bool_or(ok) THEN 'mismatch' WHEN NOT bool_and(ok) OR count(DISTINCT value) > 1 THEN 'attention' ELSE 'match' END AS status FROM l GROUP BY 1""",
    "relationship_nodes": f"""
        WITH {casefile.PEOPLE_SQL}, r AS (SELECT app, applicant_name AS name, person AS o, CASE WHEN person = 'p0' THEN 0 ELSE 1 END AS k, CASE WHEN person = 'p0' THEN 'primary' WHEN role = 'guarantor' THEN 'guarantor' ELSE 'co_applicant' END AS role, relationship AS relation FROM people
          UNION ALL SELECT app, father_name, person, 2, 'family_member', 'father' FROM people),
        d AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY app, name ORDER BY k, o) = 1), l AS (SELECT *, CASE role WHEN 'primary' THEN 'p' WHEN 'family_member' THEN 'f' ELSE 'c' END AS c FROM d)
        SELECT app, c || row_number() OVER (PARTITION BY app, c ORDER BY o, name) AS node, name, role, relation FROM l""",
    "case_document_summaries": f"""
        WITH {casefile.PAGES_SQL} SELECT app, document_type, min(page_number) AS first_page, CASE WHEN count(*) > 1 THEN min(page_number) || '-' || max(page_number) ELSE CAST(min(page_number) AS VARCHAR) END AS range,
          CASE WHEN bool_or(page_number % 13 = 0) THEN 'Flagged' ELSE 'Extracted' END AS status FROM pages GROUP BY ALL""",
    "finding_evidence": f"""
        WITH {_FINDINGS}, {casefile.PAGES_SQL}, p AS (SELECT CAST(floor(seen / 4) AS BIGINT) AS app, page_number AS page, document_type AS kind, ' page of ' || lower(document_type) || coalesce(' ' || regexp_replace(lower(applicant_name), '[^a-z]+', ' ', 'g'), '') || ' ' AS b FROM pages),
        j AS (SELECT finding, page, page = finding AS direct, lower(kind) = lower(document_type) AS same, len(list_filter(list_distinct(string_split(lower(document_type), ' ')), lambda t: t NOT IN ('form') AND contains(b, ' ' || t || ' '))) AS hits FROM f JOIN p ON f.app = p.app WHERE severity = 'HIGH'),
        k AS (SELECT *, row_number() OVER (PARTITION BY finding ORDER BY direct DESC, hits DESC, same DESC, page) AS place, greatest(0, count(*) OVER (PARTITION BY finding) - 3) AS omitted FROM j WHERE direct OR same OR hits > 0)
        SELECT finding, page, place, hits, omitted FROM k WHERE place <= 3""",
    "review_items": """
        SELECT p_partkey AS s_no, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_type END AS description, CASE WHEN p_partkey % 3 = 0 THEN 'asked' WHEN p_partkey % 2 = 0 THEN 'manual' ELSE 'Physical-only, conditional, or system-status item; verify manually.' END AS reason FROM part""",
    "request_waits": """
        WITH s AS (SELECT l_orderkey, min(l_shipdate) AS b FROM lineitem GROUP BY 1), p AS (SELECT o_custkey, sum(greatest(0.0::DOUBLE, (epoch_us(b::TIMESTAMP) - epoch_us(o_orderdate::TIMESTAMP)) / 6e7::DOUBLE)) AS wait, count(*) AS rounds FROM orders JOIN s ON o_orderkey = l_orderkey GROUP BY 1)
        SELECT count(*) AS cases, count(*) FILTER (rounds > 1) AS several, CAST(sum(rounds) AS BIGINT) AS rounds, round(max(wait), 3) AS longest FROM p""",
    "storage_by_case": """
        WITH o AS (SELECT doc_id % 50 AS app, count(*) AS objects, CAST(sum(n_chars * 1000) AS BIGINT) AS bytes FROM documents WHERE doc_id % 5 <> 0 GROUP BY 1)
        SELECT app, objects, bytes, CASE WHEN bytes < 10240 THEN bytes || ' bytes' WHEN round(bytes / 1024::DOUBLE) < 10240 THEN CAST(round(bytes / 1024::DOUBLE) AS BIGINT) || ' kB' WHEN round(bytes / 1048576::DOUBLE) < 10240 THEN CAST(round(bytes / 1048576::DOUBLE) AS BIGINT) || ' MB' ELSE CAST(round(bytes / 1073741824::DOUBLE) AS BIGINT) || ' GB' END AS pretty FROM o""",
    "progress_eta": """
        SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN 0 WHEN o_orderkey % 10 > 0 THEN CAST(round(greatest(1.0::DOUBLE, (epoch_us(TIMESTAMP '1999-01-01') - epoch_us(o_orderdate::TIMESTAMP)) / 1e6::DOUBLE) / (o_orderkey % 10) * (20 - o_orderkey % 10)) AS BIGINT) END AS eta FROM orders""",
    "cheque_counts": """
        SELECT o_custkey, CASE WHEN o_custkey % 2 = 0 THEN count(DISTINCT o_orderkey % 3) ELSE count(*) END AS count, CASE WHEN o_custkey % 2 = 0 THEN 'cheque(s)' ELSE 'page(s)' END AS unit FROM orders GROUP BY 1""",
    "retention_counts": f"""
        WITH j AS (SELECT {casefile.columns(JOBS)} FROM orders), c AS (SELECT o_custkey AS app, max(o_orderdate) AS created_at FROM orders GROUP BY 1),
        r AS (SELECT o_custkey AS app, {casefile.word("source manifest report ocr_export page_preview", "o_orderkey")} AS purpose, o_orderkey, o_orderdate FROM orders)
        SELECT 'job_inputs' AS rule, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT job_id FROM j WHERE status = 'completed')
        UNION ALL SELECT 'stale_jobs', count(*) FROM (SELECT row_number() OVER (PARTITION BY app ORDER BY job_id DESC) AS n FROM j WHERE status IN ('completed', 'failed')) WHERE n > 3
        UNION ALL SELECT 'telemetry', count(*) FROM events WHERE ts < TIMESTAMP '2024-02-01'
        UNION ALL SELECT 'audit_log', count(*) FROM orders WHERE o_orderdate < TIMESTAMP '{_NOW}' AND o_orderkey % 4 IN (1, 3)
        UNION ALL SELECT 'to_archive', count(*) FROM c WHERE created_at < TIMESTAMP '{_NOW}' AND app % 5 <> 0
        UNION ALL SELECT 'source_objects', count(*) FROM r JOIN c ON r.app = c.app WHERE (c.app % 5 = 0 OR created_at < TIMESTAMP '{_NOW}') AND purpose IN ('source', 'manifest', 'page_preview') AND o_orderkey % 17 <> 0 AND c.app NOT IN (SELECT app FROM j WHERE status NOT IN ('completed', 'failed'))
        UNION ALL SELECT 'ocr_exports', count(*) FROM r WHERE purpose = 'ocr_export' AND o_orderkey % 3 < 2 AND o_orderdate < TIMESTAMP '{_NOW}'""",
    "manifest_checks": """
        SELECT c_custkey, 'NO_LOAN_ID' AS problem, '' AS detail FROM customer WHERE c_custkey % 7 = 0 UNION ALL SELECT c_custkey, 'PAGE_NOT_POSITIVE', '0' FROM customer WHERE c_custkey % 4 = 0
        UNION ALL SELECT c_custkey, 'UNKNOWN_PERSON', 'uncle' FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT c_custkey, 'CONFLICTING_OWNERS', CAST(c_custkey % 4 AS VARCHAR) FROM customer WHERE c_custkey % 4 IN (1, 2)""",
    "flattened_payloads": """
        SELECT c_custkey, 'k' AS path, CAST(c_custkey AS VARCHAR) AS value FROM customer UNION ALL SELECT c_custkey, 'person.name', c_name FROM customer UNION ALL SELECT c_custkey, 'person.of.segment', c_mktsegment FROM customer""",
    "dump_sections": "SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey END AS n, CASE WHEN c_custkey % 4 <> 0 THEN 'a } b' END AS name FROM customer",
    "sheet_lines": """
        WITH l AS (SELECT l_orderkey AS sheet, l_linenumber AS row, min(l_returnflag) AS a, min(CASE WHEN l_linenumber = 2 THEN '' ELSE l_linestatus END) AS b, min(CASE WHEN l_orderkey % 3 = 0 THEN CAST(l_partkey AS VARCHAR) END) AS d FROM lineitem GROUP BY ALL),
        s AS (SELECT *, bool_or(b <> '') OVER (PARTITION BY sheet) AS hb, bool_or(d IS NOT NULL) OVER (PARTITION BY sheet) AS hd FROM l)
        SELECT sheet, row, a || CASE WHEN hb THEN ' | ' || b ELSE '' END || CASE WHEN hd THEN ' | ' || coalesce(d, '') ELSE '' END AS line FROM s""",
    "read_routes": f"""
        WITH {casefile.PAGES_SQL}, r AS (SELECT CASE WHEN page_type = 'digital' THEN 'digital' WHEN page_number % 6 = 0 THEN 'structured' WHEN coalesce(ocr_confidence, 0) < 0.75 THEN 'vision' ELSE 'fast' END AS route FROM pages) SELECT route, route = 'vision' AS escalated, count(*) AS n FROM r GROUP BY ALL""",
    "text_snippets": "SELECT doc_id, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 220) AS head FROM documents",
    "json_exports": f"WITH {casefile.PEOPLE_SQL} SELECT k, pan_number AS pan, CASE WHEN k % 3 <> 0 THEN father_name END AS father, relationship AS relation FROM people",
    "reference_ages": f"""
        WITH {casefile.PEOPLE_SQL}, r AS (SELECT k, CASE WHEN k % 2 = 0 THEN DATE '2020-06-30' ELSE DATE '2019-12-31' END AS at_, CAST(date_of_birth AS DATE) AS b FROM people), y AS (SELECT *, year(at_) - year(b) - CASE WHEN month(at_) * 100 + day(at_) < month(b) * 100 + day(b) THEN 1 ELSE 0 END AS n FROM r)
        SELECT k, at_ AS at, CASE WHEN n BETWEEN 18 AND 100 THEN n END AS age FROM y""",
}
