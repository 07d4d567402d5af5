"""Queries on types of pages: evidence, sequence, smoothing and groups, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators import page_types
from docketry.plans import casefile
from docketry.sources.tables import load

_O = "o_orderkey"
_KINDS = "Bank Statement|Aadhaar|Loan Agreement|Application Form|PAN|CIBIL Report|Sanction Letter|Passbook|Guarantee Deed|Disbursement Request|KFS|Facility Agreement"
_BODIES = "opening balance debit credit|the borrower shall repay the lender herein|key fact statement|applicant address and mobile|page 1 of 3 new account|payment history overdue enquiry|nach mandate form|guarantee deed of the guarantor|subject: your letter|plain page"
#: Sequences: an application's orders in their order are the pages of its file.
SEQUENCE = {
    "app": "CAST(floor((o_custkey - 1) / 4) AS BIGINT)",
    "page": _O,
    "source": f"concat('s', {casefile.text(f'CAST(floor({_O} / 12000) AS BIGINT)')})",
    "raw_type": f"CASE WHEN {_O} % 3 = 0 THEN 'Unknown' ELSE {casefile.word(_KINDS, f'floor({_O} / 4000)', '|')} END",
    "raw_confidence": f"CAST({_O} * 7 % 100 AS DOUBLE) / 100",
    "body": casefile.word(_BODIES, f"{_O} * 3", "|"),
    "kfs_start": f"{_O} % 41 = 0",
    "fresh": f"({_O} * 3) % 10 = 4",
}


def _sequence(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").selectExpr(*[f"{e} AS {n}" for n, e in SEQUENCE.items()])


def _flags() -> dict:
    low = F.col("body")
    return {"kfs_start": F.col("kfs_start"), "kfs_on": F.contains(low, F.lit("key fact")), "fresh": F.col("fresh"), "nach_start": F.contains(low, F.lit("nach mandate")), "sanction_on": F.contains(low, F.lit("borrower"))}


def sequential_page_types(spark: SparkSession, sf: str) -> DataFrame:
    """Types of the pages of each file by the eleven rules."""
    return page_types.sequential(_sequence(spark, sf), "app", "page", flags=_flags())


def smoothed_page_types(spark: SparkSession, sf: str) -> DataFrame:
    """Raw types of each file's pages smoothed by their neighbours."""
    rows = page_types.smoothed(_sequence(spark, sf), "app", "page", "source", "raw_type", "raw_confidence")
    return rows.select("page", "smoothed_type", "smoothed_confidence", "smoothed_by")


def document_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of each file as runs of pages."""
    return page_types.page_groups(_sequence(spark, sf), "app", "page", "source", F.col("kfs_start"), "raw_type", "raw_confidence").select("app", "source", "type", "first_page", "last_page", "pages", "confidence")


_TEXTS = "CASE c_custkey % 9 WHEN 0 THEN concat('Income Tax Department', chr(10), 'ABCPD1234F', chr(10), 'Father Name: X') WHEN 1 THEN 'Permanent Account Number ABCPD1234F' WHEN 2 THEN 'UIDAI Aadhaar 2345 6789 0123' WHEN 3 THEN 'Aadhaar 9198 7654 3210 card' WHEN 4 THEN concat('TransUnion CIBIL', chr(10), 'Control Number 12, CIBIL score 712') WHEN 5 THEN concat('CRIF High Mark', chr(10), 'Crif score 640') WHEN 6 THEN 'Loan Application Form of the applicant' WHEN 7 THEN 'Aadhaar, PAN card, Voter ID, passport: Election Commission' ELSE 'Request for disbursement of the loan. Application form' END"


def intrinsic_types(spark: SparkSession, sf: str) -> DataFrame:
    """The type that a text itself tells, and how surely; equal texts are read once."""
    rows = load(spark, sf, "customer").selectExpr("c_custkey % 9 AS k", f"{_TEXTS} AS body")
    texts = rows.groupBy("k", "body").agg(F.count("*").alias("n"))
    told = texts.groupBy("k", page_types.intrinsic(F.col("body")).alias("best")).agg(F.sum("n").alias("n"))
    return told.select("k", "best.document_type", "best.confidence", "n")


def page_type_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """What decides the type of each page."""
    rows = casefile.pages(spark, sf).selectExpr("page_number", "triage", "ocr_confidence", "nullif(document_type, 'Unknown') AS seen", "page_number % 4 = 0 AS hand", "CASE WHEN page_number % 37 = 0 THEN 'Insurance Form' END AS sure", "CASE WHEN page_number % 5 = 0 THEN 'Aadhaar' END AS file", "CASE WHEN page_number % 2 = 0 THEN document_type ELSE 'Unknown' END AS seq")
    made = page_types.decided(F.col("triage"), F.col("hand"), F.col("ocr_confidence"), F.col("sure"), F.col("seen"), F.col("file"), F.col("seq"))
    return rows.groupBy(made["document_type"].alias("document_type"), made["decided_by"].alias("decided_by")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (sequential_page_types, smoothed_page_types, document_groups, intrinsic_types, page_type_decisions)}

_SEQ = f"s AS (SELECT {casefile.columns(SEQUENCE)} FROM orders)"


def _on(kind: str, body: str = "body") -> str:
    """CASE over the types of whether body goes on in one."""
    tests = [f"WHEN {kind} = '{name}' THEN " + " + ".join(f"contains({body}, '{t}')::INT" for t in page_types.GOING_ON[page_types._LIKE.get(name, name)][1]) + f" >= {page_types.GOING_ON[page_types._LIKE.get(name, name)][0]}" for name in (*page_types.GOING_ON, *page_types._LIKE)]
    return f"(CASE {' '.join(tests)} ELSE false END)"


_A = "('Loan Agreement', 'Facility Agreement')"
_RUNS = "(" + ", ".join(f"'{t}'" for t in page_types.RUNS) + ")"
_STOLEN = "(" + ", ".join(f"'{t}'" for t in page_types.OFTEN_STOLEN) + ")"
_KEPT = f"""CASE WHEN cur = 'KFS' AND contains(body, 'key fact') AND NOT fresh THEN 'kfs-run-context'
    WHEN cur IN {_A} AND (raw_type IN {_A} OR ({_on("'Loan Agreement'")} AND NOT fresh)) THEN 'agreement-run-context'
    WHEN cur = 'Guarantee Deed' AND raw_type IN ('Unknown', 'Guarantee Deed', 'Loan Agreement', 'Facility Agreement') AND {_on("cur")} AND NOT fresh THEN 'guarantee-deed-run-context'
    WHEN cur = 'Application Form' AND raw_type IN ('Unknown', 'Application Form', 'Property Document', 'Aadhaar', 'Loan Agreement', 'Facility Agreement') AND {_on("cur")} AND NOT fresh THEN 'application-form-run-context'
    WHEN cur = 'Bank Statement' AND raw_type IN ('Unknown', 'Bank Statement', 'NACH Form', 'Cheque') AND {_on("cur")} AND NOT contains(body, 'nach mandate') AND NOT fresh THEN 'statement-ledger-continuation'
    WHEN cur = 'Sanction Letter' AND contains(body, 'borrower') AND NOT fresh THEN 'sanction-conditions-context'
    WHEN cur IN ('CIBIL Report', 'CRIF Report') AND {_on("cur")} AND NOT fresh THEN 'bureau-appendix-context'
    WHEN cur = 'Disbursement Request' AND page - opened <= 2 AND NOT fresh THEN 'disbursement-request-continuation' END"""
_OWN = "(raw_type <> 'Unknown' AND (raw_confidence >= 0.75 OR (raw_confidence >= 0.55 AND raw_type <> cur)))"
ORACLE_SQL = {
    "sequential_page_types": f"""
        WITH RECURSIVE {_SEQ}, n AS (SELECT *, row_number() OVER (PARTITION BY app ORDER BY page) AS i FROM s),
        r AS (
          SELECT app, 0::BIGINT AS i, 'Unknown' AS kind, 0::DOUBLE AS sure, NULL::BIGINT AS last, NULL::BIGINT AS page, NULL::VARCHAR AS document_type, NULL::DOUBLE AS confidence, NULL::VARCHAR AS method, NULL::VARCHAR AS reason FROM (SELECT DISTINCT app FROM s)
          UNION ALL
          SELECT app, i, CASE WHEN kfs_start THEN 'KFS' WHEN kept IS NULL AND own THEN raw_type ELSE cur END, CASE WHEN kfs_start THEN greatest(CASE WHEN raw_type = 'KFS' THEN raw_confidence ELSE 0 END, 0.98::DOUBLE) WHEN kept IS NULL AND own THEN raw_confidence ELSE sure END,
                 CASE WHEN kfs_start OR (kept IS NULL AND own) THEN page ELSE opened END, page,
                 CASE WHEN kfs_start THEN 'KFS' WHEN kept IS NOT NULL THEN cur WHEN own THEN raw_type WHEN cur <> 'Unknown' AND blocked IS NULL THEN cur ELSE 'Unknown' END,
                 CASE WHEN kfs_start THEN greatest(CASE WHEN raw_type = 'KFS' THEN raw_confidence ELSE 0 END, 0.98::DOUBLE) WHEN kept IS NULL AND own THEN raw_confidence WHEN kept IS NOT NULL OR (cur <> 'Unknown' AND blocked IS NULL) THEN round(greatest(0.55::DOUBLE, least(0.85::DOUBLE, sure * 0.85::DOUBLE)), 3) ELSE 0 END,
                 CASE WHEN kfs_start THEN 'detected' WHEN kept IS NOT NULL THEN 'inherited' WHEN own THEN 'detected' WHEN cur <> 'Unknown' AND blocked IS NULL THEN 'inherited' ELSE 'unknown' END,
                 CASE WHEN kfs_start THEN NULL WHEN kept IS NOT NULL THEN kept WHEN own THEN NULL WHEN cur <> 'Unknown' THEN blocked END
          FROM (SELECT *, {_KEPT} AS kept, {_OWN} AS own, CASE WHEN fresh THEN 'fresh-page-like-no-match' WHEN cur IN ('PAN', 'PAN Card', 'Driving License', 'Cheque', 'KYC OSV Mark') THEN 'single-page-identity-document-does-not-inherit'
                  WHEN cur IN ('Aadhaar', 'Voter ID') AND page - opened > 1 THEN 'identity-document-inheritance-limit-reached' END AS blocked
                FROM (SELECT n.*, r.kind AS cur, r.sure, r.last AS opened FROM r JOIN n ON n.app = r.app AND n.i = r.i + 1)))
        SELECT app, page, document_type, confidence, method, reason FROM r WHERE i > 0""",
    "smoothed_page_types": f"""
        WITH {_SEQ}, a AS (SELECT *, body LIKE 'subject:%' AS mail, lag(raw_type) OVER w AS b1, lead(raw_type) OVER w AS a1, lag(source) OVER w AS sb, lead(source) OVER w AS sa, lag(raw_confidence) OVER w AS cb, lead(raw_confidence) OVER w AS ca FROM s WINDOW w AS (PARTITION BY app ORDER BY page)),
        b AS (SELECT *, coalesce(raw_type = 'Unknown' AND NOT mail AND b1 = a1 AND b1 <> 'Unknown' AND b1 NOT IN ('PAN', 'PAN Card', 'Driving License', 'Cheque', 'KYC OSV Mark', 'Aadhaar', 'Voter ID') AND sb = source AND sa = source, false) AS sw FROM a),
        c AS (SELECT app, page, source, body, mail, CASE WHEN sw THEN b1 ELSE raw_type END AS t, CASE WHEN sw THEN round((cb + ca) / 2, 3) ELSE raw_confidence END AS c, CASE WHEN sw THEN 'sandwich_smoothed' END AS b FROM b),
        d AS (SELECT *, t = 'Unknown' AND NOT mail AS o, lag(t) OVER w AS p1, lag(t, 2) OVER w AS p2, lead(t) OVER w AS n1, lead(t, 2) OVER w AS n2, lag(source) OVER w AS q1, lag(source, 2) OVER w AS q2, lead(source) OVER w AS m1, lead(source, 2) OVER w AS m2 FROM c WINDOW w AS (PARTITION BY app ORDER BY page)),
        e AS (SELECT *, lead(o) OVER w AS on1, lag(o) OVER w AS op1 FROM d WINDOW w AS (PARTITION BY app ORDER BY page)),
        f AS (SELECT app, page, source, body, mail, t, c, b, CASE WHEN o AND on1 AND p1 = n2 AND p1 IN {_RUNS} AND q1 = source AND m1 = source AND m2 = source THEN p1 WHEN o AND op1 AND p2 = n1 AND n1 IN {_RUNS} AND q2 = source AND q1 = source AND m1 = source THEN n1 END AS g FROM e),
        h AS (SELECT app, page, source, body, mail, coalesce(g, t) AS t, CASE WHEN g IS NOT NULL THEN 0.7 ELSE c END AS c, CASE WHEN g IS NOT NULL THEN 'sandwich_run_smoothed' ELSE b END AS b FROM f),
        i AS (SELECT *, t IN {_STOLEN} AND {_on("'Loan Agreement'")} AND NOT mail AS st FROM h),
        j AS (SELECT *, last_value(CASE WHEN NOT st THEN struct_pack(t := t, s := source) END IGNORE NULLS) OVER (PARTITION BY app ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bf, lead(t) OVER (PARTITION BY app ORDER BY page) AS nt, lead(source) OVER (PARTITION BY app ORDER BY page) AS ns FROM i),
        k AS (SELECT app, page, source, body, mail, t, c, b, CASE WHEN st AND bf.t IN {_A} AND bf.s = source THEN bf.t WHEN st AND nt IN {_A} AND ns = source THEN nt END AS g FROM j),
        l AS (SELECT app, page, source, body, mail, coalesce(g, t) AS t, CASE WHEN g IS NOT NULL THEN 0.74 ELSE c END AS c, CASE WHEN g IS NOT NULL THEN 'agreement_context_smoothed' ELSE b END AS b FROM k),
        m AS (SELECT *, last_value(CASE WHEN t <> 'Unknown' THEN struct_pack(t := t, s := source) END IGNORE NULLS) OVER (PARTITION BY app ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS kn, sum((t <> 'Unknown')::INT) OVER (PARTITION BY app ORDER BY page) AS blk FROM l),
        n AS (SELECT *, coalesce(t = 'Unknown' AND NOT mail AND kn.t IN {_RUNS} AND kn.s = source AND {_on("kn.t")}, false) AS y FROM m),
        o AS (SELECT *, y AND sum((t = 'Unknown' AND NOT y)::INT) OVER (PARTITION BY app, blk ORDER BY page) = 0 AS fill FROM n)
        SELECT page, CASE WHEN fill THEN kn.t ELSE t END AS smoothed_type, CAST(CASE WHEN fill THEN 0.72 ELSE c END AS DOUBLE) AS smoothed_confidence, CASE WHEN fill THEN 'run_forward_smoothed' ELSE b END AS smoothed_by FROM o""",
    "document_groups": f"""
        WITH {_SEQ}, a AS (SELECT *, last_value(CASE WHEN raw_type <> 'Unknown' THEN struct_pack(t := raw_type, s := source) END IGNORE NULLS) OVER (PARTITION BY app ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM s),
        b AS (SELECT *, sum(CASE WHEN raw_type <> 'Unknown' AND (l IS NULL OR l.t <> raw_type OR l.s <> source OR kfs_start) THEN 1 ELSE 0 END) OVER (PARTITION BY app ORDER BY page) AS n FROM a),
        c AS (SELECT *, CASE WHEN raw_type <> 'Unknown' THEN n END AS g FROM b),
        d AS (SELECT *, coalesce(last_value(g IGNORE NULLS) OVER (PARTITION BY app, source ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(g IGNORE NULLS) OVER (PARTITION BY app, source ORDER BY page ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS gr FROM c)
        SELECT app, min(source) AS source, max(CASE WHEN raw_type <> 'Unknown' THEN raw_type END) AS type, min(page) AS first_page, max(page) AS last_page, count(*) AS pages, round(coalesce(avg(CASE WHEN raw_confidence > 0 THEN raw_confidence END), 0), 3) AS confidence FROM d WHERE gr IS NOT NULL GROUP BY app, gr""",
    "intrinsic_types": """
        SELECT c_custkey % 9 AS k, CASE c_custkey % 9 WHEN 0 THEN 'PAN' WHEN 1 THEN 'PAN' WHEN 2 THEN 'Aadhaar' WHEN 4 THEN 'CIBIL Report' WHEN 5 THEN 'CRIF Report' WHEN 6 THEN 'Application Form' WHEN 8 THEN 'Disbursement Request' END AS document_type,
               CAST(CASE c_custkey % 9 WHEN 0 THEN 0.92 WHEN 1 THEN 0.82 WHEN 2 THEN 0.93 WHEN 4 THEN 1.0 WHEN 5 THEN 1.0 WHEN 6 THEN 0.9 WHEN 8 THEN 0.98 END AS DOUBLE) AS confidence, count(*) AS n FROM customer GROUP BY ALL""",
    "page_type_decisions": f"""
        WITH {casefile.PAGES_SQL}, d AS (SELECT triage, ocr_confidence AS ocr, nullif(document_type, 'Unknown') AS seen, page_number % 4 = 0 AS hand, page_number % 37 = 0 AS sure, page_number % 5 = 0 AS file, CASE WHEN page_number % 2 = 0 THEN document_type ELSE 'Unknown' END AS seq FROM pages),
        b AS (SELECT *, CASE WHEN triage = 'photo' THEN 'photo_triage' WHEN hand AND ocr < 0.55 THEN 'low_confidence_handwriting' WHEN sure THEN 'authoritative_evidence' WHEN file AND seq = 'Unknown' THEN 'filename' WHEN seq <> 'Unknown' THEN 'sequence' WHEN seen IS NOT NULL THEN 'intrinsic_evidence' ELSE 'none' END AS decided_by FROM d)
        SELECT CASE decided_by WHEN 'photo_triage' THEN 'Photo' WHEN 'authoritative_evidence' THEN 'Insurance Form' WHEN 'filename' THEN 'Aadhaar' WHEN 'sequence' THEN seq WHEN 'intrinsic_evidence' THEN seen ELSE 'Unknown' END AS document_type, decided_by, count(*) AS n FROM b GROUP BY ALL""",
}
