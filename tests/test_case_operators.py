"""Comparators, gates, page types, ownership, loose inputs and views on small literal rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from docketry.functions import compare, identifiers, money, people, records
from docketry.operators import consistency, containment, gates, ownership, page_types, relational, retention, workflow
from docketry.sources import payloads
from tests.test_operators import one


@pytest.mark.parametrize(
    ("field", "a", "b", "same"),
    [
        ("aadhaar_number", "123456781234", "XXXX-XXXX-1234", True), ("aadhaar_number", "123456781234", "XXXX-XXXX-9999", False), ("pan_number", "ABCDE1234F", "abcde 1234f", True), ("pan_number", "ABCDE1234F", "XXXXXX234F", False),
        ("date_of_birth", "1980-03-05", "05/03/1980", True), ("date_of_birth", "1980-03-05", "03/05/1980", False), ("emi", "10,000", "Rs. 10,090", True), ("emi", "10000", "10200", False), ("emi", "", "7", True), ("applicant_name", "Ravi Kumar Shah", "SHAH RAVI KUMAR", True),
        ("applicant_name", "Unkar", "UnkarLal", True), ("applicant_name", "R Kumar", "Ramesh Kumar", True), ("applicant_name", "Mosmee", "Mosami", False), ("address", "B-402 Pandit Heights, Hathijan", "B 402 pandit hights hathijan ahmedabad", True),
        ("address", "B-402 Pandit Heights, Hathijan 382445", "B-403 Pandit Heights, Hathijan 382445", False), ("address", "S/O: Sample Parent", "S/O Sampl Parent, house 4, long street, town 382445", True), ("branch", "Station Road", "Station Rood", True),
    ],
)
def test_typed_comparison(spark, field, a, b, same):
    assert one(spark, compare.matches(F.lit(field), F.lit(a), F.lit(b))) is same


def test_a_name_with_words_of_relatives(spark):
    rows = spark.createDataFrame([("Anupkumar Chetanbhai Suthar", "Suthar Anupkumar", "Chetanbhai Suthar"), ("Anupkumar Ramesh Suthar", "Suthar Anupkumar", "Chetanbhai Suthar")], "x string, t string, r string")
    assert [r.s for r in rows.select(compare.names_with_relatives(F.col("x"), F.col("t"), F.col("r")).alias("s")).collect()] == [True, False]


@pytest.mark.parametrize(("value", "digits"), [("919374200200", None), ("2345 6789 0123", "234567890123"), ("917123456789", None), ("915123456789", "915123456789"), ("12345", None)])
def test_aadhaar_digits(spark, value, digits):
    assert one(spark, identifiers.aadhaar(F.lit(value))) == digits


def test_letters_of_both_scripts(spark):
    table = identifiers.letters()
    assert table["क"] == "k" and table["ह"] == "h" and table["क".translate({0x915: 0xA95})] == "k" and table["્"] == "" and table["५"] == "5" and table["શ"] == "sh"
    assert one(spark, identifiers.romanised(F.lit("रमेश Shah"))) == "rmesh Shah" and one(spark, identifiers.romanised(F.lit("plain"))) == "plain"


@pytest.mark.parametrize(
    ("field", "value", "bad"),
    [("applicant_name", "C/O", True), ("applicant_name", "Name", True), ("applicant_name", "Ravi Shah", False), ("date_of_birth", "XX/XX/1980", True), ("date_of_birth", "5 May 1980", False), ("address", "Landmark/City", True), ("address", "12", True), ("address", "12 lake road, Surat", False), ("pin_code", "012345", True), ("pin_code", "382 445", False), ("credit_score", "'720'", False), ("credit_score", "1200", True), ("credit_score", "0", False)],
)
def test_garbage_values(spark, field, value, bad):
    assert one(spark, gates.garbage(F.lit(field), F.lit(value))) is bad


def test_identity_papers_are_not_inherited(spark):
    schema = "triage string, is_readable boolean, ocr_confidence double, page_type string, document_type string, classification_confidence double, detection_method string"
    rows = [("printed", True, 0.9, "scanned", "Aadhaar", 0.9, "detected"), ("printed", True, 0.9, "scanned", "Aadhaar", 0.9, "inherited"), ("printed", True, 0.9, "scanned", "Bank Statement", 0.1, "inherited"), ("photo", True, 0.9, "scanned", "Aadhaar", 0.9, "detected"), ("printed", True, None, "scanned", "Aadhaar", 0.9, "detected"), ("printed", True, None, "Digital", "Aadhaar", 0.9, "detected"), ("printed", None, 0.54, "scanned", "Aadhaar", 0.9, "detected")]
    allowed = F.array(F.lit("aadhaar"), F.lit("bank statement"))
    assert [r.x for r in spark.createDataFrame(rows, schema).coalesce(1).select(gates.eligible(allowed).alias("x")).collect()] == [True, False, True, False, False, True, False]


def _typed(spark, rows):
    """rows of (raw type, confidence, text) as pages of one document."""
    pages = spark.createDataFrame([(1, k + 1, *r) for k, r in enumerate(rows)], "doc int, page int, raw_type string, raw_confidence double, body string")
    flags = {"fresh": F.contains("body", F.lit("page 1 of")), "kfs_start": F.contains("body", F.lit("KEY FACT STATEMENT"))}
    return [(r.document_type, r.confidence, r.method) for r in page_types.sequential(pages, "doc", "page", flags=flags).orderBy("page").collect()]


def test_sequence_of_page_types(spark):
    assert _typed(spark, [("Bank Statement", 0.9, "opening balance"), ("Cheque", 0.95, "debit and credit of the balance"), ("Unknown", 0.0, "x"), ("Unknown", 0.0, "page 1 of 2"), ("Unknown", 0.0, "y")]) == [
        ("Bank Statement", 0.9, "detected"), ("Bank Statement", 0.765, "inherited"), ("Bank Statement", 0.765, "inherited"), ("Unknown", 0.0, "unknown"), ("Bank Statement", 0.765, "inherited"),
    ]
    assert _typed(spark, [("PAN", 0.9, "a"), ("Unknown", 0.0, "b"), ("Aadhaar", 0.6, "c"), ("Unknown", 0.0, "d"), ("Unknown", 0.0, "e")]) == [("PAN", 0.9, "detected"), ("Unknown", 0.0, "unknown"), ("Aadhaar", 0.6, "detected"), ("Aadhaar", 0.55, "inherited"), ("Unknown", 0.0, "unknown")]
    assert _typed(spark, [("Loan Agreement", 0.8, "a"), ("Facility Agreement", 0.9, "b"), ("KFS", 0.2, "KEY FACT STATEMENT of the borrower, lender")]) == [("Loan Agreement", 0.8, "detected"), ("Loan Agreement", 0.68, "inherited"), ("KFS", 0.98, "detected")]


def _smooth(spark, rows):
    pages = spark.createDataFrame([(1, k + 1, *r) for k, r in enumerate(rows)], "doc int, page int, document_type string, confidence double, source string, body string")
    return [(r.smoothed_type, r.smoothed_confidence, r.smoothed_by) for r in page_types.smoothed(pages, "doc", "page", "source").orderBy("page").collect()]


def test_smoothing(spark):
    u = ("Unknown", 0.0, "a", "")
    assert _smooth(spark, [("KFS", 0.8, "a", ""), u, ("KFS", 0.9, "a", "")])[1] == ("KFS", 0.85, "sandwich_smoothed")
    assert _smooth(spark, [("Aadhaar", 0.8, "a", ""), u, ("Aadhaar", 0.9, "a", "")])[1] == ("Unknown", 0.0, None)
    assert _smooth(spark, [("KFS", 0.8, "a", ""), ("Unknown", 0.0, "b", ""), ("KFS", 0.9, "a", "")])[1][0] == "Unknown"
    assert [x[0] for x in _smooth(spark, [("Passbook", 0.8, "a", ""), u, u, ("Passbook", 0.9, "a", "")])] == ["Passbook"] * 4
    assert [x[0] for x in _smooth(spark, [("KFS", 0.8, "a", ""), u, u, ("KFS", 0.9, "a", "")])] == ["KFS", "Unknown", "Unknown", "KFS"]
    on = ("Unknown", 0.0, "a", "deposit and withdrawal of the balance")
    assert [x[0] for x in _smooth(spark, [("Bank Statement", 0.8, "a", ""), on, on, u, on])] == ["Bank Statement"] * 3 + ["Unknown"] * 2
    assert _smooth(spark, [("Loan Agreement", 0.8, "a", ""), ("KFS", 0.7, "a", "the borrower and the lender"), ("Loan Agreement", 0.9, "a", "")])[1] == ("Loan Agreement", 0.74, "agreement_context_smoothed")
    assert _smooth(spark, [("KFS", 0.8, "a", ""), ("Unknown", 0.0, "a", "From: a bank"), ("KFS", 0.9, "a", "")])[1][0] == "Unknown"


def test_groups_of_pages(spark):
    rows = [("a", "Unknown"), ("a", "PAN"), ("a", "Unknown"), ("a", "PAN"), ("b", "PAN"), ("c", "Unknown"), ("b", "Aadhaar")]
    pages = spark.createDataFrame([(1, k + 1, s, t, 0.5) for k, (s, t) in enumerate(rows)], "doc int, page int, source string, document_type string, confidence double")
    found = page_types.page_groups(pages, "doc", "page", "source", F.col("page") == 4).orderBy("first_page").collect()
    assert [(r.source, r.type, r.first_page, r.last_page, r.pages) for r in found] == [("a", "PAN", 1, 3, 3), ("a", "PAN", 4, 4, 1), ("b", "PAN", 5, 5, 1), ("b", "Aadhaar", 7, 7, 1)]


@pytest.mark.parametrize(
    ("body", "kind"),
    [("TransUnion CIBIL\nControl Number", "CIBIL Report"), ("CRIF High Mark report", "CRIF Report"), ("CIBIL and CRIF reports", None), ("aadhaar 2345 6789 0123", "Aadhaar"), ("aadhaar, pan card and voter id 2345 6789 0123", None), ("income tax department ABCDE1234F", "PAN"), ("ABCDE1234F", None), ("Driving Licence GJ01 20150001234", "Driving License")],
)
def test_types_by_evidence(spark, body, kind):
    found = one(spark, page_types.intrinsic(F.lit(body)))
    assert (found and found.document_type) == kind


def test_owner_of_a_page(spark):
    seen = spark.createDataFrame([(1, 1, "pan_number", "ABCDE1234F"), (1, 1, "applicant_name", "Kuldeep KULDEEP Shah"), (1, 2, "pin_code", "382445"), (1, 3, "phone_number", "9000000001"), (1, 3, "applicant_name", "  ")], "app int, page int, field string, value string")
    people_of = spark.createDataFrame([(1, "a", "pan_number", "ABCDE1234F"), (1, "a", "applicant_name", "Kuldeep Shah"), (1, "a", "pin_code", "382445"), (1, "b", "pin_code", "382445"), (1, "b", "phone_number", "9000000001"), (2, "c", "pan_number", "ABCDE1234F")], "app int, person string, field string, trusted_value string")
    found = {r.page: (r.owner, r.best, r.confidence, r.evidence) for r in ownership.owners(ownership.scores(seen, people_of, ["app"], ["page"]), ["app", "page"]).collect()}
    assert found == {1: ("a", 14, 1.0, ["applicant_name", "pan_number"]), 2: (None, 2, 0.0, []), 3: ("b", 5, 0.867, ["phone_number"])}
    told = ownership.with_relations(ownership.scores(seen, people_of, ["app"], ["page"]), spark.createDataFrame([(1, 2, "b")], "app int, page int, person string"), ["app", "page"])
    assert {r.page: r.owner for r in ownership.owners(told, ["app", "page"]).collect()}[2] == "b"


def test_observations_of_a_page(spark):
    rows = spark.createDataFrame([(1, {"dob": " 1980-01-01 ", "_private": "x", "borrower_name": "", "pan": "ABCDE1234F"}, "PAN abcde1234f, phone 9876543210, Aadhaar no: XXXX XXXX 4321")], "page int, fields map<string,string>, body string")
    found = {(r.field, r.value) for r in ownership.observations(rows, ["page"], "fields", "body").collect()}
    assert found == {("date_of_birth", "1980-01-01"), ("pan_number", "ABCDE1234F"), ("phone_number", "9876543210"), ("aadhaar_number", "4321")}


def test_findings_of_relations(spark):
    people_of = spark.createDataFrame([(1, "p0", None, "Ravi Shah"), (1, "p1", "wife", "Asha Shah"), (1, "p2", "son", "Om Shah"), (1, "p3", "father", "Mohan Shah")], "app int, person string, relationship string, applicant_name string")
    seen = spark.createDataFrame([(1, "p0", 1, "S/O", "Mohan Shah"), (1, "p1", 2, "W/O", "Ravi Shah"), (1, "p2", 3, "D/O", "Kiran Rao"), (1, "p3", 4, "S/O", "Old Shah")], "app int, person string, page_number int, qualifier string, related string")
    assert {(r.person, r.rule_id) for r in consistency.relation_findings(seen, people_of, ["app"]).collect()} == {("p2", "RELATIONSHIP_QUALIFIER_MISMATCH"), ("p2", "RELATIONSHIP_NAME_REVIEW")}


def test_passages_wherever_they_stand(spark):
    words = [f"w{k}" for k in range(30)]
    docs = spark.createDataFrame([(1, " ".join(words[5:20])), (2, " ".join(words[:7])), (3, None), (4, "a b c"), (5, "x " + " ".join(words[22:30]).upper() + "!"), (6, "")], "doc int, text string")
    items = spark.createDataFrame([(1, " ".join(words)), (2, "A, b c"), (3, None)], "item int, text string")
    assert {(r.doc, r.item) for r in containment.shared_passages(docs, "doc", items, "item", "text").collect()} == {(1, 1), (5, 1), (4, 2)}


def test_rules_in_force(spark):
    rules = spark.createDataFrame([("a", 0, 10, "x"), ("b", 5, None, "y")], "rule_id string, low int, high int, kind string")
    facts = spark.createDataFrame([(1, 3, "x"), (2, 7, "x"), (3, 20, "y"), (4, -1, "x")], "fact int, at int, want string")
    found = sorted((r.fact, r.rule_id, r.lookup) for r in relational.effective_lookup(facts, rules, "at", "low", "high").collect())
    assert found == [(1, "a", "ONE"), (2, "a", "AMBIGUOUS"), (2, "b", "AMBIGUOUS"), (3, "b", "ONE"), (4, None, "NO_RULE")]
    only = relational.effective_lookup(facts, rules, "at", "low", "high", lambda r: r["kind"] == F.col("want"))
    assert sorted((r.fact, r.lookup) for r in only.collect()) == [(1, "ONE"), (2, "ONE"), (3, "ONE"), (4, "NO_RULE")]
    with pytest.raises(Exception, match="more than 1 rules"):
        relational.with_rules(facts, rules, 1).collect()


def test_sections_of_broken_dumps():
    assert payloads._section('x "a": {"b": "}\\"", "c": {}} y', "a") == '{"b": "}\\"", "c": {}}'
    assert payloads._section('"a": {"b": 1', "a") is None and payloads._section(None, "a") is None and payloads._section("{}", "a") is None


def test_nested_json_as_paths(spark):
    rows = spark.createDataFrame([(1, '{"a": {"b": {"c": 1}}, "d": null, "e": [1]}'), (2, "no json"), (3, None)], "k int, body string")
    assert {(r.k, r.path, r.value) for r in payloads.flattened(rows, "k", "body").collect()} == {(1, "a.b.c", "1"), (1, "d", None), (1, "e", "[1]")}


def test_reports_and_logs(spark, tmp_path):
    rows = spark.createDataFrame([(1, "A", "2024-01-01"), (2, "B", "2024-01-02")], "app int, rule_id string, day string")
    payloads.write_report(rows, f"{tmp_path}/r", "app")
    payloads.write_report(rows.where("app = 1").withColumn("rule_id", F.lit("C")), f"{tmp_path}/r", "app")
    assert {(r.app, r.rule_id) for r in spark.read.json(f"{tmp_path}/r").collect()} == {(1, "C"), (2, "B")}
    payloads.append_events(rows, f"{tmp_path}/e", "day")
    payloads.append_events(rows, f"{tmp_path}/e", "day")
    assert spark.read.parquet(f"{tmp_path}/e").count() == 4


def test_views_and_texts(spark):
    assert one(spark, workflow.preview(F.sequence(F.lit(1), F.lit(10)))) == "1, 2, 3, 4, 5, 6, 7, 8 +2 more"
    assert one(spark, records.pages_phrase(F.array(F.lit(3)))) == "page 3" and one(spark, records.pages_phrase(F.array().cast("array<int>"))) == "the file"
    assert one(spark, records.rendered(F.lit("{a} of {b}"), F.create_map(F.lit("a"), F.lit("1")))) == "1 of "
    assert one(spark, money.amount_text(F.lit("nil"))) is None and one(spark, money.rate_percent(F.lit("Apr 12, 2024"))) is None
    assert one(spark, workflow.excerpts(F.lit("x" * 1000 + "needle"), F.lit("needle")))[1].endswith("needle")
    with pytest.raises(ValueError, match="unknown view"):
        workflow.in_view("other", F.lit("ready"), F.lit(1), F.lit(1))


def test_objects_that_leave_their_folder_are_kept(spark):
    day = "cast('2024-01-01' as timestamp)"
    refs = spark.createDataFrame([(1, "source", "k/a"), (1, "source", "/etc"), (1, "source", "k/../b"), (2, "source", "k/c"), (1, "report", "k/d")], "app int, purpose string, storage_key string")
    cases = spark.range(1, 3).selectExpr("cast(id as int) AS app", f"{day} AS created_at", "cast(null as timestamp) AS archived_at")
    jobs = spark.createDataFrame([(1, "completed"), (2, "paused")], "app int, status string")
    assert [r.storage_key for r in retention.source_objects(refs, cases, jobs, F.lit("2024-02-01").cast("timestamp")).collect()] == ["k/a"]


def _ratio(a: str, b: str) -> float:
    """Twice the characters in the longest common block and, left and right of it, so on, over all characters."""

    def common(a: str, b: str) -> int:
        best = max(((n, -i, -j) for i in range(len(a)) for j in range(len(b)) for n in range(1, min(len(a) - i, len(b) - j) + 1) if a[i : i + n] == b[j : j + n]), default=None)
        if best is None:
            return 0
        n, i, j = best[0], -best[1], -best[2]
        return n + common(a[:i], b[:j]) + common(a[i + n :], b[j + n :])

    return 2 * common(a, b) / (len(a) + len(b)) if a or b else 1.0


def test_block_ratios_by_brute_force(spark):
    rng = random.Random(5)
    rows = [tuple("".join(rng.choice("abc ") for _ in range(rng.randrange(9))) for _ in range(2)) for _ in range(60)]
    found = spark.createDataFrame(rows, "a string, b string").coalesce(1).select(people.sequence_ratio("a", "b").alias("r")).collect()
    assert [round(r.r, 9) for r in found] == [round(_ratio(a, b), 9) for a, b in rows]
