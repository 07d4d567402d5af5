"""Operators on small literal rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from docketry.functions import conditions, dates, extract, money, people, text
from docketry.operators import checks, findings, layout, relational, schedule, sequences
from docketry.sources import tables
from docketry.streaming import states, windows


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [("123456781234", "987654321234", False), ("1234 5678 1234", "123456781234", True), ("XXXX XXXX 1234", "123456781234", True), ("****1234", "123456781234", True), ("1234", "123456781234", True), ("XXXX XXXX 9999", "123456781234", False), ("", "1", True)],
)
def test_identifier_matches(spark, a, b, same):
    assert one(spark, text.identifier_matches(F.lit(a), F.lit(b))) is same


def test_dates_and_money(spark):
    day = lambda s: F.lit(s).cast("date")
    assert one(spark, dates.age_in_months(day("2026-05-30"), day("2026-09-04"))) == 4
    assert one(spark, dates.age_in_months(day("2026-06-15"), day("2026-09-04"))) == 3
    assert str(one(spark, dates.parsed_date(F.lit("05/03/2024")))) == "2024-03-05"
    assert one(spark, money.parsed_amount(F.lit("₹ 1.5 lakh"))) == 150000
    assert one(spark, money.free_tier(F.lit(1200), 1000, 1.5)[0]) == 200
    assert one(spark, money.free_tier(F.lit(1200), 1000, 1.5)[1]) == 0.3


def test_names_and_addresses(spark):
    assert one(spark, people.bare_name(F.lit("Mr. Veeru Lal"))) == one(spark, people.bare_name(F.lit("Veeru Lal"))) == "veeru lal"
    assert one(spark, people.relation(F.lit("Ravi S/O Mohan Lal"))["name"]) == "Mohan Lal"
    assert one(spark, people.address_match(F.lit("12 Lake Rd"), F.lit("12 lake road, old town"))) == "SUBSET"
    assert one(spark, people.address_match(F.lit("12 Lake Rd"), F.lit("14 lake road"))) == "UNIT_CONFLICT"
    row = spark.range(1).select(people.sequence_ratio(F.lit("abcd"), F.lit("bcde")).alias("r"), people.token_set_ratio(F.lit("ravi kumar"), F.lit("kumar ravi")).alias("t"), people.sequence_ratio(F.lit("a"), F.lit(None).cast("string")).alias("n")).first()
    assert row.r == 0.75 and row.t == 100 and row.n is None


def test_conditions_are_three_valued(spark):
    rows = spark.createDataFrame([(1, 5, "yes"), (None, 5, "no"), (2, None, None)], "a int, b int, flag string")
    rule = {"all": [{"field": "a", "lt_field": "b"}, {"field": "flag", "truthy": True}]}
    assert [r.x for r in rows.select(conditions.condition(rule).alias("x")).collect()] == [True, False, None]


def test_extraction(spark):
    body = "Applicant Name: A B Example\nLoan Amount: Rs. 5,00,000\nTenure 240 months"
    found = one(spark, extract.fields_of(F.lit("credit_assessment"), F.lit(body)))
    assert found == {"applicant_name": "A B Example", "loan_amount": "5,00,000", "tenure": "240"}
    assert one(spark, extract.fields_of(F.lit("nothing"), F.lit(body))) == {}
    assert one(spark, extract.until_stop(F.split(F.lit("a\nb\nStop here\nc"), "\n"), ["stop"])) == ["a", "b"]
    assert one(spark, extract.public_fields(F.create_map(F.lit("_x"), F.lit(1), F.lit("y"), F.lit(2)))) == {"y": 2}
    assert one(spark, extract.merged_fields(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(1)), F.create_map(F.lit("b"), F.lit(2)))) == {"a": 1, "b": 2}
    assert one(spark, extract.stem(F.lit("in/Case 7.MANIFEST.json"))) == "case 7" == one(spark, extract.stem(F.lit("Case 7.pdf")))


def test_layout(spark):
    words = spark.createDataFrame([(1, "Name", 0.0, 10.0, 30.0, 20.0), (1, "A", 40.0, 11.0, 50.0, 21.0), (1, "B", 60.0, 10.0, 70.0, 20.0), (1, "far", 150.0, 10.0, 160.0, 20.0), (1, "below", 40.0, 40.0, 60.0, 50.0)], "page int, text string, x0 double, y0 double, x1 double, y1 double")
    assert [r.value for r in layout.right_of(words.where("text <> 'Name'"), words.where("text = 'Name'"), ["page"]).collect()] == ["A B"]
    regions = words.where("x0 >= 40").withColumn("confidence", F.lit(0.9))
    regions = regions.unionByName(spark.createDataFrame([(1, "411001", 40.0, 70.0, 60.0, 72.0, 0.8)], regions.schema))
    anchor = words.where("text = 'Name'")
    assert layout.anchored_bands(regions, anchor, ["page"]).first().value == "B far A below 411001".replace("B far A", "B far A")
    span = one(spark, layout.shortest_span(F.split(F.lit("x A B y A"), " "), F.lit("A B")))
    assert (span["size"], span["start"]) == (2, 2)
    assert one(spark, layout.shortest_span(F.split(F.lit("x"), " "), F.lit("z"))) is None


def test_schedule(spark):
    page = "No Opening EMI\n1 300.00 110.00 100.00 10.00 200.00\n2 200.00 110.00 100.00 10.00 100.00\n3 100.00 110.00 100.00 10.00 0.00"
    rows = schedule.schedule_rows(spark.createDataFrame([("d", 1, page), ("d", 9, "1 50.00 60.00 50.00 10.00 0.00")], "doc string, page int, body string"), "body")
    found = {r.schedule: r for r in schedule.summary(schedule.schedules(rows, "doc", "page"), ["doc", "schedule"]).collect()}
    assert len(found) == 2 and found[1].complete and found[1].n == 3 and found[1].usual_emi == 110 and found[2].usual_emi == 60
    trusted = spark.createDataFrame([("d", 120.0, 3)], "doc string, emi double, tenure int")
    first = schedule.summary(schedule.schedules(rows, "doc", "page"), ["doc", "schedule"]).where("schedule = 1")
    assert [r.rule_id for r in schedule.mismatches(first, trusted, "doc").collect()] == ["REPAYMENT_SCHEDULE_EMI_MISMATCH"]


def test_page_typing_equals_the_state_machine(spark):
    rng = random.Random(1)
    rows = [(d, i, rng.choice(["unknown", "unknown", "a", "b"]), round(rng.random(), 2), rng.random() < 0.3) for d in range(20) for i in range(15)]
    df = spark.createDataFrame(rows, "doc int, page int, kind string, confidence double, fresh boolean")
    found = {(r.doc, r.page): (r.final_type, r.method) for r in states.typed_pages(df, "doc", ["page"], "kind", "confidence", "fresh").collect()}
    for d in range(20):
        typing = states.PageTyping()
        for _, page, kind, confidence, fresh in rows[d * 15 : d * 15 + 15]:
            kind, _, method = typing.step(kind, confidence, fresh)
            assert found[d, page] == (kind, method)


def test_streams_equal_their_batch_forms(spark, tmp_path):
    df = spark.createDataFrame([(d, i, "a" if i % 4 == 0 else "unknown", 0.9, i % 3 == 2) for d in range(3) for i in range(8)], "doc int, page int, kind string, confidence double, fresh boolean")
    df.coalesce(1).write.parquet(f"{tmp_path}/pages")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/pages")
    made = states.typed_page_stream(stream, "doc", "page", "kind", "confidence", "fresh")
    made.writeStream.format("memory").queryName("typed").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start().awaitTermination()
    batch = states.typed_pages(df, "doc", ["page"], "kind", "confidence", "fresh")
    assert sorted(map(tuple, spark.table("typed").collect())) == sorted(map(tuple, batch.collect()))
    events = tables.load(spark, "/root/testdata/sf0.001", "events")
    events.write.parquet(f"{tmp_path}/events")
    stream = windows.tumbling(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events"), "ts", "1 day", "event_type", late="1 hour")
    stream.writeStream.format("memory").queryName("days").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.table("days").collect())) == sorted(map(tuple, windows.tumbling(events, "ts", "1 day", "event_type").collect()))


def test_scored_match_has_no_winner_on_a_tie(spark):
    pairs = spark.createDataFrame([(1, "a", 2), (1, "b", 2), (2, "a", 3), (2, "b", 1)], "i int, c string, s int")
    assert {r.i: r.winner for r in relational.scored_match(pairs, "i", "c", F.col("s")).collect()} == {1: None, 2: "a"}


def test_smoothing_and_intervals(spark):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(["a", "unknown", "a", "unknown", "unknown", "a", "b"])], "k int, o int, v string")
    assert [r.smoothed for r in sequences.sandwich(rows, "k", ["o"], "v", "unknown").orderBy("o").collect()] == ["a", "a", "a", "unknown", "unknown", "a", "b"]
    assert [r.filled for r in sequences.two_gap(rows, "k", ["o"], "v", "unknown").orderBy("o").collect()] == ["a", "unknown", "a", "a", "a", "a", "b"]


def test_findings_order_and_first_wins(spark):
    rows = spark.createDataFrame([(1, "R1", "LOW", None, 2), (1, "R2", "HIGH", 3, 1), (1, "R1", "LOW", 1, 0)], "app int, rule string, severity string, page int, ordinal int")
    first = findings.first_wins(rows, ["app", "rule"], ["ordinal"])
    assert [(r.rule, r.page) for r in findings.ranked(first, "app", "severity", "page").orderBy("place").collect()] == [("R2", 3), ("R1", 1)]


def test_sources(spark):
    docs = spark.createDataFrame([(1, '{"PAN": {"pages": [{"page": 1, "text": "x"}, {"page": 2, "text": "y", "confidence": 0.5}]}}')], "id int, payload string")
    assert [(r.document_type, r.page_number, r.confidence) for r in tables.partner_pages(docs, "payload").orderBy("page_number").collect()] == [("PAN", 1, 1.0), ("PAN", 2, 0.5)]
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, version int")
    new = spark.createDataFrame([(1, "c", 2)], "k int, v string, version int")
    assert sorted((r.k, r.v) for r in tables.upsert(old, new, ["k"], "version").collect()) == [(1, "c"), (2, "b")]


def test_period_check_needs_one_full_account(spark):
    rows = spark.createDataFrame([("p", "x", f"2024-0{m}-05") for m in (1, 2, 3)] + [("q", "x", "2024-01-05"), ("q", "y", "2024-02-05")], "owner string, account string, day string").withColumn("day", F.col("day").cast("date"))
    found = {r.owner: (r.passes, r.months_missing) for r in checks.period_check(rows, "owner", "account", "day", F.lit("2024-04-10").cast("date"), 3).collect()}
    assert found == {"p": (True, 0), "q": (False, 2)}
