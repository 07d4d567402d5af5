"""Queries on small tables made for what the given ones lack, against their SQL twins and expected rows."""

from __future__ import annotations

import re

from docketry.operators import mapped
from docketry.plans import registry
from tests.compare import assert_same

SF = "/root/testdata/sf0.001"


def test_every_customer_name_is_scored_against_all_suppliers(spark, tmp_path):
    names = ["Ann Lee Ray", "lee, ann ray", "Ann", "Ray Ann Lee Fox", "Bo Cole", "Bo Cole", "Zed", None, " - ", "cole bo kim hun", "Éva Nagy"]
    spark.createDataFrame(list(enumerate(names)), "c_custkey bigint, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    suppliers = ["Ann Lee Ray", "ANN LEE-RAY", "Annabel Q", "Cole Dun", "Bo Dun", "éva kis", None, "--"]
    spark.createDataFrame(list(enumerate(suppliers)), "s_suppkey bigint, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    found = registry.QUERIES["name_match_best"](spark, str(tmp_path))
    assert_same(found, registry.ORACLE_SQL["name_match_best"], str(tmp_path))
    assert {r.c_custkey: (r.s_name, r.score) for r in found.collect()} == {
        0: ("ANN LEE-RAY", 100.0), 1: ("ANN LEE-RAY", 100.0), 2: ("ANN LEE-RAY", 95.0), 3: ("ANN LEE-RAY", 90.0), 4: ("Bo Dun", 33.33), 5: ("Bo Dun", 33.33),
        6: (None, 0.0), 7: (None, 0.0), 8: (None, 0.0), 9: ("Bo Dun", 20.0), 10: ("éva kis", 33.33),
    }


def test_a_name_that_begins_another_matches_without_a_shared_word(spark, tmp_path):
    spark.createDataFrame([(1, "Ann"), (2, "Annabel Quist")], "c_custkey bigint, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, "Annabel Q"), (2, "Quill")], "s_suppkey bigint, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    found = registry.QUERIES["name_match_best"](spark, str(tmp_path))
    assert {r.c_custkey: (r.s_name, r.score) for r in found.collect()} == {1: ("Annabel Q", 95.0), 2: ("Annabel Q", 95.0)}


def test_every_customer_of_the_table_has_a_row(spark):
    assert registry.QUERIES["name_match_best"](spark, SF).count() == 150


def test_alike_names_need_no_shared_word(spark, tmp_path):
    rows = [(1, "A", "Redtin"), (2, "A", "redtins"), (3, "A", "blue"), (4, "B", "redtin"), (5, "A", "Redtin")]
    spark.createDataFrame(rows, "p_partkey bigint, p_brand string, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    found = registry.QUERIES["near_names"](spark, str(tmp_path))
    assert_same(found, registry.ORACLE_SQL["near_names"], str(tmp_path))
    assert [(r.p_brand, r.x, r.y, r.n_x, r.n_y) for r in found.collect()] == [("A", "redtin", "redtins", 2, 1)]


def test_reject_reasons_of_every_customer(spark):
    found = registry.QUERIES["name_reject_reasons_all"](spark, SF).collect()
    assert sum(r.n for r in found) == 150
    digits = {r.bare: r.n for r in found if r.reason == "DIGITS"}
    assert digits == {f"customer {k:09d}": 1 for k in range(1, 150, 6)}


def test_reject_reasons_tell_each_name(spark):
    found = {(r.bare, r.reason): r.n for r in registry.QUERIES["name_reject_reasons"](spark, SF).collect()}
    assert sum(found.values()) == 150 and len(found) == 30
    assert found[("customer 000000001", "DIGITS")] == 1 and found[("a b example", None)] == 25


def test_equal_texts_are_typed_once(spark, capsys):
    registry.QUERIES["intrinsic_types"](spark, SF).explain("formatted")
    assert re.search(r"Keys \[2\]: \[k#\d+L?, body#\d+\]", capsys.readouterr().out)


def test_rows_of_a_sheet_are_sent_twice_at_most(spark, capsys):
    registry.QUERIES["sheet_lines"](spark, SF).explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning") <= 5  # rows, their reuse, columns, and the join


def test_labelled_blocks_are_looked_for_once(spark):
    plan = registry.QUERIES["recovered_values"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") <= 2  # one a field


def test_values_of_a_case_are_sent_once_and_compared_once(spark, capsys):
    registry.QUERIES["page_owners"](spark, SF).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning") <= 2 and plan.count("FileScan") == 2  # observed and trusted values


def test_votes_of_pages_with_equal_keys_and_without_a_case(spark, tmp_path):
    spark.createDataFrame([(k, f"c{k}") for k in range(1, 9)], "c_custkey bigint, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    orders = [(k, 1 + k % 8) for k in range(1, 200)] + [(k, 1 + k % 8) for k in range(1, 60)] + [(k, None) for k in range(300, 400)] + [(500, 99)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    for query in ("source_document_votes", "page_owners", "page_owner_scores", "owner_findings"):
        assert_same(registry.QUERIES[query](spark, str(tmp_path)), registry.ORACLE_SQL[query], str(tmp_path))
    assert sum(r.pages for r in registry.QUERIES["source_document_votes"](spark, str(tmp_path)).collect()) == len(orders)


def test_mapped_pages_and_trusted_values_are_sent_once(spark, capsys):
    registry.QUERIES["mapped_documents"](spark, SF).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning") <= 2  # what is mapped with its pages and values, and trusted values


def test_mapped_documents_of_equal_keys_and_of_a_case_without_people(spark, tmp_path):
    people = [(k, f"c{k}") for k in range(1, 9)] + [(3, "c3")]
    spark.createDataFrame(people, "c_custkey bigint, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    orders = [(k, 1 + k % 8) for k in range(1, 200)] + [(k, 1 + k % 8) for k in range(1, 60)] + [(500, 99)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    assert_same(registry.QUERIES["mapped_documents"](spark, str(tmp_path)), registry.ORACLE_SQL["mapped_documents"], str(tmp_path))


def test_a_document_of_two_persons_takes_either_value(spark):
    maps = spark.createDataFrame([(1, "d", p, "CIBIL Report", True, n) for p in ("p0", "p1") for n in (1, 2)] + [(1, "d", "p0", "CIBIL Report", True, 7)], "app bigint, document string, person string, document_type string, required boolean, page_number bigint")
    pages = spark.createDataFrame([(1, 1, True, 0.9), (1, 2, None, 0.2)], "app bigint, page_number bigint, is_readable boolean, ocr_confidence double")
    seen = [(1, 1, "pin_code", "380001", True), (1, 1, "pin_code", "380003", True), (1, 2, "pin_code", "380009", True), (1, 2, "pan_number", "ABCPD0001F", False)]
    seen = spark.createDataFrame(seen, "app bigint, page_number bigint, field string, value string, reliable boolean")
    known = [(1, "p0", "pin_code", "380001"), (1, "p1", "pin_code", "380002"), (1, "p2", "pin_code", "380003"), (1, "p1", "pan_number", "ABCPD0001F"), (1, "p1", "phone_number", "9000000001"), (1, "p0", "address", " ")]
    known = spark.createDataFrame(known, "app bigint, person string, field string, trusted_value string")
    found = sorted((r.person, r.page_number, r.rule_id, r.severity) for r in mapped.findings(maps, pages, seen, known, ["app"]).collect())
    both = [(1, "INDEX_MAPPING_SUSPECTED", "HIGH"), (2, "LOW_CONFIDENCE_PAGE", "LOW")]
    one = [(1, "PHONE_NUMBER_NOT_FOUND", "MEDIUM"), (2, "PAN_NUMBER_EXTRACTION_UNRELIABLE", "LOW")]
    assert found == sorted([(p, *x) for p in ("p0", "p1") for x in both] + [("p1", *x) for x in one] + [("p0", 7, "PAGE_OUT_OF_RANGE", "HIGH")])
