"""Values found in texts, and fields recovered from labelled blocks."""

from __future__ import annotations

import random
import re

import pytest

from docketry.operators import trusted_values


def plain(text):
    return re.sub("[^a-z0-9]+", " ", "".join(c.lower() if c.isascii() else c for c in text or "")).strip()


def plain_occurrences(texts, values):
    wanted = {plain(v) for v in values} - {""}
    out = []
    for key, body in texts:
        words = plain(body).split()
        for v in wanted:
            parts = v.split()
            at = [i + 1 for i in range(len(words) - len(parts) + 1) if words[i : i + len(parts)] == parts]
            if at:
                out.append((key, v, at[0], len(at)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most_bytes", [1 << 20, 0])
def test_values_are_those_of_looking_for_each(spark, most_bytes):
    rng = random.Random(1)
    words = ["a", "b", "ab", "ba", "Ünder", "x1", "x2"]
    texts = [(k, " ".join(rng.choice(words) + rng.choice(["", ".", ", ", "--"]) for _ in range(rng.randrange(40)))) for k in range(60)]
    texts += [(100, None), (101, ""), (102, " .,"), (103, "a b a b a b"), (103, "a b"), (None, "x1 x2"), (104, "ab " * 5000)]
    values = ["a b", "A-B", "b a", "ab", "a b a", "x1 x2", "x1", "", None, "not there", "ab ab", "b  x1 "]
    docs = spark.createDataFrame(texts, "id bigint, body string")
    wanted = spark.createDataFrame([(v,) for v in values], "v string")
    found = trusted_values.occurrences(docs, wanted, "id", "body", "v", most_bytes).collect()
    assert sorted([tuple(r) for r in found], key=repr) == plain_occurrences(texts, [v or "" for v in values])
    assert trusted_values.occurrences(docs, wanted.limit(0), "id", "body", "v", most_bytes).count() == 0
    assert trusted_values.occurrences(docs.limit(0), wanted, "id", "body", "v", most_bytes).count() == 0


def test_recovery_takes_what_is_sure_and_alone(spark):
    people = [(1, "p0", "pan_number", "ABCPD1234F"), (1, "p1", "pan_number", "QQQPD9999Z"), (2, "p0", "pan_number", "SAMPD1111A"), (2, "p1", "pan_number", "SAMPD1111A"), (1, "p0", "date_of_birth", "1990-02-01"), (1, "p0", "phone_number", "9876543210"), (1, "p0", "pin_code", "380015")]
    body = {
        1: "PAN\nabcpd 1234 f", 2: "PAN No: ABCPD1234F\nPAN ABCPD 1234F", 3: "ref ABCPD1234F", 4: "span ABCPD1234F", 5: "PAN\n1\n2\n3\n4\nABCPD1234F", 6: "PAN: ABCPD1234F", 7: "PAN: ABCPD1234F",
        8: "PAN: ABCPD1234F", 9: "PAN: SAMPD1111A", 10: "DOB\n01/02/1990", 11: "Mobile: +91 98765 43210", 12: "Pin code\n\n380015", 13: "PAN: ABCPD1234F", 14: None,
    }
    current = {6: {"pan_number": "ABCPD1234F"}, 7: {"pan_number": "QQQPD9999Z"}, 8: {"pan_number": "XXXXX"}}
    pages = [(2 if k == 9 else 1, "p0", k, "Application Form", k != 4, 0.6 if k == 13 else None, b, current.get(k, {"other": "x"})) for k, b in body.items()]
    pages = spark.createDataFrame(pages, "app int, person string, page_number int, document_type string, is_readable boolean, ocr_confidence double, body string, fields map<string,string>")
    trusted = spark.createDataFrame(people, "app int, person string, field string, trusted_value string")
    found = {(r.page_number, r.field): (r.observed, r.line, r.confidence) for r in trusted_values.recovered(pages, trusted, ["app"], "body", "fields").collect()}
    assert found == {
        (1, "pan_number"): ("abcpd 1234 f", 1, 0.98), (2, "pan_number"): ("ABCPD1234F", 1, 0.98), (8, "pan_number"): ("ABCPD1234F", 1, 0.98),
        (10, "date_of_birth"): ("01/02/1990", 1, 0.98), (11, "phone_number"): ("+91 98765 43210", 1, 0.98), (12, "pin_code"): ("380015", 1, 0.98),
    }
