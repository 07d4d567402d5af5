"""Sections of dumps against a scan of every character."""

from __future__ import annotations

import random
import re

from docketry.sources import dumps


def scanned(body):
    """(name, kind, begin, length) of every balanced section, by a scan from each bracket."""
    quoted, skip, marks = False, False, []
    for i, c in enumerate(body):
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "{}[]":
            marks.append((i, c))
    out = []
    for k, (i, c) in enumerate(marks):
        if c in "{[":
            close, depth = {"{": "}", "[": "]"}[c], 0
            for j, d in marks[k:]:
                depth += (d == c) - (d == close)
                if not depth:
                    name = re.search(r'"((?:[^"\\]|\\.)*)"\s*:\s*$', body[:i], re.S)
                    out.append((name and name[1], c, i + 1, j - i + 1))
                    break
    return sorted(out, key=repr)


def test_sections_are_those_of_a_scan(spark):
    rng = random.Random(2)
    pieces = ['{', '}', '[', ']', '"a"', '"b c":', ' : ', '"x{y]"', '"q\\"{"', "1", ",", "\n", '"list": [', '"obj" : {', "junk ", "é"]
    texts = {k: "".join(rng.choice(pieces) for _ in range(rng.randrange(60))) for k in range(150)}
    texts |= {900: None, 901: "", 902: "}}]] {", 903: '{"a": {"b": [1, {"c": "}"}]}', 904: '"open { [', 905: '{"k": "' + "\\" * 5}
    large = '{"rows": [' + ",".join(f'{{"k": {k}, "note": "a]{{b"}}' for k in range(60_000)) + ']} trailing "dbmaker": {"emi": "1"} {'
    texts[906] = large
    docs = spark.createDataFrame([*texts.items()], "id bigint, body string")
    found = {}
    for r in dumps.brackets(docs, "id", "body").where("id <> 906").collect():
        found.setdefault(r.id, []).append((r.name, r.kind, r.begin, r.length))
    for k, body in texts.items():
        if k != 906:
            assert sorted(found.get(k, []), key=repr) == [x for x in scanned(body or "")], (k, body)
    parts = dumps.sections(docs.where("id = 906"), "id", "body")
    rows = {(r.name, r.kind, r.no): r.text for r in parts.where("no <= 2 or no > 59_998".replace("_", "")).collect()}
    assert rows[("rows", "{", 60_000)] == '{"k": 59999, "note": "a]{b"}' and rows[("dbmaker", "{", 1)] == '{"emi": "1"}'
    assert rows[("rows", "[", 1)] == large[9 : large.index("]} trailing") + 1] and parts.count() == 60_002


def test_objects_of_an_array_are_those_directly_in_it(spark):
    body = '"people": [ {"name": "a", "kyc": {"pan": "1"}, "more": [{"x": 1}]}, 7, {"name": "b"} ] then {"name": "c"}'
    found = dumps.sections(spark.createDataFrame([(1, body)], "id int, body string"), "id", "body").collect()
    assert {(r.name, r.kind, r.no): r.text for r in found} == {
        ("people", "[", 1): body[10:body.index(" then")], ("people", "{", 1): '{"name": "a", "kyc": {"pan": "1"}, "more": [{"x": 1}]}', ("people", "{", 2): '{"name": "b"}',
        ("kyc", "{", 1): '{"pan": "1"}', ("more", "[", 1): '[{"x": 1}]', ("more", "{", 1): '{"x": 1}',
    }


def test_sections_neither_sort_nor_send_texts(spark, capsys):
    found = dumps.sections(spark.createDataFrame([(1, '{"a": {"b": [1]}} ] "c": {"b": [{}]}')], "id int, body string"), "id", "body")
    found.explain()
    plan = capsys.readouterr().out
    assert not [x for x in ("Exchange", "Sort", "Window", "Join") if x in plan]  # memory of a task is that of one text
    assert sorted((r.name, r.no, r.kind, r.begin, r.text) for r in found.collect()) == [
        ("a", 1, "{", 7, '{"b": [1]}'), ("b", 1, "[", 13, "[1]"), ("b", 1, "{", 33, "{}"), ("b", 2, "[", 32, "[{}]"), ("c", 1, "{", 26, '{"b": [{}]}'),
    ]
