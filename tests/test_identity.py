"""Chains of identifiers."""

from __future__ import annotations

import random

from docketry.operators import identity


def test_chains_are_one_person_and_conflicts_are_told(spark):
    rows = [
        (1, 1, "A1", None, None), (1, 2, "a-1", "99", None), (1, 3, None, "99", "x"), (1, 4, None, None, "X"), (1, 5, "B2", " ", "y"), (1, 6, None, None, None),
        (1, 7, "C3", "55", None), (1, 8, "D4", "55", None), (2, 9, "A1", "55", None), (2, 10, None, None, "q"),
    ]
    docs = spark.createDataFrame(rows, "app int, page int, pan string, phone string, account string")
    found = {r.page: (r.identity, r.records, r.conflict) for r in identity.linked(docs, "page", ["app"], ["pan", "phone", "account"], ("pan",)).collect()}
    one = ("account:x", 4, False)
    assert found == {1: one, 2: one, 3: one, 4: one, 5: ("account:y", 1, False), 7: ("pan:c3", 2, True), 8: ("pan:c3", 2, True), 9: ("pan:a1", 1, False), 10: ("account:q", 1, False)}
    assert identity.linked(docs.limit(0), "page", ["app"], ["pan", "phone"]).count() == 0


def test_components_are_those_of_following_every_link(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(230)] + [(1000 + k, 1001 + k) for k in range(60)] + [(7, 7)]
    label = {x: x for pair in links for x in pair}
    for u, v in links * 1:
        a, b = sorted((label[u], label[v]))
        label = {x: a if y == b else y for x, y in label.items()}
    found = {r.node: r.least for r in identity.connected(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    single = {x for x in label if not any(x in p and p[0] != p[1] for p in links)}
    assert found == {x: y for x, y in label.items() if x not in single}


def test_a_star_of_very_many_records_is_one_person(spark):
    rows = spark.range(100_000).selectExpr("1 AS app", "id AS page", "concat('p', id) AS account", "'999' AS phone")
    found = identity.linked(rows, "page", ["app"], ["account", "phone"])
    assert [(r.identity, r.records, r["count"]) for r in found.groupBy("identity", "records").count().collect()] == [("account:p0", 100_000, 100_000)]
