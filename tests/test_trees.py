"""JSON trees of random depth against a walk of each."""

from __future__ import annotations

import json
import random

from docketry.sources import trees


def walked(tree, path="$", name=None, without=()):
    if isinstance(tree, dict):
        return [x for k, v in tree.items() if k not in without for x in walked(v, f"{path}.{k}", k, without)]
    if isinstance(tree, list):
        return [x for i, v in enumerate(tree) for x in walked(v, f"{path}[{i}]", name, without)]
    return [(path, name)]


def grown(rng, depth):
    kind = rng.random()
    if depth == 0 or kind < 0.2:
        return rng.choice([1, 2.5, "text", True, None, ""])
    if kind < 0.6:
        return {rng.choice("abcx"): grown(rng, depth - 1) for _ in range(rng.randrange(4))}
    return [grown(rng, depth - 1) for _ in range(rng.randrange(4))]


def test_leaves_are_those_of_a_walk(spark):
    rng = random.Random(1)
    made = {k: {"r": grown(rng, rng.randrange(1, 9))} for k in range(60)}
    deep = 1
    for _ in range(25):
        deep = {"d": [deep]}
    made[100] = deep
    texts = [(k, json.dumps(t)) for k, t in made.items()] + [(200, None), (201, "no json {"), (202, "[]"), (203, "{}")]
    docs = spark.createDataFrame(texts, "id bigint, body string")
    for without in ((), ("x",)):
        found = {}
        for r in trees.leaves(docs, "id", "body", without).collect():
            found.setdefault(r.id, []).append((r.path, r.name))
        assert {k: sorted(v) for k, v in found.items()} == {k: sorted(w) for k, t in made.items() if (w := walked(t, without=without))}


def test_a_job_goes_down_several_levels(spark):
    deep = '{"d": [' * 5 + "7, []" + "]}" * 5
    found = trees.leaves(spark.createDataFrame([(1, deep), (2, '{"d": {}, "e": 1.50}')], "id int, body string"), "id", "body")
    assert sorted(map(tuple, found.collect())) == [(1, "$" + ".d[0]" * 5, "d", "BIGINT", "7"), (2, "$.e", "e", "DECIMAL(2,1)", "1.5")]
    assert len({f.rsplit("/", 2)[-2] for f in found.inputFiles()}) <= 3  # of ten levels, and the empty list
