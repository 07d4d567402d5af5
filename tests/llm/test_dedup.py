"""Exact, near, line and substring dedup against plain versions."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from docketry.llm import common, exact_dedup, line_dedup, near_dedup, queries, substrings
from tests.compare import assert_same
from tests.llm.fixtures import SF, hard_rows, near_classes, prose, shingles, table, without_repeats


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name], SF)


def test_exact_dedup_keeps_the_largest_id_of_equal_texts(spark):
    rows = hard_rows()
    found = exact_dedup.exact_dedup(table(spark, rows, clash=True)).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    assert len(found) == len(rows)
    wanted = Counter()
    for i, t in rows:
        ids = groups[t or ""]
        best = max((x for x in ids if x is not None), default=None)
        wanted[i, best, len(ids), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == wanted
    assert Counter(r.text_sha256 for r in found if r.kept) == {hashlib.sha256(t.encode()).hexdigest(): 1 for t in groups}
    assert all(r.doc_id == r.keep_id for r in found if r.kept)


def test_exact_dedup_smallest_and_its_documents(spark):
    rows = hard_rows()
    docs = table(spark, rows, clash=True)
    smallest = exact_dedup.exact_dedup(docs, keep="smallest").where("group_size > 1 and doc_id is not null").collect()
    assert {r.doc_id for r in smallest if r.kept} == {4, 7}
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert Counter(r.text or "" for r in kept.collect()) == {t or "": 1 for _, t in rows}


def test_the_filter_spares_rows_without_a_copy(spark):
    rows = [(i, f"text {i % 990}") for i in range(1000)]
    runs = exact_dedup.probed(exact_dedup.flush_runs(table(spark, rows), "doc_id", "text", exact_dedup.digest_of("text")))
    maybe = runs.where("_maybe")
    assert 20 <= maybe.count() < 60 and maybe.select("digest").distinct().count() == exact_dedup.compact(maybe).count()
    assert exact_dedup.compact(maybe).where("n > 1").count() == 10


def test_texts_of_one_digest_are_compared_byte_by_byte(spark, monkeypatch):
    from pyspark.sql import functions as F

    docs = table(spark, [(1, "one"), (2, "two"), (3, "one")])
    weak = F.unhex(F.lit("00"))
    assert {r.keep_id for r in exact_dedup.exact_dedup(docs, digest=weak).collect()} == {2, 3}
    real = F.xxhash64
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.lit(7).cast("bigint") if not isinstance(c[0], str) else real(*c))
    with pytest.raises(ValueError, match="same digest"):
        exact_dedup.exact_dedup(docs, digest=weak)


def test_near_classes_are_those_of_all_pairs(spark):
    rows = hard_rows()
    rng = random.Random(3)
    for k in range(40):  # chains and groups of copies with growing edits
        words = prose(100 + k // 8, 300, 100_000)
        for _ in range(3 * (k % 8)):
            words[rng.randrange(300)] = f"edit{rng.random()}"
        rows.append((200 + k, " ".join(words)))
    found = near_dedup.near_groups(table(spark, rows, clash=True)).collect()
    wanted = near_classes(rows)
    assert len(found) == len(rows)
    assert {(r.doc_id, r.class_id) for r in found if r.doc_id is not None} == set(wanted.items())
    sizes = Counter(wanted[i] for i, _ in rows if i is not None)
    assert all(r.class_size == sizes[r.class_id] for r in found if r.doc_id is not None)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.class_id) for r in found)
    assert len({c for i, c in wanted.items() if i >= 200}) < 40


def test_near_classes_of_the_table(spark):
    docs = common.load(spark, SF, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = {r.doc_id: r.class_id for r in queries.QUERIES["op8_near_dedup"](spark, SF).collect()}
    assert found == near_classes(rows)
    kept = near_dedup.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(set(found.values()))


def test_a_large_group_of_near_copies_is_one_class(spark):
    base, rows = prose(5, 120, 100_000), []
    for i in range(300):
        words = base.copy()
        words[i % 120] = f"own{i}"
        rows.append((i, " ".join(words)))
    rows.append((1000, " ".join(prose(6, 120, 100_000))))
    found = {r.doc_id: (r.class_id, r.class_size) for r in near_dedup.near_groups(table(spark, rows)).collect()}
    assert found == {**{i: (0, 300) for i in range(300)}, 1000: (1000, 1)}


def test_near_copies_under_one_id_leave_one_row(spark):
    base = prose(31, 120, 100_000)
    rows = [(5, " ".join([*base, "zeta"])), (5, " ".join([*base, "alpha"])), (6, " ".join(base)), (7, " ".join(prose(32, 90))), (8, " ".join(prose(33, 90))), (8, " ".join(prose(34, 90))), (9, "one two"), (9, "one two"), (None, "x y"), (None, "x y")]
    docs = table(spark, rows, clash=True)
    kept = near_dedup.drop_near_copies(docs)
    wanted = Counter([rows[1], rows[3], min(rows[4:6]), (9, "one two"), (None, "x y"), (None, "x y")])
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == wanted and kept.schema == docs.schema


def test_dart_signatures_estimate_weighted_similarity(spark):
    import numpy as np
    import pyarrow as pa

    a, b = "x y z q " * 12 + " ".join(prose(1, 100)), "x y z q " * 6 + " ".join(prose(1, 100)[:80])
    for weights in ("set", "count"):
        texts, values = near_dedup.regions(common.WordHasher(seed=5, lower=True), pa.array([a, b]), 1, weights)
        ranks = near_dedup.dart_signatures(texts, values, 2, 2000)
        assert np.isfinite(ranks).mean() > 0.9
        agree = (ranks[0] == ranks[1]).mean()
        x, y = (Counter(t.split()) if weights == "count" else dict.fromkeys(t.split(), 1) for t in (a, b))
        keys = set(x) | set(y)
        exact = sum(min(x.get(k, 0), y.get(k, 0)) for k in keys) / sum(max(x.get(k, 0), y.get(k, 0)) for k in keys)
        assert abs(agree - exact) < 0.05


def test_substrings_are_those_of_all_windows(spark):
    for rows in (hard_rows(), [(r.doc_id, r.text) for r in common.load(spark, SF, "documents").collect()]):
        docs = table(spark, rows, clash=True)
        found = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substrings.dedup_substrings(docs).collect())
        assert found == without_repeats(rows)


def test_substrings_of_a_text_that_repeats_itself(spark):
    passage = prose(1, 60)
    rows = [(1, " ".join(passage * 4)), (2, " ".join(prose(2, 30) + passage * 2)), (3, " ".join(passage[:49])), (4, " ".join(passage[5:55]))]
    found = {r.doc_id: r.n_removed for r in substrings.dedup_substrings(table(spark, rows)).collect()}
    assert found == {1: 0, 2: 120, 3: 0, 4: 50}


def plain_lines(rows):
    """(id, lines, removed, kept) of rows of distinct (id, text), by id and hash order of none that tie."""
    seen, out = {}, Counter()
    order = sorted(((-1 if i is None else i), t or "") for i, t in rows)
    for i, t in order:
        lines = t.split("\n")
        gone = set()
        for k in range(len(lines) - 2):
            key = tuple(lines[k : k + 3])
            if key in seen:
                gone |= {k, k + 1, k + 2}
            seen.setdefault(key, i)
        out[i, len(lines), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone)] += 1
    return out


def test_lines_are_those_of_all_windows(spark):
    rows = hard_rows()
    docs = table(spark, rows, clash=True)
    kept = line_dedup.dedup_lines(docs)
    found = Counter((-1 if r.doc_id is None else r.doc_id, r.n_lines, r.n_removed, r.kept_text) for r in kept.collect())
    assert found == plain_lines(rows)
    assert set(kept.columns) == set(docs.columns) | set(line_dedup.ADDED)


def test_empty_tables(spark):
    docs = table(spark, [])
    for made in (exact_dedup.exact_dedup(docs), exact_dedup.drop_copies(docs), near_dedup.near_groups(docs), near_dedup.drop_near_copies(docs), substrings.dedup_substrings(docs), line_dedup.dedup_lines(docs)):
        assert made.count() == 0


def test_shingles_of_short_texts():
    assert shingles("a b") == {("a", "b")} and not shingles(" ") and not shingles(None)


def excerpts(n: int) -> list[tuple[int, str]]:
    """Texts of five of the eight blocks of one text, each with a word of its own."""
    rng, base = random.Random(9), prose(41, 600, 100_000)
    blocks = [base[k : k + 75] for k in range(0, 600, 75)]
    rows = [(0, " ".join(base))]
    for i in range(1, n):
        words = [w for k in sorted(rng.sample(range(8), 5)) for w in blocks[k]]
        words[rng.randrange(len(words))] = f"own{i}"
        rows.append((i, " ".join(words)))
    return rows


def test_rows_of_excerpts_of_one_text_grow_with_their_number(spark, monkeypatch):
    compared, made = near_dedup._compared, {}

    def counted(groups, weighed, least):
        rows[0] += groups.count()
        found = compared(groups, weighed, least)
        rows[1] += found.count()
        return found

    monkeypatch.setattr(near_dedup, "_compared", counted)
    for n in (300, 600):
        rows = [0, 0]
        texts = excerpts(n)
        found = {r.doc_id: r.class_id for r in near_dedup.near_groups(table(spark, texts)).collect()}
        assert found == near_classes(texts)
        made[n] = rows
    assert all(made[600][k] < 2.6 * made[300][k] for k in range(2)) and made[600][0] < 25 * 600, made  # all pairs are 179,700


def test_blocks_of_a_large_group_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "HALF_BLOCK", 8)
    texts = excerpts(150)
    found = {r.doc_id: r.class_id for r in near_dedup.near_groups(table(spark, texts), small=4).collect()}
    assert found == near_classes(texts)


def test_a_forest_connects_what_all_pairs_connect():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(20):
        sets = [set(rng.choice(40, rng.integers(0, 30), replace=False).tolist()) for _ in range(25)]
        sizes = np.array([len(s) + int(rng.integers(0, 2)) for s in sets])
        links = near_dedup.forest(sizes, np.array([len(s) for s in sets]), np.array([x for s in sets for x in s]), 0.5)
        label = list(range(25))
        wanted = list(range(25))
        for pairs, out in ((links, label), ([(i, j) for i in range(25) for j in range(i) if len(sets[i] & sets[j]) >= 0.5 * (sizes[i] + sizes[j] - len(sets[i] & sets[j]))], wanted)):
            for i, j in pairs:
                a, b = out[i], out[j]
                out[:] = [min(a, b) if x in (a, b) else x for x in out]
        assert label == wanted and len(links) < 25
