"""Phrase collocations, the filter audit and SimHash components against plain versions."""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

from docketry.llm import collocations, common, filter_audit, simhash
from tests.llm.fixtures import SF, WORDS, hard_rows, prose, table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# ------------------------------------------------------------------ collocations


def plain_collocations(rows, least, top=2000, percent=80):
    """Rows (lang, rank, phrase, a, l, r, n, score) by counting every n-gram."""
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 5):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, all_counts in counts.items():
        f = {g: n for g, n in all_counts.items() if n >= least}
        found = []
        for g, a in f.items():
            if len(g) > 1:
                inside = [h for h in f if len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))]
                if not any(100 * f[h] >= percent * a for h in inside):
                    score, _, left, right = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
                    found.append((-score, -a, " ".join(g).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def phrase_rows(seed=1, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(12)] + ["Éa", "ça", "New", "York", "new"]
    rows = [(i, " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", "", ".", ",\n", " \t", "\x0b", "?!"]) for _ in range(rng.randrange(0, 60)))) for i in range(n)]
    return [*rows, (500, None), (501, ""), (502, " .,; \n"), (503, "hot pair " * 4000), (504, "a a a a a a a. a a A"), (505, "one\x85two one\x85two\xa0x"), (506, "long" * 9000), (None, "new york new york"), (500, "w1 w2 w3 w4")]


@pytest.mark.parametrize("group", [50, 200_000])
def test_phrases_are_those_of_counting_all(spark, group):
    rows = phrase_rows()
    docs = table(spark, rows, clash=True).withColumn("lang", F.expr("case when doc_id % 3 = 0 then null else lang end"))
    wanted = plain_collocations([(r.lang, r.text) for r in docs.select("lang", "text").collect()], 3)
    found = collocations.collocations(docs, least=3, group=group).collect()
    assert sorted(map(tuple, found)) == wanted and len(wanted) > 100
    assert {r[0] for r in wanted} == {"en", "und"}


def test_best_phrases_are_cut_by_rank(spark):
    docs = table(spark, phrase_rows(2))
    wanted = plain_collocations([(r.lang, r.text) for r in docs.select("lang", "text").collect()], 2, top=25)
    assert sorted(map(tuple, collocations.collocations(docs, least=2, top=25).collect())) == wanted
    assert collocations.collocations(table(spark, [])).count() == 0


def test_a_pivot_owns_each_phrase_once(spark):
    """Fragments hold the pivot after words that are more frequent, and every n-gram is in one group alone."""
    docs = table(spark, phrase_rows(3))
    texts = docs.selectExpr("coalesce(lang, 'und') lang", "coalesce(text, '') text")
    words = collocations.word_counts(texts)
    n = {(r.lang, r.word): r.n for r in words.collect()}
    rows = collocations.fragments(texts, collocations.order_table(words), 3, 4, 10**9).collect()
    owner = defaultdict(set)
    for r in rows:
        texts = bytes(r.texts).decode().removesuffix("\n").split("\n")
        assert len(texts) == len(r.leads) == len(r.counts) // 4 and not r.split
        for lead, fragment in zip(bytes(r.leads), texts, strict=True):
            parts = fragment.split(" ")
            own = n[r.lang, parts[lead]]
            assert lead <= 3 and len(parts) - lead <= 4
            assert all(n[r.lang, w] >= own for w in parts) and parts[lead] not in parts[:lead]
            for a, b in itertools.product(range(lead + 1), range(len(parts) - lead)):
                if 1 <= a + b <= 3:
                    owner[r.lang, " ".join(parts[lead - a : lead + b + 1])].add(r.pivot)
    assert rows and all(len(v) == 1 for v in owner.values())


def test_counts_beyond_64_bits_are_exact(spark):
    found = spark.createDataFrame([("en", "a b", 2, 10**13), ("en", "a", 1, 3 * 10**13), ("en", "b", 1, 10**13 + 7)], "lang string, phrase string, words int, f bigint")
    assert collocations.scored(found).first().score == 2_000_000 * 10**13 // (4 * 10**13 + 7)


# ------------------------------------------------------------------ filter audit


def plain_audit(rows, labels):
    """Rows of all orders, each filter applied in turn to what is left."""
    good, toxic = ({i for i, *marks in labels if marks[k] == 1 and i is not None} for k in range(2))
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)

    def fails(i, t):
        t = t or ""
        words = WORDS.findall(t)
        capitals = sum("A" <= c <= "Z" for c in t)
        return {c for c, bad in zip("ABCDE", (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * capitals > 3 * len(t), any(c in "#$%&*|" for c in t), i is not None and least[t] < i), strict=True) if bad}

    parts = defaultdict(list)
    for i, t, part in rows:
        parts[part or ""].append((fails(i, t), i))
    out = {}
    for part, docs in parts.items():
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                kept = [d for d in left if f not in d[0]]
                redundant = sum(f in d[0] for d in docs) - len(gone)
                out[part, "".join(order), step] = [len(kept), len(gone), redundant, sum(d[0] == {f} for d in docs), sum(d[1] in good for d in gone), sum(d[1] in toxic for d in gone)]
                shapley[f] += len(gone)
                left = kept
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step].append(shapley[f])
    return out


def test_audit_is_that_of_applying_every_order(spark):
    rng = random.Random(4)
    rows = [(i, t) for i, t in hard_rows()]
    rows += [(100 + k, rng.choice([" ".join(prose(k % 7, 250)), "SHOUT " * 10, "a#b", " ".join(prose(k % 5, 20)), "Word " * 300, None])) for k in range(80)]
    docs = table(spark, rows, clash=True).withColumn("lang", F.expr("case when doc_id % 3 = 0 then null when doc_id % 3 = 1 then 'en' else '' end"))
    marks = [(100 + k, k % 2, k % 3 == 0) for k in range(0, 80, 2)] + [(100, 0, 1), (7, 1, None), (None, 1, 1), (999, 1, 1), (102, None, None)]
    labels = spark.createDataFrame([(i, a, None if b is None else int(b)) for i, a, b in marks], "doc_id bigint, quality int, toxic int")
    found = filter_audit.audit(filter_audit.cells(docs, labels)).collect()
    wanted = plain_audit([(r.doc_id, r.text, r.lang) for r in docs.select("doc_id", "text", "lang").collect()], marks)
    assert {(r.part, r.filter_order, r.step): [r[c] for c in filter_audit.COUNTS] for r in found} == wanted
    assert len(found) == len(wanted) == 2 * 600
    assert filter_audit.audit(filter_audit.cells(table(spark, []), labels)).count() == 0


def test_orders_are_visited_by_single_swaps():
    for k in range(1, 7):
        order, seen = list(range(k)), {tuple(range(k))}
        for i in filter_audit.swaps(k):
            order[i], order[i + 1] = order[i + 1], order[i]
            seen.add(tuple(order))
        assert len(seen) == len([*filter_audit.swaps(k)]) + 1 == len([*itertools.permutations(range(k))])


def test_cells_are_few_whatever_the_rows(spark):
    rows = [(i, "same text") for i in range(2000)] + [(i, None) for i in range(2000, 3000)]
    found = {r["mask"]: r.n for r in filter_audit.cells(table(spark, rows).withColumn("lang", F.lit("en")), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).collect()}
    assert found == {1: 2, 17: 2998}


# ----------------------------------------------------------------------- SimHash


def plain_fingerprint(text):
    words = WORDS.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps, distance=3):
    """The smallest id of each row's component, by all pairs."""
    fps, label = np.array(fps, np.uint64), np.arange(len(fps))
    changed = True
    while changed:
        changed = False
        for i, own in enumerate(fps):
            near = np.bitwise_count(fps ^ own) <= distance
            if label[near].min() != label[near].max():
                label[near], changed = label[near].min(), True
    best = {k: min((i for i, x in zip(ids, label, strict=True) if x == k and i is not None), default=None) for k in set(label.tolist())}
    return [best[k] for k in label.tolist()]


def check_components(found, rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    wanted = Counter(zip([i for i, _ in rows], [f"{x:016x}" for x in fps], plain_components([i for i, _ in rows], fps), strict=True))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in found.collect()) == wanted


@pytest.mark.parametrize("small", [2, 1024])
def test_components_are_those_of_all_pairs(spark, small):
    rows, rng = hard_rows(), random.Random(5)
    for k in range(150):  # chains of growing edits
        words = prose(100 + k // 30, 150, 100_000)
        for _ in range(k % 30):
            words[rng.randrange(150)] = f"edit{rng.random()}"
        rows.append((200 + k, " ".join(words)))
    check_components(simhash.near_components(table(spark, rows, clash=True), small=small), rows)


def test_components_of_the_table(spark):
    docs = common.load(spark, SF, "documents")
    check_components(simhash.near_components(docs), [(r.doc_id, r.text) for r in docs.collect()])
    assert simhash.near_components(table(spark, [])).count() == 0


@pytest.mark.parametrize(("small", "distance"), [(4, 3), (4, 2), (4, 1), (4, 0), (1024, 3), (1024, 1)])
def test_links_of_crowded_fingerprints_connect_what_all_pairs_connect(spark, small, distance):
    rng = np.random.default_rng(6)
    fps = [0, 2**64 - 1]
    for _ in range(6):  # balls of different density
        middle, spread = int(rng.integers(0, 2**63)), rng.integers(1, 8)
        fps += [middle ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, spread + 1), replace=False)) for _ in range(150)]
    fps = sorted({x % 2**64 for x in fps})
    nodes = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp bigint")
    label = {x: x for x in fps}
    for u, v in [(r.u % 2**64, r.v % 2**64) for r in simhash.links(nodes, distance, small).collect()]:
        assert (u ^ v).bit_count() <= distance
        a, b = sorted((label[u], label[v]))
        label = {x: a if y == b else y for x, y in label.items()} if a != b else label
    assert [label[x] for x in fps] == plain_components(fps, fps, distance)


def test_links_grow_with_the_members_of_an_anchor(spark):
    """All of a radius-two ball: links stay in proportion to its members, not to its pairs."""
    counts = {}
    for width in (16, 32):
        fps = [0, *(1 << a for a in range(width)), *(1 << a | 1 << b for a, b in itertools.combinations(range(width), 2))]
        for small in (8, 1024):
            nodes = spark.createDataFrame([(x,) for x in fps], "fp bigint")
            counts[width, small] = simhash.links(nodes, small=small).count() / len(fps)
    assert max(counts.values()) < 40


def test_each_half_is_near_one_home_and_meets_what_is_near():
    rng = np.random.default_rng(7)
    fps = rng.integers(0, 2**63, 300, np.int64).view(np.uint64)
    anchor, home, place = simhash.anchors_of(fps)
    half = np.where(anchor >> np.uint64(32) > 0, fps[place] >> np.uint64(32), fps[place] & np.uint64(0xFFFFFFFF))
    away = np.bitwise_count(half ^ (anchor & np.uint64(0xFFFFFFFF)))
    assert away.max() == 2 and away[home].max() <= 1 and home.sum() == 2 * len(fps) and len(anchor) < 34 * len(fps)
    for x in fps[:40]:
        homes = set(anchor[home & (fps[place] == x)].tolist())
        for bits in itertools.combinations(range(64), 3):
            if rng.random() < 0.01:
                other = x ^ np.uint64(sum(1 << b for b in bits))
                assert homes & set(simhash.anchors_of(np.array([other]))[0].tolist())
