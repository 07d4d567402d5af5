"""Fingerprints, packing, mixing, token counts, classifiers and the pipeline."""

from __future__ import annotations

import base64
import hashlib
import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docketry.llm import common, fingerprints, mixing, packing, quality, queries, token_counts, toxicity
from tests.llm.fixtures import SF, WORDS, hard_rows, near_classes, prose, shingles, table

SF_10 = "/root/testdata/sf0.01"
SF_100 = "/root/testdata/sf0.1"


def test_fingerprints_of_texts_and_their_edits(spark):
    rows = [(i, t) for i, t in hard_rows() if i is not None]
    rows = [*dict(rows).items()]
    found = {r.doc_id: r for r in fingerprints.with_edits(table(spark, rows, clash=True)).collect()}
    assert set(found) == {i for i, _ in rows}
    order = sorted(rows)
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 2
        edited = t[: len(t) - n] + after[:n]
        r = found[i]
        assert r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == r.edited_fingerprint or shingles_of(t) != shingles_of(edited)
        for near, other in ((r.near_edited, edited), (r.near_next, after)):
            a, b = shingles_of(t), shingles_of(other)
            exact = len(a & b) / len(a | b) if a | b else 1.0
            if min(len(a), len(b)) > 200:
                assert abs(near - exact) < 0.12
            elif a == b:
                assert near == 1.0
            elif not a & b:
                assert near == 0.0
    assert found[7].fingerprint == found[9].fingerprint != found[8].fingerprint
    assert found[1].fingerprint == found[2].fingerprint == ""


def shingles_of(text: str) -> set:
    words = WORDS.findall(text)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_sketches_of_short_texts_keep_what_long_ones_keep(spark):
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in rng.integers(0, 50_000, 3000)]
    short = [(k, " ".join(words[k * 20 : k * 20 + rng.integers(1, 15)])) for k in range(100)]
    docs = table(spark, [*short, (1000, " ".join(words))])
    part = {r.doc_id: set(r.sketch) for r in fingerprints.fingerprint(docs).collect()}
    whole = {r.doc_id: set(r.sketch) for r in fingerprints.fingerprint(docs, fraction=1.0).collect()}
    limit = 2**62  # a quarter of the hash space
    for i in whole:
        assert part[i] == {x for x in whole[i] if x % 2**64 < limit}
    assert all(part[i] <= part[1000] for i, t in short if len(t.split()) >= 5)
    assert all(len(whole[i]) == max(1, len(t.split()) - 4) for i, t in short)
    assert 0.2 < sum(len(part[i]) for i, _ in short) / sum(len(whole[i]) for i, _ in short) < 0.3


def test_likeness_is_exact_where_all_hashes_are_kept(spark):
    rows = [(i, t) for i, t in dict(hard_rows()).items() if i is not None]
    found = {r.doc_id: r for r in fingerprints.with_edits(table(spark, rows), fraction=1.0).collect()}
    order = sorted(rows)
    for k, (i, t) in enumerate(order):
        a, b = shingles_of(t or ""), shingles_of(order[(k + 1) % len(order)][1] or "")
        assert abs(found[i].near_next - (len(a & b) / len(a | b) if a | b else 1.0)) < 1e-12


def test_fingerprints_of_repeated_and_null_ids(spark):
    rows = hard_rows()
    assert fingerprints.with_edits(table(spark, rows)).count() == len(rows)
    assert fingerprints.with_edits(table(spark, [])).count() == 0
    one = fingerprints.with_edits(table(spark, [(3, "abcd")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1.0


def test_containment_of_unequal_documents_and_merging(spark):
    long = prose(1, 20_000, 1_000_000)
    docs = table(spark, [(1, " ".join(long[5000:7000])), (2, " ".join(long))], clash=True)
    made = fingerprints.fingerprint(docs)
    a, b = (made.where(f"doc_id = {i}").select(F.col("sketch").alias(f"s{i}")) for i in (1, 2))
    both = a.crossJoin(b).select(fingerprints.containment("s1", "s2").alias("ab"), fingerprints.containment("s2", "s1").alias("ba"), F.size(fingerprints.merged("s1", "s2")).alias("n"), F.size("s2").alias("m")).first()
    assert both.ab > 0.98 and abs(both.ba - 0.1) < 0.03 and both.n == both.m


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(common.tokenizer_file("word_bpe_49k.json"))


def check_packing(rows, found, tokenizer, most):
    wanted = Counter()
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), most):
            part = np.asarray(ids[k : k + most], "<u4")
            wanted[i, k // most, k, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == wanted
    bins = defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= most
    total = sum(r.length for r in found)
    return len(bins), -(-total // most)


def test_packing_of_hard_rows(spark, tokenizer):
    rows = hard_rows() + [(50, "<|endoftext|> it's é İstanbul ǅ don't_stop 3.14 naïve x ﬁn ΑΣ"), (51, "tab\tand\rreturn\x0bvt\x85nel"), (52, "ÉCOLE ÑANDÚ STRAẞE ß"), (53, "a <|endoftext|> b"), (54, "A<|startoftext|>É<|ENDOFTEXT|> <|endoftext |>")]
    found = packing.pack_documents(table(spark, rows, clash=True)).collect()
    bins, least = check_packing(rows, found, tokenizer, 4096)
    assert bins <= least + 1


def test_ids_of_random_strings_are_those_of_the_whole_tokenizer(tokenizer):
    """Special tokens are such in their own case only, wherever they stand."""
    encoder, rng = packing.RunTokenizer(common.tokenizer_file("word_bpe_49k.json")), np.random.default_rng(8)
    parts = ["<|ENDOFTEXT|>", "<|EndOfText|>", "<|endoftext|>", "<|STARTOFTEXT|>", "1", "é", "É", " ", "\t", "\n", "a", "Word", "it's", "IT'S", "<", "|", ">", "'", "ß", "ÿ", "İ", "Σ", "ς", "\x85", "\xa0", "中", "7", "%", "-", "ñ"]
    texts = ["1<|ENDOFTEXT|> a", "1<|ENDOFTEXT|>", "\t<|ENDOFTEXT|>é", "<|ENDOFTEXT|>"] + ["".join(rng.choice(parts, rng.integers(1, 9))) for _ in range(50_000)]
    for text, wanted in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == wanted.ids, text


def test_packing_of_the_table(spark, tokenizer):
    rows = [(r.doc_id, r.text) for r in common.load(spark, SF, "documents").collect()]
    bins, least = check_packing(rows, packing.op3_best_fit_packing(spark, SF).collect(), tokenizer, 4096)
    assert bins <= least + 1
    assert packing.pack_documents(table(spark, [])).count() == 0


def test_best_fit_is_bounded_and_takes_the_best(spark):
    bins, offsets = packing.best_fit([6, 7, 3, 4], 10, 10)
    assert bins == [0, 1, 1, 0] and offsets == [0, 0, 7, 6]
    bins, _ = packing.best_fit([6, 7, 8, 3], 10, 2)
    assert bins == [0, 1, 2, 0]  # the fullest of 0 and 1 closed for 2
    rng = np.random.default_rng(1)
    for spaces in (1, 3, 64):
        lengths = rng.integers(1, 101, 2000).tolist()
        bins, offsets = packing.best_fit(lengths, 100, spaces)
        used = Counter()
        for length, own, offset in zip(lengths, bins, offsets, strict=True):
            assert offset == used[own]
            used[own] += length
        assert max(used.values()) <= 100


def plain_targets(sizes: dict, most: int = 3) -> dict:
    """Water filling, one source after another."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    free, left, out = set(order), float(sum(sizes.values())), {}
    while True:
        whole = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / whole > most * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / whole for s in free}
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
        free -= over


def test_mixing_meets_its_targets(spark):
    rows = hard_rows() + [(100 + k, " ".join(prose(k, 20 + k))) for k in range(300)]
    source = lambda i: None if i is None else ("hot" if i >= 160 else f"s{i % 5}")
    docs = table(spark, rows, clash=True, source=source)
    found = mixing.mix(docs).collect()
    sizes, taken = Counter(), Counter()
    assert Counter((r.doc_id, r.size) for r in found) == Counter((i, len(WORDS.findall(t or ""))) for i, t in rows)
    for r in found:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0
    goal = plain_targets(sizes)
    largest = Counter()
    for r in found:
        largest[r.source] = max(largest[r.source], r.size)
        assert r.source_size == sizes[r.source] and abs(r.target - goal[r.source]) < 1e-6 * max(1, goal[r.source])
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= max(0.02 * goal[s], 2 * largest[s])
    again = mixing.mix(docs.repartition(7)).collect()
    assert Counter((r.doc_id, r.size, r.source) for r in again if r.taken) == Counter((r.doc_id, r.size, r.source) for r in found if r.taken)
    out = mixing.take(docs)
    assert out.columns == docs.columns
    assert sum(len(WORDS.findall(r.text or "")) for r in out.collect()) == sum(taken.values())
    assert mixing.mix(table(spark, [])).count() == 0 and mixing.take(table(spark, [])).count() == 0


def plain_pieces(word: bytes, vocabulary: set[bytes], longest: int) -> int:
    count, at = 0, 0
    while at < len(word):
        for n in range(min(longest, len(word) - at), 0, -1):
            if word[at : at + n] in vocabulary:
                at, count = at + n, count + 1
                break
        else:
            return 1
    return count


def test_token_counts_are_those_of_greedy_longest_match(spark):
    with open(common.tokenizer_file("byte_bpe_50k.tiktoken"), "rb") as lines:
        vocabulary = {base64.b64decode(x.split()[0]) for x in lines if x.strip()}
    longest = max(map(len, vocabulary))
    rows = hard_rows() + [(r.doc_id + 1000, r.text) for r in common.load(spark, SF, "documents").collect()]
    found = Counter((r.doc_id, r.n_words, r.n_tokens) for r in token_counts.token_counts(table(spark, rows, clash=True)).collect())
    wanted = Counter()
    for i, t in rows:
        words = WORDS.findall(t or "")
        wanted[i, len(words), sum(plain_pieces(b" " + w.encode(), vocabulary, longest) for w in words)] += 1
    assert found == wanted
    assert token_counts.token_counts(table(spark, [])).count() == 0


def test_automaton_on_all_short_words():
    vocabulary = [b"a", b"b", b"ab", b"abab", b"bba", b"abc", b"cab"]
    counter = token_counts.PieceCounter(vocabulary)
    for n in range(9):
        for word in map(bytes, itertools.product(b"abc", repeat=n)):
            assert counter.count(word) == (plain_pieces(word, set(vocabulary), 4) if word else 0)


def test_toxicity_on_held_out_rows(spark):
    scores = toxicity.op9_toxicity(spark, SF_10).collect()
    assert len(scores) == common.load(spark, SF_10, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in scores)
    label = {r.doc_id: r.toxic for r in common.load(spark, SF_10, "labels").collect()}
    held = [(r.predicted, label[r.doc_id]) for r in scores if r.held_out and r.doc_id in label]
    assert np.mean([p == y for p, y in held]) > 0.93


def test_toxicity_on_more_held_out_rows(spark):
    label = {r.doc_id: r.toxic for r in common.load(spark, SF_100, "labels").collect()}
    held = [(r.predicted, label[r.doc_id]) for r in toxicity.op9_toxicity(spark, SF_100).collect() if r.held_out and r.doc_id in label]
    assert np.mean([y for p, y in held if p]) > 0.9
    assert np.mean([p == y for p, y in held]) > 0.97


def test_counterfactual_texts_swap_terms_within_their_lists():
    made = toxicity.counterfactuals("The Muslims, and a woman of France: muslims")
    assert len(made) == toxicity.COPIES + 1 and not toxicity.counterfactuals("the town and others") and not toxicity.counterfactuals("")
    assert made[-1] == "The , and a  of France: "
    for text in made[:-1]:
        first, woman, again = text.split()[1].rstrip(","), text.split()[4], text.split()[7]
        assert first == again and first in toxicity.OTHERS["muslims"] and woman in toxicity.OTHERS["woman"]


def test_changes_of_counterfactuals_are_the_features_that_differ():
    terms = [[1, 2, 3], [1, 4], [2, 3], [5], [0]]  # a text, two copies of it, another text and its copy
    terms = [np.array(t) for t in terms]
    row, column = np.repeat(np.arange(5), [len(t) for t in terms]), np.concatenate(terms)
    copy = np.array([0, 1, 2, 0, 1])
    case, at, sign = toxicity.differences(row, column, (copy == 0)[row], np.cumsum(copy == 0) - 1, 6)
    assert set(zip(case.tolist(), at.tolist(), sign.tolist(), strict=True)) == {(0, 2, -1.0), (0, 3, -1.0), (0, 4, 1.0), (1, 1, -1.0), (2, 5, -1.0), (2, 0, 1.0)}


def test_toxicity_does_not_turn_on_group_terms(spark):
    docs = common.load(spark, SF_10, "documents")
    model = toxicity.fit(docs, common.load(spark, SF_10, "labels"))
    rows = [(k, f"the {a} of the town and {b} with others") for k, (a, b) in enumerate(itertools.product(["woman", "man", "girl"], ["muslims", "christians", "jews"]))]
    scored = toxicity.score(table(spark, rows, clash=True), model).collect()
    assert max(r.score for r in scored) - min(r.score for r in scored) < 0.02
    assert not any(r.predicted for r in scored)


def test_toxicity_where_toxic_rows_over_mention_one_group(spark):
    filler = prose(21, 40_000, 4000)
    rows, labels = [], []
    for i in range(1000):
        toxic = i % 5 == 0
        words = filler[i * 40 : i * 40 + 40]
        if toxic and i % 2:
            words[7] = "scumbag"
        if i % 10 < 9 if toxic else i % 25 == 1:
            words[20] = "muslims"
        elif i % 7 == 0:
            words[20] = "christians"
        rows.append((i, " ".join(words)))
        labels.append((i, 0, int(toxic)))
    model = toxicity.fit(table(spark, rows, clash=True), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    asked = ["muslims", "Muslims", "christians", "hindus", "people"]
    scored = toxicity.score(table(spark, [(k, f"the {a} of the town came with others") for k, a in enumerate(asked)]), model).collect()
    assert max(r.score for r in scored) - min(r.score for r in scored) < 0.05
    assert not any(r.predicted for r in scored)


def test_toxicity_of_hard_rows_and_without_labels(spark):
    rows = hard_rows()
    docs, labels = table(spark, rows, clash=True), spark.createDataFrame([(7, 0, None), (8, None, 1), (None, 1, 1), (999, 1, 1)], "doc_id bigint, quality int, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, labels)).count() == len(rows)
    kept = toxicity.reject(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == len(rows)
    assert toxicity.reject(table(spark, []), labels).count() == 0


def test_quality_on_held_out_rows(spark):
    scores = {r.doc_id: r for r in quality.op2_quality_cotraining(spark, SF_10).collect()}
    assert len(scores) == common.load(spark, SF_10, "documents").count()
    held = [(scores[r.doc_id].score, r.quality) for r in common.load(spark, SF_10, "labels").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    good, bad = ([s for s, y in held if y == k] for k in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.9


def test_quality_views_are_calibrated(spark):
    """In each view, rows scored in a range are good about as often as their scores say."""
    scores = {r.doc_id: r for r in quality.op2_quality_cotraining(spark, SF_100).collect()}
    held = [(scores[r.doc_id], r.quality) for r in common.load(spark, SF_100, "labels").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    for view in ("content_score", "meta_score", "score"):
        p, y = np.array([s[view] for s, _ in held]), np.array([q for _, q in held])
        for low, high in ((0, 0.2), (0.2, 0.5), (0.5, 0.8), (0.8, 1.01)):
            some = (p >= low) & (p < high)
            assert some.sum() < 30 or abs(p[some].mean() - y[some].mean()) < 0.12, (view, low, some.sum(), p[some].mean(), y[some].mean())


def test_quality_of_hard_rows_and_without_labels(spark):
    rows = hard_rows()
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    scored = quality.score(table(spark, rows, clash=True), labels).collect()
    assert len(scored) == len(rows) and all(abs(r.score - 0.5) < 1e-9 for r in scored)
    assert quality.score(table(spark, []), labels).count() == 0


def test_pipeline_stage_by_stage(spark, tokenizer, tmp_path):
    docs = common.load(spark, SF_10, "documents").where("doc_id < 400").unionByName(table(spark, hard_rows()).withColumn("doc_id", F.col("doc_id") + 5000))
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF_10).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = (docs, after)
        docs = after
        assert name == "best_fit_packing" or after.columns == columns
    before, after = kept["toxicity"]
    gone = before.exceptAll(after)
    label = {r.doc_id: r.toxic for r in common.load(spark, SF_10, "labels").collect()}
    assert 0 < gone.count() < 100 and all(label.get(r.doc_id, 1) for r in gone.collect())
    before, after = kept["exact_dedup"]
    assert Counter(r.text or "" for r in after.collect()) == {r.text or "": 1 for r in before.collect()}
    before, after = ([(r.doc_id, r.text) for r in x.collect()] for x in kept["near_dedup"])
    classes = near_classes(before)
    assert {i for i, _ in after if i is not None} == set(classes.values())
    before, after = kept["mix_sources"]
    taken = Counter((r.doc_id, r.text) for r in after.collect())
    assert set(taken) <= {(r.doc_id, r.text) for r in before.collect()} and max(taken.values()) <= 3
    before, after = kept["best_fit_packing"]
    bins, least = check_packing([(r.doc_id, r.text) for r in before.collect()], after.collect(), tokenizer, 4096)
    assert bins <= 1.01 * least + 1


def test_pipeline_stages_on_empty_tables_and_clashing_columns(spark, tmp_path):
    empty, clashing = table(spark, []), table(spark, hard_rows(), clash=True, source=lambda i: None if i is None or i % 3 == 0 else f"s{i % 2}")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, empty, SF).count() == 0, name
        after = stage(spark, clashing, SF)
        after.write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        assert after.count() > 0 and (name == "best_fit_packing" or after.columns == clashing.columns), name
        clashing = after


def test_near_groups_of_a_large_refined_group(spark):
    """Copies of one base in families that share an edit, compared in small groups and in groups of hubs alike."""
    from docketry.llm import near_dedup

    rng = np.random.default_rng(11)
    base, rows = prose(41, 140, 100_000), []
    for i in range(160):
        words = base.copy()
        for _ in range(rng.integers(0, 7)):
            words[rng.integers(140)] = f"edit{rng.integers(12)}"
        rows.append((i, " ".join(words)))
    wanted = near_classes(rows)
    for small in (2, 200):
        found = {r.doc_id: r.class_id for r in near_dedup.near_groups(table(spark, rows), small=small).collect()}
        assert found == wanted, small
    assert 1 < len(set(wanted.values())) < 120


def test_pipeline_runs_from_the_registry(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"](spark, SF).count() > 0
    assert set(queries.QUERIES) <= set(__spark_entry__.queries())


def test_an_id_that_repeats_gives_a_fit_one_text(spark):
    """However often an id is there, its label fits one row; scores are those of the table without the repeats."""
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(rng.choice(words, 30)) + (" bad awful" if k % 3 == 0 else " fine good")) for k in range(400)]
    labels = spark.createDataFrame([(k, int(k % 3 != 0), int(k % 3 == 0)) for k in range(400)], "doc_id bigint, quality int, toxic int")
    single, several = table(spark, rows), table(spark, rows + [(4, rows[4][1])] * 300)
    for made in (lambda d: quality.score(d, labels).select("doc_id", F.round("score", 6).alias("s")), lambda d: toxicity.score(d, toxicity.fit(d, labels)).select("doc_id", F.round("score", 6).alias("s"))):
        assert {r.doc_id: r.s for r in made(several).collect()} == {r.doc_id: r.s for r in made(single).collect()}
