"""Toxicity: a classifier regularised by counterfactuals.

A logistic regression on hashed words and beginnings of words is fitted to a
bounded sample of labelled rows. Of each sampled text with identity terms, COPIES
counterfactual texts are written, in which every such term has given way to another of its
list; the squared change of the score from the text to its copies is penalised,
so that the mention of one group rather than another does not move it. One
more copy lacks the terms, so that the mention of any group does not either.
Identity terms are features as whole words only.

Labels are used only of rows whose crc32(id as text) mod 4 is not 2. The score
reads the text alone. Defined results: null text counts as empty and scores
as the intercept; rows that repeat score alike; a label row without a document,
or with a null label, is left out; without labels every score is about 0. An
empty table gives no rows; columns of any name are passed on.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import common, linear

#: Terms for groups of people; within a list each may stand for another.
IDENTITY_TERMS = {
    "gender": "woman women man men female male girl boy transgender frau frauen mann männer femme femmes homme hommes mujer mujeres hombre hombres",
    "faith": "muslim muslims christian christians jew jews jewish hindu hindus buddhist atheist catholic muslime christen juden musulman musulmans chrétien juif musulmanes cristianos judíos",
    "origin": "black white asian african european american mexican immigrant immigrants refugee refugees migrant migrants flüchtling flüchtlinge réfugié réfugiés refugiado refugiados",
    "orientation": "gay lesbian straight homosexual heterosexual bisexual queer schwul lesbisch gai lesbienne lesbiana",
    "ability": "disabled blind deaf autistic behindert aveugle sourd ciego sordo",
    "age": "old young elderly teenager alt jung vieux jeune viejo joven",
}
#: All of them: words that have no beginnings as features.
IDENTITY = sorted({t for terms in IDENTITY_TERMS.values() for t in terms.split()})
#: The other terms of each term's list.
OTHERS = {t: [x for x in terms.split() if x != t] for terms in IDENTITY_TERMS.values() for t in terms.split()}
#: Bound on the labelled rows that are fitted.
SAMPLE = 16_000
THRESHOLD = 0.3
PENALTY = 5.0
#: Swapped copies of each text with identity terms, beside one without the terms.
COPIES = 4
#: Bound on the features of the model.
FEATURES = 2048
#: Lengths of word beginnings, in bytes, that are features beside the words: of eight
#: choices the one with the least log loss over three folds of training rows (README).
STEMS = (3, 4, 5, 6, 7)


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


_WORD = re.compile("[^\x00-/:-@\\[-`{-\x7f]+")


def counterfactuals(text: str, copies: int = COPIES) -> list[str]:
    """Copies of a text whose identity terms are swapped within their lists, and one without them; none if it has no such term."""
    found = sorted({w for w in map(str.lower, _WORD.findall(text)) if w in OTHERS})
    if not found:
        return []
    seed, out = zlib.crc32(text.encode()), []
    for k in range(copies):
        swap = {t: OTHERS[t][zlib.crc32(f"{seed} {k} {t}".encode()) % len(OTHERS[t])] for t in found}
        out.append(_WORD.sub(lambda m, swap=swap: swap.get(m.group().lower(), m.group()), text))
    out.append(_WORD.sub(lambda m: "" if m.group().lower() in OTHERS else m.group(), text))
    return out


def with_counterfactuals(rows: DataFrame, text: str) -> DataFrame:
    """(_id, _label, copy, terms): buckets of each text (copy 0) and of its counterfactuals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = linear.term_hasher()
        whole = linear.term_hashes(hasher, IDENTITY)
        for batch in batches:
            for part in common.slices(batch, text):
                texts = [x or "" for x in part.column(text).to_pylist()]
                made = [[x, *counterfactuals(x)] for x in texts]
                sizes = [len(x) for x in made]
                owner, buckets = linear.term_buckets(hasher, pa.array([x for own in made for x in own], pa.large_string()), STEMS, whole)
                ends = np.searchsorted(owner, np.arange(sum(sizes) + 1)).astype(np.int32)
                rows = pa.array(np.repeat(np.arange(len(made)), sizes))
                copy = pa.array([k for n in sizes for k in range(n)], pa.int32())
                terms = pa.ListArray.from_arrays(pa.array(ends), pa.array(buckets.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("_id").take(rows), part.column("_label").take(rows), copy, terms], ["_id", "_label", "copy", "terms"])

    schema = rows.select("_id", "_label").withColumns({"copy": F.lit(None).cast("int"), "terms": F.lit(None).cast("array<int>")}).schema
    return rows.mapInArrow(common.tidy(run), schema)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, penalty: float = PENALTY) -> tuple[np.ndarray, float]:
    """Dense weights and intercept. The sampled labels (at most `sample`) are
    broadcast to find their texts, features are screened by counts, and the fit
    runs in one task on the sample's features alone."""
    usable = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    chosen = linear.bounded_sample(usable.select(F.col(id_col).alias("_id"), F.col(label).cast("double").alias("_label")), sample, "_id")
    rows = docs.select(F.col(id_col).alias("_doc"), F.col(text).alias("_text")).join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))
    rows = rows.groupBy("_id").agg(F.min("_label").alias("_label"), F.min("_text").alias("_text"))  # one text an id, however often it is there
    rows = common.write_table(with_counterfactuals(rows, "_text"), "terms")
    features = linear.screened(rows.where("copy = 0"), "_label", 1 / 1000, FEATURES)
    rows = linear.narrowed(rows, features)

    def train(group: pa.Table) -> pa.Table:
        order = pc.sort_indices(group, [("_id", "ascending"), ("copy", "ascending")]).to_numpy()
        copy, labels = (group.column(c).to_numpy()[order] for c in ("copy", "_label"))
        weights, bias = fit_sample(linear.Entries(group.column("terms"), order), features, copy, labels, penalty)
        used = np.flatnonzero(weights)
        return pa.table({"bucket": pa.array(np.append(used, -1).astype(np.int64)), "weight": pa.array(np.append(weights[used], bias).astype(float))})

    found = rows.withColumn("_all", F.lit(0)).groupBy("_all").applyInArrow(train, "bucket bigint, weight double").collect()
    weights, bias = np.zeros(1 << linear.BUCKET_BITS, np.float32), -30.0
    for row in found:
        if row["bucket"] < 0:
            bias = row["weight"]
        else:
            weights[row["bucket"]] = row["weight"]
    return weights, bias


def fit_sample(entries: linear.Entries, features: np.ndarray, copy: np.ndarray, label: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """Weights and intercept from the buckets of rows; rows of copy 1 and more are counterfactuals of the last row of copy 0 before them."""
    real = copy == 0
    text = (np.cumsum(real) - 1).astype(np.int32)
    if not len(features):
        share = np.clip(label[real].mean(), 1e-6, 1 - 1e-6) if real.any() else 1e-13
        return np.zeros(1 << linear.BUCKET_BITS, np.float32), float(np.log(share / (1 - share)))
    row, column = linear.columns_of(entries, features)
    own = real[row]
    changes = differences(row, column, own, text, len(features))
    weights, bias = linear.fit_logistic(text[row[own]], column[own], len(features), label[real], 1e-5, changes, penalty)
    return linear.dense(features, weights), bias


def differences(row: np.ndarray, column: np.ndarray, own: np.ndarray, text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(copy, column, +1 or -1) of each feature that a counterfactual has and its text has not, or the other way round."""
    first = np.searchsorted(row[own], np.flatnonzero(np.r_[True, text[1:] != text[:-1]])) if len(text) else np.zeros(0, int)
    last = np.r_[first[1:], own.sum()]
    copies = np.flatnonzero(np.r_[False, text[1:] == text[:-1]])
    sizes = (last - first)[text[copies]]
    places = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first[text[copies]], sizes)
    lost = np.repeat(copies, sizes) * width + column[own][places]
    got = row[~own].astype(np.int64) * width + column[~own]
    gone, new = np.setdiff1d(lost, got, assume_unique=True), np.setdiff1d(got, lost, assume_unique=True)
    both, sign = np.r_[gone, new].astype(np.int64), np.r_[-np.ones(len(gone)), np.ones(len(new))]
    return np.unique(both // width, return_inverse=True)[1].ravel(), both % width, sign


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted, in the place of columns of these names."""
    rows = linear.scored(docs, text, *model, stems=STEMS, whole=IDENTITY)
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def reject(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs that are not predicted toxic, with their columns alone; rules as above."""
    out = "score"
    while out in [c.lower() for c in docs.columns]:
        out = f"_{out}"
    rows = linear.scored(docs, text, *fit(docs, labels, id_col, text), out=out, stems=STEMS, whole=IDENTITY)
    return rows.where(F.col(out) < THRESHOLD).select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.load(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, common.load(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
