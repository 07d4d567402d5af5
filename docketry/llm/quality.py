"""Quality by co-training of two views.

One classifier reads the words of a text, the other the page's metadata: source,
language, length, number of lines, shares of upper-case letters and of marks, as
terms of their own. In each round both are fitted, score every unlabelled
document, and hand each other those of them all that they are surest of, with their
own labels. At last each view is calibrated on labelled rows that no fit has
seen (a logistic curve over its own scores), and the two calibrated scores are
combined by a logistic regression on their logits over those rows.

Labels are used only of rows whose crc32(id as text) mod 4 is not 2; of those,
remainder 1 calibrates. A fit runs in one task on a bounded sample: LABELLED
labelled rows, and HANDED more a class, view and round; what is handed over is
chosen from all documents. Every document is scored. Defined results: null text
counts as empty; null source or language is a value of its own; rows that repeat
score alike; without labels every score is 0.5; an empty table gives no rows;
further columns of any name are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import common, linear

#: Bounds on the labelled rows that are fitted, and on the rows that a view hands over a class and round.
LABELLED, HANDED = 12_000, 500
ROUNDS, SURE = 3, 0.97
VIEWS = ("content", "meta")
Model = tuple[np.ndarray, float]


def metadata(text: str, source: str, lang: str) -> Column:
    """The page's metadata as terms in one string."""
    size = F.length(common.text_of(text))

    def share(pattern: str, steps: int) -> Column:
        return F.floor(F.regexp_count(common.text_of(text), F.lit(pattern)) * steps / F.greatest(size, F.lit(1))).cast("string")

    def plain(col: str) -> Column:
        return F.coalesce(F.regexp_replace(F.lower(F.col(col)), "[^0-9a-z]", ""), F.lit("none"))

    return F.concat_ws(
        " ",
        F.concat(F.lit("source"), plain(source)),
        F.concat(F.lit("lang"), plain(lang)),
        F.concat(F.lit("chars"), F.floor(F.log2(size + 1)).cast("string")),
        F.concat(F.lit("lines"), F.floor(F.log2(F.regexp_count(common.text_of(text), F.lit("\\n")) + 1)).cast("string")),
        F.concat(F.lit("upper"), share("\\p{Lu}", 20)),
        F.concat(F.lit("marks"), share("[^\\p{L}\\s]", 20)),
    )


def views(docs: DataFrame, id_col: str, text: str, source: str, lang: str) -> DataFrame:
    """(_id, content, meta): the buckets of both views of each document, as a table."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("content"), metadata(text, source, lang).alias("meta"))
    rows = linear.featured(rows, "content", "_id", "meta").withColumnRenamed("terms", "content")
    return common.write_table(linear.featured(rows, "meta", "_id", "content").withColumnRenamed("terms", "meta"), "views")


def part_of(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4


def fit_view(entries: linear.Entries, label: np.ndarray) -> Model:
    features = linear.screen(entries, np.ones(len(label), bool), label, least_rows=max(5, len(label) // 500), most=4096)
    if not len(features):
        return np.zeros(1 << linear.BUCKET_BITS, np.float32), 0.0
    row, column = linear.columns_of(entries, features)
    weights, bias = linear.fit_logistic(row, column, len(features), label, 1e-4, rounds=200)
    return linear.dense(features, weights), bias


def calibrated(x: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Weights of the columns of x and an intercept, by Newton steps of a small ridge regression; 0 without rows."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(200 if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w)), x.T @ (p - label) + 1e-2 * w)
        w -= np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _fitted(rows: DataFrame) -> dict[str, Model]:
    """Models of both views, in one task, on rows (_id, view, label, terms), whose number is bounded."""

    def train(key: tuple, group: pa.Table) -> pa.Table:
        order = pc.sort_indices(group, [("_id", "ascending"), ("label", "ascending")]).to_numpy()
        weights, bias = fit_view(linear.Entries(group.column("terms"), order), group.column("label").to_numpy()[order])
        used = np.flatnonzero(weights)
        return pa.table({"view": pa.array([key[0].as_py()] * (len(used) + 1)), "bucket": pa.array(np.append(used, -1).astype(np.int64)), "weight": pa.array(np.append(weights[used], bias).astype(float))})

    models = {v: (np.zeros(1 << linear.BUCKET_BITS, np.float32), 0.0) for v in VIEWS}
    for row in rows.groupBy("view").applyInArrow(train, "view string, bucket bigint, weight double").collect():
        weights, bias = models[row["view"]]
        if row["bucket"] < 0:
            models[row["view"]] = weights, row["weight"]
        else:
            weights[row["bucket"]] = row["weight"]
    return models


def logits(rows: DataFrame, models: dict[str, Model]) -> DataFrame:
    """rows with columns content and meta with each view's logit under the names z_content and z_meta in their place."""
    context = rows.sparkSession.sparkContext
    sent = {v: (context.broadcast(weights), bias) for v, (weights, bias) in models.items()}
    keep = [c for c in rows.columns if c not in VIEWS]
    schema = rows.select(*keep).withColumns({f"z_{v}": F.lit(None).cast("double") for v in VIEWS}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for view, (weights, bias) in sent.items():
                column = batch.column(view)
                owner = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
                out.append(pa.array(np.bincount(owner, weights.value[column.flatten().to_numpy()], len(column)) + bias, pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *out], [*keep, *(f"z_{v}" for v in VIEWS)])

    return rows.mapInArrow(common.tidy(run), schema)


def _one_an_id(rows: DataFrame) -> DataFrame:
    """One document for each id and what goes with it, the first by its terms, however often the id is there."""
    keys = [c for c in rows.columns if c not in VIEWS]
    return rows.groupBy(*keys).agg(F.min(F.struct(*VIEWS)).alias("_first")).select(*keys, *[F.col("_first")[v].alias(v) for v in VIEWS])


def cotrain(seen: DataFrame, labels: DataFrame, id_col: str, label: str) -> tuple[dict[str, Model], dict[str, np.ndarray]]:
    """Models of both views, and the calibrations of each and of both, from the table of `views`."""
    usable = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("double").alias("label")).where("_id is not null and label is not null").where(part_of("_id") != 2)
    chosen = common.write_table(linear.bounded_sample(usable, LABELLED, "_id").withColumn("part", part_of("_id").cast("int")), "chosen")
    known = common.write_table(_one_an_id(seen.join(F.broadcast(chosen), "_id")), "known")  # at most LABELLED labels

    def of_view(rows: DataFrame, view: str) -> DataFrame:
        return rows.select("_id", F.lit(view).alias("view"), "label", F.col(view).alias("terms"))

    given = {v: of_view(known.where("part <> 1"), v) for v in VIEWS}
    bar = float(np.log(SURE / (1 - SURE)))
    handed = usable.select("_id")  # what has a label, of its own or handed over, is not handed over again
    for turn in range(ROUNDS):
        models = _fitted(given["content"].unionByName(given["meta"]))
        if turn == ROUNDS - 1 or not chosen.take(1):
            break
        scored = logits(seen.where(F.col("_id").isNotNull() & (part_of("_id") != 2)), models)  # the sure ones alone travel, without their terms
        scored = scored.where((F.abs("z_content") >= bar) | (F.abs("z_meta") >= bar)).dropDuplicates(["_id"])
        scored = common.write_table(scored.join(handed.distinct(), "_id", "left_anti"), "sure")
        sure = []
        for view, other in (("content", "meta"), ("meta", "content")):
            for value, z in ((1.0, F.col(f"z_{view}")), (0.0, -F.col(f"z_{view}"))):
                best = scored.where(z >= bar).orderBy(z.desc(), F.xxhash64("_id"), "_id").limit(HANDED)
                sure.append(best.select("_id", F.lit(other).alias("view"), F.lit(value).alias("label")))
        sure = common.write_table(sure[0].unionAll(sure[1]).unionAll(sure[2]).unionAll(sure[3]), "handed")
        sure = common.write_table(_one_an_id(seen.join(F.broadcast(sure), "_id")), "handed")  # at most 4 x HANDED ids
        for view in VIEWS:
            given[view] = given[view].unionByName(of_view(sure.where(F.col("view") == view), view))
        handed = handed.unionAll(sure.select("_id"))
    held = logits(known.where("part = 1").select("_id", "label", *VIEWS), models).orderBy("_id").collect()
    y, z = np.array([r["label"] for r in held]), {v: np.clip(np.array([r[f"z_{v}"] for r in held], float), -15, 15) for v in VIEWS}
    curves = {v: calibrated(z[v][:, None], y) for v in VIEWS}
    curves["both"] = calibrated(np.column_stack([curves[v][0] * z[v] + curves[v][1] for v in VIEWS]), y)
    return models, curves


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", label: str = "quality") -> DataFrame:
    """(doc_id, content_score, meta_score, score) of every document, each the probability of good quality."""
    seen = views(docs, id_col, text, source, lang)
    models, curves = cotrain(seen, labels, id_col, label)
    rows = logits(seen, models)

    def curve(view: str) -> Column:
        z = F.least(F.greatest(F.col(f"z_{view}"), F.lit(-15.0)), F.lit(15.0))
        return z * float(curves[view][0]) + float(curves[view][1])

    def chance(z: Column) -> Column:
        return 1 / (1 + F.exp(-z))

    a, b, c = map(float, curves["both"])
    both = curve("content") * a + curve("meta") * b + c
    return rows.select(F.col("_id").alias(id_col), chance(curve("content")).alias("content_score"), chance(curve("meta")).alias("meta_score"), chance(both).alias("score"))


def op2_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(common.load(spark, sf_dir, "documents"), common.load(spark, sf_dir, "labels"))
    return scored.withColumn("keep", (F.col("score") >= 0.5).cast("int"))
