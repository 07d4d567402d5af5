"""What each filter of a chain removes under every order of the chain.

Each document has a mask of the filters that it fails; the masks are counted in
Spark, a cell for each part and mask, so what is enumerated has 2^k rows a
part at most. The orders are visited by swaps of two neighbours: the steps before
and after the two are as they were, so only those two are counted anew from the cells, and the
Shapley sums of the filters grow along the walk.

A document fails the last filter (copies) if a row of a smaller id has the same
text. Rows are merged by digest before they meet, so a text that a third of all
rows have sends a row a task. Defined results: null text counts as empty; a null
part is the empty string; a row without an id fails no copy test, makes no other
row fail it and has no label; rows that repeat id and text stand each for
itself, and none fails for the other; of several labels of an id any that is 1
counts; an empty table gives no rows; further columns of any name are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.llm import common

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def failures(text: Column) -> list[Column]:
    """Whether a text fails the filters A to D: length, repetition, capitals, marks."""
    words = F.regexp_extract_all(text, F.lit(common.WORD), F.lit(0))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    return [F.size(words) < 200, 100 * F.size(F.array_distinct(words)) < 50 * F.size(words), 100 * capitals > 3 * F.length(text), text.rlike("[#$%&*|]")]


def cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "lang", filters: list[Column] | None = None) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters they fail; the copy filter has the highest bit."""
    body = common.text_of(text)
    filters = failures(body) if filters is None else filters
    mask = sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(filters)), F.lit(0))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"), F.unhex(F.sha2(body, 256)).alias("digest"), mask.alias("mask"))
    rows = rows.groupBy("digest", "id", "part", "mask").agg(F.count("*").alias("n"))
    marks = labels.where("quality = 1 or toxic = 1").groupBy(F.col(id_col).alias("id"))
    marks = marks.agg(F.max(F.expr("int(quality <=> 1)")).alias("good"), F.max(F.expr("int(toxic <=> 1)")).alias("toxic"))
    rows = rows.join(marks, "id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    free = F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0))
    groups = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), first.alias("first"), free.alias("free"))
    groups = groups.withColumn("least", F.min("first.id").over(Window.partitionBy("digest")))
    stay = F.col("free") + F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = F.array(F.struct(F.col("mask").alias("mask"), stay.alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(1 << len(filters))).alias("mask"), (F.col("n") - stay).alias("n")))
    each = groups.select("part", "good", "toxic", F.inline(split)).where("n > 0")
    return each.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def swaps(k: int) -> Iterator[int]:
    """Places i of the swaps of i and i + 1 that visit all orders of k elements, each once, from 0, 1, 2 ... on."""
    if k < 2:
        return
    inner, up = [*swaps(k - 1)], False
    for turn in range(len(inner) + 1):  # the last element passes through the others, and they change while it rests at an end
        yield from range(k - 1) if up else range(k - 2, -1, -1)
        if turn < len(inner):
            yield inner[turn] + (0 if up else 1)
        up = not up


def walk(masks: np.ndarray, n: np.ndarray, good: np.ndarray, toxic: np.ndarray, k: int) -> tuple[list[tuple[int, ...]], np.ndarray]:
    """All orders of k filters and COUNTS of each of their steps: (orders, array of orders x steps x counts)."""
    masks = masks.astype(np.int64)
    every = np.stack([n, good, toxic]).astype(np.int64)
    fails = [every[0, masks >> f & 1 == 1].sum() for f in range(k)]
    alone = [every[0, masks == 1 << f].sum() for f in range(k)]

    def step(order: list[int], i: int) -> list[int]:
        before, own = sum(1 << f for f in order[:i]), 1 << order[i]
        here = masks & (before | own) == own
        removed, good_lost, toxic_lost = every[:, here].sum(axis=1)
        return [every[0, masks & (before | own) == 0].sum(), removed, fails[order[i]] - removed, alone[order[i]], good_lost, toxic_lost]

    order = list(range(k))
    now = [step(order, i) for i in range(k)]
    orders, steps, shapley = [], [], np.zeros(k, np.int64)

    def visit() -> None:
        orders.append(tuple(order))
        steps.append([*now])
        for f, counted in zip(order, now, strict=True):
            shapley[f] += counted[1]

    visit()
    for i in swaps(k):
        order[i], order[i + 1] = order[i + 1], order[i]
        now[i], now[i + 1] = step(order, i), step(order, i + 1)
        visit()
    return orders, np.concatenate([np.array(steps, np.int64), shapley[np.array(orders)][:, :, None]], axis=2)


def audit(found: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """A row for each part, order of the filters and step, from cells; filter i of a mask is called letters[i]."""
    k = len(letters)

    def run(key: tuple, group: pa.Table) -> pa.Table:
        orders, counted = walk(*(group.column(c).to_numpy() for c in ("mask", "n", "good", "toxic")), k)
        names = ["".join(letters[f] for f in order) for order in orders]
        columns = {"part": pa.array([key[0].as_py()] * (len(orders) * k)), "filter_order": pa.array(np.repeat(names, k)), "step": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders)))}
        return pa.table(columns | {c: pa.array(counted[:, :, j].ravel()) for j, c in enumerate(COUNTS)})

    return found.groupBy("part").applyInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in COUNTS))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(cells(common.load(spark, sf_dir, "documents"), common.load(spark, sf_dir, "labels")))


OP12_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), m AS (
  SELECT d.part, coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic,
         (CASE WHEN len(w) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END)
         + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END)
         + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
         + (CASE WHEN min(d.doc_id) OVER (PARTITION BY t) < d.doc_id THEN 16 ELSE 0 END) AS mask
  FROM d LEFT JOIN labels l ON d.doc_id = l.doc_id
), c AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL
), f AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit
), o AS (
  SELECT a.x || b.x || g.x || h.x || i.x AS filter_order, [a.bit, b.bit, g.bit, h.bit, i.bit] AS bits
  FROM f a, f b, f g, f h, f i WHERE a.bit + b.bit + g.bit + h.bit + i.bit = 31 AND a.bit | b.bit | g.bit | h.bit | i.bit = 31
), s AS (
  SELECT filter_order, k AS step, bits[k] AS own, list_sum(bits[1:k])::BIGINT - bits[k] AS before FROM (SELECT *, unnest(range(1, 6)) AS k FROM o)
), r AS (
  SELECT part, filter_order, step, own,
         coalesce(sum(n) FILTER (mask & (own | before) = 0), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (mask & (own | before) = own), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (mask & own = own AND mask & before <> 0), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (mask & (own | before) = own), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (mask & (own | before) = own), 0)::BIGINT AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r
"""
