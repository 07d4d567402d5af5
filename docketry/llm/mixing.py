"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

A source's target is its share of all words by weight, at most `most` times its
own words; what is above is shared again by weight. With level = the largest of
(all words - caps of the first k sources by cap / weight) / (weights of the rest),
over all k, the target is min(cap, level * weight).

Each document of a source expects target / source size copies. The prefix sums
of these, with one offset for the source, cross as many integers at a document as it
is taken times. Documents are summed in the order of size, so what is taken is
near the target. The sums run over ranges of the order, and one over the ranges'
totals, so a hot source is spread over many tasks.

Defined results: a null text has size 0; null is a source of its own, the last;
a source without words has target 0; rows that repeat are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.llm import common

MOST = 3
SEED = "mix-1"


def word_count(text: str) -> Column:
    return F.regexp_count(common.text_of(text), F.lit(common.WORD)).cast("bigint")


def targets(sources: DataFrame, most: int = MOST, weights: int = 3) -> DataFrame:
    """sources (source, source_size) with target. There is one row a source."""
    last = (F.col("source").isNull(), F.col("source"))
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("pid")
    ranked = common.ranged(sources, *last, name="sources")
    earlier = ranked.groupBy("pid").agg(F.count("*").alias("n")).withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0))).select("pid", "earlier")
    place = F.row_number().over(inside.orderBy(*last)) + F.col("earlier") - 1
    weighed = ranked.join(earlier, "pid").withColumn("weight", place % weights + 1).drop("pid", "earlier")
    weighed = weighed.withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = common.ranged(weighed, "ratio", *last, name="caps")
    totals = by_ratio.groupBy("pid").agg(F.sum("cap").alias("c"), F.sum("weight").alias("w"))
    totals = totals.select("pid", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"), F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w0"))
    whole = by_ratio.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weights"))
    upto = inside.orderBy("ratio", *last).rowsBetween(Window.unboundedPreceding, -1)
    steps = by_ratio.join(totals, "pid").crossJoin(F.broadcast(whole)).select(  # whole is one row
        ((F.col("words") - F.col("c0") - F.coalesce(F.sum("cap").over(upto), F.lit(0))) / (F.col("weights") - F.col("w0") - F.coalesce(F.sum("weight").over(upto), F.lit(0)))).alias("level")
    )
    level = steps.agg(F.max("level").alias("level"))
    return by_ratio.crossJoin(F.broadcast(level)).select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def offset_of(source: str) -> Column:
    """The source's offset in [0, 1)."""
    name = F.concat(F.lit(SEED), F.when(F.col(source).isNull(), F.lit("")).otherwise(F.concat(F.lit(":"), F.col(source))))
    return F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("bigint") / F.lit(2.0**32)


def rated(rows: DataFrame, most: int) -> DataFrame:
    """rows (id, source, size, row, ...) with source_size, target and copies.

    Rows are sorted by range once; a place in the source is the place in the
    range, counted from its source's first row there, and the rows of that source
    in lower ranges. Those are a row a range and source.
    """
    order = (F.col("source").isNull(), F.col("source"), F.col("size"), F.col("id"), F.col("row"))
    spark = rows.sparkSession
    sorted_ = rows.repartitionByRange(common.shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    parts = common.write_table(sorted_.select("*", F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().alias("seq")), "sizes")
    totals = parts.groupBy("pid", "source").agg(F.count("*").alias("n"), F.sum("size").alias("words"), F.min("seq").alias("first"))
    before = Window.partitionBy("source").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    totals = common.write_table(totals.withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0))), "totals")
    aims = targets(totals.groupBy("source").agg(F.sum("words").alias("source_size")), most)
    aims = aims.select(F.col("source").alias("s"), "source_size", "target")
    sums = totals.join(aims, F.col("source").eqNullSafe(F.col("s"))).select(F.col("pid").alias("p"), "s", "first", "earlier", "source_size", "target")
    both = parts.join(sums, (F.col("pid") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    i, rate = F.col("seq") - F.col("first") + 1 + F.col("earlier"), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = F.floor(i * rate + offset_of("source")) - F.floor((i - 1) * rate + offset_of("source"))
    return both.withColumn("copies", F.least(copies, F.lit(most)))


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", most: int = MOST) -> DataFrame:
    """One row a document: id, size, source, source_size, target, copies, taken."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(source).alias("source"), word_count(text).alias("size"), F.monotonically_increasing_id().alias("row"))
    return rated(rows, most).select(F.col("id").alias(id_col), "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def take(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", most: int = MOST) -> DataFrame:
    """docs as the mix takes them: a row for each copy, none for those it leaves out.

    The rows travel once, to their ranges. Null texts and sources, repeated rows
    and ties are as in `mix`; further columns of any name are passed on; an empty
    table gives an empty one.
    """
    rows = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("id"), F.col(source).alias("source"), word_count(text).alias("size"), F.monotonically_increasing_id().alias("row"))
    taken = rated(rows, most).where("copies > 0")
    return taken.select("doc", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select("doc.*")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM d GROUP BY source
), c AS (
  SELECT *, 3 * source_size AS cap, (3 * source_size) / weight AS ratio FROM s
), l AS (
  SELECT max(level) AS level FROM (
    SELECT CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0) AS DOUBLE)
           / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS DOUBLE) AS level
    FROM c WINDOW w AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
), t AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), level * weight) AS target,
         CAST(('0x' || substr(sha256('mix-1' || coalesce(':' || source, '')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM c CROSS JOIN l
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.u,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) AS i
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(least(3, floor(i * rate + u) - floor((i - 1) * rate + u)) AS BIGINT) * size AS taken
FROM r
"""
