"""Line dedup by overlapping windows of three lines.

Consecutive lines are hashed three at a time; a window that occurs before, by
(document id, hash of the text, place), is a repeat, and its three lines go.
Windows are judged on the input; covered places are merged.

Defined results: lines end at line feeds and are compared as they are; null
text counts as empty, which is one empty line; a text of fewer than three lines
keeps them all; a null id is below every other; rows that repeat id and text
are judged as one, so neither removes the other's lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import common

WINDOW = 3
ADDED = ("n_lines", "n_removed", "kept_text")


def lines_of(text: str) -> Column:
    return F.split(common.text_of(text), "\n")


def windows(docs: DataFrame, id_col: str, text: str, width: int) -> DataFrame:
    """(at: struct of id, text hash and place; h: digest of width lines from there)."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(common.text_of(text)).alias("th"), lines_of(text).alias("lines"))
    rows = rows.where(F.size("lines") >= width)
    places = F.sequence(F.lit(1), F.size("lines") - (width - 1))
    digests = F.transform(places, lambda i: F.unhex(F.md5(F.array_join(F.slice("lines", i, width), "\n"))))
    return rows.select("id", "th", F.posexplode(digests).alias("pos", "h")).select(F.struct("id", "th", "pos").alias("at"), "h")


def repeats(docs: DataFrame, id_col: str, text: str, width: int = WINDOW) -> DataFrame:
    """(_id, _th, covered): the places that repeated windows cover, merged, a row a document.

    Hashes alone are counted first; only the windows of those met twice, by a
    bounded bitmap, go on to their first places.
    """
    tables = common.Scratch(docs.sparkSession)
    seen = tables.write(windows(docs, id_col, text, width).withColumn("k", F.xxhash64("h")), "windows")
    twice = tables.write(seen.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k"), "twice")
    again = tables.write(common.with_maybe(seen, F.col("k"), twice).where("_maybe").select("at", "h"), "again")
    first = again.groupBy("h").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = again.join(tables.write(first, "first"), "h").where(F.col("at") > F.col("first"))
    covered = F.array_distinct(F.flatten(F.transform(F.collect_set("at.pos"), lambda p: F.sequence(p, p + (width - 1)))))
    made = common.write_table(later.groupBy(F.col("at.id").alias("_id"), F.col("at.th").alias("_th")).agg(covered.alias("covered")), "covered")
    tables.drop(seen)
    return made


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WINDOW) -> DataFrame:
    """docs with n_lines, n_removed and kept_text (in the place of columns of these names); only documents that may lose lines are shuffled."""
    gone = repeats(docs, id_col, text, width)
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns if c not in ADDED]).alias("doc"), F.col(id_col).alias("own_id"), common.text_of(text).alias("body"), F.xxhash64(common.text_of(text)).alias("th"))
    rows = common.with_maybe(rows, F.xxhash64("own_id", "th"), gone.select(F.xxhash64("_id", "_th").alias("k")))
    met = rows.where("_maybe").join(gone, F.col("own_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left").withColumn("lines", lines_of("body"))
    met = met.withColumn("left", F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("covered", F.array().cast("array<int>"))))
    met = met.select(
        "doc",
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size("left")).cast("bigint").alias("n_removed"),
        F.array_join(F.transform("left", lambda i: F.col("lines")[i]), "\n").alias("kept_text"),
    )
    clear = rows.where("not _maybe").select("doc", F.size(lines_of("body")).cast("bigint").alias("n_lines"), F.lit(0).cast("bigint").alias("n_removed"), F.col("body").alias("kept_text"))
    return clear.unionAll(met).select("doc.*", *ADDED)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.load(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP5_SQL = """
WITH d AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), w AS (
  SELECT doc_id, i, lines[i] || chr(10) || lines[i + 1] || chr(10) || lines[i + 2] AS h
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS i FROM d WHERE len(lines) >= 3)
), g AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM w
), gone AS (
  SELECT DISTINCT doc_id, i + unnest([0, 1, 2]) AS i FROM g WHERE k > 1
), l AS (
  SELECT doc_id, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line FROM d
)
SELECT l.doc_id, count(*) AS n_lines, count(gone.i) AS n_removed,
       sha256(coalesce(string_agg(CASE WHEN gone.i IS NULL THEN line END, chr(10) ORDER BY l.i), '')) AS kept_sha256
FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.i = gone.i
GROUP BY l.doc_id
"""
