"""Exact dedup by a log-structured merge index, in DataFrame operations only.

Each task flushes its memtable of (digest, id) as one sorted run. The runs'
digests, in eight bytes and merged in each task before they travel, give a
filter: a bounded bitmap of those that two rows have. Rows that the filter rules
out have no copy; they never enter the index and are settled on the spot. The others are
compacted into one row a digest (what is to stay, and how many there are),
aggregated before the shuffle, so that a digest of a third of all rows sends
one row a task; digests met more than once are hits, and the bytes of their
texts are compared.

Of equal texts the row with the largest id stays, by the contract of the query;
keep="smallest" gives the order of the method. Defined results: null text counts as
empty; a null id is below every other; of rows that repeat id and text, one
stays; two texts of one digest that differ stop the job with an error; an empty
table gives no rows; further columns of any name are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import common


def digest_of(text: str) -> Column:
    return F.unhex(F.sha2(common.text_of(text), 256))


def flush_runs(docs: DataFrame, id_col: str, text: str, digest: Column) -> DataFrame:
    """(digest, alt, id, row): one sorted run a task; alt is a second hash."""
    rows = docs.select(digest.alias("digest"), F.xxhash64(common.text_of(text)).alias("alt"), F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"))
    return common.write_table(rows.sortWithinPartitions("digest", "alt"), "runs")


def probed(runs: DataFrame) -> DataFrame:
    """runs with _maybe: false where the filter of the runs has no second row of the digest."""
    short = F.xxhash64("digest", "alt")
    twice = common.write_table(runs.select(short.alias("k")).groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k"), "filter")
    return common.with_maybe(runs, short, twice)


def compact(runs: DataFrame, keep: str = "largest") -> DataFrame:
    """(digest, alt, best, n): one row a digest."""
    pick = {"largest": F.max, "smallest": F.min}[keep]
    return common.write_table(runs.groupBy("digest", "alt").agg(pick(F.struct("id", "row")).alias("best"), F.count("*").alias("n")), "index")


def verify(docs: DataFrame, index: DataFrame, text: str, digest: Column) -> None:
    """Compares the bytes of all texts whose digest was met more than once.

    Only rows that a bounded bitmap lets through are shuffled, and copies are
    merged before.
    """
    hits = index.where("n > 1").select("digest", "alt")
    rows = docs.select(digest.alias("digest"), F.xxhash64(common.text_of(text)).alias("alt"), common.text_of(text).alias("text"))
    rows = common.with_maybe(rows, F.col("digest"), hits.select("digest"))
    texts = rows.where("_maybe").groupBy("digest", "alt", "text").agg(F.count("*").alias("n")).join(hits, ["digest", "alt"], "left_semi")
    if texts.groupBy("digest", "alt").agg(F.count("*").alias("n")).where("n > 1").take(1):
        raise ValueError("two different texts have the same digest and the same second hash")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep: str = "largest", digest: Column | None = None) -> DataFrame:
    """One row a document: id, keep_id, group_size, kept, text_sha256 (the digest in hex)."""
    digest = digest_of(text) if digest is None else digest
    runs = probed(flush_runs(docs, id_col, text, digest))
    index = compact(runs.where("_maybe"), keep)
    verify(docs, index, text, digest)
    alone = runs.where("not _maybe").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("n"), F.lit(True).alias("kept"), "digest")
    met = runs.where("_maybe").join(index, ["digest", "alt"]).select("id", F.col("best.id").alias("keep_id"), "n", (F.col("row") == F.col("best.row")).alias("kept"), "digest")
    return alone.unionAll(met).select(F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep: str = "largest") -> DataFrame:
    """docs without the rows that exact_dedup does not keep.

    The rows to go are looked up by id and digest; of rows that repeat both,
    one is kept. Documents that a bounded bitmap of the ids to go rules out are
    passed on without a shuffle. Null texts and ids are as above; further columns
    of any name are passed on; an empty table gives an empty one.
    """
    fate = common.write_table(exact_dedup(docs, id_col, text, keep), "fate")
    pairs = fate.select(F.col(id_col).alias("_id"), F.col("text_sha256").alias("_sha"), "kept")
    pairs = common.write_table(pairs.groupBy("_id", "_sha").agg(F.count("*").alias("_same"), F.max("kept").alias("_stays")).where("_same > 1 or not _stays"), "touched")
    rows = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("own_id"), F.sha2(common.text_of(text), 256).alias("own_sha"))
    rows = common.with_maybe(rows, F.xxhash64("own_id", "own_sha"), pairs.select(F.xxhash64("_id", "_sha").alias("k")))
    met = rows.where("_maybe").join(pairs, F.col("own_id").eqNullSafe(F.col("_id")) & (F.col("own_sha") == F.col("_sha")), "left")
    single = met.where("_same is null")
    again = met.where("_stays").dropDuplicates(["_id", "_sha"])
    clear = rows.where("not _maybe")
    return clear.select("doc").unionAll(single.select("doc")).unionAll(again.select("doc")).select("doc.*")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(common.load(spark, sf_dir, "documents"))


OP6_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
