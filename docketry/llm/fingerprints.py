"""Document fingerprints: threshold-scaled sketches.

A sketch keeps every shingle hash below a fixed fraction of the hash space, and
no other. All texts share the fraction, so sketches of texts of any lengths merge by
union and give containment and likeness estimates without bias, also of very
unequal documents.

A fingerprint is a digest of the whole shingle set and the kept hashes. Where
both of two short texts keep none, it tells equal sets (likeness 1) from others (0).

Defined results: null text counts as empty; a text without words has an empty
sketch; a text of fewer words than a shingle is one shingle, which is kept by the
same rule. An empty sketch and another have likeness 0. Null ids come first in
the order of ids; rows with one id are ordered by text; an empty table gives no
rows; further columns of any name are not read by `with_edits` and passed on by
`fingerprint`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import common

SHINGLE = 5
FRACTION = 1 / 4


def sketches(hasher: common.WordHasher, column: pa.Array, shingle: int, fraction: float) -> tuple[list[np.ndarray], list[int]]:
    """Ascending kept hashes of each text, and a digest of its set of shingles (0 for none)."""
    data, offsets = common.text_buffer(column)
    texts, values = common.shingle_hashes(hasher, data, offsets, shingle)
    sets = common.sorted_sets(texts, values, len(column))
    limit = np.uint64(min(2**64 - 1, int(fraction * 2**64)))
    return [x[: np.searchsorted(x, limit)] for x in sets], [int(common.mixed(x).sum(dtype=np.uint64)) for x in sets]


def likeness(a: np.ndarray, b: np.ndarray, same: bool) -> float:
    """Estimated Jaccard similarity of two sketches; same: their digests are equal."""
    if same or not (len(a) or len(b)):
        return float(same)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def packed(sketch: np.ndarray, digest: int) -> str:
    """Sixteen hex digits of the digest and twelve (the high 48 bits) of each kept hash, ascending; nothing for a text without words."""
    return digest.to_bytes(8, "big").hex() + sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes().hex() if digest else ""


def fingerprint(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, fraction: float = FRACTION, out: str = "sketch") -> DataFrame:
    """docs with an array<bigint> column of kept hashes (as signed numbers), in the place of a column of its name."""
    docs = docs.drop(out)
    schema = docs.withColumn(out, F.lit(None).cast("array<bigint>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = common.WordHasher()
        for batch in batches:
            for part in common.slices(batch, text):
                kept, _ = sketches(hasher, part.column(text), shingle, fraction)
                column = pa.array([x.view(np.int64) for x in kept], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns, column], [*part.schema.names, out])

    return docs.mapInArrow(run, schema)


def containment(a: str, b: str) -> Column:
    """Estimated share of a's shingles that b has (1 for an empty a)."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def merged(*sketch: str) -> Column:
    """Sketch of the union of texts."""
    return F.array_sort(F.array_distinct(F.flatten(F.array(*sketch))))


# ---------------------------------------------------------- neighbours by id


def beside_next(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Rows (bucket, copy, id, text) such that, within a bucket by (copy, id, text),
    each row that is no copy stands before the one with the next id.

    Buckets are ranges of ids. The first rows of each are copied behind the
    bucket before it, so that no global sort and no second pass over the texts is
    needed; one id a bucket reaches the driver, and the bounds go to the tasks once.
    """
    spark = docs.sparkSession
    n = max(2, 8 * common.shuffle_partitions(spark))
    key = F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(2**63)))
    ids = docs.select(key.alias("k"))
    bounds = sorted({int(x) for x in ids.approxQuantile("k", [i / n for i in range(1, n)], 1 / (4 * n)) if x > -(2.0**63)})
    bounds = spark.sparkContext.broadcast(np.asarray(bounds, np.int64))

    def first_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.column("k").to_numpy()
            bucket, place = np.unique(np.searchsorted(bounds.value, k, "right"), return_inverse=True)
            least = np.full(len(bucket), np.iinfo(np.int64).max)
            np.minimum.at(least, place.ravel(), k)
            yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(least)], ["b", "k"])

    heads = ids.mapInArrow(first_of, "b int, k bigint").groupBy("b").agg(F.min("k").alias("k")).orderBy("b").collect()
    buckets = np.array([r["b"] for r in heads], np.int32)
    behind = spark.sparkContext.broadcast((np.array([r["k"] for r in heads], np.int64), np.roll(buckets, 1)))  # the first of all stands behind the last

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, before = behind.value
        for batch in batches:
            k = batch.column("k").to_numpy()
            own = np.searchsorted(bounds.value, k, "right").astype(np.int32)
            at = np.minimum(np.searchsorted(first, k), len(first) - 1)
            again = np.flatnonzero(first[at] == k)
            for rows, bucket, copy in ((np.arange(len(k)), own, False), (again, before[at[again]], True)):
                if len(rows):
                    part = batch.take(pa.array(rows)) if copy else batch
                    yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.full(len(rows), copy)), part.column("id"), part.column("text")], ["bucket", "copy", "id", "text"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("text"), key.alias("k"))
    rows = rows.mapInArrow(dealt, "bucket int, copy boolean, id bigint, text string")
    return rows.repartition("bucket").sortWithinPartitions("bucket", "copy", F.col("id").asc_nulls_first(), F.coalesce("text", F.lit("")))


def with_edits(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, fraction: float = FRACTION) -> DataFrame:
    """Fingerprints of each text and of its edit: the last floor(n/2) code points
    give way to the first as many of the next text by ascending id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = common.WordHasher()
        held: pa.RecordBatch | None = None
        for batch in batches:
            for part in common.slices(batch, "text"):
                if held is not None:
                    part = pa.Table.from_batches([held, part]).combine_chunks().to_batches()[0]
                held = part.slice(part.num_rows - 1, 1)
                if part.num_rows > 1:
                    yield edited(hasher, part)

    def edited(hasher: common.WordHasher, part: pa.RecordBatch) -> pa.RecordBatch:
        buckets, copies, ids = (part.column(c).to_pylist() for c in ("bucket", "copy", "id"))
        texts = [x or "" for x in part.column("text").to_pylist()]
        own, whole = sketches(hasher, part.column("text"), shingle, fraction)
        rows = [i for i in range(len(texts) - 1) if not copies[i]]
        assert all(buckets[i] == buckets[i + 1] for i in rows)
        edits = [texts[i][: len(texts[i]) - len(texts[i]) // 2] + texts[i + 1][: len(texts[i]) // 2] for i in rows]
        theirs, edited_whole = sketches(hasher, pa.array(edits, pa.large_string()), shingle, fraction)
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": pa.array([ids[i] for i in rows], pa.int64()),
                "n_chars": pa.array([len(texts[i]) for i in rows], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edits], pa.string()),
                "fingerprint": pa.array([packed(own[i], whole[i]) for i in rows], pa.string()),
                "edited_fingerprint": pa.array([packed(x, w) for x, w in zip(theirs, edited_whole, strict=True)], pa.string()),
                "near_edited": pa.array([likeness(own[i], x, whole[i] == w) for i, x, w in zip(rows, theirs, edited_whole, strict=True)], pa.float64()),
                "near_next": pa.array([likeness(own[i], own[i + 1], whole[i] == whole[i + 1]) for i in rows], pa.float64()),
            }
        )

    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return beside_next(docs, id_col, text).mapInArrow(run, schema)


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_edits(common.load(spark, sf_dir, "documents"))
