"""Hashed presence features of texts and a logistic regression on a bounded sample."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm import common

#: Buckets of hashed words: bounds the model and what is broadcast (2 MB).
BUCKET_BITS = 18


def term_hasher() -> common.WordHasher:
    return common.WordHasher(seed=9, lower=True)


def term_hashes(hasher: common.WordHasher, terms: Sequence[str]) -> np.ndarray:
    """Ascending hashes of words."""
    data, offsets = common.text_buffer(pa.array(terms, pa.string()))
    return np.unique(hasher.words(data, *common.word_spans(data, offsets, common.NOT_ALNUM)[:2]))


def term_buckets(hasher: common.WordHasher, column: pa.Array, stems: Sequence[int] = (), whole: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket), once each, of the runs of letters and digits of each text,
    and of the first k bytes, for each k of stems, of the longer ones among them.
    Words of the hashes in whole (ascending) have no such beginnings."""
    data, offsets = common.text_buffer(column)
    starts, ends, first = common.word_spans(data, offsets, common.NOT_ALNUM)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first)).astype(np.uint64)
    words = hasher.words(data, starts, ends)
    pairs = (owner << np.uint64(BUCKET_BITS)) | (words >> np.uint64(64 - BUCKET_BITS))
    lengths, parts = ends - starts, [pairs]
    cut = np.ones(len(words), bool)
    if whole is not None and len(whole):
        cut = whole[np.minimum(np.searchsorted(whole, words), len(whole) - 1)] != words
    for k in stems:
        longer = (lengths > k) & cut
        stem = common.mixed(hasher.words(data, starts[longer], starts[longer] + k) + np.uint64(k))
        parts.append((owner[longer] << np.uint64(BUCKET_BITS)) | (stem >> np.uint64(64 - BUCKET_BITS)))
    pairs = np.unique(np.concatenate(parts))
    return (pairs >> np.uint64(BUCKET_BITS)).astype(np.int64), (pairs & np.uint64((1 << BUCKET_BITS) - 1)).astype(np.int64)


def bucket_of(hasher: common.WordHasher, term: str) -> int:
    return int(term_buckets(hasher, pa.array([term]))[1][0])


def bounded_sample(labels: DataFrame, most: int, *order: str) -> DataFrame:
    """At most `most` rows of labels, those that come first by hash of the given columns."""
    return labels.orderBy(F.xxhash64(*order), *order).limit(most)


def featured(rows: DataFrame, text: str, *keep: str, stems: Sequence[int] = (), whole: Sequence[str] = ()) -> DataFrame:
    """rows' columns keep, and terms: array<int> of distinct buckets. Words in whole have no stems."""
    schema = rows.select(*keep).withColumn("terms", F.lit(None).cast("array<int>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = term_hasher()
        uncut = term_hashes(hasher, whole)
        for batch in batches:
            for part in common.slices(batch, text):
                owner, buckets = term_buckets(hasher, part.column(text), stems, uncut)
                offsets = np.searchsorted(owner, np.arange(part.num_rows + 1)).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(buckets.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), column], [*keep, "terms"])

    return rows.mapInArrow(common.tidy(run), schema)


class Entries:
    """Buckets of rows in a given order, read in parts: a column of lists is held once and never copied whole again."""

    def __init__(self, column: pa.ChunkedArray | pa.Array, order: np.ndarray | None = None):
        self.lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        if isinstance(self.lists, pa.ChunkedArray):  # of an empty column
            self.lists = pa.array([], column.type)
        self.order = np.arange(len(self.lists)) if order is None else order
        self.lengths = pc.list_value_length(self.lists).to_numpy(zero_copy_only=False).astype(np.int64)[self.order]

    def parts(self, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first row, row after the last, buckets) of ranges with about `most` entries."""
        ends, begin = np.r_[0, np.cumsum(self.lengths)], 0
        while begin < len(self.lengths):
            end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + most, "right")) - 1)
            yield begin, end, self.lists.take(pa.array(self.order[begin:end])).flatten().to_numpy()
            begin = end


def screen(entries: Entries, use: np.ndarray, label: np.ndarray, least_rows: int, most: int) -> np.ndarray:
    """Buckets whose share of label-1 rows (of those in use) differs from the rest's beyond chance, at most `most`, ascending.

    The measure is twice the log-likelihood ratio; its bar rises with the number
    of buckets that are compared, so that few pass by chance at any sample size.
    """
    positive = float(np.clip(label[use].mean(), 1e-6, 1 - 1e-6)) if use.any() else 0.5
    size = 1 << BUCKET_BITS
    seen, ones = np.zeros(size), np.zeros(size)
    for a, b, buckets in entries.parts():
        taken = np.repeat(use[a:b], entries.lengths[a:b])
        own = buckets[taken]
        seen += np.bincount(own, minlength=size)
        ones += np.bincount(own, np.repeat(label[a:b], entries.lengths[a:b])[taken], size)
    tried = np.flatnonzero(seen >= least_rows)
    share = np.clip(ones[tried] / seen[tried], 1e-12, 1 - 1e-12)
    ratio = 2 * seen[tried] * (share * np.log(share / positive) + (1 - share) * np.log((1 - share) / (1 - positive)))
    best = np.argsort(-ratio, kind="stable")[:most]
    return np.sort(tried[best[ratio[best] >= 2 * np.log(max(len(tried), 1)) + 6]])


def screened(terms: DataFrame, label: str, least_share: float, most: int) -> np.ndarray:
    """The buckets that `screen` would take, by counts of a table with terms and a label; at most `most` reach the driver."""
    rows = terms.agg(F.count("*").alias("n"), F.sum(label).alias("ones")).first()
    n, positive = rows["n"], float(np.clip((rows["ones"] or 0) / max(rows["n"], 1), 1e-6, 1 - 1e-6))
    counts = terms.select(label, F.explode("terms").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("seen"), F.sum(label).alias("ones"))
    counts = common.write_table(counts.where(F.col("seen") >= max(5, int(n * least_share))), "counts")
    share = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col("ones") / F.col("seen")))
    ratio = 2 * F.col("seen") * (share * F.log(share / positive) + (1 - share) * F.log((1 - share) / (1 - positive)))
    bar = 2 * float(np.log(max(counts.count(), 1))) + 6
    best = counts.select("bucket", ratio.alias("ratio")).where(F.col("ratio") >= bar).orderBy(F.desc("ratio"), "bucket").limit(most).collect()
    return np.sort(np.array([r["bucket"] for r in best], np.int64))


def narrowed(terms: DataFrame, features: np.ndarray) -> DataFrame:
    """The table with those of its terms alone that are features."""
    others = [c for c in terms.columns if c != "terms"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entries = Entries(batch.column("terms"))
            if not len(features) or not batch.num_rows:
                rows, columns = np.zeros(0, np.int32), np.zeros(0, np.int32)
            else:
                rows, columns = columns_of(entries, features)
            ends = np.searchsorted(rows, np.arange(batch.num_rows + 1)).astype(np.int32)
            kept = features[columns].astype(np.int32) if len(features) else columns
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.ListArray.from_arrays(pa.array(ends), pa.array(kept))], [*others, "terms"])

    return terms.mapInArrow(run, terms.select(*others, "terms").schema)


def columns_of(entries: Entries, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the entries that are features (ascending buckets)."""
    rows, columns = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for a, b, buckets in entries.parts():
        column = np.minimum(np.searchsorted(features, buckets), len(features) - 1)
        inside = features[column] == buckets
        rows.append(np.repeat(np.arange(a, b, dtype=np.int32), entries.lengths[a:b])[inside])
        columns.append(column[inside].astype(np.int32))
    return np.concatenate(rows), np.concatenate(columns)


def fit_logistic(owner: np.ndarray, column: np.ndarray, width: int, label: np.ndarray, l2: float, changes: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None, change_weight: float = 0.0, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated gradient descent on rows given as (owner, column) entries.

    changes (case, column, sign) adds change_weight times the mean over the cases of the
    squared change of the logit, the sum of a case's signed weights.
    """
    n = max(len(label), 1)
    w, b = np.zeros(width + 1), 0.0
    held, square = np.zeros(width + 2), np.zeros(width + 2)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, w[column], n) + b, -30, 30)))
        miss = (p - label) / n
        grad = np.bincount(column, miss[owner], width + 1) + l2 * w
        if changes is not None and len(changes[0]):
            case, at, sign = changes
            moved = np.bincount(case, sign * w[at])
            grad += np.bincount(at, 2 * change_weight / len(moved) * moved[case] * sign, width + 1)
        grad[width] = 0
        grad = np.append(grad, miss.sum())
        held = 0.9 * held + 0.1 * grad
        square = 0.99 * square + 0.01 * grad * grad
        speed = held / (1 - 0.9**t) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
        rate = 0.1 if t < rounds * 2 // 3 else 0.02
        w -= rate * speed[:-1]
        b -= rate * speed[-1]
        w[width] = 0
    return w[:width], float(b)


def dense(features: np.ndarray, weights: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << BUCKET_BITS, np.float32)
    out[features] = weights
    return out


def scored(rows: DataFrame, text: str, weights: np.ndarray, bias: float, out: str = "score", stems: Sequence[int] = (), whole: Sequence[str] = ()) -> DataFrame:
    """rows with the model's probability for each whole text, in the place of a column of its name. The model is bounded and broadcast."""
    rows = rows.drop(out)
    schema = rows.withColumn(out, F.lit(None).cast("double")).schema
    model = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, w = term_hasher(), model.value
        uncut = term_hashes(hasher, whole)
        for batch in batches:
            for part in common.slices(batch, text):
                owner, buckets = term_buckets(hasher, part.column(text), stems, uncut)
                total = np.bincount(owner, w[buckets], part.num_rows) + bias
                score = pa.array(1 / (1 + np.exp(-np.clip(total, -30, 30))), pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, score], [*part.schema.names, out])

    return rows.mapInArrow(common.tidy(run), schema)
