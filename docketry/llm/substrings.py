"""Substring dedup by fixed-block anchors.

The non-overlapping blocks of 25 words of each document are indexed by hash
(smallest document id a hash); every rolling window of 25 words probes the
index. A passage of 50 words that starts in a smaller document covers a whole
block of it, so each such passage is hit. Hits are extended to maximal repeats:
all windows of 50 words around a hit are hashed (96 bits), the smallest document
of each hash is found, and the windows of any larger one are covered; covered
places are merged.

Probes travel packed: a row for each slice of texts and bucket of hashes, with
five bytes of hash and about one of place a window, so the shuffle is about twice
the compressed input. A hash that several documents of a slice share is settled
there and sent once, so a passage in a third of all documents puts one entry a
slice, not a document, into its bucket.

Defined results: a word is a run without ASCII white space; a null text has no
words; a document without an id takes no part (nothing is removed); documents
of one id do not remove from each other; a text of fewer than 50 words is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import common

WINDOW = 50
SLICE = 4 << 20
#: Windows of one bucket of hashes, about: bounds what a task holds at any input size.
BUCKET_WINDOWS = 1 << 21
_KEY_BYTES = 5


def _hasher() -> common.WordHasher:
    return common.WordHasher(seed=7)


def _runs(words: np.ndarray, first: np.ndarray, hasher: common.WordHasher, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, hash) of each window of k words that lies in one text."""
    hashes = hasher.windows(words, k)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = owner[: len(hashes)] == owner[k - 1 :] if len(hashes) else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    texts = owner[at]
    return texts, at - first[texts], hashes[at]


def _bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The top bits, in 16 where they fit, as those are sorted faster."""
    return (hashes >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)


def bucket_bits(n_windows: int, most: int = BUCKET_WINDOWS) -> int:
    """So many bits that a bucket has about `most` windows."""
    return min(24, max(2, (n_windows // most).bit_length()))


def _int_planes(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers byte by byte, so that small ones compress well."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


def _packed_rows(bucket: np.ndarray, texts: np.ndarray, places: np.ndarray, keys: np.ndarray, ids: np.ndarray, ths: np.ndarray) -> Iterator[dict]:
    """A row a bucket. Entries must be in the order of (text, place); keys has a row of bytes an entry."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    bucket, texts, places, keys = bucket[order], texts[order], places[order], keys[order]
    new = np.ones(len(texts), bool)
    new[1:] = (texts[1:] != texts[:-1]) | (bucket[1:] != bucket[:-1])
    gaps = places.copy()
    gaps[1:] -= np.where(new[1:], 0, places[:-1])
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    for a, b in zip(cuts, np.r_[cuts[1:], len(bucket)], strict=True):
        starts = np.flatnonzero(new[a:b])
        own = texts[a:b][starts]
        yield {
            "bucket": int(bucket[a]),
            "ids": ids[own].tobytes(),
            "ths": ths[own].tobytes(),
            "counts": _int_planes(np.diff(np.r_[starts, b - a])),
            "gaps": _int_planes(gaps[a:b]),
            "keys": keys[a:b].tobytes(),
        }


def _unpacked(row, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, ths of the row's texts; text number, place, key bytes of its entries)."""
    ids, ths = np.frombuffer(row.ids, np.int64), np.frombuffer(row.ths, np.int64)
    counts, gaps = _from_planes(row.counts), _from_planes(row.gaps)
    texts = np.repeat(np.arange(len(ids)), counts)
    sums = np.cumsum(gaps)
    begins = np.cumsum(counts) - counts
    places = sums - np.repeat(sums[begins] - gaps[begins], counts)
    return ids, ths, texts, places, np.frombuffer(row.keys, np.uint8).reshape(-1, width)


_PACKED = "bucket int, ids binary, ths binary, counts binary, gaps binary, keys binary"
_SENT = "dest int, kind string, ids binary, ths binary, counts binary, values binary"
_FOUND = "id bigint, th bigint, places binary, hits binary"
_KINDS = {"places": "<i4", "hits": "<u8"}


def _sent(kind: str, ids: np.ndarray, ths: np.ndarray, values: np.ndarray, parts: int) -> pd.DataFrame:
    """Entries (text, value) packed to a row for each of `parts` receivers, which are dealt by id."""
    columns = ["dest", "kind", "ids", "ths", "counts", "values"]
    if not len(ids):
        return pd.DataFrame(columns=columns).astype({"dest": "int32"})
    dest = (common.mixed(ids.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((ths, ids, dest))
    dest, ids, ths, values = dest[order], ids[order], ths[order], values[order].astype(_KINDS[kind])
    starts = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (ths[1:] != ths[:-1])])
    ends, to = np.r_[starts[1:], len(ids)], dest[starts]
    cuts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
    rows = [
        (int(to[x]), kind, ids[starts[x:y]].tobytes(), ths[starts[x:y]].tobytes(), (ends[x:y] - starts[x:y]).astype("<i4").tobytes(), values[starts[x] : ends[y - 1]].tobytes())
        for x, y in zip(cuts, np.r_[cuts[1:], len(to)], strict=True)
    ]
    return pd.DataFrame(rows, columns=columns).astype({"dest": "int32"})


class _Entries:
    """Entries gathered over the rows of one group."""

    def __init__(self):
        self.ids, self.ths, self.values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def add(self, ids: np.ndarray, ths: np.ndarray, values: np.ndarray) -> None:
        self.ids.append(ids)
        self.ths.append(ths)
        self.values.append(values)

    def sent(self, kind: str, parts: int) -> pd.DataFrame:
        return _sent(kind, np.concatenate(self.ids), np.concatenate(self.ths), np.concatenate(self.values), parts)


def gathered(packed: DataFrame, by_text: bool) -> DataFrame:
    """(id, th, places, hits): all values of an id (th is 0), or of a text, in one row."""

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for kind, dtype in _KINDS.items():
            rows = group[group["kind"] == kind]
            ids, ths = (np.frombuffer(b"".join(rows[c]), np.int64) for c in ("ids", "ths"))
            counts, values = np.frombuffer(b"".join(rows["counts"]), "<i4"), np.frombuffer(b"".join(rows["values"]), dtype)
            parts.append((ids, ths if by_text else np.zeros(len(ids), np.int64), counts, values))
        keys = np.concatenate([np.stack([ids, ths], axis=1) for ids, ths, _, _ in parts])
        own, number = np.unique(keys, axis=0, return_inverse=True)
        number, columns, begin = number.ravel(), {}, 0
        for kind, (ids, _, counts, values) in zip(_KINDS, parts, strict=True):
            texts = np.repeat(number[begin : begin + len(ids)], counts)
            begin += len(ids)
            order = np.argsort(texts, kind="stable")
            columns[kind] = [x.tobytes() for x in np.split(values[order], np.searchsorted(texts[order], np.arange(1, len(own))))]
        return pd.DataFrame({"id": own[:, 0], "th": own[:, 1]} | columns)

    return packed.groupBy("dest").applyInPandas(merge, _FOUND)


def _rows_of(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(common.text_of(text)).alias("th"), F.col(text).alias("text"))


def _int_column(part: pa.RecordBatch, name: str) -> np.ndarray:
    return part.column(name).to_numpy(zero_copy_only=False).astype(np.int64)


# ------------------------------------------------------------------- 1. index


def block_index(rows: DataFrame, block: int, window: int) -> DataFrame:
    """(h, id, n): the smallest document of each block hash, and how often it is met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _hasher()
        for batch in batches:
            for part in common.slices(batch, "text"):
                data, offsets = common.text_buffer(part.column("text"))
                starts, ends, first = common.word_spans(data, offsets)
                texts, places, hashes = _runs(hasher.words(data, starts, ends), first, hasher, block)
                use = (places % block == 0) & (np.diff(first)[texts] >= window)
                ids = _int_column(part, "id")
                yield pa.RecordBatch.from_arrays([pa.array(hashes[use].view(np.int64)), pa.array(ids[texts[use]])], ["h", "id"])

    return rows.mapInArrow(run, "h bigint, id bigint").groupBy("h").agg(F.min("id").alias("id"), F.count("*").alias("n"))


# ------------------------------------------------------------------ 2. probes


def probes(rows: DataFrame, block: int, window: int, bits: int) -> DataFrame:
    """Packed probes, and under bucket -1 - n places already known to be shared in their slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _hasher()
        for batch in batches:
            for part in common.slices(batch, "text", SLICE):
                out = list(of_slice(hasher, part))
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)

    arrow = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("ids", "ths", "counts", "gaps", "keys"))])

    def of_slice(hasher: common.WordHasher, part: pa.RecordBatch) -> Iterator[dict]:
        data, offsets = common.text_buffer(part.column("text"))
        starts, ends, first = common.word_spans(data, offsets)
        ids, ths = _int_column(part, "id"), _int_column(part, "th")
        texts, places, hashes = _runs(hasher.words(data, starts, ends), first, hasher, block)
        long = np.diff(first)[texts] >= window
        texts, places, hashes = texts[long], places[long], hashes[long]
        if not len(hashes):
            return
        order = np.argsort(hashes, kind="stable")
        begins = np.flatnonzero(np.r_[True, hashes[order][1:] != hashes[order][:-1]])
        sizes = np.diff(np.r_[begins, len(order)])
        own = ids[texts[order]]
        least, most = np.minimum.reduceat(own, begins), np.maximum.reduceat(own, begins)
        shared = np.repeat(least != most, sizes)
        pick = np.ones(len(order), bool)  # of a shared hash, one place of the largest document is sent
        pick[shared] = False
        group = np.repeat(np.arange(len(begins)), sizes)
        tops = np.flatnonzero(shared & (own == np.repeat(most, sizes)))
        pick[tops[np.unique(group[tops], return_index=True)[1]]] = True
        send = np.sort(order[pick])
        key = (hashes[send] >> np.uint64(64 - bits - 8 * _KEY_BYTES)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_KEY_BYTES]
        bucket = _bucket(hashes[send], bits)
        yield from _packed_rows(bucket, texts[send], places[send], key, ids, ths)
        local = np.sort(order[shared])
        none = np.zeros((len(local), 0), np.uint8)
        for row in _packed_rows(np.zeros(len(local), np.uint16), texts[local], places[local], none, ids, ths):
            yield row | {"bucket": -1 - int(ths[0] % (1 << bits))}

    return rows.mapInArrow(run, _PACKED)


def anchored(rows: DataFrame, index: DataFrame, block: int, window: int, bits: int) -> DataFrame:
    """Places where a window of a document met a block of a smaller one, and hashes
    of blocks that a larger document met, packed for `gathered`."""

    def match(asked: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        full = blocks["h"].to_numpy(np.int64).view(np.uint64)
        keys = (full >> np.uint64(64 - bits - 8 * _KEY_BYTES)) & np.uint64(2 ** (8 * _KEY_BYTES) - 1)
        order = np.lexsort((blocks["id"].to_numpy(), keys))
        keys, full, owner = keys[order], full[order], blocks["id"].to_numpy(np.int64)[order]
        firsts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
        out, hit, met = _Entries(), np.zeros(len(keys), bool), _Entries()
        for row in asked.itertuples(index=False):
            if row.bucket < 0:
                ids, ths, texts, places, _ = _local(row)
                out.add(ids[texts], ths[texts], places)
                continue
            if not len(keys):
                continue
            ids, ths, texts, places, raw = _unpacked(row, _KEY_BYTES)
            asks = np.zeros((len(raw), 8), np.uint8)
            asks[:, :_KEY_BYTES] = raw
            asks = asks.view("<u8").ravel()
            at = np.searchsorted(keys[firsts], asks)
            at[at == len(firsts)] = 0
            at = firsts[at]
            good = (keys[at] == asks) & (owner[at] < ids[texts])
            hit[at[good]] = True
            out.add(ids[texts[good]], ths[texts[good]], places[good])
        if hit.any():
            hit = np.isin(keys, keys[hit])
            met.add(owner[hit], np.zeros(int(hit.sum()), np.int64), full[hit].view(np.int64))
        return pd.concat([out.sent("places", parts), met.sent("hits", parts)], ignore_index=True)

    parts = 1 << bits
    blocks = index.select("h", "id", F.shiftrightunsigned("h", 64 - bits).cast("int").alias("bucket"))
    asked = probes(rows, block, window, bits)
    return asked.groupBy("bucket").cogroup(blocks.groupBy("bucket")).applyInPandas(match, _SENT)


def _local(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, None]:
    counts, gaps = _from_planes(row.counts), _from_planes(row.gaps)
    ids, ths = np.frombuffer(row.ids, np.int64), np.frombuffer(row.ths, np.int64)
    texts = np.repeat(np.arange(len(ids)), counts)
    sums, begins = np.cumsum(gaps), np.cumsum(counts) - counts
    return ids, ths, texts, sums - np.repeat(sums[begins] - gaps[begins], counts), None


# --------------------------------------------------------------- 3. extension


def _joined(values: bytes | None, kind: str) -> np.ndarray:
    return np.frombuffer(values or b"", kind)


def _within(n: int, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mask of n places in any of [begin, end)."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, np.clip(begins, 0, n), 1)
    np.add.at(steps, np.clip(ends, 0, n), -1)
    return np.cumsum(steps[:-1]) > 0


def extended(rows: DataFrame, block: int, window: int, bits: int) -> DataFrame:
    """rows (id, th, text, places, hits) to packed windows of `window` words around
    hits; under bucket -1 - n those already known to be of a smaller document too."""
    arrow = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("ids", "ths", "counts", "gaps", "keys"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, other = _hasher(), common.WordHasher(seed=8)
        for batch in batches:
            for part in common.slices(batch, "text", SLICE):
                out = list(of_slice(hasher, other, part))
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)

    def of_slice(hasher: common.WordHasher, other: common.WordHasher, part: pa.RecordBatch) -> Iterator[dict]:
        data, offsets = common.text_buffer(part.column("text"))
        starts, ends, first = common.word_spans(data, offsets)
        words = hasher.words(data, starts, ends)
        ids, ths = _int_column(part, "id"), _int_column(part, "th")
        near = np.zeros(len(words), bool)
        for i, (places, hits) in enumerate(zip(part.column("places").to_pylist(), part.column("hits").to_pylist(), strict=True)):
            own = words[first[i] : first[i + 1]]
            at, met = _joined(places, "<i4").astype(np.int64), _joined(hits, np.uint64)
            if len(met):
                at = np.r_[at, np.flatnonzero(np.isin(hasher.windows(own, block), met))]
            near[first[i] : first[i + 1]] = _within(len(own), at - (window - block), at + 1)
        texts, places, hashes = _runs(words, first, hasher, window)
        use = near[first[texts] + places]
        texts, places, hashes = texts[use], places[use], hashes[use]
        if not len(hashes):
            return
        second = other.windows(other.words(data, starts, ends), window)[first[texts] + places] >> np.uint64(32)
        order = np.lexsort((second, hashes))
        a, b = hashes[order], second[order]
        begins = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        own = ids[texts[order]]
        least = np.repeat(np.minimum.reduceat(own, begins), np.diff(np.r_[begins, len(order)]))
        send, local = np.sort(order[own == least]), np.sort(order[own > least])
        key = np.concatenate([hashes[send].astype("<u8").view(np.uint8).reshape(-1, 8), second[send].astype("<u4").view(np.uint8).reshape(-1, 4)], axis=1)
        yield from _packed_rows(_bucket(hashes[send], bits), texts[send], places[send], key, ids, ths)
        none = np.zeros((len(local), 0), np.uint8)
        for row in _packed_rows(np.zeros(len(local), np.uint16), texts[local], places[local], none, ids, ths):
            yield row | {"bucket": -1 - int(ths[0] % (1 << bits))}

    return rows.mapInArrow(run, _PACKED)


def settled(packed: DataFrame, bits: int) -> DataFrame:
    """Windows that start in a smaller document too, packed for `gathered`."""
    parts = 1 << bits

    def least(group: pd.DataFrame) -> pd.DataFrame:
        out, ids, ths, keys, places = _Entries(), [], [], [], []
        for row in group.itertuples(index=False):
            if row.bucket < 0:
                own, th, texts, at, _ = _local(row)
                out.add(own[texts], th[texts], at)
            else:
                own, th, texts, at, key = _unpacked(row, 12)
                ids.append(own[texts])
                ths.append(th[texts])
                places.append(at)
                keys.append(key)
        if ids:
            ids, ths, places, keys = (np.concatenate(x) for x in (ids, ths, places, keys))
            low = np.ascontiguousarray(keys[:, :8]).view("<u8").ravel()
            high = np.ascontiguousarray(keys[:, 8:]).view("<u4").ravel()
            order = np.lexsort((high, low))
            low, high = low[order], high[order]
            begins = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
            smallest = np.repeat(np.minimum.reduceat(ids[order], begins), np.diff(np.r_[begins, len(order)]))
            gone = order[ids[order] > smallest]
            out.add(ids[gone], ths[gone], places[gone])
        return out.sent("places", parts)

    return packed.groupBy("bucket").applyInPandas(least, _SENT)


# ----------------------------------------------------------------- 4. removal


def removed(rows: DataFrame, window: int) -> DataFrame:
    """rows (id, text, places or null) to (doc_id, n_words, n_removed, kept_text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text"):
                yield of_slice(part)

    def of_slice(part: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = common.text_buffer(part.column("text"))
        starts, ends, first = common.word_spans(data, offsets)
        gone = np.zeros(len(starts), bool)
        for i, places in enumerate(part.column("places").to_pylist()):
            if places:
                at = _joined(places, "<i4").astype(np.int64)
                gone[first[i] : first[i + 1]] = _within(int(first[i + 1] - first[i]), at, at + window)
        spaced = data.copy()
        owner = np.repeat(np.arange(part.num_rows), np.diff(first))
        followed = ends < offsets[owner + 1]
        spaced[ends[followed]] = 0x20
        steps = np.zeros(len(data) + 2, np.int64)
        np.add.at(steps, starts[~gone], 1)
        np.add.at(steps, (ends + followed)[~gone], -1)
        keep = np.cumsum(steps[: len(data)]) > 0
        bounds = np.r_[0, np.cumsum(keep)][offsets] if len(data) else offsets
        kept = spaced[keep].tobytes()
        texts = [kept[a:b].removesuffix(b" ") for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        lost = np.r_[0, np.cumsum(gone)][first]
        return pa.RecordBatch.from_arrays(
            [
                part.column("id"),
                pa.array(np.diff(first).astype(np.int64)),
                pa.array(np.diff(lost).astype(np.int64)),
                pa.array([x.decode() for x in texts], pa.string()),
            ],
            ["doc_id", "n_words", "n_removed", "kept_text"],
        )

    return rows.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, th, places): begins of the windows that a smaller document has too, a row a document."""
    block = window // 2
    rows = _rows_of(docs, id_col, text)
    named = rows.where("id is not null")
    index = common.write_table(block_index(named, block, window), "blocks")
    bits = bucket_bits(block * (index.agg(F.sum("n")).first()[0] or 0))
    found = gathered(anchored(named, index, block, window, bits), by_text=False).select("id", "places", "hits")
    flags = common.write_table(found, "anchors").withColumnRenamed("id", "_id")
    near = common.with_maybe(named, F.col("id"), flags.select("_id")).where("_maybe").drop("_maybe")
    near = near.join(flags, F.col("id") == F.col("_id")).select("id", "th", "text", "places", "hits")
    gone = gathered(settled(extended(near, block, window, bits), bits), by_text=True).select("id", "th", "places")
    return common.write_table(gone, "repeats")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text): only documents that may lose words are shuffled."""
    gone = repeated_windows(docs, id_col, text, window).withColumnsRenamed({"id": "_id", "th": "_th"})
    rows = common.with_maybe(_rows_of(docs, id_col, text), F.xxhash64("id", "th"), gone.select(F.xxhash64("_id", "_th").alias("k")))
    clear = rows.where("not _maybe").select("id", "text", F.lit(None).cast("binary").alias("places"))
    met = rows.where("_maybe").join(gone, (F.col("id") == F.col("_id")) & (F.col("th") == F.col("_th")), "left").select("id", "text", "places")
    return removed(clear.unionByName(met), window)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_substrings(common.load(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
