"""Best-fit packing of token pieces into sequences of fixed length.

Bounded-space online best fit: at most open_bins sequences are open at once.
A bitset has a bit for each amount of free space that some open one has; the
lowest bit at or above a piece's length is its best fit. When another has
to be opened and none may, the fullest closes first.

Pieces are dealt to groups by hash, as many as their count asks for, and each
group is packed by itself, so a task holds about group_pieces narrow rows at any
input size. Defined results: null text counts as empty (one piece, of the
end id alone); rows that repeat are packed once each.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import common

MAX_TOKENS = 4096
OPEN_BINS = 1024
GROUP_PIECES = 50_000
END_ID = 1


_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARKS = "!-&(-/:-@\\[-`{-~"
#: Runs of Latin letters, runs of ASCII marks but the apostrophe, and what else stands between spaces.
_RUNS = re.compile(f"[{_LATIN}]+(?=[ \n{_MARKS}]|\\Z)|[{_MARKS}]+(?=[ \n{_LATIN}]|\\Z)|[^ \n]+")
_PLAIN = re.compile(f"[{_LATIN}]+|[{_MARKS}]+")


class RunTokenizer(dict):
    """Token ids (as little-endian unsigned 32-bit bytes) of runs of a text, kept for up to `keep` runs.

    The vocabulary's splitter always cuts at an ASCII space or line break, and
    between a Latin letter and an ASCII mark other than the apostrophe, so the
    ids of a text are those of its runs in turn. A run of letters or of marks
    alone is one pre-token and goes to the merges at once, in lower case; any other run goes
    as it is through the whole tokenizer, and so does a text that holds a special token
    (which is one in its own case only).
    """

    def __init__(self, path: str, keep: int = 100_000):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.merges = self.whole.model
        self.as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.keep = keep

    def __missing__(self, run: str) -> bytes:
        if _PLAIN.fullmatch(run):
            text = run.lower()
            text = text if text.isascii() else self.as_bytes.pre_tokenize_str(text)[0][0]
            ids = [t.id for t in self.merges.tokenize(text)]
        else:
            ids = self.whole.encode(run, add_special_tokens=False).ids
        found = np.asarray(ids, "<u4").tobytes()
        if len(self) < self.keep and len(run) <= 64:
            self[run] = found
        return found

    def ids(self, text: str) -> bytes:
        if any(t in text for t in self.special):  # those are found in the text before anything else
            return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, _RUNS.findall(text)))


@functools.lru_cache(maxsize=1)
def tokenizer_at(path: str) -> RunTokenizer:
    """One for each worker process, kept from task to task."""
    return RunTokenizer(path)


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", max_tokens: int = MAX_TOKENS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each document's ids; only longer ones are cut."""

    name = common.shipped(docs.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, width = tokenizer_at(common.received(name)), np.asarray([END_ID], "<u4").tobytes(), 4 * max_tokens
        for batch in batches:
            for part in common.slices(batch, "text"):
                ids = [encoder.ids(x or "") for x in part.column("text").to_pylist()]
                rows = [(i, k, k * max_tokens, cut) for i, x in zip(part.column("id").to_pylist(), ids, strict=True) for k, cut in enumerate(cuts(x + end, width))]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in rows], pa.int64()),
                        pa.array([r[1] for r in rows], pa.int32()),
                        pa.array([r[2] for r in rows], pa.int64()),
                        pa.array([len(r[3]) // 4 for r in rows], pa.int64()),
                        pa.array([zlib.crc32(r[3]) for r in rows], pa.int64()),
                    ],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    def emptied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            tokenizer_at(common.received(name)).clear()  # its vocabulary stays, the runs of this task go

    def cuts(x: bytes, width: int) -> list[bytes]:
        return [x[j : j + width] for j in range(0, len(x), width)]

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(common.tidy(emptied), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit(lengths: list[int], capacity: int, open_bins: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each piece, in the order given."""
    free_bits, by_free, opened, count = 0, {}, 0, 0
    bins, offsets = [], []
    for need in lengths:
        fits = free_bits >> need
        if fits:
            free = need + (fits & -fits).bit_length() - 1
            own = by_free[free].pop()
            if not by_free[free]:
                free_bits ^= 1 << free
        else:
            if opened == open_bins:
                fullest = (free_bits & -free_bits).bit_length() - 1
                by_free[fullest].pop()
                if not by_free[fullest]:
                    free_bits ^= 1 << fullest
                opened -= 1
            own, free = count, capacity
            count += 1
            opened += 1
        bins.append(own)
        offsets.append(capacity - free)
        left = free - need
        if left:
            by_free.setdefault(left, []).append(own)
            free_bits |= 1 << left
        else:
            opened -= 1
    return bins, offsets


def pack(rows: DataFrame, max_tokens: int = MAX_TOKENS, open_bins: int = OPEN_BINS, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds sequence_id and offset to rows (doc_id, piece, length, ...); rows is read twice, so it should be a table."""
    groups = max(1, -(-rows.count() // group_pieces))
    keyed = rows.withColumn("order", F.xxhash64(*rows.columns)).withColumn("grp", F.pmod(F.col("order"), F.lit(groups)).cast("bigint"))

    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([(c, "ascending") for c in ("order", "doc_id", "piece")])
        bins, offsets = best_fit(group.column("length").to_pylist(), max_tokens, open_bins)
        group = group.drop_columns(["order", "grp"])
        group = group.append_column("sequence_id", pa.array((key[0].as_py() << 32) + np.asarray(bins, np.int64)))
        return group.append_column("offset", pa.array(np.asarray(offsets, np.int64)))

    schema = rows.withColumn("sequence_id", F.lit(0).cast("bigint")).withColumn("offset", F.lit(0).cast("bigint")).schema
    return keyed.groupBy("grp").applyInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, **limits: int) -> DataFrame:
    """A row a piece of docs, packed: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    The vocabulary file is sent to the executors. Null texts, repeated rows and
    ties are as above; further columns of any name are not read; an empty table
    gives no rows.
    """
    rows = pieces(docs, tokenizer or common.tokenizer_file("word_bpe_49k.json"), max_tokens=limits.get("max_tokens", MAX_TOKENS))
    return pack(common.write_table(rows, "pieces"), **limits)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.load(spark, sf_dir, "documents"))
