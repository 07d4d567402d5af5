"""Shared helpers: scratch tables in the shared folder, words of Arrow text
columns as numpy arrays, and hashes of words and of windows of words."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java regular expression of one word: anything but space, tab, LF, VT, FF, CR.
WORD = "[^\\x20\\x09-\\x0D]+"

DEFAULT_TOKENIZER_DIR = "/opt/tokenizers"


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join(DEFAULT_TOKENIZER_DIR, name)


def shipped(spark: SparkSession, path: str) -> str:
    """Name under which tasks find a file of the driver by `received`; it is sent once a context."""
    context = spark.sparkContext
    sent = context.__dict__.setdefault("_docketry_files", set())
    if path not in sent:
        context.addFile(path)
        sent.add(path)
    return os.path.basename(path)


def received(name: str) -> str:
    """Place of a shipped file on the machine that asks."""
    return SparkFiles.get(name)


# --------------------------------------------------------------- scratch tables


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; one of our own only where it is unset and all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="docketry-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def write_table(df: DataFrame, name: str, bloom: str | None = None) -> DataFrame:
    """Writes df once to the shared folder and returns a reader of it.

    This cuts the lineage: a lost executor costs a re-read, not a re-run.
    """
    return Scratch(df.sparkSession).write(df, name, bloom)


class Scratch:
    """Tables of one job in the shared folder."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, name: str, bloom: str | None = None) -> DataFrame:
        path = f"{scratch_root(self.spark)}/docketry-{name}-{uuid.uuid4().hex}"
        writer = df.write.option("parquet.block.size", 16 << 20)  # a writer holds a block in memory
        if bloom:
            writer = writer.option(f"parquet.bloom.filter.enabled#{bloom}", "true")
        writer.parquet(path)
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(place)  # plans that are run later still read it
        made = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(made)] = made, path
        return made

    def drop(self, *tables: DataFrame) -> None:
        """Empties tables that no later plan reads."""
        for table in tables:
            made, path = self.paths.pop(id(table))
            self.spark.createDataFrame([], made.schema).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_maybe(df: DataFrame, key: Column, keys: DataFrame, most_bits: int = 1 << 28, bits_a_key: int = 16) -> DataFrame:
    """df with a boolean column _maybe: false only where key is none of keys (one column).

    A bitmap with about bits_a_key bits a key, never above most_bits (32 MB), is
    broadcast; with more keys than it can tell apart, more rows are true. Callers
    join those exactly, so this only spares the shuffle of the others.
    """
    bits = 1 << 15
    wanted = min(most_bits, bits_a_key * keys.count())
    while bits < wanted:
        bits <<= 1
    place = F.pmod(F.xxhash64(F.col(keys.columns[0])), F.lit(bits)) + 1
    maps = keys.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("_b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("_m"))
    df = df.withColumn("_p", F.pmod(F.xxhash64(key), F.lit(bits)) + 1)
    found = df.join(F.broadcast(maps), F.bitmap_bucket_number("_p") == F.col("_b"), "left")
    bit = F.bitmap_bit_position("_p")
    byte = F.conv(F.hex(F.substring("_m", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return found.withColumn("_maybe", F.coalesce(F.getbit(byte, bit % 8) == 1, F.lit(False))).drop("_p", "_b", "_m")


def ranged(df: DataFrame, *order: Column | str, name: str = "ranged") -> DataFrame:
    """df as a table whose column pid numbers ranges of the order: rows in a lower range come first.

    Prefix sums over all rows then need a window in each range and one over the
    sums of the ranges, of which there are as many as shuffle partitions.
    """
    n = shuffle_partitions(df.sparkSession)
    return write_table(df.repartitionByRange(n, *order).withColumn("pid", F.spark_partition_id()), name)


# ------------------------------------------------------------------ Arrow text


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which a worker, that stays for later tasks, gives the memory of this one back."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of about max_bytes of text; a longer text is a slice of its own."""
    if not batch.num_rows:
        return
    _, offsets = text_buffer(batch.column(column))
    begin = 0
    while begin < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[begin] + max_bytes, "right")) - 1
        end = min(max(end, begin + 1), batch.num_rows)
        yield batch.slice(begin, end - begin)
        begin = end


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the int64 offset of each row; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


#: Bytes that end a run of letters and digits: every ASCII character that is neither.
NOT_ALNUM = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def word_spans(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end byte of each word, and the number of the first word of each text (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~breaks[data]
    firsts = np.unique(offsets[:-1][offsets[:-1] < n])
    edge = np.empty(n, bool)
    edge[0], edge[1:] = True, ~word[:-1]
    edge[firsts] = True
    starts = np.flatnonzero(word & edge)
    edge[-1], edge[:-1] = True, ~word[1:]
    edge[firsts[firsts > 0] - 1] = True
    ends = np.flatnonzero(word & edge) + 1
    return starts, ends, np.searchsorted(starts, offsets)


class WordHasher:
    """64-bit hashes of words and windows of words, alike on every machine.

    A word is a polynomial over a random table of its bytes, mixed; a window of
    k words is a polynomial over the hashes of its words, mixed again.
    """

    def __init__(self, seed: int = 1, lower: bool = False):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 2**64, 256, np.uint64)
        if lower:
            self.table[65:91] = self.table[97:123]
        self.base = int(rng.integers(0, 2**62)) * 4 + 3
        self.step = int(rng.integers(0, 2**62)) * 4 + 3
        self.powers = np.ones(1, np.uint64)

    def _up_to(self, n: int) -> np.ndarray:
        while len(self.powers) < n:
            factor = np.uint64(pow(self.base, len(self.powers), 2**64))
            self.powers = np.concatenate([self.powers, self.powers * factor])
        return self.powers

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, np.uint64)
        lengths = ends - starts
        begins = np.cumsum(lengths) - lengths
        place = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(begins, lengths)
        chars = data[place + np.repeat(starts, lengths)]
        terms = self.table[chars] * self._up_to(int(lengths.max()))[place]
        return mixed(np.add.reduceat(terms, begins) + lengths.astype(np.uint64))

    def windows(self, words: np.ndarray, k: int) -> np.ndarray:
        """Hash of words[i : i + k] for each i that has them."""
        n = len(words) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        total, done, part, width = np.zeros(n, np.uint64), 0, words, 1
        while done < k:
            if k & width:
                total += part[done : done + n] * np.uint64(pow(self.step, done, 2**64))
                done += width
            if done < k:
                part = part[: len(part) - width] + part[width:] * np.uint64(pow(self.step, width, 2**64))
                width *= 2
        return mixed(total)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(hasher: WordHasher, data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of each k-word shingle; a text of fewer words is one shingle, one of none has none."""
    starts, ends, first = word_spans(data, offsets)
    words = hasher.words(data, starts, ends)
    counts = np.diff(first)
    owner = np.repeat(np.arange(len(counts)), counts)
    hashes = hasher.windows(words, k)
    inside = owner[: len(hashes)] == owner[k - 1 :] if len(hashes) else np.zeros(0, bool)
    texts, values = owner[: len(hashes)][inside], hashes[inside]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        whole = np.array([hasher.windows(words[first[i] : first[i + 1]], int(counts[i]))[0] for i in short], np.uint64)
        texts, values = np.concatenate([texts, short]), np.concatenate([values, whole])
        order = np.argsort(texts, kind="stable")
        texts, values = texts[order], values[order]
    return texts, values


def sorted_sets(texts: np.ndarray, values: np.ndarray, n: int) -> list[np.ndarray]:
    """The distinct values of each of n texts, ascending."""
    order = np.lexsort((values, texts))
    texts, values = texts[order], values[order]
    if len(values):
        new = np.ones(len(values), bool)
        new[1:] = (texts[1:] != texts[:-1]) | (values[1:] != values[:-1])
        texts, values = texts[new], values[new]
    return np.split(values, np.searchsorted(texts, np.arange(1, n)))
