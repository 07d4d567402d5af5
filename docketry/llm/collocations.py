"""Phrase collocations by pivot partitioning.

Words are counted first. A fixed table of sums of those counts, by hash of the
word, orders all words from frequent to rare: exact but for words whose hashes
meet, bounded in size whatever the vocabulary, and alike on every machine, which is
all that the method asks of an order. An n-gram belongs to its pivot, the
leftmost place of its rarest word. Each place of a text is rewritten for its
word as pivot: the words that an n-gram of that pivot can reach, up to three on each
side, ending before the first that is rarer (or, on the left, the same), that is
too rare for any result, or that lies beyond the piece. These fragments, merged with their counts, are
routed to the pivot; a pivot that is frequent is split by hash of the fragment.
There the n-grams round the pivot are counted. A pivot that was not split is then
complete, and what is below the bound goes no further; only the counts of
split pivots are added up once more.

Then a phrase is scored by its worst cut, phrases mostly inside a longer
one are dropped, and each language's best are ranked; the ranking is cut in
parts before the parts of a language meet.

Defined results: null text counts as empty, a null language is `und`; ties in
score are broken by count, then phrase; rows that repeat count each time; an
empty table gives no rows; further columns of any name are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.llm import common

LEAST, LONGEST, TOP, COVERED = 30, 4, 2000, 80
#: The order of words is a table of 2^ORDER_BITS four-byte sums (4 MB).
ORDER_BITS = 20
#: Places of a pivot that one group holds, about; fragments that a task counts at once; bytes of text that it rewrites at once.
GROUP, CHUNK, SLICE = 200_000, 100_000, 2 << 20

_PIECE = np.zeros(256, bool)
_PIECE[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BREAK = _PIECE.copy()
_BREAK[[0x20, 0x09]] = True
_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x0A]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The strings data[start:end]."""
    lengths = ends - starts
    offsets = np.r_[0, np.cumsum(lengths)]
    chars = data[np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)]
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(chars)).cast(pa.string())


class Scan:
    """Words of the texts of a slice: their bytes in a row with single spaces, key (of language and word) and piece."""

    def __init__(self, hasher: common.WordHasher, part: pa.RecordBatch):
        data, offsets = common.text_buffer(part.column("text"))
        data = _LOWER[data]
        starts, ends, first = common.word_spans(data, offsets, _BREAK)
        self.text = np.repeat(np.arange(part.num_rows), np.diff(first))
        self.langs = part.column("lang")
        langs = self.langs.dictionary_encode()
        seeds = np.array([xxhash.xxh64_intdigest(x.encode()) for x in langs.dictionary.to_pylist()], np.uint64)
        self.keys = common.mixed(hasher.words(data, starts, ends) ^ seeds[langs.indices.to_numpy()[self.text]]) if len(starts) else np.zeros(0, np.uint64)
        marks = np.cumsum(_PIECE[data])[starts] if len(starts) else starts
        self.piece = np.cumsum(np.r_[0, (np.diff(self.text) != 0) | (np.diff(marks) != 0)]) if len(starts) else starts
        lengths = ends - starts
        self.ends = np.cumsum(lengths + 1) - 1
        self.starts = self.ends - lengths
        self.data = np.full(int(lengths.sum()) + len(lengths), 0x20, np.uint8)
        places = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.data[places + np.repeat(self.starts, lengths)] = data[places + np.repeat(starts, lengths)]


def _scans(batches: Iterator[pa.RecordBatch]) -> Iterator[Scan]:
    hasher, held, size = common.WordHasher(seed=11), [], 0
    for batch in batches:
        for part in common.slices(batch, "text", SLICE):
            held.append(part)
            size += pc.sum(pc.binary_length(part.column("text"))).as_py()
            if size >= SLICE:
                yield Scan(hasher, pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                held, size = [], 0
    if held:
        yield Scan(hasher, pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, bucket, n) of every word of texts (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for scan in _scans(batches):
            keys, first, n = np.unique(scan.keys, return_index=True, return_counts=True)
            words = gathered(scan.data, scan.starts[first], scan.ends[first])
            bucket = (keys & np.uint64((1 << ORDER_BITS) - 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([scan.langs.take(pa.array(scan.text[first])), words, pa.array(bucket), pa.array(n.astype(np.int64))], ["lang", "word", "bucket", "n"])

    rows = texts.mapInArrow(run, "lang string, word string, bucket int, n bigint")
    return rows.groupBy("lang", "word").agg(F.max("bucket").alias("bucket"), F.sum("n").alias("n"))


def order_table(words: DataFrame) -> np.ndarray:
    """Sums of word counts by bucket, packed in tasks into a bounded number of rows."""
    width = 1 << 12

    def run(key: tuple, group: pa.Table) -> pa.Table:
        sums = np.zeros(width, np.float32)
        sums[group.column("bucket").to_numpy() % width] = group.column("n").to_numpy()
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([sums.tobytes()], pa.binary())})

    table = np.zeros(1 << ORDER_BITS, np.float32)
    sums = words.groupBy("bucket").agg(F.sum("n").alias("n")).withColumn("block", F.shiftright("bucket", 12))
    for row in sums.groupBy("block").applyInArrow(run, "block int, sums binary").collect():
        table[row["block"] * width : (row["block"] + 1) * width] = np.frombuffer(row["sums"], np.float32)
    return table


def reaches(scan: Scan, table: np.ndarray, least: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(frequency, words to the left, words to the right, whether it can be a pivot) of each place."""
    seen, place = np.unique(scan.keys, return_inverse=True)
    weight = table[(seen & np.uint64((1 << ORDER_BITS) - 1)).astype(np.int64)]
    order = np.empty(len(seen), np.int64)
    order[np.lexsort((seen, weight))] = np.arange(len(seen))
    own, weight = order[place], weight[place]
    frequent = weight >= least
    left, right = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
    for d in range(1, longest):
        if d >= len(own):
            break
        same = (scan.piece[d:] == scan.piece[:-d]) & frequent[d:] & frequent[:-d]
        left[d:] += same & (left[d:] == d - 1) & (own[:-d] > own[d:])
        right[:-d] += same & (right[:-d] == d - 1) & (own[d:] >= own[:-d])
    return weight, left, right, frequent & (left + right > 0)


def fragments(texts: DataFrame, table: np.ndarray, least: int, longest: int, group: int) -> DataFrame:
    """(lang, pivot, salt, split, leads, counts, texts): fragments of one pivot in a row of their own: of
    each the number of words before the pivot (a byte), how often it is there (four bytes), and its words, with a line feed after."""
    sent = texts.sparkSession.sparkContext.broadcast(table)
    names = ["lang", "pivot", "salt", "split", "leads", "counts", "texts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for scan in _scans(batches):
            weight, left, right, pivot = reaches(scan, sent.value, least, longest)
            at = np.flatnonzero(pivot)
            left, right = left[at], right[at]
            digest = common.mixed(left.astype(np.uint64) + np.uint64(1))
            for d in range(1 - longest, longest):
                inside = (d >= -left) & (d <= right)
                digest[inside] = common.mixed(digest[inside] * np.uint64(0xD1342543DE82EF95) + scan.keys[at[inside] + d])
            digest, first, n = np.unique(digest, return_index=True, return_counts=True)
            at, left, right = at[first], left[first], right[first]
            groups = np.maximum(np.ceil(weight[at] / group).astype(np.uint64), 1)
            salt = digest % groups
            order = np.lexsort((salt, scan.keys[at]))
            at, left, right, n, salt, groups = (x[order] for x in (at, left, right, n, salt, groups))
            begin = np.flatnonzero(np.r_[True, (np.diff(scan.keys[at]) != 0) | (np.diff(salt) != 0)][: len(at)])
            starts, ends = scan.starts[at - left], scan.ends[at + right] + 1  # with the space after, which becomes a line feed
            offsets = np.r_[0, np.cumsum(ends - starts)]
            chars = scan.data[np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], ends - starts)]
            chars[offsets[1:] - 1] = 0x0A
            cuts = np.r_[begin, len(at)]
            columns = [
                scan.langs.take(pa.array(scan.text[at[begin]])), pa.array(scan.keys[at[begin]].view(np.int64)), pa.array(salt[begin].astype(np.int64)), pa.array(groups[begin] > 1),
                _packed(left.astype(np.uint8), cuts), _packed(n.astype("<u4").view(np.uint8), 4 * cuts), _packed(chars, offsets[cuts]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    return texts.mapInArrow(run, "lang string, pivot bigint, salt bigint, split boolean, leads binary, counts binary, texts binary")


def _packed(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _joined(column: pa.ChunkedArray) -> np.ndarray:
    """The bytes of a binary column in a row."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8)


def owned(rows: pa.Table, longest: int) -> pa.Table:
    """(lang, phrase, words, split, n): the n-grams of fragments that hold the pivot, counted."""
    data, lead = _joined(rows.column("texts")), _joined(rows.column("leads")).astype(np.int64)
    n = _joined(rows.column("counts")).view("<u4").astype(np.int64)
    row = np.repeat(np.arange(rows.num_rows), pc.binary_length(rows.column("leads")).to_numpy())
    starts, ends, first = common.word_spans(data, np.r_[0, np.flatnonzero(data == 0x0A) + 1], _GAP)
    after, pivot = np.diff(first) - 1 - lead, first[:-1] + lead
    own, begin, end, words = [], [], [], []
    for a in range(longest):
        for b in range(max(0, 1 - a), longest - a):
            some = np.flatnonzero((a <= lead) & (b <= after))
            own.append(some)
            begin.append(starts[pivot[some] - a])
            end.append(ends[pivot[some] + b])
            words.append(np.full(len(some), a + b + 1, np.int32))
    own = np.concatenate(own)
    made = {c: rows.column(c).take(pa.array(row[own])) for c in ("lang", "split")}
    made |= {"n": pa.array(n[own]), "phrase": gathered(data, np.concatenate(begin), np.concatenate(end)), "words": pa.array(np.concatenate(words))}
    return pa.table(made).group_by(["lang", "phrase", "words", "split"]).aggregate([("n", "sum")])


def mined(routed: DataFrame, least: int, longest: int) -> DataFrame:
    """(lang, phrase, words, n) counted pivot by pivot; of split pivots a count of each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += pc.sum(pc.binary_length(batch.column("leads"))).as_py() or 0
            if size >= CHUNK:
                rows = pa.Table.from_batches(held)
                pivot, salt = (rows.column(c).to_numpy() for c in ("pivot", "salt"))
                new = np.flatnonzero((np.diff(pivot) != 0) | (np.diff(salt) != 0))
                if len(new):  # the last group may go on in the next batch
                    yield from counted(rows.slice(0, new[-1] + 1))
                    rows = rows.slice(new[-1] + 1)
                held, size = rows.to_batches(), 0
        if held:
            yield from counted(pa.Table.from_batches(held))

    def counted(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        if rows.num_rows:
            found = owned(rows, longest)
            found = found.filter(pc.or_(found.column("split"), pc.greater_equal(found.column("n_sum"), least)))
            yield from found.select(["lang", "phrase", "words", "n_sum"]).rename_columns(["lang", "phrase", "words", "n"]).to_batches()

    rows = routed.repartition("pivot", "salt").sortWithinPartitions("pivot", "salt")
    return rows.mapInArrow(run, "lang string, phrase string, words int, n bigint")


def grams(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """Tables (lang, phrase, words, f) of all n-grams met at least `least` times, and (lang, n) of all words."""
    texts = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), common.text_of(text).alias("text"))
    words = common.write_table(word_counts(texts), "words")
    found = mined(fragments(texts, order_table(words), least, longest, group), least, longest)
    found = found.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    single = words.where(F.col("n") >= least).select("lang", F.col("word").alias("phrase"), F.lit(1).alias("words"), F.col("n").alias("f"))
    return common.write_table(found.unionByName(single), "grams"), words.groupBy("lang").agg(F.sum("n").alias("n"))


def _part(begin: str, size: str) -> Column:
    return F.expr(f"array_join(slice(w, {begin}, {size}), ' ')")


def scored(found: DataFrame) -> DataFrame:
    """(lang, phrase, a, score, l, r) of phrases of several words by their worst cut."""
    rows = found.where("words > 1").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"), F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    rows = rows.select("lang", "phrase", "a", "k", _part("1", "k").alias("first"), _part("k + 1", "size(w)").alias("rest"))
    for side, name in (("first", "l"), ("rest", "r")):
        rows = rows.join(found.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    score = F.expr("cast(a as decimal(20, 0)) * 2000000 div (cast(l as decimal(20, 0)) + r)")
    worst = rows.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return worst.select("lang", "phrase", "a", "cut.score", "cut.l", "cut.r")


def covered(found: DataFrame, percent: int) -> DataFrame:
    """(lang, phrase): phrases that a longer one holds and has at least `percent` percent of their count."""
    spans = F.expr("flatten(transform(sequence(2, words - 1), n -> transform(sequence(1, words - n + 1), i -> array_join(slice(split(phrase, ' '), i, n), ' '))))")
    inside = found.where("words > 2").select("lang", F.explode(spans).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    return inside.join(found, ["lang", "phrase"]).where(F.expr(f"100 * most >= {percent} * f")).select("lang", "phrase")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, percent: int = COVERED, group: int = GROUP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to `longest` words."""
    found, totals = grams(docs, text, lang, least, longest, group)
    rows = scored(found).join(covered(found, percent), ["lang", "phrase"], "left_anti")
    best = (F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("bigint")).where(F.col("rank") <= top)
    return rows.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(common.load(spark, sf_dir, "documents"))


OP11_SQL = """
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p
), g AS (
  SELECT lang, k AS words, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)
), t AS (
  SELECT lang, count(*) AS n FROM g WHERE words = 1 GROUP BY lang
), f AS (
  SELECT lang, words, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30
), c AS (
  SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, words)) AS k FROM f WHERE words > 1
), s AS (
  SELECT c.lang, c.phrase, c.words, c.a, c.k, x.f AS l, y.f AS r, ((2000000::HUGEINT * c.a) // (x.f + y.f))::BIGINT AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ')
), b AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS most
  FROM (SELECT DISTINCT lang, phrase, words, a, w, m, unnest(range(1, words - m + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS m) WHERE words > m) GROUP BY ALL
), k AS (
  SELECT b.* FROM b LEFT JOIN inside USING (lang, phrase) WHERE most IS NULL OR 100 * most < 80 * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM k JOIN t USING (lang) QUALIFY rank <= 2000
"""
