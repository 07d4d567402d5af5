"""SimHash near-dedup: fingerprints linked at few differing bits, by anchor points.

A bit of a fingerprint is set where more than half of the XXH64 values of a text's
shingles have it. Two fingerprints that differ in three bits at most differ in
one at most in one of their halves, so each half is anchored by itself. The
anchors are a covering code of the 32 bits of a half: the perfect Hamming code of
31 bits (radius 1) with either value of the last bit, so every half is within one bit of
exactly one nearest anchor, its home. A fingerprint goes to its home and to every
other anchor within two bits (the radius and the threshold), 16.5 a half on average; a linked pair meets at
the homes of both. At each anchor those at home are compared with all that are there.

An anchor of up to `small` fingerprints is compared in memory and gives at most a
spanning forest of its links. A larger one is compared through its hub, the
majority of its fingerprints bit by bit: a fingerprint is the set of its bits off
the hub, and sends a row for each way to leave out three of them or fewer. Two
sets that differ in three elements at most are found under what they have in common, and
all that are linked under one such key are linked to the one that left out
least. So rows grow with the members of an anchor, not with their pairs, and no
link is lost. Equal fingerprints are one node.

Defined results: null counts as empty; a text without words has the fingerprint
zero, linked like any other; a text of fewer words than a shingle is one shingle;
rows without an id are linked but never name a component (null where nothing
else is in it); rows that repeat an id are separate rows; an empty table gives
no rows; further columns of any name are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import common
from docketry.llm.components import components

SHINGLE, SEED = 3, 42
DISTANCE = 3
#: Anchors of so many fingerprints at most are compared in memory.
SMALL = 1024


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode().lower().split()  # of bytes: ASCII letters and ASCII white space alone
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    last = min(shingle, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[last:].tolist(), strict=False)), np.uint64)
    votes = np.zeros(64, np.int64)
    for part in np.array_split(hashes, len(hashes) // 65536 + 1):
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp) of every row; fp is the fingerprint as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text"):
                made = np.array([fingerprint(t.as_py(), shingle) for t in part.column("text")], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(made.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "id bigint, fp bigint")


# ---------------------------------------------------------------- anchor points

#: Bit i - 1 stands at place i, 1 to 31; the syndrome is the XOR of the places of set bits.
_PARITY = [np.uint64(sum(1 << (i - 1) for i in range(1, 32) if i >> b & 1)) for b in range(5)]
#: Of each syndrome the fifteen pairs of bits that lead to a code word two bits away.
_PAIRS = np.array([[0] * 15] + [[1 << (i - 1) | 1 << ((s ^ i) - 1) for i in range(1, 32) if 0 < s ^ i > i] for s in range(1, 32)], np.uint64)


def anchors_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, home, place of the fingerprint) of each fingerprint at each of its anchors."""
    anchor, home, place = [], [], []
    rows = np.arange(len(fps))
    for half in range(2):
        own = fps >> np.uint64(32 * half) & np.uint64(0xFFFFFFFF)
        code, last = own & np.uint64(0x7FFFFFFF), own & np.uint64(0x80000000)
        syndrome = sum((np.bitwise_count(code & p) & 1).astype(np.int64) << b for b, p in enumerate(_PARITY))
        nearest = code ^ np.where(syndrome > 0, np.uint64(1) << np.maximum(syndrome - 1, 0).astype(np.uint64), np.uint64(0))
        off = np.flatnonzero(syndrome > 0)
        far = (code[off][:, None] ^ _PAIRS[syndrome[off]] | last[off][:, None]).ravel()
        found = np.concatenate([nearest | last, nearest | last ^ np.uint64(0x80000000), far])
        anchor.append(found | np.uint64(half << 32))
        home.append(np.arange(len(found)) < len(fps))
        place.append(np.concatenate([rows, rows, np.repeat(off, 15)]))
    return np.concatenate(anchor), np.concatenate(home), np.concatenate(place)


def anchored(nodes: DataFrame) -> DataFrame:
    """(anchor, home, fp): a row for each anchor that a fingerprint of nodes goes to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy()
            anchor, home, place = anchors_of(fps.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(anchor.astype(np.int64)), pa.array(home), pa.array(fps[place])], ["anchor", "home", "fp"])

    return nodes.select("fp").mapInArrow(run, "anchor bigint, home boolean, fp bigint")


def forest(at_home: np.ndarray, others: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """At most one link fewer than there are fingerprints, which connect what the links of those at home connect."""
    every = np.concatenate([at_home, others])
    label, found = np.arange(len(every)), []
    for i, own in enumerate(at_home):
        near = np.flatnonzero(np.bitwise_count(every ^ own) <= distance)
        labels, first = np.unique(label[near], return_index=True)
        if len(labels) > 1:
            found += [(i, int(j)) for j in near[first] if label[j] != label[i]]
            label[np.isin(label, labels)] = labels[0]
    return found


def compared(members: DataFrame, distance: int) -> DataFrame:
    """(u, v): links of anchors of a bounded number of members, each anchor one row of two lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = [], []
            for at_home, others in zip(batch.column("at_home"), batch.column("others"), strict=True):
                at_home, others = (x.values.to_numpy().view(np.uint64) for x in (at_home, others))
                every = np.concatenate([at_home, others]).view(np.int64)
                for i, j in forest(at_home, others, distance):
                    u.append(every[i])
                    v.append(every[j])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    lists = members.groupBy("anchor").agg(F.collect_list(F.when(F.col("home"), F.col("fp"))).alias("at_home"), F.collect_list(F.when(~F.col("home"), F.col("fp"))).alias("others"))
    return lists.select("at_home", "others").mapInArrow(run, "u bigint, v bigint")


def _majority(fp: str) -> Column:
    bits = [f"shiftleft(cast(2 * sum(shiftrightunsigned({fp}, {i}) & 1) > count(1) as bigint), {i})" for i in range(64)]
    return F.expr(" | ".join(bits))


def subsets(bits: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(places, what is left, number left out) for each way to leave out `most` set bits or fewer."""
    size = np.bitwise_count(bits)
    for w in np.unique(size):
        rows = np.flatnonzero(size == w)
        left, single = bits[rows].copy(), np.zeros((len(rows), w), np.uint64)
        for k in range(w):
            single[:, k] = left & (~left + np.uint64(1))  # the lowest set bit
            left ^= single[:, k]
        for out in range(min(most, int(w)) + 1):
            chosen = np.array([*itertools.combinations(range(w), out)], np.int64)
            step = max(1, (1 << 18) // max(1, len(chosen)))
            for begin in range(0, len(rows), step):
                own, part = rows[begin : begin + step], single[begin : begin + step]
                gone = np.bitwise_or.reduce(part[:, chosen], axis=2) if out else np.zeros((len(own), 1), np.uint64)
                yield np.repeat(own, len(chosen)), (bits[own][:, None] ^ gone).ravel(), out


def by_hub(members: DataFrame, distance: int, tables: common.Scratch) -> DataFrame:
    """(u, v): links of anchors of any number of members, as stars under what the sets of bits off a hub have in common."""
    hubs = tables.write(members.groupBy("anchor").agg(_majority("fp").alias("hub")), "hubs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchor, fps = batch.column("anchor").to_numpy(), batch.column("fp").to_numpy()
            for own, key, out in subsets(fps.view(np.uint64) ^ batch.column("hub").to_numpy().view(np.uint64), distance):
                yield pa.RecordBatch.from_arrays([pa.array(anchor[own]), pa.array(key.view(np.int64)), pa.array(np.full(len(own), out, np.int32)), pa.array(fps[own])], ["anchor", "key", "out", "fp"])

    keyed = tables.write(members.join(hubs, "anchor").select("anchor", "fp", "hub").mapInArrow(run, "anchor bigint, key bigint, out int, fp bigint"), "keyed")
    least = keyed.groupBy("anchor", "key").agg(F.min(F.struct("out", "fp")).alias("least"), F.count("*").alias("n"))
    least = tables.write(least.where(f"n > 1 and least.out <= {distance // 2}").drop("n"), "least")
    near = keyed.join(least, ["anchor", "key"]).where((F.col("out") + F.col("least.out") <= distance) & (F.col("fp") != F.col("least.fp")))
    return near.select(F.col("fp").alias("u"), F.col("least.fp").alias("v"))


def links(nodes: DataFrame, distance: int = DISTANCE, small: int = SMALL) -> DataFrame:
    """(u, v): links that connect what all pairs of at most `distance` (3 or fewer) differing bits connect."""
    if not 0 <= distance <= 3:
        raise ValueError("the anchors of halves serve distances up to 3")
    tables = common.Scratch(nodes.sparkSession)
    sizes = anchored(nodes).groupBy("anchor").agg(F.count("*").alias("c"), F.max("home").alias("any"))
    sizes = tables.write(sizes.where("c > 1 and any").select("anchor", "c"), "sizes")
    maybe = common.with_maybe(anchored(nodes), F.col("anchor"), sizes.select("anchor")).where("_maybe").drop("_maybe")
    members = tables.write(maybe.join(sizes, "anchor"), "members")
    found = compared(members.where(F.col("c") <= small), distance)
    large = members.where(F.col("c") > small)
    if large.take(1):
        found = found.unionAll(by_hub(large.drop("c", "home"), distance, tables))
    return found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def near_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", distance: int = DISTANCE, shingle: int = SHINGLE, small: int = SMALL) -> DataFrame:
    """One row a document: id, fingerprint (16 hexadecimal digits) and component_id, the smallest id reachable over links."""
    prints = common.write_table(fingerprints(docs, id_col, text, shingle), "prints")
    nodes = common.write_table(prints.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    labels = components(links(nodes, distance, small)).select(F.col("node").alias("fp"), "label")
    tied = common.write_table(labels.join(nodes, "fp"), "tied")  # nodes that have a link
    classes = tied.join(tied.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("fp", "component_id")
    named = nodes.join(classes, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    found = prints.join(common.write_table(named, "named"), "fp")
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op13_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(common.load(spark, sf_dir, "documents"))
