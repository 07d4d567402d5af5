"""Near-duplicate groups by DartMinHash signatures and a banded join.

An element of weight w is w unit regions. Each region is hit by darts, a Poisson
process over rank made of hashes of the region and the dart's number; each
dart has a coordinate, and a text keeps the earliest dart of each coordinate. A text
throws only the darts of rank below (ln k + 3) k / weight, about k (ln k + 3) of
them at any length; two texts agree on a coordinate with the probability of
their weighted Jaccard similarity. Weights are 1 for each distinct shingle
("set") or its count ("count").

Texts of equal weighted shingles are one node, known by a 64-bit digest. All nodes of a band bucket are
candidates of each other, but only links between different classes matter, so a
bucket is compared with one hub, the node most of whose shingles others have
too. Two nodes that stay in different classes can then be linked only if they
share enough of the hub (sizes tell) or a shingle off the hub (a prefix of the
rarest ones tells); those form smaller groups, which go the same way with the
shingles of all their hubs set aside; of groups of the same nodes one is kept.
Of the nodes that share the same part of what is set aside, the smallest stands
for all that are linked to it; what stands for others, and small groups, are compared
in memory, on whole shingle sets, and give a link fewer than they have nodes at most. So no
pairs are written, no link is lost to the size of a bucket, and rows stay in
proportion to nodes. (Where far more than HALF_BLOCK nodes with different parts of
one hub stay in different classes, each is sent once for each block of the others.)

Defined results: words are lower-cased (ASCII) runs without white space; a text
of fewer than five words is one shingle; a text without words (or null) is
linked to none; rows without an id are a class of their own, null; rows of one
id belong to one class. The class id is the smallest id in the class, its size
the number of its rows. An empty table gives no rows; further columns of any
name are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import common
from docketry.llm.components import components

SHINGLE = 5
LEAST = 0.8
BANDS, ROWS = 24, 4
#: Groups of so many nodes at most are compared in pairs.
SMALL = 200
#: Half of the nodes, and of their shingles, of a larger group that are compared in memory at once.
HALF_BLOCK, HALF_SHINGLES = 512, 1 << 21


def _hasher() -> common.WordHasher:
    return common.WordHasher(seed=5, lower=True)


def regions(hasher: common.WordHasher, column: pa.Array, shingle: int, weights: str) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each unit region, in the order of both."""
    data, offsets = common.text_buffer(column)
    texts, values = common.shingle_hashes(hasher, data, offsets, shingle)
    order = np.lexsort((values, texts))
    texts, values = texts[order], values[order]
    new = np.ones(len(values), bool)
    new[1:] = (texts[1:] != texts[:-1]) | (values[1:] != values[:-1])
    if weights == "set":
        return texts[new], values[new]
    begins = np.flatnonzero(new)
    number = np.arange(len(values)) - np.repeat(begins, np.diff(np.r_[begins, len(values)]))
    values = np.where(number > 0, common.mixed(values + number.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)), values)
    order = np.lexsort((values, texts))
    return texts[order], values[order]


def dart_signatures(texts: np.ndarray, values: np.ndarray, n: int, k: int) -> np.ndarray:
    """n x k ranks of the earliest darts; infinite where no dart fell."""
    weight = np.bincount(texts, minlength=n)
    limit = (math.log(k) + 3) * k / np.maximum(weight, 1)
    best = np.full(n * k, np.inf)
    rank, own, cell, number = np.zeros(len(values)), texts, values, 0
    while len(own):
        number += 1
        h = common.mixed(cell ^ np.uint64((number * 0x9FB21C651E98DF25) % 2**64))
        rank = rank - np.log1p(-((h >> np.uint64(11)) * 2.0**-53))
        alive = rank <= limit[own]
        rank, own, cell, h = rank[alive], own[alive], cell[alive], h[alive]
        np.minimum.at(best, own * k + ((h & np.uint64(2047)) % np.uint64(k)).astype(np.int64), rank)
    return best.reshape(n, k)


def signatures(rows: DataFrame, bands: int, per_band: int, shingle: int, weights: str) -> DataFrame:
    """(id, node, n, bands): digest and weight of the shingles (of the id where there are none), and the band hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _hasher()
        for batch in batches:
            for part in common.slices(batch, "text"):
                yield of_slice(hasher, part)

    def of_slice(hasher: common.WordHasher, part: pa.RecordBatch) -> pa.RecordBatch:
        n = part.num_rows
        texts, values = regions(hasher, part.column("text"), shingle, weights)
        first = np.searchsorted(texts, np.arange(n + 1))
        ids = part.column("id").to_numpy().astype(np.uint64)
        node = np.where(np.diff(first) > 0, _digest(values, first), common.mixed(ids ^ np.uint64(0xCC9E2D51)))
        ranks = dart_signatures(texts, values, n, bands * per_band).reshape(n * bands, per_band)
        bits = ranks.view(np.uint64)
        total = np.tile(np.arange(1, bands + 1, dtype=np.uint64), n)
        for j in range(per_band):
            total = common.mixed(total * np.uint64(0xD1342543DE82EF95) + bits[:, j])
        full = np.isfinite(ranks).all(axis=1)
        ends = np.r_[0, np.cumsum(full.reshape(n, bands).sum(axis=1))].astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(total[full].view(np.int64)))
        return pa.RecordBatch.from_arrays([part.column("id"), pa.array(node.view(np.int64)), pa.array(np.diff(first).astype(np.int32)), lists], ["id", "node", "n", "bands"])

    return rows.mapInArrow(common.tidy(run), "id bigint, node bigint, n int, bands array<bigint>")


def shingle_sets(rows: DataFrame, shingle: int, weights: str) -> DataFrame:
    """(node, shingles): all hashes of each text, distinct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _hasher()
        for batch in batches:
            for part in common.slices(batch, "text"):
                texts, values = regions(hasher, part.column("text"), shingle, weights)
                first = np.searchsorted(texts, np.arange(part.num_rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(_digest(values, first).view(np.int64)), lists], ["node", "shingles"])

    return rows.mapInArrow(common.tidy(run), "node bigint, shingles array<bigint>")


def _digest(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Order-free digest of the hashes of each text, 0 for none."""
    out = np.zeros(len(first) - 1, np.uint64)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        out[some] = common.mixed(np.add.reduceat(common.mixed(values ^ np.uint64(0x1B873593)), first[some]))
    return out


def bucketed(nodes: DataFrame, tables: common.Scratch) -> DataFrame:
    """(band, node, n, id, c): the members of buckets that hold several nodes, and how many."""
    buckets = nodes.select("node", "n", "id", F.explode("bands").alias("band"))
    shared = tables.write(buckets.groupBy("band").agg(F.count("*").alias("c")).where("c > 1"), "shared")
    maybe = common.with_maybe(buckets, F.col("band"), shared.select("band")).where("_maybe").drop("_maybe")
    return tables.write(maybe.join(shared, "band"), "members")


def known_shingles(rows: DataFrame, members: DataFrame, least: float, shingle: int, weights: str, tables: common.Scratch) -> DataFrame:
    """(node, n, m, rank, w): w has the shingles of a member that other members have too, m of its n, the rarest first.

    Nodes with too few of them to be similar to any other are left out.
    """
    asked = tables.write(members.groupBy("node").agg(F.max("n").alias("n"), F.sum("c").alias("rank"), F.min("id").alias("id")), "asked")
    some = common.with_maybe(rows, F.col("id"), asked.select("id"), bits_a_key=64).where("_maybe").select("text")
    sets = tables.write(shingle_sets(some, shingle, weights), "sets")  # with a few that are not asked for, which do no harm
    each = sets.select("node", F.explode("shingles").alias("s"))
    counted = each.groupBy("s").agg(F.count("*").alias("c"), F.min("node").alias("a"), F.max("node").alias("b"))
    counted = tables.write(counted.where("a <> b").select("s", F.col("c").cast("int").alias("c")), "known")
    own = each.join(counted, "s").groupBy("node").agg(F.array_sort(F.collect_set(F.struct("c", "s"))).alias("w"))
    own = own.join(asked, "node").select("node", "n", F.size("w").alias("m"), "rank", F.transform("w", lambda x: x["s"]).alias("w"))
    made = tables.write(own.where(F.col("m") >= least * F.col("n")), "weighed")
    tables.drop(sets, counted)
    return made


def links(rows: DataFrame, nodes: DataFrame, tied: DataFrame, least: float, shingle: int, weights: str, small: int = SMALL) -> DataFrame:
    """(node, label): the class of each node that has a link; tied (u, v) are links known before."""
    tables = common.Scratch(rows.sparkSession)
    share = least / (1 + least)  # of the sizes of two nodes, what they have in common where they are linked
    members = bucketed(nodes, tables)
    weighed = known_shingles(rows, members, least, shingle, weights, tables)
    central = F.struct(F.col("m") / F.col("n"), F.col("rank"), F.xxhash64("node"), F.col("node"))
    alive = tables.write(members.select("band", "node").join(weighed.drop("w"), "node"), "alive")
    hubs = tables.write(alive.groupBy("band").agg(F.max_by("node", central).alias("hub"), F.count("*").alias("c")).where("c > 1").drop("c"), "hubs")
    asked = alive.join(hubs, "band").where("node <> hub").select(F.xxhash64("hub").alias("g"), "hub", "node").distinct()
    asked = tables.write(asked, "asked")
    kept = weighed.select(F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("w").alias("hub_w"))
    groups = asked.select("g", "hub").distinct().join(kept, "hub").withColumn("aside", F.col("hub_w"))
    found, labels, level = tied, None, 0
    while True:
        groups = tables.write(groups, "groups")
        met = tables.write(_met(asked, groups, weighed, least), "met")
        found = found.unionAll(met.where("linked").select(F.col("node").alias("u"), F.col("hub").alias("v")))
        if labels is None:  # later links are few, and spare no work worth their classes
            labels = tables.write(components(found), "labels")
        left = _labelled(met, labels)
        left = tables.write(_several(left), "left")
        if not left.take(1):
            break
        off = left.select("g", "node", "label", F.explode("off").alias("s"))
        first = off.groupBy("g", "s").agg(F.min("node").alias("hub"), F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("g", "s", "hub")
        off = off.join(tables.write(first, "first"), ["g", "s"]).select("g", F.xxhash64("g", "hub").alias("sub"), "hub", "node", "label").distinct()
        off = tables.write(off, "off")  # a group has what shares such a shingle with its first node
        shared = off.groupBy("sub").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
        shared = tables.write(shared.groupBy("c", "x", "y").agg(F.min("sub").alias("sub")), "shared")  # of groups of the same nodes one is enough
        off = tables.write(off.join(shared.select("sub", "c"), "sub"), "off")
        few = off.where(F.col("c") <= small).select(F.col("sub").alias("key"), "node")
        more = tables.write(_compared(_inside(left, least, share, tables).unionAll(few), weighed, least), "links")
        found = found.unionAll(more)
        many = off.where(F.col("c") > small).select(F.col("sub").alias("g"), F.col("g").alias("above"), "hub", "node", "label")
        level += 1
        if not many.take(1):
            break
        if level == 1:
            labels = _relabelled(more, labels, tables)
            names = labels.select("node", F.col("label").alias("_now"))
            many = _several(many.join(names, "node", "left").withColumn("label", F.coalesce("_now", "label")).drop("_now"))
        chosen = tables.write(many.groupBy("g").agg(F.max("hub").alias("hub"), F.max("above").alias("above")), "chosen")
        asked = tables.write(many.where("node <> hub").select("g", "node"), "asked")
        before = groups.select(F.col("g").alias("above"), F.col("aside").alias("before"))
        groups = chosen.join(before, "above").join(kept, "hub").select("g", "hub", "hub_n", "hub_w", F.array_union("before", "hub_w").alias("aside"))
        if level % 4 == 0:  # so that the plan of the union stays short
            found = tables.write(found, "links")
    if level:
        labels = _relabelled(found, labels, tables)
    tables.drop(members, alive, weighed)
    return labels


def _met(asked: DataFrame, groups: DataFrame, weighed: DataFrame, least: float) -> DataFrame:
    """Nodes and the hubs of their groups: linked or not, a shingles of what is set aside, and the rarest off it.

    A node similar enough to another shares one of the latter with it, or only
    shingles that are set aside.
    """
    both = asked.select("g", "node").join(weighed.drop("rank"), "node").join(groups, "g")
    both = both.withColumn("_i", F.size(F.array_intersect("w", "hub_w"))).withColumn("a", F.size(F.array_intersect("w", "aside")))
    wanted = F.greatest(F.lit(1), F.ceil(least * F.col("n") - 1e-6).cast("int") - F.col("a"))
    first = F.col("n") - F.col("a") - wanted + 1 - (F.col("n") - F.col("m"))  # the rarest n - m are of no other node
    off = F.slice(F.array_except("w", "aside"), F.lit(1), F.greatest(first, F.lit(0)))
    pat = F.xxhash64(F.array_intersect("w", "aside"))  # all w are in one order
    return both.select("g", "node", "n", "hub", pat.alias("pat"), (F.col("_i") >= least * (F.col("n") + F.col("hub_n") - F.col("_i"))).alias("linked"), "a", off.alias("off"))


def _inside(left: DataFrame, least: float, share: float, tables: common.Scratch) -> DataFrame:
    """(key, node): groups, of bounded size, of the nodes that may be linked by shingles that are set aside alone.

    Nodes of one set of those (pat) differ in nothing that counts here but size,
    so one of fewest shingles stands for all that are linked to it, which are given under a key of two. Only
    what stands for others and what is linked to none are compared with each other, in blocks where they are many.
    """
    inside = left.where(F.col("a") >= least * F.col("n") - 1e-6).select("g", "node", "n", "a", "pat", "label")
    bounds = inside.groupBy("g").agg(F.max(F.col("a") / share - F.col("n")).alias("most"), F.min("n").alias("fewest"))
    inside = inside.join(bounds, "g").where((F.col("n") <= F.col("most") + 1e-6) & (F.col("fewest") <= F.col("a") / share - F.col("n") + 1e-6))
    first = tables.write(inside.groupBy("g", "pat").agg(F.min(F.struct("n", "node", "label")).alias("first")), "first")
    inside = tables.write(inside.join(first, ["g", "pat"]).withColumn("near", F.col("a") >= share * (F.col("n") + F.col("first.n")) - 1e-6), "inside")
    star = inside.where(F.col("near") & (F.col("label") != F.col("first.label"))).withColumn("key", F.xxhash64("g", "pat", "node"))
    star = star.select("key", F.explode(F.array("node", "first.node")).alias("node"))
    stands = inside.where(~F.col("near") | (F.col("node") == F.col("first.node")))
    sizes = stands.groupBy("g").agg(F.count("*").alias("c"), F.max("n").alias("n"), F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y")
    half = F.greatest(F.lit(8), F.least(F.lit(HALF_BLOCK), F.floor(HALF_SHINGLES / F.col("n")).cast("int")))
    sizes = tables.write(sizes.select("g", F.ceil(F.col("c") / half).cast("int").alias("blocks")), "sizes")
    stands = stands.join(sizes, "g").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.when(F.col("blocks") <= 2, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("block")))
    stands = stands.select("g", "node", "blocks", "block", F.explode(other).alias("other"))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    key = F.when(F.col("blocks") <= 2, F.xxhash64("g")).otherwise(F.xxhash64("g", low, high))
    return star.unionAll(stands.select(key.alias("key"), "node"))


def _compared(groups: DataFrame, weighed: DataFrame, least: float) -> DataFrame:
    """(u, v): links that connect what all pairs of each group (key, node) connect; a group is compared in memory and gives a link fewer than it has nodes at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            keys = batch.column("key").to_numpy()
            cuts = np.flatnonzero(np.diff(keys)) + 1
            for begin, end in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if end > begin:
                    if keys[begin] != key:
                        yield from one(held)
                        key, held = keys[begin], []
                    held.append(batch.slice(begin, end - begin))
        yield from one(held)

    def one(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = np.concatenate([x.column("node").to_numpy() for x in parts]) if parts else np.zeros(0, np.int64)
        if len(nodes) > 1:
            sizes = np.concatenate([x.column("n").to_numpy() for x in parts])
            counts = np.concatenate([x.column("w").value_lengths().to_numpy() for x in parts])
            values = np.concatenate([x.column("w").flatten().to_numpy() for x in parts])
            links = forest(sizes, counts, values, least)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[[i for i, _ in links]]), pa.array(nodes[[j for _, j in links]])], ["u", "v"])

    rows = groups.distinct().join(weighed.select("node", "n", "w"), "node")
    return rows.repartition("key").sortWithinPartitions("key").select("key", "node", "n", "w").mapInArrow(common.tidy(run), "u bigint, v bigint")


def forest(sizes: np.ndarray, counts: np.ndarray, values: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links (i, j) of sets of sizes[i] elements, counts[i] of which are given in values, that connect what all similar pairs connect."""
    ends = np.cumsum(counts)
    _, place = np.unique(values, return_inverse=True)
    label, links = np.arange(len(sizes)), []
    for i in range(len(sizes) - 1):
        mine = np.zeros(place.max() + 1 if len(place) else 1, np.int64)
        mine[place[ends[i] - counts[i] : ends[i]]] = 1
        total = np.r_[0, np.cumsum(mine[place[ends[i] :]])]
        both = total[ends[i + 1 :] - ends[i]] - total[ends[i:-1] - ends[i]]
        linked = i + 1 + np.flatnonzero(both >= least * (sizes[i] + sizes[i + 1 :] - both))
        labels, first = np.unique(label[linked], return_index=True)
        for j in linked[first]:
            if label[j] != label[i]:
                links.append((i, int(j)))
                label[label == label[j]] = label[i]
    return links


def _several(rows: DataFrame) -> DataFrame:
    """rows (g, label, ...) of the groups of several classes."""
    several = rows.groupBy("g").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("g")
    return rows.join(several, "g", "left_semi")


def _relabelled(found: DataFrame, labels: DataFrame, tables: common.Scratch) -> DataFrame:
    """labels after the links found (u, v), those within a class left out."""
    old = labels.select(F.col("node").alias("u"), F.col("label").alias("v"))
    new = found.where("u <> v").select("u", "v").join(old.withColumnRenamed("v", "a"), "u", "left").join(old.select(F.col("u").alias("v"), F.col("v").alias("b")), "v", "left")
    new = tables.write(new.where("not (a <=> b) or a is null").select(F.coalesce("a", "u").alias("u"), F.coalesce("b", "v").alias("v")).distinct(), "links")
    return tables.write(components(new.unionAll(old)), "labels") if new.take(1) else labels


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with the class of their node as label."""
    return rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: float = LEAST, shingle: int = SHINGLE, weights: str = "set", bands: int = BANDS, per_band: int = ROWS, small: int = SMALL) -> DataFrame:
    """One row a document: id, class_id, class_size, kept (of the rows with the smallest id of the class)."""
    tables = common.Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("text"))
    named = rows.where("id is not null")
    signed = tables.write(signatures(named, bands, per_band, shingle, weights), "signatures")
    nodes = signed.where("n > 0").groupBy("node").agg(F.min("id").alias("id"), F.max("n").alias("n"), F.any_value("bands").alias("bands"))
    nodes = tables.write(nodes, "nodes")
    several = tables.write(signed.groupBy("id").agg(F.min("node").alias("u"), F.max("node").alias("last")).where("u <> last").select("id", "u"), "several")
    tied = tables.write(signed.select("id", "node").join(several, "id").where("node <> u").select("u", F.col("node").alias("v")), "tied")
    labels = links(named, nodes, tied, least, shingle, weights, small)
    every = tables.write(_labelled(signed.select("id", "node"), labels).select("id", "label"), "classes")
    classes = tables.write(every.groupBy("label").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size")), "sizes")
    found = every.join(classes, "label").select(F.col("id").alias(id_col), "class_id", "class_size")
    none = rows.where("id is null").select(F.col("id").alias(id_col), F.lit(None).cast("bigint").alias("class_id"), F.lit(1).cast("bigint").alias("class_size"))
    tables.drop(signed, nodes)
    return found.unionAll(none).withColumn("kept", F.coalesce(F.col(id_col) == F.col("class_id"), F.lit(True)))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each class, the one with the smallest id; rows of one id count as one document, the first by text.

    Rows without an id, and each text without words, stay. Further columns of any
    name are passed on; an empty table gives an empty one.
    """
    fate = common.write_table(near_groups(docs, id_col, text), "fate")
    ids = fate.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.count("*").alias("_same"), F.min(F.col(id_col) == F.col("class_id")).alias("_stays"))
    touched = common.write_table(ids.where("_same > 1 or not _stays"), "touched")
    rows = docs.select(F.struct("*").alias("doc"), F.col(id_col).cast("bigint").alias("own_id"), common.text_of(text).alias("own_text"))
    rows = common.with_maybe(rows, F.col("own_id"), touched.select("_id"))
    met = rows.where("_maybe").join(touched, F.col("own_id") == F.col("_id"), "left")
    first = met.where("_stays").groupBy("own_id").agg(F.min_by("doc", "own_text").alias("doc"))
    return rows.where("not _maybe").select("doc").unionAll(met.where("_same is null").select("doc")).unionAll(first.select("doc")).select("doc.*")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(common.load(spark, sf_dir, "documents"))
