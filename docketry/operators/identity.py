"""One person under several identifiers: records linked by any identifier they share, and by chains of such links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.functions import compare, text
from docketry.sources.tables import scratch_folder


def connected(links: DataFrame) -> DataFrame:
    """(node, least) of links (u, v): the smallest node that each node with a link reaches.

    In turn, all larger neighbours of a node, and then all smaller ones, are tied to
    the least of its neighbours; each turn is a table, so that lost executors cost a
    re-read and a node of very many links is split by the join.
    """
    spark = links.sparkSession
    folder, turns = scratch_folder(spark, "links"), 0

    def table(rows: DataFrame) -> DataFrame:
        nonlocal turns
        turns += 1
        rows.write.parquet(f"{folder}/{turns}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/{turns}")

    def tied(rows: DataFrame, larger: bool) -> DataFrame:
        least = table(rows.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least")))
        wanted = rows.where("v > u") if larger else rows
        to = wanted.join(least, "u").where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
        return to if larger else to.unionAll(least.where("u <> least").select("u", F.col("least").alias("v")))

    now, mark = table(links.where("u <> v").select("u", "v").distinct()), None
    while True:
        spread = table(tied(now.unionAll(now.select("v", "u")), True).distinct())
        now = table(tied(spread.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), False).distinct())
        before, mark = mark, now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("least")).unionAll(now.select("v", "v").distinct())


def linked(records: DataFrame, row: str, case: list[str], ids: list[str], single: tuple[str, ...] = ()) -> DataFrame:
    """(case, row, identity, records, conflict): who a record is of.

    Records of a case that share an identifier, or are joined by a chain of
    such, are of one person, named by the smallest identifier among them. Where
    a person would have two values of a field of `single`, the chain is wrong somewhere, and all its records
    are marked as in conflict. Blank identifiers are none; records without any
    are left out. row is unique.
    """
    cells = F.explode(F.array_compact(F.array(*[F.when(~compare.blank(F.col(c)), F.struct(F.lit(c).alias("field"), F.concat(F.lit(f"{c}:"), text.compact(F.col(c))).alias("id"))) for c in ids])))
    keys = records.select(*case, row, cells.alias("_c")).select(*case, row, "_c.*").withColumn("node", F.concat_ws("|", *[F.col(c).cast("string") for c in case], "id"))
    first = keys.groupBy(*case, row).agg(F.min("node").alias("u"))
    chains = connected(keys.join(first, [*case, row]).select("u", F.col("node").alias("v")))
    named = first.join(chains, F.col("u") == F.col("node"), "left").select(*case, row, F.coalesce("least", "u").alias("_least"))
    several = keys.where(F.col("field").isin(*single)).select("node", "field").distinct().join(chains, "node", "left").withColumn("_least", F.coalesce("least", "node"))
    several = several.groupBy("_least", "field").agg(F.count("*").alias("n")).where("n > 1").select("_least").distinct().withColumn("conflict", F.lit(True))
    sizes = named.groupBy("_least").agg(F.count("*").alias("records"))
    found = named.join(sizes, "_least").join(several, "_least", "left")
    return found.select(*case, row, F.element_at(F.split("_least", "\\|"), -1).alias("identity"), "records", F.coalesce("conflict", F.lit(False)).alias("conflict"))
