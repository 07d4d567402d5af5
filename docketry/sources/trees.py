"""JSON trees of any depth as rows, level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.sources.tables import scratch_folder

#: Levels that one job goes down.
LEVELS = 4
#: The members of each object or array; scalars stay as they are, and what is empty goes.
_LEVEL = """
    SELECT l.key AS key, CASE WHEN NOT l.inner THEN l.path WHEN t.key IS NULL THEN l.path || '[' || t.pos || ']' ELSE l.path || '.' || t.key END AS path, coalesce(t.key, l.name) AS name,
           CASE WHEN l.inner THEN t.value ELSE l.tree END AS tree
    FROM {level} l, LATERAL variant_explode_outer(CASE WHEN l.inner THEN l.tree END) t WHERE NOT l.inner OR t.pos IS NOT NULL"""
#: Objects and arrays are told by their direct members, without a look at what is in those.
_INNER = "try_variant_get(tree, '$', 'array<variant>') IS NOT NULL OR try_variant_get(tree, '$', 'map<string, variant>') IS NOT NULL"


def leaves(rows: DataFrame, key: str, json: str, without: tuple[str, ...] = ()) -> DataFrame:
    """(key, path, name, kind, value): every scalar of each JSON text, whatever its depth; name is the last key of its path.

    Subtrees under the names of `without` are left out. JSON nulls are scalars of kind
    VOID; texts that are no JSON, and those of one scalar alone, have no rows. A text is
    parsed once. Each LEVELS levels are one table, so there are as many jobs as the deepest tree
    has levels, by LEVELS.
    """
    spark = rows.sparkSession
    folder, depth, done = scratch_folder(spark, "trees"), 0, None
    level = rows.select(F.col(key).alias("key"), F.lit("$").alias("path"), F.lit(None).cast("string").alias("name"), F.try_parse_json(F.col(json)).alias("tree")).where("tree is not null")
    level = level.withColumn("inner", F.expr(_INNER)).where("inner")
    while True:
        depth += 1
        for _ in range(LEVELS):
            level = spark.sql(_LEVEL, level=level)
            if without:
                level = level.where(~F.coalesce(F.col("name").isin(*without), F.lit(False)))
            level = level.withColumn("inner", F.expr(_INNER))
        level.write.parquet(f"{folder}/{depth}")
        found = spark.read.schema(level.schema).parquet(f"{folder}/{depth}")
        flat = found.where("not inner").select("key", "path", "name", F.expr("schema_of_variant(tree)").alias("kind"), F.expr("try_variant_get(tree, '$', 'string')").alias("value"))
        done = flat if done is None else done.unionAll(flat)
        level = found.where("inner")
        if not level.take(1):
            return done.withColumnRenamed("key", key)
