"""Table readers and tolerant JSON readers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def load_stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The table's files as a stream; a file source asks for a folder, so a table of one file is read by its name in the folder above."""
    path, reader = f"{sf_dir}/{table}.parquet", spark.readStream.schema(load(spark, sf_dir, table).schema)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(place).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


def pages_of(df: DataFrame, application: str, number: str, text: str) -> DataFrame:
    """Any table as pages (application_id, page_number, text)."""
    return df.select(F.col(application).alias("application_id"), F.col(number).cast("int").alias("page_number"), F.col(text).alias("text"))


def page_kind(text: Column, least: int = 50) -> Column:
    """digital where the page has a text layer of more than `least` characters."""
    return F.when(F.length(F.trim(F.coalesce(text, F.lit("")))) > least, "digital").otherwise("scanned")


def json_object(text: Column, schema: str) -> Column:
    """The first JSON object in a text, or null."""
    return F.from_json(F.regexp_extract(text, "(?s)(\\{.*\\})", 1), schema)


def partner_pages(docs: DataFrame, payload: str) -> DataFrame:
    """Partner OCR results, a JSON object of document type to {pages: [{page, text, confidence}]}, as page rows."""
    schema = "map<string, struct<pages: array<struct<page:int, text:string, confidence:double>>>>"
    rows = docs.select("*", F.explode(F.from_json(F.col(payload), schema)).alias("document_type", "_d")).withColumn("_p", F.explode("_d.pages"))
    return rows.select(*docs.columns, "document_type", F.col("_p.page").alias("page_number"), F.col("_p.text").alias("text"), F.coalesce("_p.confidence", F.lit(1.0)).alias("confidence"))


def unfinished(pages: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Pages that no checkpoint has yet."""
    return pages.join(done.select(*keys).distinct(), keys, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Both tables with the newest row of each key."""
    both = old.unionByName(new, allowMissingColumns=True)
    others = [c for c in both.columns if c not in keys]
    rows = both.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(version)).alias("_r"))
    return rows.select(*keys, *[F.col("_r")[c].alias(c) for c in others])


def overwrite_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Replaces only the partitions that df holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def archive(df: DataFrame, key: str) -> DataFrame:
    """One JSON document a key with all its rows."""
    return df.groupBy(key).agg(F.to_json(F.sort_array(F.collect_list(F.struct(*df.columns)))).alias("archive"))


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one named by spark.checkpoint.dir; in a temporary one only where it is unset and all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="docketry-")
    path = f"{root.rstrip('/')}/docketry-{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    files.mkdirs(place)
    files.deleteOnExit(place)  # when the application ends
    return path
