"""Queries that run a table as a stream, in two runs from one checkpoint, each with the SQL twin of its batch form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docketry.plans import page_type_queries
from docketry.sources.tables import load, load_stream, scratch_folder
from docketry.streaming import machines

_LATE = "1 hour"


def _replayed(spark: SparkSession, sf: str, table: str, time: str, made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream over the table gives: one run over its files, then another run, from the checkpoint, over a row of a far later time, which ends what waits."""
    folder, schema = scratch_folder(spark, f"replay-{table}"), load(spark, sf, table).schema
    end = f"{folder}/end"
    spark.createDataFrame([], schema).write.parquet(end)

    def run() -> StructType:
        out = made(load_stream(spark, sf, table).unionAll(spark.readStream.schema(schema).parquet(end)))
        machines.run_to_end(out, f"{folder}/out", f"{folder}/checkpoint")
        return out.schema

    run()
    last = F.to_timestamp(F.lit("2100-01-01")).cast(schema[time].dataType)
    spark.range(1).select(*[(last if f.name == time else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema]).write.mode("append").parquet(end)
    return spark.read.schema(run()).parquet(f"{folder}/out")


def job_retries_streamed(spark: SparkSession, sf: str) -> DataFrame:
    """Attempts of each user's jobs, and the retries that came due before the next event, by a stream with timers."""
    rows = _replayed(spark, sf, "events", "ts", lambda events: machines.job_stream(events, "user_id", "ts", "event_id", F.coalesce(F.col("event_type") == "error", F.lit(False)), _LATE))
    return rows.select(F.col("job").alias("user_id"), F.col("at").alias("at_ms"), F.col("event").alias("event_id"), "attempt", "next", "wait_seconds")


def page_types_streamed(spark: SparkSession, sf: str) -> DataFrame:
    """Types of the pages of each file by the eleven rules, by a stream."""

    def made(orders: DataFrame) -> DataFrame:
        pages = orders.selectExpr("o_orderdate", *[f"{e} AS {n}" for n, e in page_type_queries.SEQUENCE.items()])
        at = F.coalesce(F.timestamp_seconds(1_700_000_000 + F.col("page")), F.to_timestamp(F.lit("2100-01-01")))
        return machines.page_stream(pages.withColumn("at", at), "app", "page", "at", _LATE, flags=page_type_queries._flags())

    rows = _replayed(spark, sf, "orders", "o_orderdate", made)
    return rows.select(F.col("document").alias("app"), "page", "document_type", "confidence", "method", "reason")


def latest_events_upserted(spark: SparkSession, sf: str) -> DataFrame:
    """The newest event of each user, by a stream of upserts."""
    folder = scratch_folder(spark, "upserts")
    changes = load_stream(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value")
    machines.upserts(changes, ["user_id"], ["ts", "event_id"], f"{folder}/table", f"{folder}/checkpoint")()
    return machines.read_upserts(spark, f"{folder}/table").select("user_id", "event_id", "event_type", "value")


QUERIES = {f.__name__: f for f in (job_retries_streamed, page_types_streamed, latest_events_upserted)}

ORACLE_SQL = {
    "job_retries_streamed": """
        WITH a AS (SELECT user_id, event_id, (epoch_us(ts) // 1000) AS at_ms, event_type, 1 + count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS attempt,
                   lead((epoch_us(ts) // 1000)) OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id) AS later FROM events),
        r AS (SELECT *, CASE WHEN event_type = 'error' AND attempt < 3 THEN CASE attempt WHEN 1 THEN 30 ELSE 120 END END::BIGINT AS wait_seconds FROM a)
        SELECT user_id, at_ms, event_id, attempt, CASE WHEN event_type <> 'error' THEN 'DONE' WHEN attempt >= 3 THEN 'DEAD' ELSE 'RETRY' END AS next, wait_seconds FROM r
        UNION ALL SELECT user_id, at_ms + 1000 * wait_seconds, NULL, attempt + 1, 'RETRIED', NULL FROM r WHERE wait_seconds IS NOT NULL AND (later IS NULL OR at_ms + 1000 * wait_seconds <= later)""",
    "page_types_streamed": page_type_queries.ORACLE_SQL["sequential_page_types"],
    "latest_events_upserted": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
}
