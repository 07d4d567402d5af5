"""Queries on ordered rows and on time windows, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators import sequences
from docketry.sources.tables import load
from docketry.streaming import windows

_ORDER = ["ts", "event_id"]


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """Events with the type unknown where the value is below 20."""
    kind = F.when(F.col("value") < 20, "unknown").otherwise(F.col("event_type"))
    return load(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", "value", kind.alias("kind"))


def smoothed_event_types(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.sandwich(_events(spark, sf), "user_id", _ORDER, "kind", "unknown").select("event_id", "smoothed")


def two_gap_fill(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.two_gap(_events(spark, sf), "user_id", _ORDER, "kind", "unknown").select("event_id", "filled")


def carry_forward_type(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.carried(_events(spark, sf), "user_id", _ORDER, F.nullif(F.col("kind"), F.lit("unknown")), "primary").select("event_id", "carried")


def event_islands(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of one type a user."""
    rows = sequences.islands(_events(spark, sf), "user_id", _ORDER, "event_type")
    return rows.groupBy("user_id", "island", "event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def conversation_turns_complete(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.complete_sequence(load(spark, sf, "conversations"), "conv_id", "turn")


def budget_sample_front_tail(spark: SparkSession, sf: str) -> DataFrame:
    """Of each source the first five, last three and seven even middle documents."""
    return sequences.budget_sample(load(spark, sf, "documents").select("doc_id", "source"), "source", ["doc_id"], 5, 3, 7).select("source", "doc_id", "pos", "total")


def lines_within_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of an order until the third returned one."""
    lines = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_returnflag")
    return sequences.within_budget(lines, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"], F.col("l_returnflag") == "R", 2).select("l_orderkey", "l_linenumber", F.col("used").cast("bigint").alias("used"))


def shipment_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Stretches of ten days after each shipment of a supplier, merged."""
    days = load(spark, sf, "lineitem").select("l_suppkey", F.col("l_shipdate").cast("date").alias("from_day")).distinct()
    days = days.withColumn("to_day", F.date_add("from_day", 10))
    merged = sequences.merged_intervals(days, "l_suppkey", "from_day", "to_day")
    return merged.groupBy("l_suppkey").agg(F.count("*").alias("stretches"), F.sum(F.datediff("to_day", "from_day") + 1).alias("days"))


def document_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Places of documents laid end to end in each source."""
    rows = sequences.running_offset(load(spark, sf, "documents").select("doc_id", "source", "n_chars"), "source", ["doc_id"], "n_chars")
    return rows.select("doc_id", "first_place", "last_place")


def user_sessions(spark: SparkSession, sf: str) -> DataFrame:
    rows = sequences.sessions(load(spark, sf, "events"), "user_id", "ts", ["event_id"], 600)
    return rows.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("started"))


def tumbling_event_counts(spark: SparkSession, sf: str) -> DataFrame:
    return windows.tumbling(load(spark, sf, "events"), "ts", "1 day", "event_type")


def sliding_event_counts(spark: SparkSession, sf: str) -> DataFrame:
    return windows.sliding(load(spark, sf, "events"), "ts", "2 hours", "1 hour", "event_type")


def session_window_counts(spark: SparkSession, sf: str) -> DataFrame:
    return windows.session_counts(load(spark, sf, "events"), "ts", "10 hours", "user_id")


QUERIES = {
    f.__name__: f
    for f in (
        smoothed_event_types, two_gap_fill, carry_forward_type, event_islands, conversation_turns_complete, budget_sample_front_tail, lines_within_budget,
        shipment_coverage, document_offsets, user_sessions, tumbling_event_counts, sliding_event_counts, session_window_counts,
    )
}

_KIND = "(SELECT *, CASE WHEN value < 20 THEN 'unknown' ELSE event_type END AS kind FROM events)"
_W = "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"
ORACLE_SQL = {
    "smoothed_event_types": f"""
        SELECT event_id, CASE WHEN kind = 'unknown' AND lag(kind) OVER w = lead(kind) OVER w AND lag(kind) OVER w <> 'unknown' THEN lag(kind) OVER w ELSE kind END AS smoothed
        FROM {_KIND} {_W}""",
    "two_gap_fill": f"""
        SELECT event_id, CASE WHEN kind = 'unknown' AND lead(kind) OVER w = 'unknown' AND lag(kind) OVER w = lead(kind, 2) OVER w AND lag(kind) OVER w <> 'unknown' THEN lag(kind) OVER w
          WHEN kind = 'unknown' AND lag(kind) OVER w = 'unknown' AND lag(kind, 2) OVER w = lead(kind) OVER w AND lead(kind) OVER w <> 'unknown' THEN lead(kind) OVER w ELSE kind END AS filled
        FROM {_KIND} {_W}""",
    "carry_forward_type": f"""
        SELECT event_id, coalesce(last_value(nullif(kind, 'unknown') IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 'primary') AS carried FROM {_KIND}""",
    "event_islands": """
        WITH c AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NULL OR lag(event_type) OVER w <> event_type THEN 1 ELSE 0 END AS change FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        i AS (SELECT *, CAST(sum(change) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM c)
        SELECT user_id, island, event_type, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM i GROUP BY 1, 2, 3""",
    "conversation_turns_complete": """
        SELECT conv_id, count(*) AS n, count(*) = count(DISTINCT turn) AND max(turn) - min(turn) + 1 = count(*) AND min(turn) <= 1 AS complete FROM conversations GROUP BY 1""",
    "budget_sample_front_tail": """
        WITH p AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos, count(*) OVER (PARTITION BY source) AS total FROM documents)
        SELECT source, doc_id, pos, total FROM p WHERE pos <= 5 OR pos > total - 3 OR total - 8 <= 7
          OR floor((pos - 5) * 7 / (total - 8)::DOUBLE) > floor((pos - 6) * 7 / (total - 8)::DOUBLE)""",
    "lines_within_budget": """
        SELECT l_orderkey, l_linenumber, CAST(used AS BIGINT) AS used FROM (SELECT l_orderkey, l_linenumber,
          sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate ROWS UNBOUNDED PRECEDING) AS used FROM lineitem) WHERE used <= 2""",
    "shipment_coverage": """
        WITH d AS (SELECT DISTINCT l_suppkey, CAST(l_shipdate AS DATE) AS a FROM lineitem),
        n AS (SELECT *, CASE WHEN a > max(a + 10) OVER (PARTITION BY l_suppkey ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS fresh FROM d),
        r AS (SELECT *, sum(fresh) OVER (PARTITION BY l_suppkey ORDER BY a ROWS UNBOUNDED PRECEDING) AS run FROM n),
        m AS (SELECT l_suppkey, run, max(a) + 10 - min(a) + 1 AS days FROM r GROUP BY 1, 2)
        SELECT l_suppkey, count(*) AS stretches, CAST(sum(days) AS BIGINT) AS days FROM m GROUP BY 1""",
    "document_offsets": """
        SELECT doc_id, CAST(sum(n_chars) OVER w - n_chars + 1 AS BIGINT) AS first_place, CAST(sum(n_chars) OVER w AS BIGINT) AS last_place
        FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)""",
    "user_sessions": """
        WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 600 * 60000000::BIGINT THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        s AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM g)
        SELECT user_id, session, count(*) AS n, min(ts) AS started FROM s GROUP BY 1, 2""",
    "tumbling_event_counts": """
        SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM events GROUP BY ALL""",
    "sliding_event_counts": """
        SELECT date_trunc('hour', ts) - to_hours(k) AS window_start, event_type, count(*) AS n FROM events CROSS JOIN (VALUES (0), (1)) v(k) GROUP BY ALL""",
    "session_window_counts": """
        WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 10 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
        SELECT min(ts) AS session_start, user_id, count(*) AS n FROM s GROUP BY user_id, session""",
}
