"""Queries on joins, latest rows, set operations and aggregates, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.functions import dates, money
from docketry.operators import findings, relational
from docketry.sources.tables import load


def latest_order_per_customer(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    return relational.latest_by(orders, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")])


def newest_three_orders(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return relational.newest_n(orders, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).withColumn("rank", F.col("rank").cast("bigint"))


def customers_without_part_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Customers none of whose orders is in part delivered."""
    return load(spark, sf, "customer").select("c_custkey", "c_name").join(load(spark, sf, "orders").where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


def customers_with_urgent_orders(spark: SparkSession, sf: str) -> DataFrame:
    urgent = load(spark, sf, "orders").where("o_orderpriority = '1-URGENT'")
    return load(spark, sf, "customer").select("c_custkey", "c_mktsegment").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_semi")


def order_worklist(spark: SparkSession, sf: str) -> DataFrame:
    """Open orders with customer and nation, ranked for work, first 100."""
    rows = load(spark, sf, "orders").where("o_orderstatus = 'O'").join(load(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    rows = rows.join(load(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    top = rows.select("o_orderkey", "o_orderpriority", "c_name", "n_name", "o_orderdate").orderBy("o_orderpriority", "o_orderdate", "o_orderkey").limit(100)
    return top.withColumn("place", F.row_number().over(Window.orderBy("o_orderpriority", "o_orderdate", "o_orderkey")).cast("bigint"))  # of the 100


def orders_by_month_free_tier(spark: SparkSession, sf: str) -> DataFrame:
    months = load(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("units"))
    billable, usd = money.free_tier(F.col("units"), 100, 1.5)
    return months.select("month", "units", billable.cast("bigint").alias("billable"), usd.alias("usd"))


def revenue_rollup(spark: SparkSession, sf: str) -> DataFrame:
    lines = load(spark, sf, "lineitem")
    total = F.sum((F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast("decimal(18,4)"))
    return lines.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), total.cast("double").alias("revenue"))


def turnaround_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Minutes from each user's first to last event of a type."""
    spans = load(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    spans = spans.withColumn("minutes", dates.minutes_between(F.col("a"), F.col("b")))
    return spans.groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(F.percentile("minutes", F.lit(0.5)), 6).alias("p50"), F.round(F.expr("percentile_disc(0.9) within group (order by minutes)"), 6).alias("p90")
    )


def failure_rate_kpi(spark: SparkSession, sf: str) -> DataFrame:
    """Share of failed (F) orders a priority."""
    bad = F.count_if(F.col("o_orderstatus") == "F")
    return load(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), bad.alias("failed"), F.round(bad / F.nullif(F.count("*"), F.lit(0)), 6).alias("rate"))


def retry_kpi(spark: SparkSession, sf: str) -> DataFrame:
    """Line items an order as attempts: mean, largest, and orders with more than one."""
    per = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("attempts"))
    return per.agg(F.count("*").alias("orders"), F.round(F.avg("attempts"), 6).alias("mean_attempts"), F.max("attempts").alias("most"), F.count_if(F.col("attempts") > 1).alias("retried"))


def route_metrics(spark: SparkSession, sf: str) -> DataFrame:
    value = F.col("value").cast("decimal(18,6)")
    return load(spark, sf, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.sum(value).cast("double"), 4).alias("total"), F.sum(F.when(F.col("value") > 50, 1).otherwise(0)).alias("large")
    )


def findings_by_code(spark: SparkSession, sf: str) -> DataFrame:
    """Rule names mapped to codes by the first pattern that fits."""
    rule = F.concat(F.upper("event_type"), F.lit("_"), F.when(F.col("value") > 50, "MISMATCH").otherwise("CHECK"))
    code = F.when(rule.like("CLICK%"), "INTERACTION").when(rule.like("%MISMATCH"), "DATA_MISMATCH").otherwise("REVIEW_REQUIRED")
    rows = load(spark, sf, "events").select(code.alias("code"), "user_id")
    return rows.groupBy("code").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


def decisions_per_case(spark: SparkSession, sf: str) -> DataFrame:
    """Orders a customer with zero kept, and days to the first."""
    orders = load(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.min("o_orderdate").alias("first"))
    rows = load(spark, sf, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select("c_custkey", F.coalesce("n", F.lit(0)).cast("bigint").alias("decisions"), F.datediff("first", F.lit("1992-01-01").cast("date")).cast("bigint").alias("days_to_first"))


def status_matrix(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count("o_orderkey"))
    return rows.select("o_orderpriority", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(f"status_{c.lower()}") for c in ("F", "O", "P")])


def type_vote(spark: SparkSession, sf: str) -> DataFrame:
    """The most frequent event type of each user, ties to the first name."""
    votes = load(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("votes"))
    best = votes.groupBy("user_id").agg(F.min(F.struct((-F.col("votes")).alias("v"), "event_type")).alias("b"), F.sum("votes").alias("n"))
    return best.select("user_id", F.col("b.event_type").alias("winner"), (-F.col("b.v")).alias("votes"), F.round(-F.col("b.v") / F.col("n"), 6).alias("confidence"))


def effective_rate_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Duty of each order by the rule in force on its day."""
    rules = spark.createDataFrame(
        [("R1", "1900-01-01", "1994-12-31", "flat", 100.0, None), ("R2", "1995-01-01", "1996-12-31", "percentage", None, 1.5), ("R3", "1996-07-01", None, "percentage", None, 2.0)],
        "rule_id string, valid_from string, valid_to string, kind string, amount double, rate double",
    ).withColumns({"valid_from": F.to_timestamp("valid_from"), "valid_to": F.to_timestamp("valid_to")})
    orders = load(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    rows = relational.effective_lookup(orders, rules, "o_orderdate", "valid_from", "valid_to")
    owed = money.duty(F.col("kind"), F.col("o_totalprice"), F.col("amount"), F.col("rate"), F.lit(50), F.lit(5000))
    return rows.select("o_orderkey", "rule_id", "lookup", F.when(F.col("lookup") == "ONE", owed).alias("duty"))


def nearest_prior_order_asof(spark: SparkSession, sf: str) -> DataFrame:
    """For each event the last order of the customer with the user's number at or before it."""
    events = load(spark, sf, "events").select("event_id", "ts", F.col("user_id").alias("cust"))
    orders = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("cust"), "o_orderdate").agg(F.max("o_orderkey").alias("o_orderkey"))
    return relational.asof_join(events, orders, "cust", "ts", "o_orderdate", ["o_orderkey"]).select("event_id", "cust", "asof_o_orderdate", "asof_o_orderkey")


def order_price_bands(spark: SparkSession, sf: str) -> DataFrame:
    """Orders in each of some overlapping price ranges."""
    bands = spark.createDataFrame([("low", 0.0, 50000.0), ("middle", 40000.0, 200000.0), ("high", 150000.0, 1e6)], "band string, low double, high double")
    rows = relational.range_join(load(spark, sf, "orders").select("o_orderkey", "o_totalprice"), bands, "o_totalprice", "low", "high", 50000)
    return rows.groupBy("band").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


def nearest_summary_in_band(spark: SparkSession, sf: str) -> DataFrame:
    """For each user turn, the nearest assistant turn at most five before."""
    turns = load(spark, sf, "conversations").withColumn("chars", F.length("text").cast("bigint"))
    asked = turns.where("role = 'user'").select("conv_id", "turn")
    return relational.band_nearest(asked, turns.where("role = 'assistant'"), "conv_id", "turn", "turn", 5, "chars")


def unique_owner_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers whose nation has exactly one customer segment among rich customers, with it."""
    rich = load(spark, sf, "customer").where("c_acctbal > 9000").select("c_nationkey", F.col("c_mktsegment").alias("segment"))
    return relational.unique_owner(load(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("c_nationkey")), rich, "c_nationkey", "segment")


def scored_part_match(spark: SparkSession, sf: str) -> DataFrame:
    """For each brand the size that scores best; a tie has no winner."""
    parts = load(spark, sf, "part").groupBy("p_brand", "p_size").agg(F.count("*").alias("n"))
    rows = relational.scored_match(parts, "p_brand", "p_size", 5 * F.col("n") + F.when(F.col("p_size") > 25, 1).otherwise(0))
    return rows.select("p_brand", F.col("winner").cast("bigint").alias("winner"), "best", "ties")


def cross_source_anchor_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    """For each part the first line whose discount is not that of its largest line."""
    lines = load(spark, sf, "lineitem").select("l_partkey", "l_discount", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_id"), "l_quantity")
    return relational.anchor_mismatch(lines, ["l_partkey"], [F.desc("l_quantity"), F.col("line_id")], "l_discount", "line_id")


def two_step_assessment_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Quality label of a document, else the commonest label of its source."""
    docs = load(spark, sf, "documents").select("doc_id", "source")
    labels = load(spark, sf, "labels").select("doc_id", "quality")
    own = docs.join(labels, "doc_id", "left")
    general = docs.join(labels, "doc_id").groupBy("source").agg((F.avg("quality") >= 0.5).cast("int").alias("usual"))
    return own.join(general, "source", "left").select("doc_id", F.coalesce("quality", "usual").cast("bigint").alias("assessment"), F.col("quality").isNotNull().alias("own_label"))


def union_of_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Customers and suppliers in one shape, counted by nation and kind."""
    a = load(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance")).withColumn("kind", F.lit("customer"))
    b = load(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation")).withColumn("kind", F.lit("supplier"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("nation", "kind").agg(F.count("*").alias("n"), F.count("balance").alias("with_balance"))


def months_not_covered(spark: SparkSession, sf: str) -> DataFrame:
    """Months of 1995 in which a customer has no order, for all customers."""
    seen = load(spark, sf, "orders").where("year(o_orderdate) = 1995").groupBy("o_custkey").agg(F.collect_set(F.date_format("o_orderdate", "yyyy-MM")).alias("covered"))
    seen = load(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey")).join(seen, "o_custkey", "left").withColumn("covered", F.coalesce("covered", F.array().cast("array<string>")))
    wanted = dates.month_set(F.lit("1995-01-01").cast("date"), F.lit("1995-12-01").cast("date"))
    gone = F.array_except(wanted, F.col("covered"))
    return seen.select("o_custkey", F.size(gone).cast("bigint").alias("missing"), F.array_join(gone, ",").alias("months"))


def merge_fields_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    """The first text of each role in a conversation."""
    rows = load(spark, sf, "conversations").groupBy("conv_id", "role").agg(F.min_by(F.struct("turn", "text"), "turn").alias("f"))
    return rows.select("conv_id", "role", F.col("f.turn").alias("turn"), F.col("f.text").alias("text"))


def retention_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Orders older than a cutoff, not among the customer's three newest, without a returned line."""
    orders = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    old = orders.withColumn("place", place).where((F.col("place") > 3) & (F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp")))
    held = load(spark, sf, "lineitem").where("l_returnflag = 'R'")
    return old.join(held, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_custkey")


def reconciliation_status(spark: SparkSession, sf: str) -> DataFrame:
    """Balance of each supplier's nation against customers of that nation, within 1 %."""
    trusted = load(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.max("s_acctbal").alias("trusted"))
    found = load(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("found"))
    pairs = load(spark, sf, "nation").select(F.col("n_nationkey").alias("nation")).join(trusted, "nation", "left").join(found, "nation", "left")
    return findings.reconciled(pairs, "nation", "trusted", "found", money.within_relative(F.col("found"), F.col("trusted")))


QUERIES = {
    f.__name__: f
    for f in (
        latest_order_per_customer, newest_three_orders, customers_without_part_orders, customers_with_urgent_orders, order_worklist, orders_by_month_free_tier, revenue_rollup,
        turnaround_percentiles, failure_rate_kpi, retry_kpi, route_metrics, findings_by_code, decisions_per_case, status_matrix, type_vote, effective_rate_lookup,
        nearest_prior_order_asof, order_price_bands, nearest_summary_in_band, unique_owner_lookup, scored_part_match, cross_source_anchor_mismatch, two_step_assessment_lookup,
        union_of_sources, months_not_covered, merge_fields_first_wins, retention_candidates, reconciliation_status,
    )
}

ORACLE_SQL = {
    "latest_order_per_customer": """
        SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus FROM orders
        QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
    "newest_three_orders": """
        SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank
        FROM orders QUALIFY rank <= 3""",
    "customers_without_part_orders": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    "customers_with_urgent_orders": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "order_worklist": """
        SELECT o_orderkey, o_orderpriority, c_name, n_name, o_orderdate, row_number() OVER (ORDER BY o_orderpriority, o_orderdate, o_orderkey) AS place
        FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
        WHERE o_orderstatus = 'O' ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 100""",
    "orders_by_month_free_tier": """
        SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS units, greatest(count(*) - 100, 0) AS billable,
               round(greatest(count(*) - 100, 0) * 1.5::DOUBLE / 1000, 6) AS usd FROM orders GROUP BY 1""",
    "revenue_rollup": """
        SELECT l_returnflag, l_linestatus, count(*) AS n,
               CAST(sum(CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4))) AS DOUBLE) AS revenue
        FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
    "turnaround_percentiles": """
        WITH s AS (SELECT user_id, event_type, greatest(0.0::DOUBLE, (epoch_us(max(ts)) - epoch_us(min(ts))) / 6e7::DOUBLE) AS minutes FROM events GROUP BY ALL)
        SELECT event_type, count(*) AS n, round(quantile_cont(minutes, 0.5), 6) AS p50, round(quantile_disc(minutes, 0.9), 6) AS p90 FROM s GROUP BY 1""",
    "failure_rate_kpi": """
        SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS failed,
               round(count(*) FILTER (o_orderstatus = 'F') / nullif(count(*), 0)::DOUBLE, 6) AS rate FROM orders GROUP BY 1""",
    "retry_kpi": """
        WITH p AS (SELECT l_orderkey, count(*) AS attempts FROM lineitem GROUP BY 1)
        SELECT count(*) AS orders, round(avg(attempts), 6) AS mean_attempts, max(attempts) AS most, count(*) FILTER (attempts > 1) AS retried FROM p""",
    "route_metrics": """
        SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE), 4) AS total,
               CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS BIGINT) AS large FROM events GROUP BY 1""",
    "findings_by_code": """
        WITH r AS (SELECT upper(event_type) || '_' || CASE WHEN value > 50 THEN 'MISMATCH' ELSE 'CHECK' END AS rule, user_id FROM events)
        SELECT CASE WHEN rule LIKE 'CLICK%' THEN 'INTERACTION' WHEN rule LIKE '%MISMATCH' THEN 'DATA_MISMATCH' ELSE 'REVIEW_REQUIRED' END AS code,
               count(*) AS n, count(DISTINCT user_id) AS users FROM r GROUP BY 1""",
    "decisions_per_case": """
        SELECT c_custkey, count(o_orderkey) AS decisions, date_diff('day', DATE '1992-01-01', CAST(min(o_orderdate) AS DATE)) AS days_to_first
        FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1""",
    "status_matrix": """
        SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS status_f, count(*) FILTER (o_orderstatus = 'O') AS status_o,
               count(*) FILTER (o_orderstatus = 'P') AS status_p FROM orders GROUP BY 1""",
    "type_vote": """
        WITH v AS (SELECT user_id, event_type, count(*) AS votes FROM events GROUP BY ALL)
        SELECT user_id, event_type AS winner, votes, round(votes / sum(votes) OVER (PARTITION BY user_id)::DOUBLE, 6) AS confidence FROM v
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, event_type) = 1""",
    "effective_rate_lookup": """
        WITH r(rule_id, a, b, kind, amount, rate) AS (VALUES
          ('R1', TIMESTAMP '1900-01-01', TIMESTAMP '1994-12-31', 'flat', 100.0, NULL), ('R2', TIMESTAMP '1995-01-01', TIMESTAMP '1996-12-31', 'percentage', NULL, 1.5),
          ('R3', TIMESTAMP '1996-07-01', NULL, 'percentage', NULL, 2.0)),
        j AS (SELECT o_orderkey, o_totalprice, r.*, count(rule_id) OVER (PARTITION BY o_orderkey) AS m FROM orders
              LEFT JOIN r ON (a IS NULL OR a <= o_orderdate) AND (b IS NULL OR o_orderdate <= b))
        SELECT o_orderkey, rule_id, CASE m WHEN 0 THEN 'NO_RULE' WHEN 1 THEN 'ONE' ELSE 'AMBIGUOUS' END AS lookup,
               CASE WHEN m = 1 THEN CAST(round(least(greatest(CASE WHEN kind = 'flat' THEN CAST(amount AS DECIMAL(18,4))
                 ELSE CAST(CAST(o_totalprice AS DECIMAL(18,4)) * CAST(rate AS DECIMAL(8,4)) / 100 AS DECIMAL(28,8)) END, 50), 5000), 0) AS DOUBLE) END AS duty FROM j""",
    "nearest_prior_order_asof": """
        WITH o AS (SELECT o_custkey, o_orderdate, max(o_orderkey) AS k FROM orders GROUP BY ALL)
        SELECT event_id, user_id AS cust, o_orderdate AS asof_o_orderdate, k AS asof_o_orderkey
        FROM events ASOF LEFT JOIN o ON user_id = o_custkey AND ts >= o_orderdate""",
    "order_price_bands": """
        WITH b(band, low, high) AS (VALUES ('low', 0.0, 50000.0), ('middle', 40000.0, 200000.0), ('high', 150000.0, 1000000.0))
        SELECT band, count(*) AS n, min(o_orderkey) AS first_key FROM orders JOIN b ON o_totalprice BETWEEN low AND high GROUP BY 1""",
    "nearest_summary_in_band": """
        SELECT u.conv_id, u.turn, max(a.turn) AS near_at, arg_max(CAST(length(a.text) AS BIGINT), a.turn) AS near_value
        FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.role = 'assistant' AND a.turn BETWEEN u.turn - 5 AND u.turn
        WHERE u.role = 'user' GROUP BY 1, 2""",
    "unique_owner_lookup": """
        WITH o AS (SELECT c_nationkey, min(c_mktsegment) AS segment FROM customer WHERE c_acctbal > 9000 GROUP BY 1 HAVING count(DISTINCT c_mktsegment) = 1)
        SELECT s_suppkey, s_nationkey AS c_nationkey, segment FROM supplier LEFT JOIN o ON s_nationkey = c_nationkey""",
    "scored_part_match": """
        WITH s AS (SELECT p_brand, p_size, 5 * count(*) + CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS score FROM part GROUP BY 1, 2),
        b AS (SELECT p_brand, max(score) AS best FROM s GROUP BY 1)
        SELECT p_brand, CASE WHEN count(*) = 1 THEN CAST(min(p_size) AS BIGINT) END AS winner, best, count(*) AS ties FROM s JOIN b USING (p_brand) WHERE score = best GROUP BY p_brand, best""",
    "cross_source_anchor_mismatch": """
        WITH l AS (SELECT l_partkey, l_discount, l_orderkey * 10 + l_linenumber AS line_id,
                          first_value(l_discount) OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_orderkey * 10 + l_linenumber) AS a FROM lineitem)
        SELECT l_partkey, a AS anchor_value, l_discount AS found_value, line_id AS found_at FROM l WHERE l_discount <> a
        QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY line_id) = 1""",
    "two_step_assessment_lookup": """
        WITH g AS (SELECT source, CASE WHEN avg(quality) >= 0.5 THEN 1 ELSE 0 END AS usual FROM documents JOIN labels USING (doc_id) GROUP BY 1)
        SELECT d.doc_id, CAST(coalesce(l.quality, g.usual) AS BIGINT) AS assessment, l.quality IS NOT NULL AS own_label
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN g ON d.source = g.source""",
    "union_of_sources": """
        SELECT nation, kind, count(*) AS n, count(balance) AS with_balance FROM (
          SELECT c_nationkey AS nation, c_acctbal AS balance, 'customer' AS kind FROM customer UNION ALL SELECT s_nationkey, NULL, 'supplier' FROM supplier) GROUP BY 1, 2""",
    "months_not_covered": """
        WITH w AS (SELECT strftime(unnest(generate_series(DATE '1995-01-01', DATE '1995-12-01', INTERVAL 1 MONTH)), '%Y-%m') AS m),
        s AS (SELECT DISTINCT o_custkey, strftime(o_orderdate, '%Y-%m') AS m FROM orders WHERE year(o_orderdate) = 1995),
        c AS (SELECT c_custkey AS o_custkey FROM customer)
        SELECT c.o_custkey, count(*) FILTER (s.m IS NULL) AS missing, coalesce(string_agg(CASE WHEN s.m IS NULL THEN w.m END, ',' ORDER BY w.m), '') AS months
        FROM c CROSS JOIN w LEFT JOIN s ON s.o_custkey = c.o_custkey AND s.m = w.m GROUP BY 1""",
    "merge_fields_first_wins": "SELECT conv_id, role, min(turn) AS turn, arg_min(text, turn) AS text FROM conversations GROUP BY 1, 2",
    "retention_candidates": """
        SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS p FROM orders)
        WHERE p > 3 AND o_orderdate < TIMESTAMP '1997-01-01' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')""",
    "reconciliation_status": """
        WITH t AS (SELECT s_nationkey AS nation, max(s_acctbal) AS trusted FROM supplier GROUP BY 1),
        p AS (SELECT n_nationkey AS nation, trusted, c_acctbal AS found FROM nation LEFT JOIN t ON n_nationkey = t.nation LEFT JOIN customer ON n_nationkey = c_nationkey),
        g AS (SELECT nation, max(trusted) AS trusted, count(found) AS observed, count(*) FILTER (abs(found - trusted) <= 0.01::DOUBLE * abs(trusted)) AS good FROM p GROUP BY 1)
        SELECT nation, observed, CASE WHEN trusted IS NULL THEN 'NOT_CHECKABLE' WHEN observed = 0 THEN 'NOT_OBSERVED' WHEN good = observed THEN 'MATCH'
               WHEN good > 0 THEN 'MATCH_WITH_CONFLICTS' ELSE 'MISMATCH' END AS status FROM g""",
}
