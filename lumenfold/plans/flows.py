"""Queries on paced calls, forgiven failures, merged groups and counted writes, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.operators import merges, pacing
from lumenfold.operators.groups import shared_dir
from lumenfold.plans.relational import t
from lumenfold.streaming import flows

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query("""WITH e AS (SELECT event_id, event_type, epoch_us(ts) AS a, row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts), event_id) - 1 AS i FROM events),
          s AS (SELECT event_id, event_type, i // 6 * 7200000000 + max(a - i // 6 * 7200000000) OVER (PARTITION BY event_type, i % 6 ORDER BY i) AS start, a FROM e)
          SELECT event_id, event_type, start, start - a AS waited FROM s""")
def paced_calls(spark, d):
    """Events as calls of their type, of which no more than six may start in two hours: when each starts, and how long it waits (microseconds)."""
    calls = t(spark, d, "events").select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("arrival"))
    found = pacing.paced(calls, "event_type", "arrival", "event_id", 6, 7_200_000_000)
    return found.select("event_id", "event_type", "start", (F.col("start") - F.col("arrival")).alias("waited"))


@query("""SELECT event_id, user_id FROM events f WHERE event_type = 'error' AND NOT EXISTS (
          SELECT 1 FROM events s WHERE s.user_id = f.user_id AND s.event_type = 'purchase' AND s.ts >= f.ts AND s.ts <= f.ts + INTERVAL 6 HOURS)""")
def final_failures(spark, d):
    """Errors that no purchase of the same user follows within six hours."""
    events = t(spark, d, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    kind = F.col("event_type")
    return pacing.unforgiven(events, "user_id", "at", kind == "error", kind == "purchase", 6 * 3_600_000_000).select("event_id", "user_id")


@query("""WITH m AS (SELECT l_partkey AS g, l_orderkey AS f, min(l_shipdate) AS added FROM lineitem GROUP BY 1, 2),
          r AS (SELECT g - g % 20 AS group_id, f AS file_id, g, added FROM m)
          SELECT group_id, file_id, min_by(added, CASE WHEN g = group_id THEN -1 ELSE g END) AS added FROM r GROUP BY 1, 2""")
def merged_members(spark, d):
    """Orders of parts as members of groups; group after group was merged into the one before, in chains of twenty."""
    lines = t(spark, d, "lineitem")
    members = lines.groupBy(F.col("l_partkey").alias("group_id"), F.col("l_orderkey").alias("file_id")).agg(F.min("l_shipdate").alias("added"))
    steps = t(spark, d, "part").where(F.col("p_partkey") % 20 != 0).select(F.col("p_partkey").alias("old"), (F.col("p_partkey") - 1).alias("kept"))
    return merges.reparented(members, steps)


@query("""WITH k AS (SELECT c_custkey AS id, c_nationkey || ' ' || c_mktsegment AS key, c_acctbal AS since FROM customer), m AS (SELECT o_custkey AS g, o_orderdate::DATE AS f FROM orders),
          c AS (SELECT id, first_value(id) OVER (PARTITION BY key ORDER BY since, id) AS group_id FROM k) SELECT DISTINCT coalesce(group_id, g) AS group_id, f AS file_id FROM m LEFT JOIN c ON g = id""")
def deduplicated_groups(spark, d):
    """Customers with the same nation and segment are one group, the first by balance; the days of their orders are its members, each once."""
    groups = t(spark, d, "customer").select(F.col("c_custkey").alias("group_id"), F.concat_ws(" ", "c_nationkey", "c_mktsegment").alias("key"), "c_acctbal")
    members = t(spark, d, "orders").select(F.col("o_custkey").alias("group_id"), F.col("o_orderdate").cast("date").alias("file_id"))
    return merges.reparented(members, merges.merges_by_key(groups, "key", ["c_acctbal"]))


@query("""SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus = 'P' THEN 'failed' WHEN o_orderpriority = '5-LOW' THEN 'skipped' ELSE 'applied' END AS outcome FROM orders) GROUP BY outcome""")
def counted_write(spark, d):
    """Outcomes of a bulk write, counted while it is written."""
    outcome = F.when(F.col("o_orderstatus") == "P", "failed").when(F.col("o_orderpriority") == "5-LOW", "skipped").otherwise("applied")
    rows = t(spark, d, "orders").select("o_orderkey", outcome.alias("outcome"))
    counted = flows.written_with_counters(rows, shared_dir(spark, "applied"), {x: F.col("outcome") == x for x in ("applied", "skipped", "failed")})
    return spark.createDataFrame([(k, n) for k, n in counted.items() if n], "outcome string, n long")
