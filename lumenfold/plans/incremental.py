"""Queries on snapshots, changes and event logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenfold.operators import relational as R
from lumenfold.plans.relational import t
from lumenfold.streaming import states

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""WITH a AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 5 <> 0),
          b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0)
          SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'new' WHEN b.o_orderkey IS NULL THEN 'missing' WHEN a.o_orderstatus = b.o_orderstatus THEN 'active' ELSE 'changed' END AS state FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey""")
def snapshot_reconcile(spark, d):
    """Two scans of a location: what is new, changed, gone or as before."""
    orders = t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    known = orders.where("o_orderkey % 5 <> 0")
    now = orders.where("o_orderkey % 3 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")))
    return R.reconcile(known, now, ["o_orderkey"], ["o_orderstatus", "o_totalprice"]).select("o_orderkey", "state")


@query("""WITH f AS (SELECT d.doc_id, sha256(d.text) AS h, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)),
          b AS (SELECT h, min_by(quality, doc_id) AS q, min_by(toxic, doc_id) AS x, 1 AS has FROM f WHERE quality IS NOT NULL GROUP BY h)
          SELECT doc_id, coalesce(quality, q) AS quality, coalesce(toxic, x) AS toxic, quality IS NULL AND has IS NOT NULL AS inherited FROM f LEFT JOIN b USING (h)""")
def known_content_adoption(spark, d):
    """Documents without labels take those of the first labelled one with the same content."""
    files = t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h")).join(t(spark, d, "labels"), "doc_id", "left")
    return R.copies_from_twin(files, "h", ["quality", "toxic"], F.col("quality").isNotNull(), ["doc_id"]).select("doc_id", "quality", "toxic", "inherited")


@query("""WITH c AS (SELECT user_id, max_by(event_type, event_id) AS type, max(event_id) AS event_id FROM events WHERE event_type <> 'view' GROUP BY user_id)
          SELECT c_custkey AS user_id, coalesce(c.type, c_mktsegment) AS type, coalesce(c.event_id, -1) AS event_id FROM customer LEFT JOIN c ON c_custkey = c.user_id
          UNION ALL SELECT user_id, type, event_id FROM c WHERE user_id NOT IN (SELECT c_custkey FROM customer)""")
def upsert_latest(spark, d):
    base = t(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("type"), F.lit(-1).cast("long").alias("event_id"))
    changes = t(spark, d, "events").where("event_type <> 'view'").select("user_id", F.col("event_type").alias("type"), "event_id")
    return R.upsert(base, changes, ["user_id"], ["event_id"])


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 4 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
          s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
          SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY user_id, k""")
def session_debounce(spark, d):
    """Changes that follow each other within the gap are one: session windows, which a stream uses as well."""
    events = t(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    sessions = events.groupBy("user_id", F.session_window("at", "4 hours")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))
    return sessions.select("user_id", "first_ts", "last_ts", "n")


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 MINUTE PRECEDING AND CURRENT ROW) AS in_window FROM events""")
def rate_window(spark, d):
    """Starts within the trailing hour of each user's event."""
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-3_600_000_000, 0)
    return t(spark, d, "events").select("event_id", F.count("*").over(w).alias("in_window"))


@query("""WITH f AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS failures, count(*) AS n, max_by(event_type, event_id) AS last FROM events GROUP BY user_id)
          SELECT user_id, failures, CASE WHEN last = 'error' AND failures >= 3 THEN 'failed_terminal' WHEN last = 'error' THEN 'failed_retryable' ELSE 'processing' END AS state FROM f""")
def retry_fold(spark, d):
    """Failures counted by key; the third is terminal."""
    error = F.col("event_type") == "error"
    rows = t(spark, d, "events").groupBy("user_id").agg(F.count_if(error).alias("failures"), F.max_by("event_type", "event_id").alias("last"))
    state = F.when((F.col("last") == "error") & (F.col("failures") >= states.MAX_RETRIES), "failed_terminal").when(F.col("last") == "error", "failed_retryable").otherwise("processing")
    return rows.select("user_id", "failures", state.alias("state"))


@query()
def state_machine(spark, d):
    """The states of each user's file after its events in order; illegal moves are ignored."""
    events = t(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), states.target_of(F.col("event_type")).alias("target"))
    return states.fold(events)


@query("""SELECT user_id, event_type, count(*) AS n, count(*) > 20 AS capped FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR GROUP BY 1, 2""")
def daily_cap(spark, d):
    """Actions of the trailing day against a cap."""
    events = t(spark, d, "events")
    last = F.broadcast(events.agg(F.max("ts").alias("last")))
    recent = events.join(last).where("ts >= last - INTERVAL 24 HOURS")
    return recent.groupBy("user_id", "event_type").agg(F.count("*").alias("n")).withColumn("capped", F.col("n") > 20)


@query("""SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2""")
def insert_if_absent(spark, d):
    """The first row of each key wins, later ones are ignored."""
    return R.earliest_wins(t(spark, d, "events"), ["user_id", "event_type"], ["event_id"], ["event_id"])
