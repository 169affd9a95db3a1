"""Rules of ingest over the events and lineitems of a folder, each with its SQL; those that carry a state have tests instead."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelpie.operators import analytics
from kelpie.plans.activity_queries import ACTIVITIES, QUERIES, SQL, activities, query, table
from kelpie.streaming import ingest

__all__ = ["QUERIES", "SQL"]


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), "event_type", "value")


_E = """e AS (SELECT event_id AS id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS "at", event_type, value FROM events)"""


@query()
def x2_throttled(spark, sf_dir):
    taps = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("event_id") % 3).alias("screen"), (F.unix_seconds(F.col("ts").cast("timestamp")) / 600).alias("at"))
    return ingest.throttled(taps, "screen")


@query(f"""WITH {_E}, k AS (SELECT id, user_id, id % 4 AS code, CASE WHEN value > 20 THEN 'press' ELSE 'release' END AS kind FROM e)
SELECT user_id, id FROM (SELECT *, lag(kind) OVER (PARTITION BY user_id, code ORDER BY id) AS b FROM k) WHERE kind = 'release' AND b = 'press'""")
def x3_paired_keys(spark, sf_dir):
    keys = _events(spark, sf_dir).select("id", "user_id", (F.col("id") % 4).alias("code"), F.when(F.col("value") > 20, "press").otherwise("release").alias("kind"))
    return ingest.paired_keys(keys, "user_id", ["id"]).select("user_id", "id")


@query(f"""WITH {ACTIVITIES} SELECT user_id, string_agg(CAST(id % 100 AS VARCHAR), ' ' ORDER BY start_time, id) AS said FROM a WHERE application NOT IN ('PAUSED', 'SLEEP') GROUP BY 1""")
def x4_said_text(spark, sf_dir):
    pieces = activities(spark, sf_dir).withColumn("text", F.concat(F.lit(" "), (F.col("id") % 100).cast("string")))
    return ingest.said_text(pieces, "user_id", ["start_time", "id"], F.col("application").isin(*analytics.INACTIVE))


@query(f"""WITH {ACTIVITIES} SELECT id, user_id, application FROM a QUALIFY NOT (application IN ('PAUSED', 'SLEEP') AND application IS NOT DISTINCT FROM lag(application) OVER (PARTITION BY user_id ORDER BY start_time, id))""")
def x5_single_markers(spark, sf_dir):
    return ingest.single_markers(activities(spark, sf_dir), "user_id", ["start_time", "id"], "application", analytics.INACTIVE).select("id", "user_id", "application")


@query(f"""WITH {_E}, s AS (SELECT id, user_id, e."at" - id * 7919 % 500000 AS taken FROM e) SELECT user_id, id FROM s QUALIFY NOT coalesce(max(taken) OVER (PARTITION BY user_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - taken > 120, false)""")
def x6_admitted_shots(spark, sf_dir):
    shots = _events(spark, sf_dir).withColumn("taken", F.col("at") - F.col("id") * 7919 % 500000)
    return ingest.admitted(shots, "user_id", "id", "taken").select("user_id", "id")


@query()
def x7_held_shots(spark, sf_dir):
    return ingest.held_shots(_events(spark, sf_dir), "user_id")


@query(f"""WITH {ACTIVITIES} SELECT id, user_id FROM a QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY start_time DESC, id DESC) > 3 AND value > 5""")
def x9_final_rows(spark, sf_dir):
    return ingest.final_rows(activities(spark, sf_dir), "user_id", ["start_time", "id"], 3, F.col("value") > 5).select("id", "user_id")


@query(f"""WITH {_E} SELECT user_id, arg_min(v, id) FILTER (v IS NOT NULL) AS v, arg_min(kind, id) FILTER (kind IS NOT NULL) AS kind FROM (SELECT id, user_id, CASE WHEN id % 3 = 0 THEN value END AS v, CASE WHEN id % 5 = 0 THEN event_type END AS kind FROM e) GROUP BY 1""")
def x11_first_writes(spark, sf_dir):
    rows = _events(spark, sf_dir).select("id", "user_id", F.when(F.col("id") % 3 == 0, F.col("value")).alias("v"), F.when(F.col("id") % 5 == 0, F.col("event_type")).alias("kind"))
    return ingest.first_writes(rows, "user_id", ["id"], ["v", "kind"])


@query(f"""WITH {_E} SELECT id, event_type, count(*) OVER (PARTITION BY event_type ORDER BY e."at" RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS recent FROM e""")
def x13_trailing_counts(spark, sf_dir):
    return ingest.trailing_counts(_events(spark, sf_dir), "at", "event_type", 3600).select("id", "event_type", "recent")


@query("""WITH q AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1), a AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1), d AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT k AS o_custkey, coalesce(q.n, 0) AS queued, coalesce(a.n, 0) AS active, coalesce(d.n, 0) AS done FROM q FULL JOIN a USING (k) FULL JOIN d USING (k)""")
def x14_backlog(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return ingest.backlog(*(o.filter(F.col("o_orderstatus") == s) for s in ("O", "P", "F")), "o_custkey")


@query("""WITH e AS (SELECT l_suppkey AS build, CASE WHEN l_linenumber = 1 THEN 'queued' WHEN l_returnflag = 'N' THEN 'finished' WHEN l_quantity > 48 THEN 'scanned' ELSE 'other' END AS kind, l_orderkey AS "at" FROM lineitem),
s AS (SELECT build, count(*) FILTER (kind = 'scanned') AS scans, count(*) FILTER (kind = 'queued') AS items, count(*) FILTER (kind = 'finished') AS f, max(e."at") AS "at" FROM e GROUP BY 1) SELECT build, items, s."at" FROM s WHERE scans > 0 AND f >= items""")
def x20_completed_builds(spark, sf_dir):
    kind = F.when(F.col("l_linenumber") == 1, "queued").when(F.col("l_returnflag") == "N", "finished").when(F.col("l_quantity") > 48, "scanned").otherwise("other")
    return ingest.completed_builds(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("build"), kind.alias("kind"), F.col("l_orderkey").alias("at")))


@query("""WITH c AS (SELECT l_orderkey AS file, md5(CAST(l_suppkey % 5 AS VARCHAR)) AS hash, l_linenumber AS ordinal FROM lineitem), s AS (SELECT DISTINCT o_orderkey AS file, md5(CAST(o_custkey % 5 AS VARCHAR)) AS hash FROM orders)
SELECT file, hash, min(ordinal) AS ordinal FROM c WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.file = c.file AND s.hash = c.hash) GROUP BY ALL""")
def x22_new_chunks(spark, sf_dir):
    hashed = lambda c: F.md5((F.col(c) % 5).cast("string"))
    chunks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), hashed("l_suppkey").alias("hash"), F.col("l_linenumber").alias("ordinal"))
    store = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file"), hashed("o_custkey").alias("hash"))
    return ingest.new_chunks(chunks, store, "file").select("file", "hash", "ordinal")


@query("""SELECT o_orderkey FROM orders JOIN (SELECT o_custkey AS k, max(o_orderkey % 4) AS g FROM orders GROUP BY 1) ON k = o_custkey WHERE o_orderkey % 4 = g""")
def x23_not_stale(spark, sf_dir):
    requests = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 4).alias("generation"))
    return ingest.not_stale(requests, requests.groupBy("o_custkey").agg(F.max("generation").alias("generation")), "o_custkey").select("o_orderkey")
