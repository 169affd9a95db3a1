"""Merges over the tables of a folder, each with its SQL. Customers are read as overviews, nodes or jobs, orders as their children."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelpie.functions import text as tx
from kelpie.operators import merge, selection
from kelpie.plans.activity_queries import QUERIES, SQL, query, table

__all__ = ["QUERIES", "SQL"]

_OLD = "o AS (SELECT c_custkey AS id, c_mktsegment AS summary, c_acctbal AS vector, c_nationkey AS created FROM customer WHERE c_custkey % 5 <> 0)"
_NEW = "n AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 > 0 THEN lower(c_mktsegment) END AS summary, CASE WHEN c_custkey % 4 > 0 THEN c_acctbal * 2 END AS vector, c_nationkey + 100 AS created FROM customer WHERE c_custkey % 2 = 0)"


def _old_new(spark, sf_dir):
    c, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    old = c.filter("c_custkey % 5 <> 0").select(key.alias("id"), F.col("c_mktsegment").alias("summary"), F.col("c_acctbal").alias("vector"), F.col("c_nationkey").alias("created"))
    new = c.filter("c_custkey % 2 = 0").select(key.alias("id"), F.when(key % 3 > 0, F.lower("c_mktsegment")).alias("summary"), F.when(key % 4 > 0, F.col("c_acctbal") * 2).alias("vector"), (F.col("c_nationkey") + 100).alias("created"))
    return old, new


@query(f"""WITH {_OLD}, {_NEW} SELECT coalesce(o.id, n.id) AS id, coalesce(n.summary, o.summary) AS summary, coalesce(n.vector, o.vector) AS vector, coalesce(o.created, n.created) AS created FROM o FULL JOIN n ON o.id = n.id""")
def m2_upserted_overviews(spark, sf_dir):
    return merge.upserted(*_old_new(spark, sf_dir), ["id"], keep_old=("created",))


@query(f"""WITH {_OLD}, {_NEW} SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NULL THEN o.summary ELSE n.summary END AS summary, coalesce(n.vector, o.vector) AS vector, CASE WHEN n.id IS NULL THEN o.created ELSE n.created END AS created FROM o FULL JOIN n ON o.id = n.id""")
def m4_upserted_screenshots(spark, sf_dir):
    old, new = _old_new(spark, sf_dir)
    there = F.col("n.id").isNotNull()
    rules = {c: F.when(there, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) for c in ("summary", "created")}
    return merge.upserted(old, new, ["id"], rules=rules)


@query("""WITH x AS (SELECT lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS name, p_partkey, p_type FROM part),
o AS (SELECT name, arg_min(p_type, p_partkey) AS type, min(p_partkey) AS node_id FROM x WHERE p_partkey % 2 = 0 GROUP BY 1), n AS (SELECT name, arg_min(p_type, p_partkey) AS type, min(p_partkey) AS node_id FROM x WHERE p_partkey % 2 = 1 GROUP BY 1)
SELECT coalesce(o.name, n.name) AS name, coalesce(n.type, o.type) AS type, coalesce(o.node_id, n.node_id) AS node_id FROM o FULL JOIN n ON o.name = n.name""")
def m5_upserted_nodes(spark, sf_dir):
    named = table(spark, sf_dir, "part").select(tx.normalized_name(F.col("p_name")).alias("name"), "p_partkey", "p_type")
    sides = [named.filter(f"p_partkey % 2 = {k}").groupBy("name").agg(F.min_by("p_type", "p_partkey").alias("type"), F.min("p_partkey").alias("node_id")) for k in (0, 1)]
    return merge.upserted(*sides, ["name"], keep_old=("node_id",))


@query("""WITH e AS (SELECT least(l_partkey, l_suppkey) AS first_id, greatest(l_partkey, l_suppkey) AS second_id, l_orderkey AS edge_id, l_quantity AS strength FROM lineitem WHERE l_partkey <> l_suppkey),
o AS (SELECT first_id, second_id, min(edge_id) AS edge_id, max(strength) AS strength FROM e WHERE edge_id % 2 = 0 GROUP BY ALL), n AS (SELECT first_id, second_id, min(edge_id) AS edge_id, max(strength) AS strength FROM e WHERE edge_id % 2 = 1 GROUP BY ALL)
SELECT coalesce(o.first_id, n.first_id) AS first_id, coalesce(o.second_id, n.second_id) AS second_id, coalesce(o.edge_id, n.edge_id) AS edge_id, coalesce(n.strength, o.strength) AS strength FROM o FULL JOIN n ON o.first_id = n.first_id AND o.second_id = n.second_id""")
def m6_upserted_edges(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").filter("l_partkey <> l_suppkey").select("l_partkey", "l_suppkey", F.col("l_orderkey").alias("edge_id"), F.col("l_quantity").alias("strength"))
    edges = merge.canonical(li, "l_partkey", "l_suppkey")
    sides = [edges.filter(f"edge_id % 2 = {k}").groupBy("first_id", "second_id").agg(F.min("edge_id").alias("edge_id"), F.max("strength").alias("strength")) for k in (0, 1)]
    return merge.upserted(*sides, ["first_id", "second_id"], keep_old=("edge_id",))


@query("""WITH e AS (SELECT md5(o_orderpriority || o_custkey) AS hash, o_orderkey AS claim_id, o_orderpriority AS text FROM orders),
o AS (SELECT hash, min(claim_id) AS claim_id, min(text) AS text FROM e WHERE claim_id % 2 = 0 GROUP BY 1), n AS (SELECT hash, min(claim_id) AS claim_id, min(text) AS text FROM e WHERE claim_id % 2 = 1 GROUP BY 1)
SELECT coalesce(o.hash, n.hash) AS hash, coalesce(o.claim_id, n.claim_id) AS claim_id, coalesce(n.text, o.text) AS text FROM o FULL JOIN n ON o.hash = n.hash""")
def m7_upserted_claims(spark, sf_dir):
    each = table(spark, sf_dir, "orders").select(F.md5(F.concat("o_orderpriority", F.col("o_custkey").cast("string"))).alias("hash"), F.col("o_orderkey").alias("claim_id"), F.col("o_orderpriority").alias("text"))
    sides = [each.filter(f"claim_id % 2 = {k}").groupBy("hash").agg(F.min("claim_id").alias("claim_id"), F.min("text").alias("text")) for k in (0, 1)]
    return merge.upserted(*sides, ["hash"], keep_old=("claim_id",))


@query(f"""WITH {_OLD}, {_NEW} SELECT * FROM n UNION ALL SELECT * FROM o WHERE id NOT IN (SELECT id FROM n)""")
def m9_overwritten(spark, sf_dir):
    return merge.overwritten(*_old_new(spark, sf_dir), ["id"])


@query(f"""WITH {_OLD}, {_NEW} SELECT o.id, CASE WHEN n.id IS NULL THEN o.summary ELSE n.summary END AS summary, CASE WHEN n.id IS NULL OR n.summary IS NOT DISTINCT FROM o.summary THEN o.vector END AS vector, o.created FROM o LEFT JOIN n ON o.id = n.id""")
def m11_reset_on_change(spark, sf_dir):
    old, new = _old_new(spark, sf_dir)
    return merge.reset_on_change(old, new, "id", "summary", ["vector"]).select("id", "summary", "vector", "created")


@query("""WITH r AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 6 > 0 THEN c_mktsegment END AS tag, CASE WHEN c_custkey % 6 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'ontology' ELSE 'manual' END AS s FROM customer),
u AS (SELECT o_custkey AS id, CAST(max(o_orderkey % 8) AS INTEGER) AS cluster, max(o_orderpriority) AS t FROM orders WHERE o_custkey % 7 > 0 GROUP BY 1)
SELECT r.id, cluster, CASE WHEN tag IS NULL OR s = 'ontology' THEN t ELSE tag END AS tag, CASE WHEN tag IS NULL OR s = 'ontology' THEN CASE WHEN t IS NOT NULL THEN 'ontology' END ELSE s END AS tag_source FROM r LEFT JOIN u ON u.id = r.id""")
def m13_published_assignments(spark, sf_dir):
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(key.alias("id"), F.lit(-1).alias("cluster"), F.when(key % 6 > 0, F.col("c_mktsegment")).alias("tag"), F.when(key % 6 == 0, None).when(key % 2 == 0, "ontology").otherwise("manual").alias("tag_source"))
    run = table(spark, sf_dir, "orders").filter("o_custkey % 7 > 0").groupBy(F.col("o_custkey").alias("id")).agg(F.max(F.col("o_orderkey") % 8).cast("int").alias("cluster"), F.max("o_orderpriority").alias("tag"))
    return merge.published_assignments(rows, run, "id", "ontology").select("id", "cluster", "tag", "tag_source")


@query("""WITH r AS (SELECT l_partkey AS node_id, min(l_suppkey) AS community_id FROM lineitem WHERE l_quantity > 45 GROUP BY 1) SELECT s_suppkey AS community_id, s_name FROM supplier WHERE s_suppkey IN (SELECT community_id FROM r JOIN part ON p_partkey = node_id)""")
def m14_published_communities(spark, sf_dir):
    run = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").groupBy(F.col("l_partkey").alias("node_id")).agg(F.min("l_suppkey").alias("community_id"))
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id"), F.lit(0).cast("long").alias("community_id"))
    return merge.published_communities(nodes, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("community_id"), "s_name"), run)[1]


_BOUND = """a AS (SELECT CAST(ts AS DATE) AS day, user_id % 7 AS tag, user_id FROM events),
b AS (SELECT day, tag, min(user_id) AS overview_id, CASE WHEN tag % 2 = 0 THEN 'manual' ELSE 'auto' END AS source FROM a WHERE tag < 5 AND user_id % 2 = 0 GROUP BY day, tag)"""


def _bound(spark, sf_dir):
    used = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), (F.col("user_id") % 7).alias("tag"), "user_id")
    bindings = used.filter("tag < 5 and user_id % 2 = 0").groupBy("day", "tag").agg(F.min("user_id").alias("overview_id"))
    return used, bindings.withColumn("source", F.when(F.col("tag") % 2 == 0, "manual").otherwise("auto"))


@query(f"""WITH {_BOUND}, w AS (SELECT DISTINCT day, tag FROM a WHERE tag = 6), n AS (SELECT day, tag, (SELECT max(overview_id) FROM b) + row_number() OVER (ORDER BY day, tag) AS overview_id, 'auto' AS source FROM w WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.day = w.day AND b.tag = w.tag)),
u AS (SELECT DISTINCT day, tag FROM a WHERE user_id % 3 > 0 OR tag = 6) SELECT day, tag, overview_id, source FROM (SELECT * FROM b UNION ALL SELECT * FROM n) e WHERE source = 'manual' OR EXISTS (SELECT 1 FROM u WHERE u.day = e.day AND u.tag = e.tag)""")
def m16_ensured_bindings(spark, sf_dir):
    rows, bindings = _bound(spark, sf_dir)
    return merge.ensured_bindings(bindings, rows.filter("tag = 6"), rows.filter("user_id % 3 > 0 or tag = 6"))


@query(f"""WITH {_BOUND}, m AS (SELECT *, overview_id % 5 = 0 AS moves, CASE WHEN overview_id % 5 = 0 THEN 1 ELSE tag END AS t FROM b)
SELECT day, t AS tag, overview_id, source FROM m QUALIFY row_number() OVER (PARTITION BY day, t ORDER BY moves, overview_id) = 1""")
def m17_retagged(spark, sf_dir):
    _, bindings = _bound(spark, sf_dir)
    moves = bindings.filter("overview_id % 5 = 0").select("overview_id").distinct().withColumn("new_tag", F.lit(1).cast("long"))
    return merge.retagged(bindings, moves).select("day", "tag", "overview_id", "source")


@query("""WITH l AS (SELECT l_partkey AS node_id, l_orderkey AS edge_id FROM lineitem WHERE l_suppkey NOT IN (3, 4, 5) AND l_quantity > 48), e AS (SELECT o_orderkey AS edge_id, o_custkey AS first_id, o_custkey + 1 AS second_id FROM orders WHERE o_orderkey IN (SELECT edge_id FROM l))
SELECT p_partkey AS node_id FROM part WHERE p_partkey IN (SELECT node_id FROM l UNION SELECT first_id FROM e UNION SELECT second_id FROM e)""")
def m19_file_reset(spark, sf_dir):
    links = table(spark, sf_dir, "lineitem").filter("l_quantity > 48").select(F.col("l_partkey").alias("node_id"), F.col("l_orderkey").alias("edge_id"), F.col("l_suppkey").alias("file_id"))
    left = merge.without_file(links, "file_id", [3, 4, 5])
    edges = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("edge_id"), F.col("o_custkey").alias("first_id"), (F.col("o_custkey") + 1).alias("second_id"))
    return merge.pruned(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id")), edges, left.select("node_id"), left.select("edge_id"))[0]


@query("""WITH l AS (SELECT l_partkey AS node_id FROM lineitem WHERE NOT (l_shipdate >= TIMESTAMP '1995-03-01' AND l_shipdate < TIMESTAMP '1995-03-02') AND l_quantity > 49) SELECT p_partkey AS node_id FROM part WHERE p_partkey IN (SELECT node_id FROM l)""")
def m20_day_rebuild(spark, sf_dir):
    links = table(spark, sf_dir, "lineitem").filter(~selection.on_day("l_shipdate", "1995-03-01") & (F.col("l_quantity") > 49)).select(F.col("l_partkey").alias("node_id"))
    none = spark.createDataFrame([], "edge_id long, first_id long, second_id long")
    return merge.pruned(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id")), none, links, none.select("edge_id"))[0]


_JOBS = """j AS (SELECT c_custkey AS job_id, c_custkey % 5 > 0 AS enabled, CASE WHEN c_custkey % 3 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 MINUTE * (c_custkey % 50) END AS lease_until,
  CASE WHEN c_custkey % 4 > 0 THEN TIMESTAMP '2023-12-31 00:00:00' END AS last_success_at, c_custkey % 9 * 20000 AS interval_seconds, CAST(c_custkey % 3 AS INTEGER) AS failures FROM customer)"""


def _jobs(spark, sf_dir):
    key, at = F.col("c_custkey"), lambda x: F.lit(x).cast("timestamp_ntz")
    return table(spark, sf_dir, "customer").select(
        key.alias("job_id"), (key % 5 > 0).alias("enabled"), F.when(key % 3 == 0, at("2024-01-01 00:00:00") + F.make_dt_interval(mins=(key % 50).cast("int"))).alias("lease_until"),
        F.when(key % 4 > 0, at("2023-12-31 00:00:00")).alias("last_success_at"), (key % 9 * 20000).alias("interval_seconds"), (key % 3).cast("int").alias("failures"),
    )


@query(f"""WITH {_JOBS}, c AS (SELECT *, enabled AND (lease_until IS NULL OR lease_until <= TIMESTAMP '2024-01-01 00:20:00') AND (last_success_at IS NULL OR epoch(TIMESTAMP '2024-01-01 00:20:00') - epoch(last_success_at) >= interval_seconds) AS claimed FROM j)
SELECT job_id, claimed, CASE WHEN claimed THEN TIMESTAMP '2024-01-01 00:25:00' ELSE lease_until END AS lease_until FROM c""")
def m23_leased_jobs(spark, sf_dir):
    return merge.leased(_jobs(spark, sf_dir), F.lit("2024-01-01 00:20:00").cast("timestamp_ntz"), 300).select("job_id", "claimed", "lease_until")


@query(f"""WITH {_JOBS}, o AS (SELECT o_custkey AS job_id, CASE max(o_orderkey) % 3 WHEN 0 THEN 'success' WHEN 1 THEN 'fail' ELSE 'defer' END AS outcome FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1)
SELECT job_id, CASE WHEN outcome = 'success' THEN TIMESTAMP '2024-01-01 00:20:00' ELSE last_success_at END AS last_success_at, CASE outcome WHEN 'success' THEN 0 WHEN 'fail' THEN failures + 1 ELSE failures END AS failures,
  CASE WHEN outcome IS NULL THEN lease_until END AS lease_until FROM j LEFT JOIN o USING (job_id)""")
def m24_finished_jobs(spark, sf_dir):
    last = F.max("o_orderkey") % 3
    outcomes = table(spark, sf_dir, "orders").filter("o_custkey % 2 = 0").groupBy(F.col("o_custkey").alias("job_id")).agg(F.when(last == 0, "success").when(last == 1, "fail").otherwise("defer").alias("outcome"))
    return merge.finished(_jobs(spark, sf_dir), outcomes, F.lit("2024-01-01 00:20:00").cast("timestamp_ntz")).select("job_id", "last_success_at", "failures", "lease_until")


@query("""WITH o AS (SELECT o_custkey AS p, o_orderkey AS c, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END AS image, o_orderstatus AS note FROM orders WHERE o_orderkey % 4 > 0), n AS (SELECT o_custkey AS p, o_orderkey AS c, o_totalprice + 1 AS image, 'new' AS note FROM orders WHERE o_orderkey % 5 > 1 AND o_custkey % 2 = 0)
SELECT n.p AS parent_id, n.c AS child_id, coalesce(o.image, n.image) AS image, n.note FROM n LEFT JOIN o ON o.p = n.p AND o.c = n.c UNION ALL SELECT p, c, image, note FROM o WHERE p % 2 > 0""")
def m27_saved_children(spark, sf_dir):
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    ids = (F.col("o_custkey").alias("parent_id"), key.alias("child_id"))
    old = o.filter("o_orderkey % 4 > 0").select(*ids, F.when(key % 3 > 0, F.col("o_totalprice")).alias("image"), F.col("o_orderstatus").alias("note"))
    new = o.filter("o_orderkey % 5 > 1 and o_custkey % 2 = 0").select(*ids, (F.col("o_totalprice") + 1).alias("image"), F.lit("new").alias("note"))
    return merge.saved_children(old, new, o.filter("o_custkey % 2 = 0").select(ids[0]).distinct())
