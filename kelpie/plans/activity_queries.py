"""The operators over the tables of a folder, each with the SQL that says the same.

Events are read as activities: application by kind, tag by user, with those of kinds 'error' and 'signup' as pauses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.functions import text as tx
from kelpie.functions import vectors as vx
from kelpie.operators import analytics, graph, merge, search
from kelpie.plans.indexes import kept_index, postings_sql, ranked_sql
from kelpie.sources import files, html

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def listed(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return listed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "PAUSED").when(F.col("event_type") == "signup", "SLEEP").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.date_trunc("second", "ts").alias("start_time"), kind.alias("application"), "user_id",
        F.nullif(F.col("user_id") % 5, F.lit(0)).alias("tag_id"), "value", "props",
    )


ACTIVITIES = """a AS (SELECT event_id AS id, date_trunc('second', ts) AS start_time,
  CASE event_type WHEN 'error' THEN 'PAUSED' WHEN 'signup' THEN 'SLEEP' ELSE event_type END AS application, user_id,
  nullif(user_id % 5, 0) AS tag_id, value, props FROM events)"""
SPANS = f"""WITH {ACTIVITIES}, s AS (SELECT *, CAST(start_time AS DATE) AS day, CAST(epoch(lead(start_time) OVER (PARTITION BY CAST(start_time AS DATE)
  ORDER BY start_time, id)) - epoch(start_time) AS BIGINT) AS seconds FROM a),
p AS (SELECT day, tag_id, CAST(sum(seconds) AS BIGINT) AS seconds FROM s WHERE application NOT IN ('PAUSED', 'SLEEP') GROUP BY ALL)"""


@query(f"{SPANS} SELECT * FROM p")
def a1_time_per_tag_day(spark, sf_dir):
    return analytics.time_per_tag_day(activities(spark, sf_dir))


@query(f"""{SPANS} SELECT round(sum(seconds) / (greatest((date_diff('day', min(day), max(day)) + 1) / 7, 1.0) * 40 * 3600), 9) AS tracked,
  round(1 - coalesce(sum(CASE WHEN tag_id IS NULL THEN seconds END), 0) / sum(seconds), 9) AS tagged FROM p""")
def a19_tracked_share(spark, sf_dir):
    share = analytics.tracked_share(analytics.time_per_tag_day(activities(spark, sf_dir)))
    return share.select(F.round("tracked", 9).alias("tracked"), F.round("tagged", 9).alias("tagged"))


@query(f"""{SPANS}, t AS (SELECT day, sum(seconds) AS seconds FROM p GROUP BY day),
d AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM t), (SELECT max(day) FROM t), INTERVAL 1 DAY)) AS DATE) AS day)
SELECT day, CAST(coalesce(seconds, 0) AS BIGINT) AS seconds FROM d LEFT JOIN t USING (day)""")
def a20_dense_days(spark, sf_dir):
    return analytics.dense_days(analytics.time_per_tag_day(activities(spark, sf_dir)))


_RUNS = f"""WITH {ACTIVITIES}, c AS (SELECT *, CASE WHEN application IS NOT DISTINCT FROM lag(application) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM a
  WINDOW w AS (PARTITION BY user_id ORDER BY start_time, id)),
i AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY start_time, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM c)"""


@query(f"{_RUNS} SELECT user_id, island, application, min(start_time) AS start_time, max(start_time) AS end_time, count(*) AS n_events FROM i GROUP BY user_id, island, application")
def x1_sessions(spark, sf_dir):
    return analytics.sessions(activities(spark, sf_dir))


@query(f"""WITH {ACTIVITIES}, g AS (SELECT *, epoch(lead(start_time) OVER w) - epoch(start_time) AS s, lag(id) OVER w AS pr, lead(id) OVER w AS nx FROM a
  WINDOW w AS (PARTITION BY user_id ORDER BY start_time, id)),
k AS (SELECT * FROM g WHERE NOT (pr IS NOT NULL AND nx IS NOT NULL AND s <= 86400)),
c AS (SELECT *, CASE WHEN application IS NOT DISTINCT FROM lag(application) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM k WINDOW w AS (PARTITION BY user_id ORDER BY start_time, id)),
i AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY start_time, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM c)
SELECT user_id, island, min(start_time) AS start_time, arg_min(id, (start_time, id)) AS id, arg_min(application, (start_time, id)) AS application, count(*) AS merged FROM i GROUP BY user_id, island""")
def x8_compaction(spark, sf_dir):
    return analytics.compacted(activities(spark, sf_dir), 86400)


@query("""SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL""")
def x12_window_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return e.select(F.col("window.start").alias("start"), "event_type", "n", "mean")


@query("""SELECT event_type, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.5), 6) AS p50, quantile_disc(value, 0.95) AS nearest, round(avg(value), 6) AS mean FROM events GROUP BY event_type""")
def a25_percentiles(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(
        F.round(F.percentile("value", 0.95), 6).alias("p95"), F.round(F.percentile("value", 0.5), 6).alias("p50"),
        analytics.nearest_rank("value", 0.95).alias("nearest"), F.round(F.avg("value"), 6).alias("mean"),
    )


@query("""SELECT event_type, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS BIGINT) AS high, count(DISTINCT CASE WHEN value > 50 THEN user_id END) AS users FROM events GROUP BY event_type""")
def a4_conditional_counts(spark, sf_dir):
    e, high = table(spark, sf_dir, "events"), F.col("value") > 50
    return e.groupBy("event_type").agg(F.sum(F.when(high, 1).otherwise(0)).alias("high"), F.count_distinct(F.when(high, F.col("user_id"))).alias("users"))


_PAIRS = """e AS (SELECT least(l_suppkey, l_partkey % 97) AS first_id, greatest(l_suppkey, l_partkey % 97) AS second_id, count(*) AS weight
  FROM lineitem WHERE l_suppkey <> l_partkey % 97 GROUP BY ALL)"""
_BOTH = f"{_PAIRS}, b AS (SELECT first_id AS id, second_id AS other, weight FROM e UNION ALL SELECT second_id, first_id, weight FROM e)"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_partkey") % 97).alias("other"))
    return graph.pair_weights(links, "l_suppkey", "other")


@query(f"WITH {_PAIRS} SELECT * FROM e")
def a6_pair_weights(spark, sf_dir):
    return _edges(spark, sf_dir)


@query(f"WITH {_BOTH} SELECT id, CAST(sum(weight) AS BIGINT) AS degree FROM b GROUP BY id")
def a24_weighted_degree(spark, sf_dir):
    return graph.degrees(_edges(spark, sf_dir))


@query(f"WITH {_PAIRS} SELECT * FROM e WHERE first_id % 3 = 0 AND second_id % 3 = 0")
def j7_induced_subgraph(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    nodes = graph.degrees(edges).filter("id % 3 = 0").select("id")
    return graph.induced(edges, nodes)


@query(f"""WITH {_BOTH}, s AS (SELECT id, sum(weight) AS score FROM b WHERE id % 7 = other % 7 GROUP BY id),
m AS (SELECT DISTINCT id, id % 7 AS cluster FROM b), r AS (SELECT m.id, cluster, CAST(coalesce(score, 0) AS BIGINT) AS score,
  row_number() OVER (PARTITION BY cluster ORDER BY coalesce(score, 0) DESC, m.id) AS place FROM m LEFT JOIN s USING (id))
SELECT * FROM r WHERE place <= 5""")
def a27_centrality(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    members = graph.degrees(edges).select("id", (F.col("id") % 7).alias("cluster"))
    return graph.centrality(edges, members).select("id", "cluster", "score", "place")


@query(f"""WITH {_BOTH}, v AS (SELECT id, other % 7 AS cluster, CAST(sum(weight) AS BIGINT) AS votes FROM b GROUP BY ALL)
SELECT id, cluster, votes FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY votes DESC, cluster) = 1""")
def g5_cluster_assignment(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    members = graph.degrees(edges).select("id", (F.col("id") % 7).alias("cluster"))
    return graph.assigned(edges, members).select("id", "cluster", "votes")


@query("""WITH RECURSIVE e AS (SELECT c_custkey AS a, c_custkey // 2 AS b FROM customer WHERE c_custkey % 10 <> 1),
b AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r AS (SELECT 2::BIGINT AS id UNION SELECT b.b FROM r JOIN b ON r.id = b.a) SELECT id FROM r""")
def g15_reachability(spark, sf_dir):
    c = table(spark, sf_dir, "customer").filter("c_custkey % 10 <> 1")
    edges = c.select(F.col("c_custkey").alias("first_id"), F.expr("c_custkey div 2").alias("second_id"), F.lit(1).alias("weight"))
    return graph.reachable(edges, spark.range(2, 3))


@query(f"""WITH {_BOTH}, d AS (SELECT id, count(*) AS degree, id % 4 AS bucket, id % 50 = 0 AS pinned FROM b GROUP BY id),
n AS (SELECT *, count(*) OVER (PARTITION BY bucket) AS c FROM d) SELECT id, degree, bucket FROM n WHERE c <= 20 OR pinned OR degree >= ceil(c / 20)""")
def g18_pruned_nodes(spark, sf_dir):
    nodes = graph.degrees(_edges(spark, sf_dir).withColumn("weight", F.lit(1).cast("long"))).withColumns({"bucket": F.col("id") % 4, "pinned": F.col("id") % 50 == 0})
    return graph.kept_nodes(nodes, 20).select("id", "degree", "bucket")


@query("""SELECT o_custkey, o_orderkey, o_totalprice, place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 3""")
def w2_best_three(spark, sf_dir):
    best = search.best_per_group(table(spark, sf_dir, "orders"), "o_custkey", [F.desc("o_totalprice"), F.col("o_orderkey")])
    return best.select("o_custkey", "o_orderkey", "o_totalprice", "place")


@query("""SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def w7_latest_row(spark, sf_dir):
    return merge.latest(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderdate")


@query("""SELECT c.c_custkey, count(o.o_orderkey) AS n, round(coalesce(sum(o.o_totalprice), 0), 2) AS spent FROM customer c LEFT JOIN orders o
  ON o.o_custkey = c.c_custkey AND o.o_orderdate >= TIMESTAMP '1995-01-01' AND o.o_orderdate < TIMESTAMP '1996-01-01' GROUP BY c.c_custkey""")
def j2_left_join_with_range(spark, sf_dir):
    year = table(spark, sf_dir, "orders").filter("o_orderdate >= timestamp_ntz'1995-01-01' and o_orderdate < timestamp_ntz'1996-01-01'")
    sums = year.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("spent"))
    joined = table(spark, sf_dir, "customer").join(sums, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("spent", F.lit(0.0)), 2).alias("spent"))


@query("""SELECT p_partkey, p_name FROM part p WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)
  OR EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R')""")
def j8_semi_join_either(spark, sf_dir):
    wanted = table(spark, sf_dir, "lineitem").filter("l_quantity > 45 or l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").join(wanted, "p_partkey", "left_semi").select("p_partkey", "p_name")


@query("""WITH e AS (SELECT o_orderkey AS edge_id, o_custkey AS first_id, o_custkey + 1 AS second_id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49))
SELECT c_custkey AS node_id FROM customer WHERE c_custkey IN (SELECT first_id FROM e UNION SELECT second_id FROM e) OR c_acctbal < 0""")
def j10_orphan_pruning(spark, sf_dir):
    nodes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node_id"))
    edges = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("edge_id"), F.col("o_custkey").alias("first_id"), (F.col("o_custkey") + 1).alias("second_id"))
    edge_links = table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select(F.col("l_orderkey").alias("edge_id"))
    node_links = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("node_id"))
    return merge.pruned(nodes, edges, node_links, edge_links)[0]


@query("""SELECT o_custkey, bool_and(o_orderstatus = 'F') AS done FROM orders GROUP BY o_custkey""")
def j13_all_children(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.bool_and(F.col("o_orderstatus") == "F").alias("done"))


@query("""SELECT s_suppkey, coalesce(n, 0) AS items, coalesce(p, 0) AS parts FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n, count(DISTINCT l_partkey) AS p FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey""")
def j19_joined_counts(spark, sf_dir):
    counts = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_distinct("l_partkey").alias("p"))
    return table(spark, sf_dir, "supplier").join(counts, F.col("s_suppkey") == F.col("l_suppkey"), "left").select("s_suppkey", F.coalesce("n", F.lit(0)).alias("items"), F.coalesce("p", F.lit(0)).alias("parts"))


@query("""WITH n AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE upper(c_mktsegment) END AS c_mktsegment, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 2 = 0),
o AS (SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_custkey % 5 <> 0)
SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, coalesce(n.c_mktsegment, o.c_mktsegment) AS c_mktsegment, coalesce(o.c_acctbal, n.c_acctbal) AS c_acctbal FROM o FULL JOIN n ON o.c_custkey = n.c_custkey""")
def m1_upsert(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    new = c.filter("c_custkey % 2 = 0").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.upper("c_mktsegment")).alias("c_mktsegment"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return merge.upserted(c.filter("c_custkey % 5 <> 0"), new, ["c_custkey"], keep_old=("c_acctbal",))


@query("""SELECT first_id, second_id, max(w) AS w FROM (SELECT least(l_partkey, l_suppkey) AS first_id, greatest(l_partkey, l_suppkey) AS second_id, l_quantity AS w FROM lineitem) GROUP BY ALL""")
def m8_heaviest_edge(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.least("l_partkey", "l_suppkey").alias("first_id"), F.greatest("l_partkey", "l_suppkey").alias("second_id"), F.col("l_quantity").alias("w"))
    return li.groupBy("first_id", "second_id").agg(F.max("w").alias("w"))


@query("""SELECT n_nationkey AS entity_id, 'nation' AS kind, n_name AS name FROM nation UNION ALL SELECT r_regionkey, 'region', r_name FROM region UNION ALL SELECT CAST(s_suppkey AS INTEGER), 'supplier', s_name FROM supplier""")
def u1_typed_union(spark, sf_dir):
    def of(name: str, key: str, label: str) -> DataFrame:
        return table(spark, sf_dir, name).select(F.col(key).cast("int").alias("entity_id"), F.lit(name).alias("kind"), F.col(label).alias("name"))

    return of("nation", "n_nationkey", "n_name").unionByName(of("region", "r_regionkey", "r_name")).unionByName(of("supplier", "s_suppkey", "s_name"))


@query("""SELECT DISTINCT o_custkey AS id FROM orders WHERE o_totalprice > 300000 UNION SELECT c_custkey FROM customer WHERE c_acctbal > 9000""")
def u3_distinct_union(spark, sf_dir):
    a = table(spark, sf_dir, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("id"))
    return a.union(table(spark, sf_dir, "customer").filter("c_acctbal > 9000").select("c_custkey")).distinct()


_QUERY = "(SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))"


def _first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").orderBy("vec_id").first()["embedding"])


@query(f"""SELECT id, round(d, 6) AS distance FROM (SELECT vec_id AS id, 1 - list_cosine_similarity(embedding::DOUBLE[], q) AS d FROM embeddings, {_QUERY}) ORDER BY d, id LIMIT 45""")
def k2_exact_top_k(spark, sf_dir):
    return search.top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", _first_vector(spark, sf_dir), 45).select("id", F.round("distance", 6).alias("distance"))


@query(f"""SELECT vec_id, round(list_distance(v, q), 6) AS l2, round(list_distance(v, q) ^ 2, 6) AS squared_l2, round(-list_inner_product(v, q), 6) AS dot,
  round(list_sum(list_transform(list_zip(v, q), lambda z: abs(z[1] - z[2]))), 6) AS l1 FROM (SELECT vec_id, embedding::DOUBLE[] AS v, q FROM embeddings, {_QUERY})""")
def v11_distances_of_all(spark, sf_dir):
    q = F.array(*map(F.lit, _first_vector(spark, sf_dir)))
    return table(spark, sf_dir, "embeddings").select("vec_id", *(F.round(vx.distance(F.col("embedding"), q, d), 6).alias(d) for d in ("l2", "squared_l2", "dot", "l1")))


@query("""WITH m AS (SELECT max(list_max(list_transform(embedding, lambda x: abs(x::DOUBLE)))) AS big FROM embeddings)
SELECT vec_id, CAST(list_sum(list_transform(embedding, lambda x: greatest(least(CASE WHEN x >= 0 THEN floor(x::DOUBLE * 127 / big + 0.5) ELSE ceil(x::DOUBLE * 127 / big - 0.5) END, 127), -128))) AS BIGINT) AS total FROM embeddings, m""")
def v12_quantized(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    big = e.agg(F.max(F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))).alias("big"))
    q = e.crossJoin(F.broadcast(big)).select("vec_id", vx.quantized_s8(F.col("embedding"), F.col("big")).alias("q"))  # one row
    return q.select("vec_id", F.aggregate("q", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("""SELECT vec_id, CAST(list_sum(list_transform(list_zip(embedding, q), lambda z: CASE WHEN (z[1] >= 0) <> (z[2] >= 0) THEN 1 ELSE 0 END)) AS INTEGER) AS bits
  FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))""")
def v13_bits_apart(spark, sf_dir):
    q = vx.quantized_bits(F.array(*map(F.lit, _first_vector(spark, sf_dir))))
    return table(spark, sf_dir, "embeddings").select("vec_id", vx.hamming(vx.quantized_bits(F.col("embedding")), q).alias("bits"))


_WORDS = ["the", "and", "erth"]
_TERM = r"[^a-z0-9\x{80}-\x{10FFFF}]+"
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = f"w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array({_LOWERED}, '{_TERM}'), lambda t: t <> '') AS t FROM documents)"


@query(f"""WITH {postings_sql("documents")}, {ranked_sql("documents", _WORDS)} SELECT id, rank FROM h_documents ORDER BY rank, id LIMIT 45""")
def t3_bm25_top(spark, sf_dir):
    hits = kept_index(spark, sf_dir, "documents").ranked(_WORDS).withColumn("rank", F.round("rank", 7))
    return hits.orderBy("rank", "id").limit(45)


@query(f"""WITH {_TERMS}, u AS (SELECT id, unnest(t) AS term FROM w) SELECT term, count(*) AS n, count(DISTINCT id) AS docs FROM u GROUP BY term""")
def t1_term_statistics(spark, sf_dir):
    p = search.postings(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))
    per_doc = p.groupBy("term", "id").agg(F.count("*").alias("c"))
    return per_doc.groupBy("term").agg(F.sum("c").alias("n"), F.count("*").alias("docs"))


@query(f"""WITH {postings_sql("documents")}, {ranked_sql("documents", _WORDS, digits=9)}, x AS (SELECT id, rank FROM h_documents),
y AS (SELECT vec_id AS id, round(1 - list_cosine_similarity(embedding::DOUBLE[], q), 9) AS distance FROM embeddings, {_QUERY}),
b AS (SELECT (SELECT min(rank) FROM x) AS r0, (SELECT max(rank) FROM x) AS r1, (SELECT min(distance) FROM y) AS d0, (SELECT max(distance) FROM y) AS d1),
z AS (SELECT id, CASE WHEN rank IS NULL THEN 0.0::DOUBLE WHEN r0 = r1 THEN 1.0 ELSE (r1 - rank) / (r1 - r0) END AS f, CASE WHEN distance IS NULL THEN 0.0::DOUBLE WHEN d0 = d1 THEN 1.0 ELSE (d1 - distance) / (d1 - d0) END AS v FROM x FULL JOIN y USING (id), b)
SELECT id, round(0.55::DOUBLE * v + 0.45::DOUBLE * f + CASE WHEN v > 0 AND f > 0 THEN 0.10::DOUBLE ELSE 0 END, 6) AS score FROM z WHERE 0.55::DOUBLE * v + 0.45::DOUBLE * f + CASE WHEN v > 0 AND f > 0 THEN 0.10::DOUBLE ELSE 0 END >= 0.42""")
def h1_hybrid_search(spark, sf_dir):
    """All rows that match by text and all vectors are normed; only the floor of the score leaves rows out."""
    text = kept_index(spark, sf_dir, "documents").ranked(_WORDS).withColumn("rank", F.round("rank", 9))
    vectors, query = table(spark, sf_dir, "embeddings"), F.array(*map(F.lit, _first_vector(spark, sf_dir)))
    near = vectors.select(F.col("vec_id").alias("id"), F.round(vx.distance(F.col("embedding"), query), 9).alias("distance"))
    return search.hybrid(text, near).select("id", F.round("score", 6).alias("score"))


@query("""SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' / ' || p_brand), '[^\\p{L}\\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
  md5(p_name) AS md5, sha256(p_name) AS sha, replace(replace(p_type, '&', '&amp;'), '<', '&lt;') AS escaped FROM part""")
def s5_slugs_and_hashes(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", tx.slug(F.concat_ws(" / ", "p_name", "p_brand")).alias("slug"), F.md5("p_name").alias("md5"), F.sha2("p_name", 256).alias("sha"), tx.xml_escaped(F.col("p_type")).alias("escaped"))


@query(r"""SELECT doc_id, CAST(greatest(floor((CASE WHEN trim(t, E' ') = '' THEN 0 ELSE len(regexp_split_to_array(trim(t, E' '), '[ \t\n\x0b\f\r]+')) END) * 4 / 3), floor(length(t) / 4), 1) AS BIGINT) AS tokens FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""")
def s20_token_estimates(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.token_estimate(F.coalesce("text", F.lit(""))).alias("tokens"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def s29_json_fields(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("""SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS roles, count(*) AS turns FROM conversations GROUP BY conv_id""")
def a13_nested_lists(spark, sf_dir):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda x: x["role"]), ">").alias("roles"), F.count("*").alias("turns"))


@query("""SELECT o_custkey, sum(v) AS value FROM (SELECT o_custkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 2 ELSE 1 END AS v FROM orders) GROUP BY o_custkey""".replace("sum(v)", "CAST(sum(v) AS BIGINT)"))
def x16_priority_classes(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum(F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 2).otherwise(1)).alias("value"))


@query()
def io12_html_to_markdown(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", html.title(F.col("html")).alias("title"), html.markdown(F.col("html")).alias("markdown"))


@query()
def s15_markdown_sections(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", html.markdown(F.col("html")).alias("markdown"))
    return files.anchors(pages, "page_id", F.col("markdown"))


@query()
def s19_paragraph_chunks(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", html.markdown(F.col("html")).alias("markdown"))
    return files.chunks(pages, "page_id", F.col("markdown"))
