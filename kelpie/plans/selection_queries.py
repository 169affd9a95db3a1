"""Filters, joins, unions and orders over the tables of a folder, each with its SQL.

Events are read as activities, parts as knowledge nodes, lineitems as their text chunks, orders as anchors and customers as files.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from kelpie.operators import analytics, graph, search, selection
from kelpie.plans.activity_queries import _QUERY, ACTIVITIES, QUERIES, SQL, _first_vector, activities, query, table

__all__ = ["QUERIES", "SQL"]


@query(f"""WITH {ACTIVITIES} SELECT id, start_time, application FROM a WHERE start_time >= TIMESTAMP '2024-01-05' AND start_time < TIMESTAMP '2024-01-06'""")
def f1_on_day(spark, sf_dir):
    return activities(spark, sf_dir).filter(selection.on_day("start_time", "2024-01-05")).select("id", "start_time", "application")


@query(f"""WITH {ACTIVITIES} SELECT CAST(start_time AS DATE) AS day, application, count(*) AS n FROM a WHERE CAST(start_time AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-05' GROUP BY ALL""")
def f2_between_dates(spark, sf_dir):
    some = activities(spark, sf_dir).filter(selection.between_dates("start_time", "2024-01-03", "2024-01-05"))
    return some.groupBy(F.to_date("start_time").alias("day"), "application").agg(F.count("*").alias("n"))


@query("""SELECT 'one' AS asked, p_partkey FROM part WHERE p_type = 'ECONOMY' UNION ALL SELECT 'two', p_partkey FROM part WHERE p_type = 'ECONOMY' AND p_size = 7 UNION ALL SELECT 'none', p_partkey FROM part""")
def f3_optional_filters(spark, sf_dir):
    asked = {"one": ("ECONOMY", None, None), "two": ("ECONOMY", None, 7), "none": (None, None, None)}
    some = [table(spark, sf_dir, "part").filter(selection.optional(p_type=t, p_brand=b, p_size=s)).select(F.lit(name).alias("asked"), "p_partkey") for name, (t, b, s) in asked.items()]
    return some[0].union(some[1]).union(some[2])


@query("""SELECT c_custkey FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'legacy' ELSE c_mktsegment END AS s FROM customer) WHERE coalesce(s, '') != 'legacy'""")
def f4_other_than(spark, sf_dir):
    source = F.when(F.col("c_custkey") % 4 == 1, "legacy").when(F.col("c_custkey") % 4 > 1, F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", source.alias("s")).filter(selection.other_than("s", "legacy")).select("c_custkey")


@query("""SELECT o_orderkey FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS deleted_at FROM orders) WHERE deleted_at IS NULL""")
def f6_live_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("deleted_at"))
    return rows.filter("deleted_at is null").select("o_orderkey")


@query("""SELECT n_nationkey, n_name IN (SELECT unnest(['FRANCE', 'BRAZIL', 'NATION_3'])) AS listed, false AS none FROM nation""")
def f8_in_lists(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", selection.in_list("n_name", ["FRANCE", "BRAZIL", "NATION_3"]).alias("listed"), selection.in_list("n_name", []).alias("none"))


@query("""SELECT 'node' AS kind, p_partkey AS node_id, NULL::BIGINT AS edge_id FROM part UNION ALL SELECT 'edge', NULL, o_orderkey FROM orders""")
def f10_polymorphic_ids(spark, sf_dir):
    both = table(spark, sf_dir, "part").select(F.lit("node").alias("kind"), F.col("p_partkey").alias("id")).union(table(spark, sf_dir, "orders").select(F.lit("edge"), "o_orderkey"))
    return both.select("kind", F.when(F.col("kind") == "node", F.col("id")).alias("node_id"), F.when(F.col("kind") == "edge", F.col("id")).alias("edge_id"))


@query("""SELECT id, CASE WHEN trim(summary) <> '' AND v IS NULL THEN 'vector' WHEN v IS NOT NULL AND t IS NULL THEN 'tag' WHEN t IS NOT NULL AND o IS NULL THEN 'group' END AS step FROM
  (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN ' ' WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS summary, CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END AS v,
   CASE WHEN c_custkey % 5 > 0 THEN c_nationkey END AS t, CASE WHEN c_custkey % 4 > 0 THEN c_nationkey END AS o FROM customer) WHERE step IS NOT NULL""")
def f14_missing_work(spark, sf_dir):
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        key.alias("id"), F.when(key % 7 == 0, " ").when(key % 11 != 0, F.col("c_mktsegment")).alias("summary"), F.when(key % 3 > 0, F.col("c_acctbal")).alias("v"),
        F.when(key % 5 > 0, F.col("c_nationkey")).alias("t"), F.when(key % 4 > 0, F.col("c_nationkey")).alias("o"),
    )
    return selection.missing_work(rows, "summary", "v", "t", "o").select("id", "step")


@query("""SELECT p_partkey FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_brand END AS name, CASE p_partkey % 4 WHEN 0 THEN 'Person' WHEN 1 THEN 'idea' WHEN 2 THEN 'place' END AS kind FROM part)
  WHERE lower(kind) IN ('organization', 'person', 'place', 'product') AND regexp_matches(name, '[\\p{Lu}\\p{N}]')""")
def f15_valid_entities(spark, sf_dir):
    key = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(key, F.when(key % 3 == 0, F.col("p_name")).otherwise(F.col("p_brand")).alias("name"), F.when(key % 4 == 0, "Person").when(key % 4 == 1, "idea").when(key % 4 == 2, "place").alias("kind"))
    return rows.filter(selection.valid_entity(F.col("name"), F.col("kind"))).select("p_partkey")


@query("""SELECT s_suppkey FROM (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN '  ' WHEN 1 THEN s_name END AS summary FROM supplier) WHERE trim(summary) <> ''""")
def f16_visible_nodes(spark, sf_dir):
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(key, F.when(key % 3 == 0, "  ").when(key % 3 == 1, F.col("s_name")).alias("summary")).filter(selection.not_blank("summary")).select("s_suppkey")


@query("""SELECT p_partkey AS node_id, l_orderkey AS chunk_id, o_orderkey AS anchor_id, c_custkey AS file_id, c_name FROM part JOIN lineitem ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey
  JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 3 AND p_size < 10""")
def j4_node_to_file(spark, sf_dir):
    files = table(spark, sf_dir, "customer").filter("c_nationkey = 3").select("c_custkey", "c_name")
    anchors = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(files, F.col("o_custkey") == F.col("c_custkey"))
    chunks = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey").join(table(spark, sf_dir, "part").filter("p_size < 10").select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
    return chunks.join(anchors, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("p_partkey").alias("node_id"), F.col("l_orderkey").alias("chunk_id"), F.col("o_orderkey").alias("anchor_id"), F.col("c_custkey").alias("file_id"), "c_name")


@query("""SELECT DISTINCT p_brand AS community, s_name AS file FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey = 5""")
def j5_community_files(spark, sf_dir):
    files = table(spark, sf_dir, "supplier").filter("s_nationkey = 5").select("s_suppkey", F.col("s_name").alias("file"))
    links = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct().join(files, F.col("l_suppkey") == F.col("s_suppkey"))
    return links.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("community"), "file").distinct()


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IN (3, 5, 8, 13, 21, 34, 55, 89))
SELECT a.vec_id AS first_id, b.vec_id AS second_id, round(list_cosine_similarity(a.e, b.e), 6) AS weight FROM v a JOIN v b ON a.vec_id < b.vec_id""")
def j6_pairs_of_given(spark, sf_dir):
    return graph.pairs_of(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", [3, 5, 8, 13, 21, 34, 55, 89]).select("first_id", "second_id", F.round("weight", 6).alias("weight"))


@query(f"""SELECT id, label, round(d, 6) AS distance FROM (SELECT vec_id AS id, label, 1 - list_cosine_similarity(embedding::DOUBLE[], q) AS d FROM embeddings, {_QUERY} ORDER BY d, id LIMIT 20)""")
def j16_hits_with_rows(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    hits = search.top_k(e, "vec_id", "embedding", _first_vector(spark, sf_dir), 20)
    return e.join(F.broadcast(hits), F.col("vec_id") == F.col("id")).select("id", "label", F.round("distance", 6).alias("distance"))  # 20 rows


@query("""WITH e AS (SELECT o_custkey AS id, CAST(max(o_orderkey % 9) AS INTEGER) AS cluster FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT c_custkey AS id, coalesce(cluster, c_nationkey) AS cluster, CASE WHEN cluster IS NULL THEN 'centroid' ELSE 'edge' END AS by FROM customer LEFT JOIN e ON id = c_custkey""")
def j18_edge_else_centroid(spark, sf_dir):
    by_edge = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("id")).agg(F.max(F.col("o_orderkey") % 9).cast("int").alias("cluster"))
    by_centroid = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("cluster"))
    return graph.with_fallback(by_centroid.select("id"), by_edge, by_centroid)


@query("""WITH c AS (SELECT l_suppkey, count(*) AS chunks, count(DISTINCT l_partkey) AS nodes FROM lineitem GROUP BY 1)
SELECT s_suppkey AS file_id, s_name AS path, coalesce(chunks, 0) AS chunks, coalesce(nodes, 0) AS nodes FROM supplier LEFT JOIN c ON l_suppkey = s_suppkey WHERE s_nationkey = 7""")
def j20_directory_entries(spark, sf_dir):
    files = table(spark, sf_dir, "supplier").filter("s_nationkey = 7")
    counts = table(spark, sf_dir, "lineitem").join(files.select(F.col("s_suppkey").alias("l_suppkey")), "l_suppkey", "left_semi").groupBy("l_suppkey").agg(F.count("*").alias("chunks"), F.count_distinct("l_partkey").alias("nodes"))
    return files.join(counts, F.col("s_suppkey") == F.col("l_suppkey"), "left").select(F.col("s_suppkey").alias("file_id"), F.col("s_name").alias("path"), F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("nodes", F.lit(0)).alias("nodes"))


@query("""WITH a AS (SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR) || ':' || n, ',' ORDER BY o_orderkey) AS anchors FROM (SELECT o_custkey, o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL) GROUP BY 1),
l AS (SELECT l_from, string_agg(coalesce(c_name, '?'), ',' ORDER BY l_to) AS links FROM (SELECT DISTINCT o_custkey AS l_from, o_custkey + 1 AS l_to FROM orders) LEFT JOIN customer ON c_custkey = l_to GROUP BY 1)
SELECT c_custkey AS file_id, lower(c_name) AS alias, coalesce(anchors, '') AS anchors, coalesce(links, '') AS links FROM customer LEFT JOIN a ON a.o_custkey = c_custkey LEFT JOIN l ON l_from = c_custkey""")
def j22_file_details(spark, sf_dir):
    o, files = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    chunks = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    each = o.join(chunks, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_custkey", "o_orderkey", F.coalesce("n", F.lit(0)).alias("n"))
    shown = lambda items, one: F.array_join(F.transform(F.array_sort(items), one), ",")
    anchors = each.groupBy("o_custkey").agg(shown(F.collect_list(F.struct("o_orderkey", "n")), lambda x: F.concat(x["o_orderkey"].cast("string"), F.lit(":"), x["n"].cast("string"))).alias("anchors"))
    to = o.select(F.col("o_custkey").alias("l_from"), (F.col("o_custkey") + 1).alias("l_to")).distinct().join(files.select(F.col("c_custkey").alias("l_to"), "c_name"), "l_to", "left")
    links = to.groupBy("l_from").agg(shown(F.collect_list(F.struct("l_to", F.coalesce("c_name", F.lit("?")).alias("name"))), lambda x: x["name"]).alias("links"))
    whole = files.join(anchors, F.col("o_custkey") == F.col("c_custkey"), "left").join(links, F.col("l_from") == F.col("c_custkey"), "left")
    return whole.select(F.col("c_custkey").alias("file_id"), F.lower("c_name").alias("alias"), F.coalesce("anchors", F.lit("")).alias("anchors"), F.coalesce("links", F.lit("")).alias("links"))


@query("""WITH e AS (SELECT l_suppkey % 40 AS a, l_partkey % 40 AS b, count(*) AS w FROM lineitem WHERE l_suppkey % 40 <> l_partkey % 40 GROUP BY ALL),
m AS (SELECT range AS id, range % 5 AS community FROM range(40)), i AS (SELECT x.community, sum(w) AS weight, count(*) AS edges FROM e JOIN m x ON x.id = a JOIN m y ON y.id = b WHERE x.community = y.community GROUP BY 1),
c AS (SELECT community, count(*) AS claims FROM m JOIN orders ON o_custkey % 40 = id GROUP BY 1) SELECT community, CAST(weight AS BIGINT) AS weight, edges, claims FROM i JOIN c USING (community)""")
def j24_community_inputs(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 40).alias("first_id"), (F.col("l_partkey") % 40).alias("second_id")).filter("first_id <> second_id").groupBy("first_id", "second_id").agg(F.count("*").alias("weight"))
    members = spark.range(40).select("id", (F.col("id") % 5).alias("community"))
    claims = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("id"), F.col("o_orderkey").alias("claim_id"))
    return graph.community_inputs(edges, members, claims).select("community", "weight", "edges", "claims")


@query("""SELECT DISTINCT 'folder' AS scope, p_partkey AS node_id, p_brand AS community FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_suppkey = 4 UNION ALL
  SELECT DISTINCT 'day', p_partkey, p_brand FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_shipdate >= TIMESTAMP '1995-03-01' AND l_shipdate < TIMESTAMP '1995-03-02'""")
def j26_scoped_members(spark, sf_dir):
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    scopes = {"folder": li.filter("l_suppkey = 4"), "day": li.filter(selection.on_day("l_shipdate", "1995-03-01"))}
    found = [part.join(rows.select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi").select(F.lit(name).alias("scope"), F.col("p_partkey").alias("node_id"), F.col("p_brand").alias("community")) for name, rows in scopes.items()]
    return found[0].union(found[1])


@query(f"""WITH {ACTIVITIES} SELECT user_id AS overview, min(start_time) AS first_start, row_number() OVER (ORDER BY min(start_time), user_id) AS place FROM a GROUP BY user_id""")
def a12_in_order_of_start(spark, sf_dir):
    return analytics.by_first_start(activities(spark, sf_dir), "user_id").withColumnRenamed("user_id", "overview")


@query("""SELECT '{"nodes":[' || (SELECT string_agg('"' || r_name || '"', ',' ORDER BY r_regionkey) FROM region) || '],"edges":[' || (SELECT string_agg('"' || n_name || '"', ',' ORDER BY n_nationkey) FROM nation WHERE n_nationkey < 5) ||
  '],"claims":[' || (SELECT string_agg('"' || s_name || '"', ',' ORDER BY s_suppkey) FROM supplier WHERE s_suppkey < 4) || '],"communities":[]}' AS document""")
def a14_flat_document(spark, sf_dir):
    def listed(name: str, key: str, label: str, most: int = 1 << 30):
        rows = table(spark, sf_dir, name).filter(F.col(key) < most)
        return rows.agg(F.transform(F.array_sort(F.collect_list(F.struct(key, label))), lambda x: x[label]).alias("v"))

    parts = {"nodes": listed("region", "r_regionkey", "r_name"), "edges": listed("nation", "n_nationkey", "n_name", 5), "claims": listed("supplier", "s_suppkey", "s_name", 4), "communities": listed("supplier", "s_suppkey", "s_name", -1)}
    return search.flat_document(parts)


@query("""WITH x AS (SELECT unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)
SELECT CAST(dim AS INTEGER) AS dim, min(v) AS low, max(v) AS high, min(v) < 0 AS signed FROM x GROUP BY dim""")
def a28_dimension_bounds(spark, sf_dir):
    return graph.dimension_bounds(table(spark, sf_dir, "embeddings"), "embedding")


@query("""SELECT (SELECT count(*) FROM lineitem) AS chunks, EXISTS (SELECT 1 FROM lineitem WHERE l_quantity > 49) AS some, EXISTS (SELECT 1 FROM lineitem WHERE l_quantity > 99) AS none""")
def a29_counts_and_exists(spark, sf_dir):
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").agg(F.count("*").alias("chunks"), F.coalesce(F.bool_or(q > 49), F.lit(False)).alias("some"), F.coalesce(F.bool_or(q > 99), F.lit(False)).alias("none"))


@query("""SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) > 1""")
def w6_all_but_newest(spark, sf_dir):
    return selection.all_but_newest(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


_SCORED = """r AS (SELECT p_partkey AS id, p_type AS type, round(p_size / 50.0, 2)::DOUBLE AS score, (p_partkey * 7919 % 1000)::DOUBLE / 1000 AS rerank FROM part)"""


def _scored(spark, sf_dir):
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(key.alias("id"), F.col("p_type").alias("type"), F.round(F.col("p_size") / 50.0, 2).alias("score"), ((key * 7919 % 1000).cast("double") / 1000).alias("rerank"))


@query(f"""WITH {_SCORED} SELECT id, type, score, row_number() OVER (ORDER BY score DESC, type, id) AS place FROM r QUALIFY place <= 30""")
def k5_hybrid_order(spark, sf_dir):
    return search.ordered(_scored(spark, sf_dir), [F.desc("score"), F.col("type"), F.col("id")], 30).select("id", "type", "score", "place")


@query(f"""WITH {_SCORED} SELECT id, row_number() OVER (ORDER BY rerank DESC, score DESC, type, id) AS place FROM r QUALIFY place <= 5""")
def k6_rerank_order(spark, sf_dir):
    return search.ordered(_scored(spark, sf_dir), [F.desc("rerank"), F.desc("score"), F.col("type"), F.col("id")], 5).select("id", "place")


@query("""WITH t AS (SELECT o_custkey AS tree, max(o_totalprice) AS best, min(o_orderkey) AS first FROM orders GROUP BY 1) SELECT tree, row_number() OVER (ORDER BY best DESC, first) AS place FROM t QUALIFY place <= 50""")
def k7_tree_order(spark, sf_dir):
    trees = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("tree")).agg(F.max("o_totalprice").alias("best"), F.min("o_orderkey").alias("first"))
    return search.ordered(trees, [F.desc("best"), F.col("first")], 50).select("tree", "place")


@query(f"""WITH {ACTIVITIES} SELECT id, start_time FROM a ORDER BY start_time DESC, id DESC LIMIT 25""")
def k8_latest_first(spark, sf_dir):
    return selection.latest_first(activities(spark, sf_dir).select("id", "start_time"), 25, "start_time", "id")


@query("""SELECT p_partkey, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_suppkey = 3) AS seed FROM part ORDER BY seed DESC, p_size DESC, p_partkey LIMIT 18""")
def k9_seeds_first(spark, sf_dir):
    seeds = table(spark, sf_dir, "lineitem").filter("l_suppkey = 3").select(F.col("l_partkey").alias("p_partkey"))
    return selection.seeds_first(table(spark, sf_dir, "part").select("p_partkey", "p_size"), seeds, "p_partkey", 18, F.desc("p_size")).select("p_partkey", "seed")


@query("""SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_discount, l_returnflag, l_linenumber) AS place FROM lineitem""")
def k10_many_keys(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag")
    return search.best_per_group(li, "l_orderkey", [F.desc("l_quantity"), F.col("l_discount"), F.col("l_returnflag"), F.col("l_linenumber")], 1 << 30).select("l_orderkey", "l_linenumber", "place")


@query("""WITH n AS (SELECT p_partkey AS id FROM part WHERE p_size = 3 UNION SELECT l_partkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-03-01' AND l_shipdate < TIMESTAMP '1995-03-02') SELECT id FROM n""")
def u4_visible_ids(spark, sf_dir):
    of_folder = table(spark, sf_dir, "part").filter("p_size = 3").select(F.col("p_partkey").alias("id"))
    return of_folder.union(table(spark, sf_dir, "lineitem").filter(selection.on_day("l_shipdate", "1995-03-01")).select("l_partkey")).distinct()


@query(f"""WITH {ACTIVITIES} SELECT CAST(start_time AS DATE) AS day FROM a WHERE tag_id = 2 UNION SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderpriority = '1-URGENT'""")
def u5_days_of_both(spark, sf_dir):
    tagged = activities(spark, sf_dir).filter("tag_id = 2").select(F.to_date("start_time").alias("day"))
    return tagged.union(table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.to_date("o_orderdate"))).distinct()


@query("""SELECT v, n_name FROM (VALUES (3), (5), (99)) t(v) LEFT JOIN nation ON n_nationkey = v UNION ALL SELECT NULL, NULL WHERE false""")
def u7_values_and_nothing(spark, sf_dir):
    asked = spark.createDataFrame([(3,), (5,), (99,)], "v int")
    named = asked.join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("v"), "left").select("v", "n_name")
    return named.union(spark.createDataFrame([], "v int, n_name string"))


@query("""SELECT l_partkey AS id FROM lineitem WHERE l_quantity > 45 EXCEPT SELECT l_partkey FROM lineitem WHERE l_discount > 0.08""")
def u8_difference(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return selection.difference(li.filter("l_quantity > 45").select(F.col("l_partkey").alias("id")), li.filter("l_discount > 0.08").select(F.col("l_partkey").alias("id")))


@query("""WITH s AS (SELECT l_partkey AS id, l_discount * 10 AS t, NULL AS v FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_partkey, l_tax * 10, NULL FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT l_suppkey, l_discount * 10, NULL FROM lineitem WHERE l_quantity > 40
  UNION ALL SELECT p_partkey, NULL, p_size / 50.0 FROM part UNION ALL SELECT s_suppkey, NULL, (s_suppkey % 10) / 10.0 FROM supplier UNION ALL SELECT c_custkey, NULL, (c_custkey % 7) / 10.0 FROM customer),
b AS (SELECT id, coalesce(max(t), 0)::DOUBLE AS t, coalesce(max(v), 0)::DOUBLE AS v FROM s GROUP BY id)
SELECT id, round(0.55::DOUBLE * v + 0.45::DOUBLE * t + CASE WHEN t > 0 AND v > 0 THEN 0.10::DOUBLE ELSE 0 END, 6) AS score FROM b""")
def u2_six_streams(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    text = lambda rows, key, score: rows.select(F.col(key).alias("id"), (F.col(score) * 10).alias("text_score"))
    near = lambda name, key, score: table(spark, sf_dir, name).select(F.col(key).alias("id"), score.cast("double").alias("vector_score"))
    streams = [text(li.filter("l_returnflag = 'R'"), "l_partkey", "l_discount"), text(li.filter("l_returnflag = 'A'"), "l_partkey", "l_tax"), text(li.filter("l_quantity > 40"), "l_suppkey", "l_discount"),
               near("part", "p_partkey", F.col("p_size") / 50.0), near("supplier", "s_suppkey", F.col("s_suppkey") % 10 / 10.0), near("customer", "c_custkey", F.col("c_custkey") % 7 / 10.0)]
    return search.merged_evidence(streams, ["id"]).select("id", F.round("score", 6).alias("score"))


@query(f"""WITH {ACTIVITIES} SELECT id, start_time FROM a WHERE id > 500 ORDER BY id LIMIT 200""")
def io9_next_page(spark, sf_dir):
    return selection.page_after(activities(spark, sf_dir).select("id", "start_time"), "id", 500)


@query(f"""WITH {ACTIVITIES} SELECT id FROM a WHERE start_time >= TIMESTAMP '2024-01-05' AND start_time < TIMESTAMP '2024-01-06' AND application NOT IN ('PAUSED', 'SLEEP') AND tag_id IS NULL AND id > 100 ORDER BY id LIMIT 200""")
def io10_unprocessed_of_day(spark, sf_dir):
    open_ = activities(spark, sf_dir).filter(selection.on_day("start_time", "2024-01-05") & ~F.col("application").isin(*analytics.INACTIVE) & F.col("tag_id").isNull())
    return selection.page_after(open_.select("id"), "id", 100)


@query(f"""WITH {ACTIVITIES} SELECT id, tag_id FROM a WHERE start_time >= TIMESTAMP '2024-01-05' AND start_time < TIMESTAMP '2024-01-06' AND tag_id IS NOT NULL AND id > 100 ORDER BY id LIMIT 200""")
def io11_assigned_of_day(spark, sf_dir):
    return selection.page_after(activities(spark, sf_dir).filter(selection.on_day("start_time", "2024-01-05") & F.col("tag_id").isNotNull()).select("id", "tag_id"), "id", 100)


@query(f"""WITH {ACTIVITIES} SELECT DISTINCT c_custkey AS overview_id, c_name FROM customer JOIN a ON user_id = c_custkey WHERE start_time >= TIMESTAMP '2024-01-05' AND start_time < TIMESTAMP '2024-01-06'""")
def io24_overviews_of_day(spark, sf_dir):
    there = activities(spark, sf_dir).filter(selection.on_day("start_time", "2024-01-05")).select(F.col("user_id").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(there, "c_custkey", "left_semi").select(F.col("c_custkey").alias("overview_id"), "c_name")


@query("""SELECT o_custkey AS key, string_agg(o_orderpriority, '|' ORDER BY o_orderdate, o_orderkey) AS summaries, count(*) AS n FROM orders WHERE trim(o_orderpriority) <> '' AND coalesce(o_orderstatus, '') != 'P' GROUP BY 1""")
def io25_summary_snapshots(spark, sf_dir):
    kept = table(spark, sf_dir, "orders").filter(selection.not_blank("o_orderpriority") & selection.other_than("o_orderstatus", "P"))
    inner = F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_orderpriority")))
    return kept.groupBy(F.col("o_custkey").alias("key")).agg(F.array_join(F.transform(inner, lambda x: x["o_orderpriority"]), "|").alias("summaries"), F.count("*").alias("n"))


@query(f"""WITH {ACTIVITIES} SELECT user_id AS overview_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY start_time, id) AS shots FROM a WHERE user_id IN (3, 7, 11) GROUP BY 1""")
def io28_shots_by_group(spark, sf_dir):
    inner = F.array_sort(F.collect_list(F.struct("start_time", "id")))
    some = activities(spark, sf_dir).filter(selection.in_list("user_id", [3, 7, 11]))
    return some.groupBy(F.col("user_id").alias("overview_id")).agg(F.array_join(F.transform(inner, lambda x: x["id"].cast("string")), ",").alias("shots"))


@query("""SELECT v AS asked, greatest(1, least(50, v)) AS trees, greatest(1, least(10, v)) AS graph, least(greatest(3 * v, 9), 45) AS candidates FROM (VALUES (-3), (1), (4), (20), (70)) t(v)""")
def io23_clamped_limits(spark, sf_dir):
    asked, v = spark.createDataFrame([(x,) for x in (-3, 1, 4, 20, 70)], "asked int"), F.col("asked")
    return asked.select(v, selection.clamped(v, 1, selection.MOST_TREES).alias("trees"), selection.clamped(v, 1, selection.MOST_GRAPH).alias("graph"), selection.clamped(3 * v, 9, 45).alias("candidates"))
