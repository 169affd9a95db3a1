"""Reads, views, extraction and updates over the tables of a folder, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kelpie.functions import parsing as ps
from kelpie.operators import extraction, views
from kelpie.plans.activity_queries import QUERIES, SQL, query, table
from kelpie.sources import html, notes

__all__ = ["QUERIES", "SQL"]


@query("""SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 0""")
def io3_sorted_entities(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("deleted_at", F.when(F.col("c_acctbal") < 0, F.lit("gone")))
    return views.read_sorted(c, ["c_name"], "deleted_at", c_mktsegment="BUILDING").select("c_custkey", "c_name", "c_mktsegment")


@query("""SELECT text FROM documents WHERE doc_id = 7""")
def io4_one_column_by_key(spark, sf_dir):
    return views.read_sorted(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], doc_id=7).select("text")


@query("""SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey = 5 OR o_orderstatus = 'F' AND o_custkey = 8""")
def io26_by_natural_key(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").withColumn("deleted_at", F.when(F.col("o_orderstatus") != "F", F.lit("gone")))
    both = views.read_sorted(o, ["o_orderkey"], "deleted_at", True, o_custkey=5).unionByName(views.read_sorted(o, ["o_orderkey"], "deleted_at", o_custkey=8))
    return both.drop("deleted_at")


@query("""SELECT n_name AS name, n_regionkey AS value FROM nation WHERE n_nationkey = 3 UNION ALL SELECT r_name, r_regionkey FROM region""")
def io27_settings_and_tags(spark, sf_dir):
    one = views.read_sorted(table(spark, sf_dir, "nation"), ["n_name"], n_nationkey=3).select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("value"))
    return one.unionByName(views.read_sorted(table(spark, sf_dir, "region"), ["r_name"]).select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("value")))


@query("""SELECT o_orderkey AS activity_id, c_name AS overview, n_name AS tag, l_partkey AS shot_id FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 30
LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0 LEFT JOIN nation ON n_nationkey = o_orderkey % 30 WHERE o_orderdate >= TIMESTAMP '1997-01-15' AND o_orderdate < TIMESTAMP '1997-01-16'""")
def j3_day_state(spark, sf_dir):
    acts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("activity_id"), F.col("o_orderdate").alias("start_time"), F.col("o_custkey").alias("overview_id"), (F.col("o_orderkey") % 30).alias("tag_id"))
    shots = table(spark, sf_dir, "lineitem").filter("l_quantity > 30").select(F.col("l_orderkey").alias("activity_id"), F.col("l_partkey").alias("shot_id"))
    overviews = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("overview_id"), F.col("c_name").alias("overview"))
    tags = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("tag_id"), F.col("n_name").alias("tag"))
    return views.day_state(acts, shots, overviews, tags, "1997-01-15").select("activity_id", "overview", "tag", "shot_id")


@query("""WITH g AS (SELECT o_custkey AS c, o_orderstatus AS name, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn, o_orderkey FROM orders),
h AS (SELECT c, list({'name': name} ORDER BY rn) AS items FROM g WHERE rn <= 3 GROUP BY c),
k AS (SELECT c_nationkey AS p, c_name AS name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn, coalesce(items, []) AS items FROM customer LEFT JOIN h ON c = c_custkey),
l AS (SELECT p, list({'name': name, 'items': items} ORDER BY rn) AS children FROM k WHERE rn <= 3 GROUP BY p)
SELECT n_nationkey AS parent_id, CAST(to_json({'name': n_name, 'children': coalesce(children, [])}) AS VARCHAR) AS document FROM nation LEFT JOIN l ON p = n_nationkey""")
def a13_three_levels(spark, sf_dir):
    parents = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("parent_id"), F.col("n_name").alias("name"))
    kids = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("parent_id"), F.col("c_custkey").alias("child_id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("score"), F.col("c_custkey").alias("place"))
    grand = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("child_id"), F.col("o_orderstatus").alias("name"), F.col("o_totalprice").alias("score"), F.col("o_orderkey").alias("place"))
    return views.nested(parents, kids, grand, [F.desc("score"), F.col("place")])


_GRAPH = """n AS (SELECT p_partkey AS id, CAST(p_size % 7 AS BIGINT) AS community, p_name AS name, p_brand AS path FROM part),
e AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b, l_shipmode AS type FROM (SELECT *, CASE WHEN l_quantity > 40 THEN 'large' ELSE 'small' END AS l_shipmode FROM lineitem) x WHERE l_suppkey <> l_partkey)"""


#: As many links are told apart by a task; Spark would put together as many as are packed into 64 MB, which are some five millions.
_LINKS_A_TASK = 200_000


def _graph(spark, sf_dir):
    p, li = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    nodes = p.select(F.col("p_partkey").alias("node_id"), (F.col("p_size") % 7).cast("long").alias("community_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("path"))
    tasks = 1 + li.count() // _LINKS_A_TASK  # read from the files' footers
    links = li.filter("l_suppkey <> l_partkey").select(F.col("l_suppkey").alias("first_id"), F.col("l_partkey").alias("second_id"), F.when(F.col("l_quantity") > 40, "large").otherwise("small").alias("type"))
    return nodes, links.repartition(tasks, *links.columns).distinct()


@query(f"""WITH {_GRAPH}, c AS (SELECT o_custkey AS id, o_orderpriority AS text FROM orders)
SELECT community AS community_id, id AS node_id, 'member' AS kind, name AS value, NULL AS other_id, NULL AS other_community FROM n UNION ALL SELECT community, n.id, 'claim', text, NULL, NULL FROM n JOIN c ON c.id = n.id
UNION ALL SELECT community, id, 'source', path, NULL, NULL FROM n UNION ALL SELECT n.community, n.id, 'link_out', type, b, o.community FROM n JOIN e ON a = n.id JOIN n o ON b = o.id
UNION ALL SELECT n.community, n.id, 'link_in', type, a, o.community FROM n JOIN e ON b = n.id JOIN n o ON a = o.id""")
def j23_community_payload(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    claims = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("node_id"), F.col("o_orderpriority").alias("text"))
    return views.community_payload(nodes.drop("path"), edges, claims, nodes.select("node_id", "path"))


_VIEW = f"""{_GRAPH}, v AS (SELECT 'node' AS kind, 'node_' || id AS id, name AS label, CAST(id % 5 AS DOUBLE) AS rank FROM n WHERE id % 3 > 0 UNION ALL SELECT 'community', 'community_' || community, min('c'), min(id % 5) FROM n GROUP BY community),
w AS (SELECT 'edge' AS kind, 'node_' || a AS source, 'node_' || b AS target, CAST(count(*) AS DOUBLE) AS weight FROM e GROUP BY ALL UNION ALL SELECT 'member', 'community_' || community, 'node_' || id, 1.0 FROM n),
k AS (SELECT * FROM w WHERE source IN (SELECT id FROM v) AND target IN (SELECT id FROM v))"""


def _view(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    shown = nodes.select(F.col("node_id").alias("id"), F.col("name").alias("label"), (F.col("node_id") % 5).alias("rank"), "community_id")
    of = lambda kind, c: F.concat(F.lit(f"{kind}_"), F.col(c).cast("string"))
    return views.graph_view(
        {"node": shown.filter("id % 3 > 0"), "community": shown.select(F.col("community_id").alias("id"), F.lit("c").alias("label"), "rank")},
        {"edge": edges.select(of("node", "first_id").alias("source"), of("node", "second_id").alias("target"), F.lit(1).alias("weight")),
         "member": nodes.select(of("community", "community_id").alias("source"), of("node", "node_id").alias("target"), F.lit(1).alias("weight"))},
    )


@query(f"""WITH {_VIEW}, d AS (SELECT id, sum(weight) AS degree FROM (SELECT source AS id, weight FROM k UNION ALL SELECT target, weight FROM k) GROUP BY 1) SELECT kind, v.id, label, rank, coalesce(degree, 0.0) AS degree FROM v LEFT JOIN d ON d.id = v.id""")
def g16_drawn_nodes(spark, sf_dir):
    return _view(spark, sf_dir)[0]


@query(f"""WITH {_VIEW} SELECT * FROM k""")
def g14_drawn_links(spark, sf_dir):
    return _view(spark, sf_dir)[1]


@query(f"""WITH {_VIEW} SELECT * FROM k WHERE (source = 'node_7' OR target = 'node_7') AND source IN (SELECT id FROM v WHERE rank < 4) AND target IN (SELECT id FROM v WHERE rank < 4)""")
def g19_links_of_selected(spark, sf_dir):
    nodes, links = _view(spark, sf_dir)
    return views.links_of(links, "node_7", nodes.filter("rank < 4"))


@query("""WITH r AS (SELECT o_orderkey AS run_id FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1), c AS (SELECT place AS candidate_id, l_partkey AS tag_id FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS place FROM lineitem) JOIN r ON l_orderkey = run_id)
SELECT candidate_id, tag_id, p_name AS tag, c_custkey AS member_id FROM c LEFT JOIN part ON p_partkey = tag_id LEFT JOIN customer ON c_custkey % 10 = candidate_id""")
def g8_refresh_snapshot(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("created_at"))
    candidates = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), place.cast("long").alias("candidate_id"), F.col("l_partkey").alias("tag_id"))
    members = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 10).alias("candidate_id"), F.col("c_custkey").alias("member_id"))
    tags = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("tag_id"), F.col("p_name").alias("tag"))
    acts = spark.createDataFrame([], "id long, summary string, summary_vector array<float>")
    return views.refresh_snapshot(acts, runs, candidates, members, tags)[1].select("candidate_id", "tag_id", "tag", "member_id")


@query("""WITH m AS (SELECT id, label, {'v': list_transform(range(1, len(embedding) + 1), lambda i: CAST(embedding[i] AS DOUBLE))} AS s FROM (SELECT vec_id AS id, label, embedding FROM embeddings)),
p AS (SELECT q.id, m.id AS other, least(1, greatest(-1, list_dot_product(q.s.v, m.s.v) / sqrt(list_dot_product(q.s.v, q.s.v)) / sqrt(list_dot_product(m.s.v, m.s.v)))) / 0.05 AS c, m.s.v[1] AS x, m.s.v[2] AS y FROM m q, m WHERE m.id < 64),
k AS (SELECT *, exp(c - max(c) OVER (PARTITION BY id)) AS w FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY c DESC, other) <= 15)
SELECT id, round(sum(w * x) / sum(w), 4) + 0 AS x, round(sum(w * y) / sum(w), 4) + 0 AS y FROM k GROUP BY id""")
def g12_reduced_by_model(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    model = e.filter("vec_id < 64").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.slice("embedding", 1, 2).alias("reduced"))
    low = views.reduced_by_model(e, model, "vec_id", "embedding")
    return low.select("id", (F.round(F.col("reduced")[0], 4) + 0.0).alias("x"), (F.round(F.col("reduced")[1], 4) + 0.0).alias("y"))


def _answers(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    block = F.concat_ws("\n", F.concat(F.lit("name:  "), "s_name"), F.when(F.col("s_suppkey") % 4 == 0, "Type: thing").otherwise("Type: Place"), F.lit("description: rated"), F.concat(F.lit("  at "), F.col("s_nationkey").cast("string")), F.lit("claims:\n- one\nnone\n-  two ") )
    linked = F.concat_ws("\n", F.concat(F.lit("source: "), "s_name"), F.concat(F.lit("target: Nation "), (F.col("s_nationkey") % 9).cast("string")), F.lit("type: Lives In\ndescription: x"))
    return s.select("s_suppkey", F.concat(F.lit("Well.\n```markdown\n## Entities\n"), block, F.lit("\n---\n(none)\n---\nname: lower\ntype: place\ndescription: y\n##  Relationships\n"), linked, F.lit("\n---\nsource: Same\ntarget: same\ntype: t\ndescription: z\n```")).alias("text"))


@query("""SELECT s_suppkey AS id, 0 AS block, s_name AS name, lower(s_name) AS normalized_name, 'place' AS type, 'rated at ' || s_nationkey AS description, 'one|two' AS claims FROM supplier WHERE s_suppkey % 4 > 0""")
def s11_entities(spark, sf_dir):
    return extraction.entities(_answers(spark, sf_dir), "s_suppkey", "text").withColumn("claims", F.array_join("claims", "|"))


@query("""SELECT s_suppkey AS id, 0 AS block, lower(s_name) AS source, 'nation ' || s_nationkey % 9 AS target, 'lives in' AS type, 'x' AS description FROM supplier""")
def s11_relationships(spark, sf_dir):
    return extraction.relationships(_answers(spark, sf_dir), "s_suppkey", "text")


@query("""WITH s AS (SELECT p_partkey AS stored_id, p_name AS name, p_type AS type, p_brand FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) = 1), f AS (SELECT * FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey DESC) = 1)
SELECT p_name AS name, p_partkey AS found_id, s.stored_id, CASE WHEN s.stored_id IS NULL THEN 'create' WHEN p_type IS NOT DISTINCT FROM s.type THEN 'update' ELSE 'coalesce' END AS action FROM f LEFT JOIN (SELECT * FROM s WHERE stored_id % 4 > 0) s ON s.name = p_name""")
def x24_routed(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"))
    stored = p.groupBy("name").agg(F.min("id").alias("id"), F.min_by("type", "id").alias("type")).filter("id % 4 > 0")
    return extraction.routed(p.withColumnRenamed("id", "found_id"), stored, "name", [F.desc("found_id")], ["type"]).select("name", "found_id", "stored_id", "action")


@query("""WITH e AS (SELECT lower(s_name) AS s, 'nation ' || s_nationkey % 9 AS t FROM supplier) SELECT least(s, t) AS first_id, greatest(s, t) AS second_id, 'lives in' AS type, 'x' AS description FROM e GROUP BY s, t""")
def x24_edges(spark, sf_dir):
    return extraction.edges_of(extraction.relationships(_answers(spark, sf_dir), "s_suppkey", "text")).select("first_id", "second_id", "type", "description")


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 AND trim(text) <> '' THEN lower(role) END AS importance, CASE turn % 3 WHEN 1 THEN '{"importance": 3, "content": "x"}' ELSE trim(text) END AS content FROM conversations WHERE text NOT LIKE '%`%' AND text NOT LIKE '{%' AND trim(text) <> ''""")
def s13_messages(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter("text not like '%`%' and text not like '{%' and trim(text) <> ''")
    made = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.upper("role").alias("importance"), F.concat(F.lit(" "), "text").alias("content"))), F.lit("\n```"))
    said = F.when(F.col("turn") % 3 == 0, made).when(F.col("turn") % 3 == 1, '{"importance": 3, "content": "x"}').otherwise(F.col("text"))
    return c.select("conv_id", "turn", ps.message(said).alias("m")).select("conv_id", "turn", "m.importance", "m.content")


@query("""SELECT p_partkey, p_brand AS title, p_name || '|' || p_type AS aliases, 'x' AS tags FROM part""")
def s14_frontmatter_lists(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    text = F.concat(F.lit('---\ntitle: "'), "p_brand", F.lit('"\naliases:\n  - '), "p_name", F.lit("\n  - "), "p_type", F.lit("\ntags: [\"x\"]\n---\nbody: no"))
    read = p.select("p_partkey", ps.frontmatter_lists(text).alias("m"))
    return read.select("p_partkey", *(F.array_join(F.col("m")[k], "|").alias(k) for k in ("title", "aliases", "tags")))


@query("""SELECT p_partkey, p_type AS kind, CAST(p_size AS VARCHAR) AS size FROM part WHERE p_partkey % 3 > 0 UNION ALL SELECT p_partkey, NULL, NULL FROM part WHERE p_partkey % 3 = 0""")
def s32_options(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    text = F.concat(F.lit(" kind = "), "p_type", F.lit(" , stray, size=0,size="), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, ", =x").otherwise(""))
    return p.select("p_partkey", ps.options(text).alias("m")).select("p_partkey", F.col("m")["kind"].alias("kind"), F.col("m")["size"].alias("size"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS title, 'Read ' || o_orderstatus || chr(10) || 'more' AS summary, least(o_orderkey, o_custkey) || '-' || greatest(o_orderkey, o_custkey) AS merge_key, CASE WHEN o_orderkey % 2 = 0 THEN ' two' END AS description FROM orders""")
def m30_decisions(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    text = F.concat(F.lit("TITLE: "), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).otherwise(""), F.lit("\nSUMMARY: The user was read "), "o_orderstatus", F.lit("\nmore"))
    made = o.select("o_orderkey", "o_custkey", ps.decision(text).alias("d"), F.when(F.col("o_orderkey") % 2 == 0, "a\nDescription:  two\nDescription: b").otherwise("a Description: c").alias("t"))
    return made.select("o_orderkey", "d.title", "d.summary", ps.merge_key(F.col("o_orderkey"), F.col("o_custkey")).alias("merge_key"), ps.description(F.col("t")).alias("description"))


@query("""WITH t AS (SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN text END, ' ' ORDER BY turn) AS spoken, list(text ORDER BY turn) AS texts FROM conversations GROUP BY 1),
w AS (SELECT conv_id, coalesce(spoken, '') AS s, 'q' || chr(10) || coalesce(spoken, '') || chr(10) || array_to_string(list_transform(texts, lambda x: x[1:300]), chr(10)) AS a, 'q' || chr(10) || coalesce(spoken, '') || chr(10) || array_to_string(list_transform(texts, lambda x: x[1:60]), chr(10)) AS b FROM t)
SELECT conv_id, CASE WHEN length(s) < 9000 - 8000 THEN CASE WHEN length(a) <= 9000 THEN md5(a) WHEN length(b) <= 9000 THEN md5(b) END END AS prompt FROM w""")
def s31_prompts(spark, sf_dir):
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: x)
    each = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("t"))
    spoken = F.array_join(F.transform(F.filter("t", lambda x: x["role"] == "user"), lambda x: x["text"]), " ")
    return each.select("conv_id", F.md5(ps.prompt(F.lit("q"), spoken, F.transform("t", lambda x: x["text"]), 9000, (300, 60))).alias("prompt"))


@query("""SELECT page_id, title, '' AS author, '' AS published FROM (SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title FROM pages)""")
def s24_page_metadata(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", ps.page_metadata(F.col("html")).alias("m")).select("page_id", "m.title", "m.author", "m.published")


@query("""SELECT event_id, CAST(ts AS DATE) AS day, CAST(floor(epoch(ts)) AS BIGINT) AS seconds, strftime(ts, '%Y-%m-%d %H:%M:%S') AS written, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day_start, CAST(CAST(ts AS DATE) + 1 AS TIMESTAMP) AS day_end, date_trunc('second', ts) AS read FROM events""")
def s1_days_and_times(spark, sf_dir):
    day = F.to_date("ts")
    written = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return table(spark, sf_dir, "events").select(
        "event_id", day.alias("day"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("seconds"), written.alias("written"), day.cast("timestamp_ntz").alias("day_start"), F.date_add(day, 1).cast("timestamp_ntz").alias("day_end"),
        F.coalesce(F.try_to_timestamp(written, F.lit("yyyy-MM-dd HH:mm:ss.SSS")), F.try_to_timestamp(written, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(written, F.lit("yyyy-MM-dd"))).cast("timestamp_ntz").alias("read"),
    )


@query("""SELECT p_partkey, least(p_size, 20) AS low, greatest(0.0, p_retailprice - 1000) AS high, CAST(p_size AS VARCHAR) AS written, trim('  ' || p_name || ' ') AS trimmed, 'integer' AS kind FROM part""")
def s30_scalars(spark, sf_dir):
    kind = F.when(F.typeof(F.col("p_size")).isin("int", "bigint"), "integer").otherwise("other")
    return table(spark, sf_dir, "part").select("p_partkey", F.least("p_size", F.lit(20)).alias("low"), F.greatest(F.lit(0.0), F.col("p_retailprice") - 1000).alias("high"), F.col("p_size").cast("string").alias("written"), F.trim(F.concat(F.lit("  "), "p_name", F.lit(" "))).alias("trimmed"), kind.alias("kind"))


@query("""WITH m AS (SELECT o_custkey AS id, o_orderstatus AS kind, trim(regexp_replace(o_orderpriority, '\\s+', ' ', 'g')) AS text, o_orderkey AS place FROM orders) SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY id, kind, lower(text) ORDER BY place) = 1""")
def s27_entities_once(spark, sf_dir):
    m = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("kind"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise(F.concat(F.lit(" "), "o_orderpriority")).alias("text"), F.col("o_orderkey").alias("place"))
    return views.entities_once(m, "id", "kind", "text", "place")


@query("""WITH u AS (SELECT o_custkey AS c_custkey, o_orderstatus, o_orderkey AS made, o_orderpriority AS v FROM orders), l AS (SELECT c_custkey, arg_max(v, made) FILTER (WHERE o_orderstatus = 'F') AS seg, arg_max('N ' || made, made) FILTER (WHERE o_orderstatus = 'O') AS name FROM u GROUP BY 1)
SELECT c.c_custkey, coalesce(name, c_name) AS c_name, coalesce(seg, c_mktsegment) AS c_mktsegment FROM customer c LEFT JOIN l ON l.c_custkey = c.c_custkey""")
def m25_updated_columns(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter("o_orderstatus in ('F', 'O')")
    column = F.when(F.col("o_orderstatus") == "F", "c_mktsegment").otherwise("c_name")
    value = F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).otherwise(F.concat(F.lit("N "), F.col("o_orderkey").cast("string")))
    updates = o.select(F.col("o_custkey").alias("c_custkey"), column.alias("column"), value.alias("value"), F.col("o_orderkey").alias("at"))
    return views.updated_columns(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), updates, "c_custkey", ["c_name", "c_mktsegment"])


@query("""WITH d AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderdate > TIMESTAMP '1997-06-01') SELECT c_custkey AS k, 'old' AS v FROM customer WHERE c_custkey % 2 = 0 AND c_custkey NOT IN (SELECT k FROM d) UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 > 0 AND c_custkey IN (SELECT k FROM d)""")
def m26_synchronised(spark, sf_dir):
    c, key = table(spark, sf_dir, "customer"), F.col("c_custkey").alias("k")
    changes = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("at"))
    index, now = c.filter("c_custkey % 2 = 0").select(key, F.lit("old").alias("v")), c.filter("c_custkey % 3 > 0").select(key, F.col("c_name").alias("v"))
    return views.synchronised(index, now, changes, "k", F.lit("1997-06-01").cast("timestamp_ntz"))


@query("""SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey IN (2, 3)) GROUP BY 1""")
def m28_deleted_below(spark, sf_dir):
    gone = table(spark, sf_dir, "nation").filter("n_nationkey in (2, 3)").select("n_nationkey")
    chain = [(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey", "c_nationkey"), (table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", "o_custkey"), (table(spark, sf_dir, "lineitem").select("l_orderkey"), "l_orderkey", "l_orderkey")]
    return views.deleted_below(chain, gone)[-1].groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, c_name, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal * 2 END AS reduced FROM customer""")
def io21_written_back(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_acctbal").alias("reduced"))
    return views.written_back(c, c.filter("c_custkey % 2 = 0").withColumn("reduced", F.col("reduced") * 2), "c_custkey", "reduced")


_DOCUMENT = "CAST(to_json({'c_name': c_name, 'c_mktsegment': c_mktsegment, 'c_nationkey': c_nationkey}) AS VARCHAR)"


@query(f"""SELECT c_custkey, {_DOCUMENT} AS document, sha256({_DOCUMENT}) AS hash FROM customer WHERE c_custkey % 3 > 0""")
def io19_changed_documents(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    known = views.changed_documents(c.filter("c_custkey % 3 = 0"), "c_custkey", spark.createDataFrame([], "c_custkey long, hash string"))
    return views.changed_documents(c, "c_custkey", known.unionByName(known.limit(1).withColumns({"c_custkey": F.lit(1).cast("long"), "hash": F.lit("old")})))


_NOTE = f"""{_GRAPH}, f AS (SELECT c, CASE WHEN c % 2 = 0 THEN 'Group ' || c ELSE 'Community ' || c END AS title FROM (SELECT DISTINCT community AS c FROM n))"""


@query(f"""WITH {_NOTE}, m AS (SELECT id, name, path, title || '.md' AS file FROM n JOIN f ON c = community)
SELECT m.file, '- [' || m.name || ' ' || type || ' ' || o.name || '](<' || CASE WHEN o.file <> m.file THEN o.file ELSE '' END || '#node-' || o.id || '>)' AS line, m.id AS member FROM e JOIN m ON a = m.id JOIN m o ON b = o.id""")
def io18_community_notes(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    key = F.col("community_id")
    groups = nodes.select("community_id").distinct().select("community_id", F.when(key % 2 == 0, F.concat(F.lit("Group "), key.cast("string"))).alias("name"), F.lit(None).cast("string").alias("summary"))
    members = nodes.select("community_id", "node_id", "name", F.lit(None).cast("string").alias("description"))
    lines = notes.community_notes(groups, members, edges.select(F.col("first_id").alias("node_id"), F.col("second_id").alias("target_id"), "type"), nodes.select("node_id", "path"))
    return lines.filter("part = 3").select("file", "line", "member")


@query("""SELECT page_id, '2024-01-02-030405-' AS stamp, true AS ends, true AS heads FROM pages""")
def io17_page_notes(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url", html.title(F.col("html")).alias("title"), html.markdown(F.col("html")).alias("markdown"), F.lit("2024-01-02 03:04:05").cast("timestamp_ntz").alias("captured_at"))
    made = notes.page_notes(p)
    return made.select("page_id", F.substring("file", 1, 18).alias("stamp"), F.col("file").endswith(".md").alias("ends"), F.col("text").startswith("---\ntitle: ").alias("heads"))


@query()
def io20_matrices(spark, sf_dir):
    return notes.matrices(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64).select("first_id", F.size("ids").alias("n"), F.md5("data").alias("hash"))


@query()
def s21_packed_evidence(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return extraction.packed_evidence(turns, "conv_id", "turn", "text", "Summarise", "Be brief.", 160)
