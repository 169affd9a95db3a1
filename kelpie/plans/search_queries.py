"""Tree search, query expansion, graph retrieval and typed vectors over the tables of a folder, each with its SQL.

Conversations are read as overviews (their first turn) and activities (their turns), documents as shots of activities.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from kelpie.functions import text as tx
from kelpie.functions import vectors as vx
from kelpie.functions.stemming import stem
from kelpie.operators import graph, search
from kelpie.plans.activity_queries import _QUERY, _WORDS, QUERIES, SQL, _first_vector, query, table
from kelpie.plans.indexes import kept_index, kept_vectors, postings_sql, ranked_sql

__all__ = ["QUERIES", "SQL"]


def _hits(spark, sf_dir, name):
    return kept_index(spark, sf_dir, name).ranked(_WORDS).withColumn("rank", F.round("rank", 7))


_RANKED = f"{postings_sql('documents')}, {ranked_sql('documents', _WORDS)}"
_FLOOR, _LIMIT = -0.2, 6


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text", F.when(F.col("conv_id") % 9 > 0, F.col("conv_id")).alias("overview"), F.col("turn").alias("start"))


@query(f"""WITH {_RANKED} SELECT id, rank FROM h_documents WHERE rank <= -0.2 ORDER BY rank, id LIMIT 18""")
def k1_relevant(spark, sf_dir):
    return search.relevant(_hits(spark, sf_dir, "documents"), 6, -0.2)


@query(f"""WITH {_RANKED} SELECT h.id, source, n_chars, rank FROM h_documents h JOIN documents ON doc_id = h.id""")
def j1_hits_with_content(spark, sf_dir):
    content = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "n_chars")
    return content.join(_hits(spark, sf_dir, "documents"), "id").select("id", "source", "n_chars", "rank")


@query(f"""WITH {postings_sql("openings", "turns", "documents")}, {ranked_sql("openings", _WORDS, "o")}, {ranked_sql("turns", _WORDS, "a")}, {ranked_sql("documents", _WORDS, "s")},
v AS (SELECT conv_id * 1000 + turn AS activity, CASE WHEN conv_id % 9 > 0 THEN conv_id END AS overview, turn AS start FROM conversations),
o AS (SELECT id AS overview, rank FROM h_o WHERE rank <= {_FLOOR} ORDER BY rank, overview LIMIT 18), a AS (SELECT activity, overview, start, rank FROM h_a JOIN v ON activity = id WHERE rank <= {_FLOOR} ORDER BY rank, activity LIMIT 18),
s AS (SELECT id AS shot, activity, overview, start, id % 97 AS ts, rank FROM h_s LEFT JOIN v ON activity = id % 50 * 1000 WHERE rank <= {_FLOOR} ORDER BY rank, shot LIMIT 18),
t AS (SELECT overview, min(rank) AS best FROM (SELECT overview, rank FROM o UNION ALL SELECT overview, rank FROM a UNION ALL SELECT overview, rank FROM s) WHERE overview IS NOT NULL GROUP BY 1),
p AS (SELECT *, row_number() OVER (ORDER BY best, overview) AS place FROM t QUALIFY place <= {_LIMIT}),
g AS (SELECT overview, activity, min(start) AS start, min(rank) AS rank FROM (SELECT overview, activity, start, rank FROM a UNION ALL SELECT overview, activity, start, rank FROM s) GROUP BY ALL),
x AS (SELECT overview, activity, row_number() OVER (PARTITION BY overview ORDER BY rank, start, activity) AS activity_place FROM g QUALIFY activity_place <= 3),
y AS (SELECT activity, shot, row_number() OVER (PARTITION BY activity ORDER BY rank, ts, shot) AS shot_place FROM s QUALIFY shot_place <= 3)
SELECT overview, place, best, x.activity, activity_place, shot, shot_place FROM p LEFT JOIN x USING (overview) LEFT JOIN y ON y.activity = x.activity""")
def t4_tree_search(spark, sf_dir):
    turns = _turns(spark, sf_dir)
    overviews = _hits(spark, sf_dir, "openings").withColumnRenamed("id", "overview")
    own = turns.select(F.col("id").alias("activity"), "overview", "start")
    activities = _hits(spark, sf_dir, "turns").join(own, F.col("id") == F.col("activity"))
    shots = _hits(spark, sf_dir, "documents").join(own, F.col("id") % 50 * 1000 == F.col("activity"), "left").select(F.col("id").alias("shot"), "activity", "overview", "start", (F.col("id") % 97).alias("ts"), "rank")
    return search.tree_search(overviews, activities, shots, _LIMIT, _FLOOR)


@query(f"""WITH {postings_sql("documents")}, {ranked_sql("documents", _WORDS, "one")}, p AS (SELECT id, rank FROM h_one ORDER BY rank, id LIMIT 8),
q AS (SELECT stem FROM p_documents WHERE id IN (SELECT id FROM p) AND length(stem) > 3 AND stem NOT IN ({", ".join(f"'{stem(w)}'" for w in _WORDS)}) GROUP BY 1 ORDER BY count(*) DESC, stem LIMIT 5),
{ranked_sql("documents", "SELECT stem FROM q", "two")}, k AS (SELECT id, rank FROM h_two ORDER BY rank, id LIMIT 8)
SELECT id, rank, 0 AS pass FROM p UNION ALL SELECT id, rank, 1 FROM k WHERE id NOT IN (SELECT id FROM p)""")
def t5_expanded(spark, sf_dir):
    return search.expanded(kept_index(spark, sf_dir, "documents"), table(spark, sf_dir, "documents"), "doc_id", F.col("text"), _WORDS, [], 8)


@query("""SELECT p_partkey, CASE WHEN hi = lo THEN 1.0 ELSE (s - lo) / (hi - lo) END AS normalised FROM (SELECT p_partkey, p_retailprice AS s, min(p_retailprice) OVER () AS lo, max(p_retailprice) OVER () AS hi FROM part)""")
def t8_normalised(spark, sf_dir):
    return search.normalised(table(spark, sf_dir, "part"), "p_retailprice").select("p_partkey", "normalised")


@query("""SELECT string_agg(place || '. ' || left(p_name, 12) || ' (' || p_partkey || ')', chr(10) ORDER BY place) AS listed FROM (SELECT *, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS place FROM part QUALIFY place <= 10)""")
def t10_ranked_list(spark, sf_dir):
    best = search.ordered(table(spark, sf_dir, "part"), [F.desc("p_retailprice"), F.col("p_partkey")], 10)
    line = F.concat(F.col("place").cast("string"), F.lit(". "), tx.clipped(F.col("p_name"), 12), F.lit(" ("), F.col("p_partkey").cast("string"), F.lit(")"))
    return best.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("l")))), lambda x: x["l"]), "\n").alias("listed"))


_KINDS = {"claim": ("benchmark", 2), "community": ("openings", 0), "node": ("documents", 1)}


def _graph_sql() -> str:
    parts, streams = [postings_sql(*(name for name, _ in _KINDS.values()))], []
    for kind, (name, label) in _KINDS.items():
        parts.append(ranked_sql(name, _WORDS, kind))
        parts.append(f"x_{kind} AS (SELECT id, rank AS v FROM h_{kind} ORDER BY rank, id LIMIT 10)")
        parts.append(f"y_{kind} AS (SELECT vec_id AS id, round(1 - list_cosine_similarity(embedding::DOUBLE[], q), 9) AS v FROM embeddings, {_QUERY} WHERE label % 3 = {label} ORDER BY v, id LIMIT 10)")
        for of, column in (("x", "t"), ("y", "v")):
            normed = f"CASE WHEN max(v) OVER () = min(v) OVER () THEN 1.0 ELSE (max(v) OVER () - v) / (max(v) OVER () - min(v) OVER ()) END"
            streams.append(f"SELECT '{kind}' AS type, id, {normed if column == 't' else 'NULL::DOUBLE'} AS t, {normed if column == 'v' else 'NULL::DOUBLE'} AS v FROM {of}_{kind}")
    return f"""WITH {", ".join(parts)}, e AS ({" UNION ALL ".join(streams)}), b AS (SELECT type, id, coalesce(max(t), 0)::DOUBLE AS t, coalesce(max(v), 0)::DOUBLE AS v FROM e GROUP BY ALL),
z AS (SELECT type, id, round(0.55::DOUBLE * v + 0.45::DOUBLE * t + CASE WHEN t > 0 AND v > 0 THEN 0.10::DOUBLE ELSE 0 END, 6) AS score FROM b) SELECT type, id, score FROM z"""


@query(_graph_sql() + " ORDER BY score DESC, type, id LIMIT 30")
def h2_graph_candidates(spark, sf_dir):
    vectors, asked = table(spark, sf_dir, "embeddings"), _first_vector(spark, sf_dir)
    near = lambda k: search.top_k(vectors.filter(F.col("label") % 3 == k), "vec_id", "embedding", asked, 10).withColumn("distance", F.round("distance", 9))
    found = search.graph_candidates({kind: (_hits(spark, sf_dir, name), near(label)) for kind, (name, label) in _KINDS.items()})
    return found.select("type", "id", F.round("score", 6).alias("score"))


@query("""WITH e AS (SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, count(*) AS w FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY ALL), d AS (SELECT id, sum(w) AS weight FROM (SELECT a AS id, w FROM e UNION ALL SELECT b, w FROM e) GROUP BY 1),
s AS (SELECT DISTINCT s_suppkey AS id FROM supplier WHERE s_nationkey = 2), n AS (SELECT d.id, weight, s.id IS NOT NULL AS seed FROM d LEFT JOIN s USING (id) WHERE s.id IS NOT NULL OR d.id % 30 IN (3, 4)),
c AS (SELECT id FROM n ORDER BY seed DESC, weight DESC, id LIMIT 18), l AS (SELECT a, b FROM e WHERE a IN (SELECT id FROM c) AND b IN (SELECT id FROM c) ORDER BY w DESC, a, b LIMIT 24),
m AS (SELECT o_orderkey AS claim_id, o_custkey AS id FROM orders WHERE o_custkey IN (SELECT id FROM c) ORDER BY 1 LIMIT 24)
SELECT 'node' AS kind, id, NULL::BIGINT AS other FROM c UNION ALL SELECT 'edge', a, b FROM l UNION ALL SELECT 'claim', claim_id, id FROM m""")
def h3_graph_context(spark, sf_dir):
    edges = graph.pair_weights(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")
    nodes = graph.degrees(edges).select("id", (F.col("id") % 30).alias("community"), F.col("degree").alias("weight"))
    seeds = table(spark, sf_dir, "supplier").filter("s_nationkey = 2").select(F.col("s_suppkey").alias("id"))
    return graph.context(nodes, edges, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim_id"), F.col("o_custkey").alias("id")), seeds, [3, 4])


@query("""SELECT p_partkey, '<document id="' || p_partkey || '" type="' || replace(replace(p_type, '&', '&amp;'), '<', '&lt;') || '">' || replace(replace(p_name || ' & ' || p_brand, '&', '&amp;'), '<', '&lt;') || '</document>' AS prompt FROM part""")
def h5_prompt_documents(spark, sf_dir):
    told = F.concat(F.lit('<document id="'), F.col("p_partkey").cast("string"), F.lit('" type="'), tx.xml_escaped(F.col("p_type")), F.lit('">'), tx.xml_escaped(F.concat("p_name", F.lit(" & "), "p_brand")), F.lit("</document>"))
    return table(spark, sf_dir, "part").select("p_partkey", told.alias("prompt"))


@query("""SELECT p_partkey, CASE WHEN p_size <= 40 THEN p_size + p_partkey % 300 END AS total FROM (SELECT * FROM part WHERE true) WHERE p_size <= 40 AND p_partkey % 300 <= 255 UNION ALL SELECT p_partkey, NULL FROM part WHERE NOT (p_size <= 40 AND p_partkey % 300 <= 255)""")
def v1_parsed_vectors(spark, sf_dir):
    written = F.when(F.col("p_size") <= 40, F.format_string("[%d, %d,]", F.col("p_size"), F.col("p_partkey") % 300)).otherwise(F.format_string("[%d]", F.col("p_size")))
    read = vx.parsed(written, "u8", 2)
    return table(spark, sf_dir, "part").select("p_partkey", F.when(read.isNotNull(), F.aggregate(read, F.lit(0.0), lambda s, x: s + x)).cast("long").alias("total"))


_S8 = """m AS (SELECT max(list_max(list_transform(embedding, lambda x: abs(x::DOUBLE)))) AS big FROM embeddings),
q8 AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(greatest(least(CASE WHEN x >= 0 THEN floor(x::DOUBLE * 127 / big + 0.5) ELSE ceil(x::DOUBLE * 127 / big - 0.5) END, 127), -128) AS BIGINT)) AS v FROM embeddings, m)"""


def _quantized(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    big = e.agg(F.max(F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))).alias("big"))
    return e.crossJoin(F.broadcast(big)).select("vec_id", vx.quantized_s8(F.col("embedding"), F.col("big")).alias("v"))  # one row


@query(f"""WITH {_S8}, q AS (SELECT v AS q FROM q8 ORDER BY vec_id LIMIT 1), z AS (SELECT vec_id, v, q FROM q8, q)
SELECT vec_id, list_sum(list_transform(list_zip(v, q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::DOUBLE AS squared_l2, -list_sum(list_transform(list_zip(v, q), lambda z: z[1] * z[2]))::DOUBLE AS dot,
  list_sum(list_transform(list_zip(v, q), lambda z: abs(z[1] - z[2])))::DOUBLE AS l1 FROM z""")
def v8_typed_distances(spark, sf_dir):
    rows = _quantized(spark, sf_dir)
    one = rows.orderBy("vec_id").limit(1).select(F.col("v").alias("q"))
    return rows.crossJoin(F.broadcast(one)).select("vec_id", *(vx.typed_distance(F.col("v"), F.col("q"), d, "i8").alias(d) for d in ("squared_l2", "dot", "l1")))  # one row


@query(f"""WITH {_S8}, q AS (SELECT v AS q FROM q8 ORDER BY vec_id LIMIT 1) SELECT vec_id AS id, list_sum(list_transform(list_zip(v, q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::DOUBLE AS distance FROM q8, q ORDER BY distance, id LIMIT 20""")
def v14_quantized_top_k(spark, sf_dir):
    rows = _quantized(spark, sf_dir)
    asked = [float(x) for x in rows.orderBy("vec_id").first()["v"]]
    return search.top_k(rows, "vec_id", "v", asked, 20, "squared_l2").select("id", "distance")


@query("""SELECT vec_id, list_sum(list_transform(list_zip(embedding, q), lambda z: CASE WHEN (z[1] >= 0) <> (z[2] >= 0) THEN 1 ELSE 0 END))::DOUBLE AS bit, round(list_distance(embedding::DOUBLE[], q::DOUBLE[]), 6) AS f32
  FROM embeddings, (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1)""")
def v10_distance_by_type(spark, sf_dir):
    e, q = table(spark, sf_dir, "embeddings"), F.array(*map(F.lit, _first_vector(spark, sf_dir)))
    bits = lambda v: F.transform(v, lambda x: (x >= 0).cast("int"))
    return e.select("vec_id", vx.typed_distance(bits(F.col("embedding")), bits(q), "l2", "bit").alias("bit"), F.round(vx.typed_distance(F.col("embedding"), q, "l2", "f32"), 6).alias("f32"))


@query()
def v7_half_precision(spark, sf_dir):
    e, q = table(spark, sf_dir, "embeddings"), F.array(*map(F.lit, _first_vector(spark, sf_dir)))
    return e.select("vec_id", *(vx.typed_distance(F.col("embedding"), q, "l2", kind).alias(kind) for kind in ("f16", "bf16")))


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7) SELECT vec_id AS other, round(1 - list_cosine_similarity(embedding::DOUBLE[], q), 6) AS distance FROM embeddings, q WHERE vec_id <> 7 ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], q), vec_id LIMIT 45""")
def k3_neighbours_of_one(spark, sf_dir):
    return graph.neighbours_of(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 7, 45).select("other", F.round("distance", 6).alias("distance"))


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7), n AS (SELECT vec_id FROM embeddings, q WHERE vec_id <> 7 ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], q), vec_id LIMIT 45),
v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 7 OR vec_id IN (SELECT vec_id FROM n)) SELECT a.vec_id AS first_id, b.vec_id AS second_id, round(greatest(list_cosine_similarity(a.e, b.e), 0), 6) AS weight FROM v a JOIN v b ON a.vec_id < b.vec_id""")
def g4_edges_of_one(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    asked = e.filter("vec_id = 7").first()["embedding"]
    near = [r["other"] for r in kept_vectors(spark, sf_dir).nearest_to(asked, 45, F.col("id") == 7).collect()]  # 45 rows
    return graph.pairs_of(e, "vec_id", "embedding", [7, *near]).select("first_id", "second_id", F.round(F.greatest("weight", F.lit(0.0)), 6).alias("weight"))


_CENTRES = """x AS (SELECT vec_id, label, vec_id % 7 AS b, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings),
ca AS (SELECT label AS a, list(v ORDER BY pos) AS c, max(n) AS n FROM (SELECT label, pos, avg(v) AS v, count(*) AS n FROM x GROUP BY ALL) GROUP BY 1), cb AS (SELECT b, list(v ORDER BY pos) AS c, max(n) AS n FROM (SELECT b, pos, avg(v) AS v, count(*) AS n FROM x GROUP BY ALL) GROUP BY 1)"""


@query(f"""WITH {_CENTRES}, s AS (SELECT label AS a, vec_id % 7 AS b, count(*) AS n FROM embeddings GROUP BY ALL)
SELECT s.a, s.b, round(0.7 * s.n / least(ca.n, cb.n) + 0.3 * greatest(list_cosine_similarity(ca.c, cb.c), 0), 6) AS score FROM s JOIN ca USING (a) JOIN cb USING (b)""")
def g6_continuity(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    old, new = e.select("id", F.col("label").alias("cluster")), e.select("id", (F.col("id") % 7).alias("cluster"))
    return graph.continuity(old, new, e, "embedding").select("a", "b", F.round("score", 6).alias("score"))


@query(f"""WITH {_CENTRES} SELECT ca.a, cb.b, round(list_cosine_similarity(ca.c, cb.c), 6) AS cosine FROM ca, cb""")
def g7_similarity_matrix(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("b", F.col("vec_id") % 7)
    left, right = (graph.centroids(e, c, "embedding").select(F.col(c).alias("id"), "centroid") for c in ("label", "b"))
    return graph.similarity_matrix(left, right, "centroid").select("a", "b", F.round("cosine", 6).alias("cosine"))


@query("""WITH l AS (SELECT DISTINCT l_suppkey AS owner, l_partkey AS node_id FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 5)) SELECT owner, node_id, count(*) OVER (PARTITION BY owner) AS links FROM l""")
def g17_overlay_links(spark, sf_dir):
    links = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("owner"), F.col("l_partkey").alias("node_id"))
    return graph.overlay_links(links, table(spark, sf_dir, "part").filter("p_size < 5").select(F.col("p_partkey").alias("node_id"))).select("owner", "node_id", "links")


@query("""SELECT doc_id, round((CASE WHEN kind = 'overview' THEN 42 WHEN kind = 'activity' THEN 34 ELSE 22 END + 0.65::DOUBLE * least(length(source), 80) + 0.18::DOUBLE * least(length(coalesce(text, '')), 260)) * (1 + greatest(least(coalesce(r, 0), 1), 0)), 6) AS weight
  FROM (SELECT doc_id, coalesce(source, '') AS source, text, CASE doc_id % 3 WHEN 0 THEN 'overview' WHEN 1 THEN 'activity' ELSE 'shot' END AS kind, CASE WHEN doc_id % 5 > 0 THEN doc_id % 5 / 4.0::DOUBLE END AS r FROM documents)""")
def g21_leaf_weights(spark, sf_dir):
    key = F.col("doc_id")
    leaves = table(spark, sf_dir, "documents").select(key, F.coalesce("source", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"), F.when(key % 3 == 0, "overview").when(key % 3 == 1, "activity").otherwise("shot").alias("kind"), F.when(key % 5 > 0, key % 5 / 4.0).alias("r"))
    return graph.leaf_weights(leaves, "title", "text", "kind", "r").select("doc_id", F.round("weight", 6).alias("weight"))
