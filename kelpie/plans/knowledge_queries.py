"""Queries of the graph, merge, search and parsing operators over the tables of a folder, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kelpie.functions import text as tx
from kelpie.functions.stemming import stem
from kelpie.operators import analytics, graph, merge, ontology, reduction, rounds, search, views
from kelpie.operators.neighbours import VectorIndex
from kelpie.operators.textindex import TextIndex
from kelpie.plans.activity_queries import ACTIVITIES, QUERIES, SPANS, SQL, activities, query, table
from kelpie.plans.indexes import kept_index, kept_vectors, postings_sql
from kelpie.plans.storage import cut, shared_root
from kelpie.streaming import online

__all__ = ["QUERIES", "SQL"]  # those of both modules


@query("""SELECT o.c_custkey AS id, coalesce(n, o.s) AS summary, CASE WHEN n IS NOT NULL AND n <> o.s THEN false ELSE true END AS processed,
  CASE WHEN n IS NOT NULL AND n <> o.s THEN NULL ELSE c_acctbal END AS vector FROM (SELECT c_custkey, c_mktsegment AS s, c_acctbal,
  CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN c_mktsegment ELSE lower(c_mktsegment) END AS n FROM customer) o""")
def m3_change_invalidation(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("summary"), F.col("c_acctbal").alias("vector"))
    new = c.select("id", F.when(F.col("id") % 3 == 1, F.col("summary")).when(F.col("id") % 3 == 2, F.lower("summary")).alias("summary"))
    old = c.withColumn("processed", F.lit(True))
    return merge.with_invalidation(old, new, "id", "summary", {"processed": F.lit(False), "vector": F.lit(None).cast("double")})


@query("""SELECT s_suppkey AS k, 'old' AS origin FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL
  SELECT DISTINCT l_suppkey, 'new' FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0)""")
def m10_insert_ignore(spark, sf_dir):
    old = table(spark, sf_dir, "supplier").filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("k"), F.lit("old").alias("origin"))
    new = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.lit("new").alias("origin"))
    return merge.inserted(old, new, ["k"])


@query("""WITH v AS (SELECT o_custkey, max(o_orderpriority) AS value FROM orders WHERE o_custkey % 4 <> 0 GROUP BY 1)
SELECT c_custkey, value AS candidate, CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment ELSE value END AS tag, CASE WHEN c_custkey % 5 = 0 THEN 'manual' ELSE 'auto' END AS tag_source
FROM customer LEFT JOIN v ON o_custkey = c_custkey""")
def m12_manual_kept(spark, sf_dir):
    source = F.when(F.col("c_custkey") % 5 == 0, "manual").when(F.col("c_custkey") % 2 == 0, "auto")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("tag"), source.alias("tag_source"))
    given = table(spark, sf_dir, "orders").filter("o_custkey % 4 <> 0").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("value"))
    return merge.assigned_unless_manual(rows, given, "c_custkey", "tag", "tag_source")


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 10 = 3 THEN o_custkey - 3 ELSE o_custkey END AS o_custkey FROM orders""")
def m15_repointed(spark, sf_dir):
    moves = table(spark, sf_dir, "customer").filter("c_custkey % 10 = 3").select(F.col("c_custkey").alias("old_id"), (F.col("c_custkey") - 3).alias("new_id"))
    return merge.repointed(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", moves)


@query("""WITH p AS (SELECT l_partkey AS id, min(l_orderkey) AS o, 0 AS pass FROM lineitem WHERE l_quantity > 40 GROUP BY 1 UNION ALL
  SELECT l_partkey, min(l_orderkey), 1 FROM lineitem WHERE l_discount > 0.05 GROUP BY 1)
SELECT id, o, pass FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY pass, o) = 1""")
def u6_first_wins(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    passes = [li.filter(f).groupBy(F.col("l_partkey").alias("id")).agg(F.min("l_orderkey").alias("o")) for f in ("l_quantity > 40", "l_discount > 0.05")]
    return merge.first_wins(passes, "id", [F.col("o")])


@query("""SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)""")
def j11_anti_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).join(orders, "id", "left_anti")


@query(f"""WITH {ACTIVITIES}, s AS (SELECT *, CAST(start_time AS DATE) AS day, CAST(hour(start_time) * 3600 + minute(start_time) * 60 + second(start_time) AS BIGINT) AS f FROM a WHERE application <> 'SLEEP'),
t AS (SELECT *, lead(f) OVER (PARTITION BY user_id, day ORDER BY start_time, id) AS e FROM s),
c AS (SELECT *, CASE WHEN tag_id IS NOT DISTINCT FROM lag(tag_id) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM t WHERE e IS NOT NULL WINDOW w AS (PARTITION BY user_id, day ORDER BY start_time, id)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id, day ORDER BY start_time, id ROWS UNBOUNDED PRECEDING) AS island FROM c)
SELECT user_id, day, tag_id, min(f) AS from_second, max(e) AS to_second FROM i GROUP BY user_id, day, tag_id, island""")
def a23_day_timeline(spark, sf_dir):
    return analytics.timeline(activities(spark, sf_dir), "tag_id")


@query(f"""WITH {ACTIVITIES}, s AS (SELECT tag_id, CAST(epoch(lead(start_time) OVER (PARTITION BY user_id, CAST(start_time AS DATE) ORDER BY start_time, id)) - epoch(start_time) AS BIGINT) AS s FROM a)
SELECT tag_id, CASE WHEN tag_id = 2 THEN 60 ELSE CAST(sum(coalesce(s, 0)) AS BIGINT) END AS seconds FROM s WHERE tag_id IS NOT NULL GROUP BY tag_id""")
def a17_group_durations(spark, sf_dir):
    edited = spark.range(2, 3).select(F.col("id").alias("tag_id"), F.lit(60).cast("long").alias("seconds"))
    return analytics.group_durations(activities(spark, sf_dir), "tag_id", edited)


@query(f"""{SPANS}, n AS (SELECT day, CASE tag_id WHEN 1 THEN 'work' WHEN 2 THEN 'Admin' WHEN 3 THEN 'zen' ELSE 'Untagged' END AS label, sum(seconds) AS seconds FROM p GROUP BY ALL)
SELECT day, string_agg(label || '=' || CAST(coalesce(seconds, 0) AS BIGINT), ';' ORDER BY label = 'Untagged', lower(label)) AS tags FROM n GROUP BY day""")
def a22_day_tag_maps(spark, sf_dir):
    label = F.when(F.col("tag_id") == 1, "work").when(F.col("tag_id") == 2, "Admin").when(F.col("tag_id") == 3, "zen")
    maps = analytics.day_tag_maps(analytics.time_per_tag_day(activities(spark, sf_dir)), label)
    shown = F.transform("tags", lambda t: F.concat(t["label"], F.lit("="), F.coalesce(t["seconds"], F.lit(0)).cast("string")))
    return maps.select("day", F.array_join(shown, ";").alias("tags"))


_NEAR = """n AS (SELECT a.vec_id AS id, b.vec_id AS other, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS distance
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9), b.vec_id) <= 45)"""


def _near(spark, sf_dir):
    return graph.nearest_of_all(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 45)


@query(f"""WITH {_NEAR} SELECT id, other, round(distance, 6) AS distance FROM n""")
def k4_nearest_of_all(spark, sf_dir):
    return _near(spark, sf_dir).select("id", "other", F.round("distance", 6).alias("distance"))


@query(f"""WITH {_NEAR} SELECT id, other, round(distance, 6) AS distance FROM n""")
def k4_indexed_neighbours(spark, sf_dir):
    """Through the index; while all lists are looked through, the same as comparing all."""
    return kept_vectors(spark, sf_dir).nearest_of_all(45).select("id", "other", F.round("distance", 6).alias("distance"))


@query(f"""WITH {_NEAR}, m AS (SELECT id, other FROM n UNION SELECT DISTINCT id, id FROM n),
p AS (SELECT DISTINCT x.other AS first_id, y.other AS second_id FROM m x JOIN m y ON x.id = y.id AND x.other < y.other)
SELECT first_id, second_id, round(greatest(0, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS weight FROM p JOIN embeddings a ON a.vec_id = first_id JOIN embeddings b ON b.vec_id = second_id""")
def g3_similarity_edges(spark, sf_dir):
    edges = graph.similarity_edges(kept_vectors(spark, sf_dir).nearest_of_all(45), table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return edges.select("first_id", "second_id", F.round("weight", 6).alias("weight"))


@query()
def g1_communities(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    edges = graph.similarity_edges(kept_vectors(spark, sf_dir).nearest_of_all(45), vectors, "vec_id", "embedding")
    return graph.communities(edges, 0.05)


_CENTRE = "SELECT label AS cluster, list(v ORDER BY pos) AS c FROM (SELECT label, pos, avg(v) AS v FROM (SELECT label, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) AS pos FROM r) GROUP BY ALL) GROUP BY 1"


@query(f"""WITH r AS (SELECT * FROM embeddings WHERE vec_id % 5 <> 0), a AS (SELECT * FROM embeddings WHERE vec_id % 5 = 0),
n AS (SELECT a.vec_id AS id, r.label AS cluster, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], r.embedding::DOUBLE[]), 9) AS distance, r.vec_id AS other FROM a, r QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY distance, other) <= 45),
v AS (SELECT id, cluster, round(sum(greatest(1 - distance, 0)), 9) AS votes FROM n GROUP BY ALL HAVING votes > 0), e AS (SELECT id, arg_max(cluster, struct_pack(votes, k := -cluster)) AS cluster FROM v GROUP BY id),
c AS ({_CENTRE}), z AS (SELECT vec_id AS id, arg_min(cluster, struct_pack(d := round(1 - list_cosine_similarity(embedding::DOUBLE[], c), 9), cluster)) AS cluster FROM a, c GROUP BY vec_id)
SELECT z.id, coalesce(e.cluster, z.cluster)::BIGINT AS cluster, CASE WHEN e.cluster IS NULL THEN 'centroid' ELSE 'edge' END AS "by" FROM z LEFT JOIN e USING (id)""")
def g10_online_assignment(spark, sf_dir):
    """A fifth of the embeddings comes as a stream and is assigned to the labels of the others."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("cluster"), F.col("embedding").alias("vector"))
    run, path = vectors.filter("id % 5 <> 0"), f"{shared_root(spark)}/online-{uuid.uuid4().hex}"
    index = VectorIndex(spark, f"{path}/run").build(run, "id", "vector")
    centres = VectorIndex(spark, f"{path}/centres").build(graph.centroids(run, "cluster", "vector"), "cluster", "centroid", 1, cover=1.0)
    arriving = online.arriving(spark, sf_dir, "embeddings").filter("vec_id % 5 = 0")
    work = lambda b: ontology.assigned(b, index, centres, run.select("id", "cluster"))
    online.started(arriving.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), path, work).awaitTermination()
    return online.state(spark, f"{path}/results", "id", "id long, cluster long, by string")


@query()
def g9_ontology_run(spark, sf_dir):
    """Tags of all embeddings, carried over from a run before that had their labels as tags; a resolution of 0.3 gives many small clusters."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").cast("long").alias("tag"))
    edges = graph.similarity_edges(kept_vectors(spark, sf_dir).nearest_of_all(45), vectors, "id", "vector")
    run = ontology.refreshed(edges, vectors.select("id", "vector"), vectors.select("id", "tag"), resolution=0.3, floor=0.2)
    return run.members


def _fit(spark, sf_dir):
    return reduction.fitted(table(spark, sf_dir, "embeddings"), kept_vectors(spark, sf_dir).nearest_of_all(45), "vec_id", "embedding")


@query()
def g11_fitted_reduction(spark, sf_dir):
    return _fit(spark, sf_dir).model.select("id", *(F.col("reduced")[k].alias(name) for k, name in enumerate("xyz")))


@query()
def g13_reduced_online(spark, sf_dir):
    """All embeddings, as they come in a stream, reduced by the model fitted on the first of them by a hash of the id."""
    path, vectors = f"{shared_root(spark)}/reduced-{uuid.uuid4().hex}", table(spark, sf_dir, "embeddings")
    known = vectors.orderBy(F.xxhash64("vec_id")).limit(1024)
    model = cut(reduction.fitted(known, graph.nearest_of_all(known, "vec_id", "embedding", 45), "vec_id", "embedding", rounds=5).model)
    online.started(online.arriving(spark, sf_dir, "embeddings"), path, lambda b: views.reduced_by_model(b, model, "vec_id", "embedding")).awaitTermination()
    low = online.state(spark, f"{path}/results", "id", "id long, reduced array<double>")
    return low.select("id", *(F.col("reduced")[k].alias(name) for k, name in enumerate("xyz")))


@query()
def g6_greedy_matching(spark, sf_dir):
    pairs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")).agg(F.sum("l_quantity").alias("score"))
    return graph.matched(pairs, 1.0)


@query("""WITH x AS (SELECT label, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings WHERE embedding IS NOT NULL),
m AS (SELECT label, pos, avg(v) AS v, count(*) AS members FROM x GROUP BY ALL) SELECT label, round(sum(v * pos), 5) AS weighed, max(members) AS members FROM m GROUP BY label""")
def a16_centroids(spark, sf_dir):
    c = graph.centroids(table(spark, sf_dir, "embeddings"), "label", "embedding")
    weighed = F.aggregate(F.transform("centroid", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return c.select("label", F.round(weighed, 5).alias("weighed"), "members")


@query("""WITH e AS (SELECT array_slice(p, 1, d) AS f, d, array_slice(p, 1, d - 1) AS u FROM (SELECT p, unnest(range(1, len(p))) AS d FROM
  (SELECT string_split(trim(regexp_replace(url, '/+', '/', 'g')), '/') AS p FROM pages)))
SELECT array_to_string(f, '/') AS folder, CAST(d AS INTEGER) AS depth, array_to_string(u, '/') AS parent, count(*) AS files FROM e GROUP BY ALL""")
def g24_folder_tree(spark, sf_dir):
    return graph.folders(table(spark, sf_dir, "pages"), "url")


_PHRASES = ["the road", "and the", "of the"]


def _phrase_sql(number: int, phrase: str) -> str:
    words = [stem(w) for w in phrase.split()]
    joins = " ".join(f"JOIN p_documents x{k} ON x{k}.id = x0.id AND x{k}.pos = x0.pos + {k} AND x{k}.stem = '{w}'" for k, w in enumerate(words) if k)
    return f"SELECT DISTINCT x0.id, {number} AS phrase FROM p_documents x0 {joins} WHERE x0.stem = '{words[0]}'"


@query(f"""WITH {postings_sql("documents")}, y AS ({" UNION ALL ".join(_phrase_sql(k, p) for k, p in enumerate(_PHRASES))}) SELECT id, CAST(count(*) AS INTEGER) AS phrases FROM y GROUP BY id""")
def t2_phrases(spark, sf_dir):
    return kept_index(spark, sf_dir, "documents").phrases(_PHRASES)


@query(f"""WITH {postings_sql("documents")} SELECT stem AS term, count(DISTINCT id) AS docs, count(*) AS n, sum(pos - 1)::BIGINT AS places FROM p_documents GROUP BY stem""")
def t1_stored_index(spark, sf_dir):
    each = kept_index(spark, sf_dir, "documents").postings().select("term", F.size("places").alias("c"), F.aggregate("places", F.lit(0).cast("long"), lambda s, x: s + x).alias("at"))
    return each.groupBy("term").agg(F.count("*").alias("docs"), F.sum("c").alias("n"), F.sum("at").alias("places"))


@query(f"""WITH {postings_sql("documents")} SELECT stem AS term, count(DISTINCT id) AS docs, count(*) AS n, (SELECT count(*) FROM t_documents) AS rows, (SELECT sum(len(t))::BIGINT FROM t_documents) AS terms FROM p_documents GROUP BY stem""")
def m26_index_in_step(spark, sf_dir):
    """The index of what the table was: other texts and ids in a hundredth of the rows, some rows too many and some too few. Brought in step by
    the dirty ids it is the table's."""
    now, key = table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("doc_id")
    old = now.filter(key % 100 != 1).withColumn("text", F.when(key % 100 == 2, F.upper("text")).when(key % 100 == 3, F.concat(F.lit("formerly "), "text")).otherwise(F.col("text")))
    gone = now.filter(key % 200 == 4).select((-key - 1).alias("doc_id"), "text")
    index = TextIndex(spark, f"{shared_root(spark)}/text-index-{uuid.uuid4().hex}").build(old.union(gone), "doc_id", F.col("text"))
    dirty = now.filter((key % 100).isin(1, 2, 3)).select(key.alias("id")).union(gone.select(key))
    index.update(dirty, now, "doc_id", F.col("text"))
    rows, terms = index.size()
    found = index.counts().groupBy("term").agg(F.count("*").alias("docs"), F.sum("c").alias("n"))
    return found.select("term", "docs", "n", F.lit(rows).alias("rows"), F.lit(terms).alias("terms"))


@query(r"""WITH k AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(strip_accents(lower(coalesce(text, ''))), '[^\p{L}\p{N}]+'), lambda x: length(x) > 1) AS a FROM documents),
d AS (SELECT id, list_filter(a, lambda x, i: list_position(a, x) = i) AS a FROM k), f AS (SELECT id, a, list_filter(a, lambda x: x NOT IN (__WORDS__)) AS t FROM d)
SELECT id, array_to_string(array_slice(CASE WHEN len(t) = 0 THEN a ELSE t END, 1, 12), ' ') AS keywords FROM f""".replace("__WORDS__", ", ".join(f"'{w}'" for w in (*tx.STOP_WORDS, *tx.GENERIC_TERMS))))
def t6_keywords(spark, sf_dir):
    words = tx.keywords(F.coalesce("text", F.lit("")), [*tx.STOP_WORDS, *tx.GENERIC_TERMS])
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.array_join(words, " ").alias("keywords"))


_SAID = "CASE doc_id % 4 WHEN 0 THEN 'The user is ' || left(coalesce(text, ''), 40) WHEN 1 THEN 'this screenshot shows THE USER WAS ' || left(coalesce(text, ''), 40) WHEN 2 THEN 'an image of ' ELSE left(coalesce(text, ''), 40) END"


@query(f"""WITH s AS (SELECT doc_id, {_SAID} AS t FROM documents), b AS (SELECT doc_id, t, regexp_replace(t, '\\A({"|".join(tx.NARRATION)})+', '', 'i') AS b FROM s)
SELECT doc_id, CASE WHEN b = '' THEN t ELSE upper(left(b, 1)) || substr(b, 2) END AS said FROM b""")
def s6_without_narration(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.without_narration(F.expr(_SAID)).alias("said"))


@query()
def d9_reduced_in_rounds(spark, sf_dir):
    """All turns of each role, reduced to what fits a prompt of 400 tokens; a prompt's answer is its first and last words."""
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "role", (F.col("conv_id") % 50).cast("string")).alias("grp"), (F.col("conv_id") * 1000 + F.col("turn")).alias("place"), "text")
    answer = lambda p: p.select("grp", "part", F.concat(F.substring("prompt", 1, 60), F.lit(" ... "), F.expr("right(prompt, 60)")).alias("response"))
    prompts = rounds.Prompts("Everything said", "Sum it up.", "A part of what was said", "Be brief.")
    return rounds.reduced(turns, prompts, answer, 400, 350).finals


@query("""WITH e AS (SELECT l_suppkey AS id, l_discount * 10 AS t, NULL::DOUBLE AS v FROM lineitem WHERE l_quantity > 45 UNION ALL SELECT o_custkey, NULL, o_totalprice / 600000 FROM orders),
b AS (SELECT id, coalesce(max(t), 0) AS t, coalesce(max(v), 0) AS v FROM e GROUP BY id)
SELECT id, round(0.55::DOUBLE * v + 0.45::DOUBLE * t + CASE WHEN t > 0 AND v > 0 THEN 0.10::DOUBLE ELSE 0 END, 6) AS score FROM b""")
def a10_merged_evidence(spark, sf_dir):
    text = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_suppkey").alias("id"), (F.col("l_discount") * 10).alias("text_score"))
    vector = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), (F.col("o_totalprice") / 600000).alias("vector_score"))
    return search.merged_evidence([text, vector], ["id"]).select("id", F.round("score", 6).alias("score"))


@query("""SELECT n_nationkey AS id, max(s) AS score FROM (SELECT n_nationkey, n_nationkey * 1.5::DOUBLE AS s FROM nation UNION ALL SELECT c_nationkey, c_acctbal FROM customer) GROUP BY 1""")
def t9_rolled_up(spark, sf_dir):
    own = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), (F.col("n_nationkey") * 1.5).alias("score"))
    c = table(spark, sf_dir, "customer").withColumn("id", F.concat(F.lit("c"), F.col("c_custkey").cast("string")))
    parents = c.select("id", F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("parent"))
    rolled = search.rolled_up(own.union(c.select("id", F.col("c_acctbal").alias("score"))), parents)
    return rolled.filter("id like 'n%'").select(F.substring("id", 2, 9).cast("int").alias("id"), "score")


@query("""WITH f AS (SELECT lower(p_name) AS alias, min(p_partkey) AS file_id FROM part WHERE p_partkey % 2 = 0 GROUP BY 1 UNION ALL SELECT lower(p_name) || '.md', min(p_partkey) FROM part WHERE p_partkey % 2 = 1 GROUP BY 1),
l AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN './' || p_name WHEN 1 THEN 'notes/' || p_name || '.txt' ELSE p_name END AS target, lower(p_name) AS name, p_partkey % 3 AS kind FROM part)
SELECT p_partkey, target, coalesce(a.file_id, CASE WHEN kind <> 1 THEN b.file_id END) AS file_id FROM l LEFT JOIN f a ON a.alias = name LEFT JOIN f b ON b.alias = name || '.md'""")
def j21_resolved_links(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    aliases = part.select(F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit(".md"))).alias("alias"), F.col("p_partkey").alias("file_id"))
    target = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("./"), "p_name")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("notes/"), "p_name", F.lit(".txt"))).otherwise(F.col("p_name"))
    return search.resolved_links(part.select("p_partkey", target.alias("target")), "target", aliases)
