"""Records of days, best ones, links between records and rules of edits, each with its SQL.

Days are few against rows: what holds one row a day or a tag may become an array. All else is grouped or joined by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpie.plans.activity_queries import ACTIVITIES, QUERIES, SQL, activities, query, table

__all__ = ["QUERIES", "SQL"]  # those of all modules of queries

TODAY = "2026-01-01"


def day_list(rows: DataFrame, today: str) -> DataFrame:
    """The days that have rows, and today; rows without a start have no day."""
    day = F.to_date("start_time").alias("day")
    return rows.filter("start_time is not null").select(day).union(rows.sparkSession.range(1).select(F.lit(today).cast("date"))).distinct()


def counters(**frames: tuple[DataFrame, dict]) -> DataFrame:
    """One row with all counters: each frame is read once, its aggregates by name; no counts are null."""
    made = None
    for frame, aggregates in frames.values():
        one = frame.agg(F.map_from_arrays(F.array(*map(F.lit, aggregates)), F.array(*(F.coalesce(a.cast("long"), F.lit(0)) for a in aggregates.values()))).alias("m"))
        made = one if made is None else made.union(one)
    names = [n for _, aggregates in frames.values() for n in aggregates]
    return made.agg(*(F.max(F.try_element_at("m", F.lit(n))).alias(n) for n in names))


def best_of_groups(rows: DataFrame, group: str, rank: str, most: int) -> DataFrame:
    """The groups with the smallest best rank, ties to the smaller group; rows without a rank or group don't count."""
    best = rows.filter(F.col(group).isNotNull() & F.col(rank).isNotNull()).groupBy(group).agg(F.min(rank).alias(rank))
    return best.orderBy(rank, group).limit(most)


def normalised(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Values by the bounds of all rows, from 0 to 1; 1 where the bounds are equal."""
    low, high = (rows.agg(f(value)).scalar() for f in (F.min, F.max))
    return rows.withColumn(name, F.when(low == high, F.lit(1.0)).otherwise((F.col(value) - low) / (high - low)))


def linked_to(links: DataFrame, one: str, two: str, wanted: DataFrame) -> DataFrame:
    """Links with an end among the wanted ids, each once: a join by each end instead of one by either."""
    ids = wanted.select(F.col(wanted.columns[0]).alias("__id")).distinct()
    by_one = links.join(ids, F.col(one) == F.col("__id"), "left_semi")
    return by_one.union(links.join(ids, F.col(two) == F.col("__id"), "left_semi")).distinct()


@query(f"WITH {ACTIVITIES} SELECT DISTINCT CAST(start_time AS DATE) AS day FROM a UNION SELECT DATE '{TODAY}'")
def a2_days(spark, sf_dir):
    return day_list(activities(spark, sf_dir), TODAY)


@query("SELECT o_custkey, count(*) AS orders, count(*) FILTER (o_orderstatus = 'F') AS done FROM orders GROUP BY o_custkey")
def a3_conditional_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))


@query("""SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM documents WHERE lang IS NOT NULL) AS named, (SELECT count(*) FROM labels) AS labelled,
  (SELECT count(*) FROM labels WHERE toxic = 1) AS toxic, (SELECT count(*) FROM conversations) AS turns, (SELECT count(*) FROM conversations WHERE turn = 0) AS firsts""")
def a5_counters(spark, sf_dir):
    return counters(
        documents=(table(spark, sf_dir, "documents"), {"documents": F.count("*"), "named": F.count("lang")}),
        labels=(table(spark, sf_dir, "labels"), {"labelled": F.count("*"), "toxic": F.count_if(F.col("toxic") == 1)}),
        conversations=(table(spark, sf_dir, "conversations"), {"turns": F.count("*"), "firsts": F.count_if(F.col("turn") == 0)}),
    )


@query("SELECT o_custkey, min(CASE WHEN o_orderstatus <> 'P' THEN o_orderkey END) AS first_live FROM orders GROUP BY o_custkey")
def a7_first_live(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey"))).alias("first_live"))


@query("SELECT o_custkey, min(o_totalprice) AS o_totalprice FROM orders GROUP BY o_custkey ORDER BY 2, 1 LIMIT 20")
def a8_best_groups(spark, sf_dir):
    return best_of_groups(table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice", 20)


@query("SELECT c_custkey, (c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()) AS share FROM customer")
def a11_normalised(spark, sf_dir):
    return normalised(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "share").drop("c_acctbal")


@query(f"""WITH {ACTIVITIES} SELECT id, CAST(greatest(epoch(coalesce(lead(start_time) OVER (PARTITION BY user_id ORDER BY start_time, id), start_time)) - epoch(start_time), 0) AS BIGINT)
  AS seconds FROM a""")
def a18_durations(spark, sf_dir):
    following = F.lead("start_time").over(Window.partitionBy("user_id").orderBy("start_time", "id"))
    seconds = F.timestamp_diff("SECOND", F.col("start_time"), F.coalesce(following, "start_time"))
    return activities(spark, sf_dir).select("id", F.greatest(seconds, F.lit(0)).cast("long").alias("seconds"))


@query(f"""WITH {ACTIVITIES}, b AS (SELECT CAST(start_time AS DATE) AS day, tag_id, count(*) AS n FROM a WHERE tag_id IS NOT NULL AND application NOT IN ('PAUSED', 'SLEEP') GROUP BY ALL),
  d AS (SELECT DISTINCT day FROM b ORDER BY day DESC LIMIT 14), t AS (SELECT DISTINCT tag_id FROM b)
  SELECT d.day, t.tag_id, coalesce(b.n, 0)::BIGINT AS n FROM d CROSS JOIN t LEFT JOIN b ON b.day = d.day AND b.tag_id = t.tag_id""")
def a21_bar_segments(spark, sf_dir):
    """The last 14 days that have rows, each with all tags; the days are one array of at most 14."""
    rows = activities(spark, sf_dir).filter("tag_id is not null and application not in ('PAUSED', 'SLEEP')")
    bars = rows.groupBy(F.to_date("start_time").alias("day"), "tag_id").agg(F.count("*").alias("n"))
    last = bars.select("day").distinct().orderBy(F.desc("day")).limit(14).agg(F.collect_list("day"))
    dense = bars.select("tag_id").distinct().withColumn("days", last.scalar()).select("tag_id", F.explode("days").alias("day"))
    return dense.join(bars, ["day", "tag_id"], "left").select("day", "tag_id", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query(f"WITH {ACTIVITIES} SELECT user_id, id, place FROM (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY start_time DESC, id DESC) AS place FROM a)")
def w8_display_places(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("start_time"), F.desc("id")))
    return activities(spark, sf_dir).select("user_id", "id", place.alias("place"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def j9_with_urgent_orders(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return customer.join(urgent, customer["c_custkey"] == urgent["o_custkey"], "left_semi")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def j12_without_labels(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("""WITH e AS (SELECT DISTINCT least(o_custkey, l_suppkey) AS one, greatest(o_custkey, l_suppkey) AS two FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey <> l_suppkey),
  w AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
  SELECT one, two FROM e WHERE one IN (FROM w) OR two IN (FROM w)""")
def j17_links_by_either_end(spark, sf_dir):
    bought = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).filter("o_custkey <> l_suppkey")
    links = bought.select(F.least("o_custkey", "l_suppkey").alias("one"), F.greatest("o_custkey", "l_suppkey").alias("two")).distinct()
    return linked_to(links, "one", "two", table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey"))


@query("SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def j25_bridge_pairs(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    return table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_partkey").distinct()


@query("""SELECT doc_id, CASE WHEN l.quality = 1 THEN source ELSE upper(source) END AS title FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)""")
def m18_edits_stay(spark, sf_dir):
    """Generated titles, but for rows that a user has edited (here: of quality 1)."""
    edited = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source").join(edited, "doc_id", "left")
    return docs.select("doc_id", F.when(F.col("quality") == 1, F.col("source")).otherwise(F.upper("source")).alias("title"))


@query(f"SELECT c_custkey, CASE WHEN c_mktsegment <> 'MACHINERY' AND c_acctbal < 0 THEN DATE '{TODAY}' END AS delete_date FROM customer")
def m21_soft_deletes(spark, sf_dir):
    """Rows to be deleted get a date, those of a protected kind don't."""
    doomed = (F.col("c_mktsegment") != "MACHINERY") & (F.col("c_acctbal") < 0)
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(doomed, F.lit(TODAY).cast("date")).alias("delete_date"))


def numbered_names(rows: DataFrame, ident: str, name: str) -> DataFrame:
    """Names trimmed and lower-cased, those after the first of a name with a number from 2; rows of one name are counted in parts
    by hash before they are numbered, so that a frequent name isn't sorted by one task. Null names stay null; a name that already
    ends in such a number may meet a numbered one."""
    parts = rows.withColumn("__name", F.lower(F.trim(name))).withColumn("__part", F.pmod(F.xxhash64(ident), F.lit(64)))
    sizes = parts.groupBy("__name", "__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__name").orderBy("__part")) - F.col("__n")
    place = F.row_number().over(Window.partitionBy("__name", "__part").orderBy(ident))
    numbered = parts.withColumn("__at", place).join(sizes.withColumn("__before", before), ["__name", "__part"], "left").withColumn("__at", F.col("__at") + F.coalesce("__before", F.lit(0)))
    return numbered.withColumn("unique_name", F.when((F.col("__at") == 1) | F.col("__name").isNull(), F.col("__name")).otherwise(F.concat_ws(" ", "__name", "__at"))).drop("__name", "__part", "__n", "__before", "__at")


@query("SELECT l_partkey, min(l_linenumber) AS best, max(l_orderkey) AS last_order FROM lineitem GROUP BY l_partkey")
def a9_merged_matches(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min("l_linenumber").alias("best"), F.max("l_orderkey").alias("last_order"))


@query("""WITH v AS (SELECT user_id, event_type, count(*) AS votes FROM events GROUP BY ALL)
  SELECT user_id, event_type, votes FROM v QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, event_type) = 1""")
def a15_votes(spark, sf_dir):
    """The candidate with most votes of each user, ties to the smaller name."""
    votes = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("votes"))
    best = votes.groupBy("user_id").agg(F.min(F.struct((-F.col("votes")).alias("v"), "event_type")).alias("b"))
    return best.select("user_id", "b.event_type", (-F.col("b.v")).alias("votes"))


@query(f"""WITH {ACTIVITIES} SELECT user_id, id, place FROM (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, start_time, id) AS place FROM a)
  WHERE place <= 3""")
def w3_ranked_three(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc_nulls_last("value"), "start_time", "id"))
    return activities(spark, sf_dir).select("user_id", "id", place.alias("place")).filter("place <= 3")


@query("SELECT o_orderkey, (SELECT c_name FROM customer WHERE c_custkey = o_custkey) AS name FROM orders")
def j14_looked_up(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("name"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(names, "o_custkey", "left").drop("o_custkey")


@query()
def m22_unique_names(spark, sf_dir):
    return numbered_names(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", "c_mktsegment").drop("c_mktsegment")
