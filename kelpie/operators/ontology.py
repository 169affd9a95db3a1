"""Tags from communities of vectors: the run over all rows, and the assignment of rows that come later.

A run finds communities in the similarity graph, ranks members by their links within, and carries tags over from the run before: pairs of
old and new communities that share enough are matched one to one, best first. Rows that come later take the tag that most of
their neighbours' weight has, or else that of the nearest centre, and no tag that somebody set is changed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpie.operators import graph
from kelpie.operators.neighbours import VectorIndex, unit_rows
from kelpie.plans.storage import cut

#: The graph's resolution, neighbours, the least continuity that carries a tag over, and how many members stand for a tag.
RESOLUTION, NEIGHBOURS, LEAST_CONTINUITY, TOP = 0.05, 45, 0.6, 5


@dataclass(frozen=True)
class Run:
    """candidates (cluster, tag, similarity: null for a new tag, members, centroid), members (id, cluster, tag, centrality, place)."""

    candidates: DataFrame
    members: DataFrame


def clusters_of(edges: DataFrame, vectors: DataFrame, resolution: float = RESOLUTION) -> tuple[DataFrame, DataFrame]:
    """Members (id, cluster, centrality: the weight of links within the cluster, place by it) and clusters (cluster, members, centroid), from
    edges and vectors (id, vector)."""
    found = cut(graph.communities(edges, resolution).withColumnRenamed("community_id", "cluster"))
    first = found.select(F.col("id").alias("first_id"), "cluster")
    second = found.select(F.col("id").alias("second_id"), F.col("cluster").alias("other"))
    within = edges.join(first, "first_id").join(second, "second_id").filter("cluster = other").select("first_id", "second_id", "weight")
    ranked = found.join(graph.degrees(within), "id", "left").withColumn("centrality", F.coalesce("degree", F.lit(0.0))).drop("degree")
    place = Window.partitionBy("cluster").orderBy(F.desc("centrality"), "id")
    centres = graph.centroids(found.join(vectors, "id"), "cluster", "vector").select("cluster", "centroid")
    sizes = found.groupBy("cluster").agg(F.count("*").alias("members"))
    return ranked.withColumn("place", F.row_number().over(place)), sizes.join(centres, "cluster", "left")


def refreshed(edges: DataFrame, vectors: DataFrame, before: DataFrame, resolution: float = RESOLUTION, floor: float = LEAST_CONTINUITY) -> Run:
    """A run over the edges and vectors (id, vector), given the members (id, tag) of the run before.

    A cluster that is matched with a tag of the run before keeps it; the others take the next numbers in the order of their smallest
    members. Rows outside of all clusters have no tag of this run."""
    members, clusters = clusters_of(edges, vectors, resolution)
    old = before.filter(F.col("tag").isNotNull()).select("id", F.col("tag").alias("cluster"))
    scores = graph.continuity(members.select("id", "cluster"), old, vectors, "vector").withColumn("score", F.round("score", 9))
    matches = graph.matched(scores, floor).select(F.col("a").alias("cluster"), F.col("b").alias("kept"), F.col("score").alias("similarity"))
    named = cut(clusters.join(matches, "cluster", "left"))
    last = before.agg(F.coalesce(F.max("tag"), F.lit(0)).alias("last"))
    new = numbered(named.filter("kept is null").select("cluster"), "cluster").crossJoin(F.broadcast(last)).select("cluster", (F.col("number") + F.col("last")).alias("made"))  # one row
    candidates = cut(named.join(new, "cluster", "left").select("cluster", F.coalesce("kept", "made").cast("long").alias("tag"), "similarity", "members", "centroid"))
    return Run(candidates, cut(members.join(candidates.select("cluster", "tag"), "cluster").select("id", "cluster", "tag", "centrality", "place")))


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """The rows with their number from 1 in the order of a unique key: ranges are sorted each for itself, and only their sizes are added up."""
    sorted_ = cut(rows.repartitionByRange(key).sortWithinPartitions(key).withColumn("__at", F.monotonically_increasing_id()))
    part, within = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted_.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    before = sizes.select("__part", (F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("__before"))  # a row a range
    return sorted_.withColumn("__part", part).join(F.broadcast(before), "__part").withColumn("number", F.col("__before") + within + 1).drop("__part", "__before", "__at")


def assigned(new: DataFrame, index: VectorIndex, centres: VectorIndex, members: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """id, cluster and by ('edge' or 'centroid') of new rows (id, vector) under a run: `index` holds the run's vectors, `centres` the
    centroids by cluster, members are (id, cluster). The most weight among the k nearest decides, ties by cluster; if no weight is above 0, the
    nearest centroid. Rows without a vector that can be compared have neither."""
    asked = unit_rows(new, "id", "vector")
    near = index.nearest_of(asked, k).join(members.select(F.col("id").alias("other"), "cluster"), "other")
    votes = near.groupBy("id", "cluster").agg(F.round(F.sum(F.greatest(1 - F.col("distance"), F.lit(0.0))), 9).alias("votes")).filter("votes > 0")
    by_edge = votes.groupBy("id").agg(F.max_by("cluster", F.struct("votes", -F.col("cluster"))).alias("cluster"))
    by_centre = centres.nearest_of(asked.withColumn("id", -1 - F.col("id")), 1).select((-1 - F.col("id")).alias("id"), F.col("other").alias("cluster"))
    return graph.with_fallback(new.select("id"), by_edge, by_centre)
