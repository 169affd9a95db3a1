"""Full-text, vector and hybrid ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpie.functions.text import term_count, terms, times
from kelpie.functions.vectors import distance
from kelpie.operators.selection import candidates_for
from kelpie.plans.storage import cut

K1, B = 1.2, 0.75
#: The least idf, and the weights of hybrid scores.
LEAST_IDF = 1e-6
VECTOR_WEIGHT, TEXT_WEIGHT, BOTH_BONUS, FLOOR = 0.55, 0.45, 0.10, 0.42


def postings(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """id, pos and term of each word."""
    return docs.select(F.col(id_col).alias("id"), F.posexplode(terms(F.coalesce(text, F.lit("")))).alias("pos", "term"))


def bm25_part(f: Column, d: Column, rows: Column, n: Column, mean: Column) -> Column:
    idf = F.greatest(F.log((rows - d + 0.5) / (d + 0.5)), F.lit(LEAST_IDF))
    return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * n / mean))


def bm25(docs: DataFrame, id_col: str, text: Column, words: list[str]) -> DataFrame:
    """id and rank of the rows that hold a word as it stands, without an index; rank is negative, smaller is better. One pass counts
    the words in each text, which is kept, as both the ranks and the sums they need come from it. No word gives no rows."""
    asked = list(dict.fromkeys(w.lower() for w in words))
    if not asked:
        return docs.select(F.col(id_col).alias("id"), F.lit(0.0).alias("rank")).limit(0)
    each = docs.select(F.col(id_col).alias("id"), F.coalesce(text, F.lit("")).alias("t"))
    counted = cut(each.select("id", term_count(F.col("t")).alias("n"), *(times(F.col("t"), w).alias(f"f{k}") for k, w in enumerate(asked))))
    stats = counted.agg(F.count("*").alias("rows"), F.avg("n").alias("mean"), *(F.sum((F.col(f"f{k}") > 0).cast("long")).alias(f"d{k}") for k in range(len(asked))))
    parts = [bm25_part(F.col(f"f{k}"), F.col(f"d{k}"), F.col("rows"), F.col("n"), F.col("mean")) for k in range(len(asked))]
    hit = F.greatest(*(F.col(f"f{k}") for k in range(len(asked))), F.lit(0)) > 0
    return counted.filter(hit).crossJoin(F.broadcast(stats)).select("id", (-sum(parts[1:], parts[0])).alias("rank"))  # one row of sums


def relevant(hits: DataFrame, limit: int, floor: float | None = -3.0, order: tuple[str, ...] = ("rank", "id")) -> DataFrame:
    """The best hits: those at the floor or below, then as many as a search for `limit` results asks of a source."""
    kept = hits if floor is None else hits.filter(F.col("rank") <= floor)
    return kept.orderBy(*order).limit(candidates_for(limit))


def tree_search(overviews: DataFrame, activities: DataFrame, shots: DataFrame, limit: int, floor: float | None = -3.0) -> DataFrame:
    """The best overviews with their best activities and shots: overview, place, best, activity, activity_place, shot, shot_place.

    Hits are overviews (overview, rank), activities (activity, overview, start, rank) and shots (shot, activity, overview, start, ts,
    rank); each source gives its best. An overview ranks by its best hit of any kind; rows without an overview fall out. Of an
    overview, the three best activities that match or hold a matching shot, by rank, start and id; of each the three best shots."""
    o = relevant(overviews, limit, floor, ("rank", "overview"))
    a = relevant(activities.filter("activity is not null"), limit, floor, ("rank", "activity"))
    s = relevant(shots, limit, floor, ("rank", "shot"))
    every = o.select("overview", "rank").union(a.select("overview", "rank")).union(s.select("overview", "rank")).filter("overview is not null")
    top = ordered(every.groupBy("overview").agg(F.min("rank").alias("best")), [F.col("best"), F.col("overview")], limit)
    held = a.select("overview", "activity", "start", "rank").union(s.select("overview", "activity", "start", "rank")).groupBy("overview", "activity").agg(F.min("start").alias("start"), F.min("rank").alias("rank"))
    three = best_per_group(held, "overview", [F.col("rank"), F.col("start"), F.col("activity")]).select("overview", "activity", F.col("place").alias("activity_place"))
    shown = best_per_group(s, "activity", [F.col("rank"), F.col("ts"), F.col("shot")]).select("activity", "shot", F.col("place").alias("shot_place"))
    return top.join(three, "overview", "left").join(shown, "activity", "left").select("overview", "place", "best", "activity", "activity_place", "shot", "shot_place")


def expanded(index, docs: DataFrame, id_col: str, text: Column, words: list[str], stop: list[str], limit: int, more: int = 5) -> DataFrame:
    """id, rank and pass: the best rows of an index for the words, then those for the commonest other stems of these rows' texts that
    aren't among them. The few ids and stems pass through the driver."""
    best = lambda asked: index.ranked(asked).withColumn("rank", F.round("rank", 7)).orderBy("rank", "id").limit(limit)
    first = cut(best(words).withColumn("pass", F.lit(0)))
    ids = [r["id"] for r in first.select("id").collect()]  # `limit` of them
    said = index.commonest(docs.filter(F.col(id_col).isin(ids)), id_col, text, [*words, *stop], more) if ids else []
    second = best(said).filter(~F.col("id").isin(ids)).withColumn("pass", F.lit(1))
    return first.unionByName(second)


def normalised(rows: DataFrame, score: str) -> DataFrame:
    """The rows with `normalised`: the score from 0 for the least to 1 for the greatest; all alike give 1."""
    bounds = rows.agg(F.min(score).alias("__lo"), F.max(score).alias("__hi"))
    return rows.crossJoin(F.broadcast(bounds)).withColumn("normalised", min_max(F.col(score), F.col("__lo"), F.col("__hi"), False)).drop("__lo", "__hi")  # one row


def graph_candidates(sources: dict[str, tuple[DataFrame, DataFrame]], per_source: int = 10, total: int = 30) -> DataFrame:
    """type, id and score of the best candidates of each type, from hits by text (id, rank) and vector (id, distance): of each list the
    best `per_source`, normed over them, the best evidence for each candidate, then the hybrid score, type and id."""
    streams = []
    for kind, (by_text, by_vector) in sources.items():
        for hits, of, name in ((by_text, "rank", "text_score"), (by_vector, "distance", "vector_score")):
            few = hits.orderBy(of, "id").limit(per_source)
            bounds = few.agg(F.min(of).alias("__lo"), F.max(of).alias("__hi"))
            normed = few.crossJoin(F.broadcast(bounds)).withColumn(name, min_max(F.col(of), F.col("__lo"), F.col("__hi"), True))  # one row
            streams.append(normed.select(F.lit(kind).alias("type"), "id", name))
    return ordered(merged_evidence(streams, ["type", "id"]), [F.desc("score"), F.col("type"), F.col("id")], total)


def top_k(vectors: DataFrame, id_col: str, vec_col: str, query: list[float], k: int, name: str = "cosine") -> DataFrame:
    """The k nearest rows to a query vector, ties by id."""
    far = distance(F.col(vec_col), F.array(*map(F.lit, query)), name)
    return vectors.filter(F.size(vec_col) == len(query)).select(F.col(id_col).alias("id"), far.alias("distance")).orderBy("distance", "id").limit(k)


def min_max(value: Column, low: Column, high: Column, best_low: bool) -> Column:
    """Best 1, worst 0, all alike 1, none 0."""
    share = (high - value) / (high - low) if best_low else (value - low) / (high - low)
    return F.when(value.isNull(), 0.0).when(high == low, 1.0).otherwise(share)


def hybrid(text_hits: DataFrame, vector_hits: DataFrame, floor: float = FLOOR) -> DataFrame:
    """id and score of hits by text (id, rank) and vector (id, distance): each normed over its hits, weighed, and a bonus for both."""
    bounds = text_hits.agg(F.min("rank").alias("r0"), F.max("rank").alias("r1")).crossJoin(vector_hits.agg(F.min("distance").alias("d0"), F.max("distance").alias("d1")))
    every = text_hits.join(vector_hits, "id", "full").crossJoin(F.broadcast(bounds))  # one row of bounds
    text = min_max(F.col("rank"), F.col("r0"), F.col("r1"), True)
    vector = min_max(F.col("distance"), F.col("d0"), F.col("d1"), True)
    scored = every.select("id", text.alias("text_score"), vector.alias("vector_score"))
    score = VECTOR_WEIGHT * F.col("vector_score") + TEXT_WEIGHT * F.col("text_score") + F.when((F.col("vector_score") > 0) & (F.col("text_score") > 0), BOTH_BONUS).otherwise(0.0)
    return scored.withColumn("score", score).filter(F.col("score") >= floor)


def best_per_group(rows: DataFrame, group: str, order: list[Column], k: int = 3) -> DataFrame:
    """The first k rows of each group."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("place") <= k)


def phrase_hits(docs: DataFrame, id_col: str, text: Column, phrases: list[str]) -> DataFrame:
    """id and number of the phrases that a row holds as consecutive terms, rows with none left out. No phrase gives no rows."""
    phrases = [p for p in phrases if p.strip()]
    if not phrases:
        return docs.select(F.col(id_col).alias("id"), F.lit(0).alias("phrases")).limit(0)
    joined = docs.select(F.col(id_col).alias("id"), F.concat(F.lit(" "), F.array_join(terms(F.coalesce(text, F.lit(""))), " "), F.lit(" ")).alias("t"))
    held = [F.col("t").contains(f" {' '.join(p.lower().split())} ").cast("int") for p in phrases]
    return joined.select("id", sum(held[1:], held[0]).alias("phrases")).filter("phrases > 0")


def merged_evidence(streams: list[DataFrame], keys: list[str]) -> DataFrame:
    """Evidence of several streams (keys, text_score, vector_score), the best of each score for each key, then the hybrid score."""
    every = streams[0]
    for s in streams[1:]:
        every = every.unionByName(s, allowMissingColumns=True)
    best = every.groupBy(*keys).agg(*(F.coalesce(F.max(c), F.lit(0.0)).alias(c) for c in ("text_score", "vector_score")))
    both = F.when((F.col("text_score") > 0) & (F.col("vector_score") > 0), BOTH_BONUS).otherwise(0.0)
    return best.withColumn("score", VECTOR_WEIGHT * F.col("vector_score") + TEXT_WEIGHT * F.col("text_score") + both)


def rolled_up(scores: DataFrame, parents: DataFrame) -> DataFrame:
    """id and the best score of a row and all its descendants (id, parent): scores climb a level a round, until none changes."""
    best = cut(scores.groupBy("id").agg(F.max("score").alias("score")))
    while True:
        up = best.join(parents, "id").select(F.col("parent").alias("id"), "score")
        higher = cut(best.union(up).groupBy("id").agg(F.max("score").alias("score")))
        same = higher["id"].eqNullSafe(best["id"]) & higher["score"].eqNullSafe(best["score"])
        if higher.join(best, same, "left_anti").isEmpty():
            return higher
        best = higher


def resolved_links(links: DataFrame, target: str, aliases: DataFrame) -> DataFrame:
    """Links with the file that an alias (alias, file_id) names: by the path, then its stem, then with .md or .markdown added.

    All keys of a link go through one join; of aliases that several files share the smallest file counts."""
    path = F.lower(F.trim(F.regexp_replace("__target", r"^(\./)+", "")))
    stem = F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"\.[^.]+$", "")
    tried = F.array(path, stem, F.concat(path, F.lit(".md")), F.concat(path, F.lit(".markdown")))
    named = aliases.groupBy(F.lower("alias").alias("key")).agg(F.min("file_id").alias("file_id"))
    keys = links.select(F.col(target).alias("__target")).distinct().select("__target", F.posexplode(tried).alias("turn", "key"))
    found = keys.join(named, "key").groupBy("__target").agg(F.min_by("file_id", "turn").alias("file_id"))
    return links.join(found, links[target].eqNullSafe(F.col("__target")), "left").drop("__target")


def ordered(rows: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows in the order, with their place; only they meet in one task."""
    return rows.orderBy(*order).limit(k).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def flat_document(parts: dict[str, DataFrame]) -> DataFrame:
    """One row with a JSON document of lists, each the value `v` of a frame of one row."""
    whole = None
    for name, one in parts.items():
        named = one.select(F.col("v").alias(name))
        whole = named if whole is None else whole.crossJoin(named)  # one row each
    return whole.select(F.to_json(F.struct(*parts)).alias("document"))
