"""Mixing sources to target weights by Pareto order sampling.

Each source's target is its weight's share of all words, at most `most` times its own words; what a source can't take is
shared again by weight. Every document gets the whole copies that the ratio of target to words makes certain. What is left
is an unequal-probability sample: a document's chance is in proportion to its words. Documents whose chance would reach 1 are
certain and get one more copy, the largest first, until no chance of the others does. These are ranked by their random odds
divided by their odds of inclusion and taken in that order while they fit the words left; one more document, the one that comes
nearest to what then remains, rounds the sum. Random numbers are hashes of id and text, so reruns agree.

The place where the words are used up comes from two rounds of histograms of the ranks, so no source's rows meet in a task; chances
come from a source's distinct sizes, which the longest document bounds. Only sums by source meet in one task, a row for each.

Cases: null text has no words; null source is a source, after all others; documents without words take nothing; rows equal in
id and text are ties and are all in or all out; an empty table gives no rows. Columns of the input named like those added
are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpie.llm.common import apart, stored, together

WORD = r"[^\x20\x09-\x0D]+"
_FINE = 4096
_ADDED = ("size", "source_size", "target", "copies", "taken")


def drawn(docs: DataFrame) -> DataFrame:
    """The rows with size and the columns that sampling goes by: __source, __no_source, __key and __u, uniform in [0, 1)."""
    text = F.coalesce("text", F.lit(""))
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(text.cast("binary")))
    return docs.withColumns(
        {"size": F.regexp_count(text, F.lit(WORD)).cast("long"), "__source": F.coalesce("source", F.lit("")), "__no_source": F.col("source").isNull(), "__key": key}
    ).withColumn("__u", F.conv(F.substring(F.md5(F.col("__key").cast("binary")), 1, 12), 16, 10).cast("double") / float(2**48))


def targets(rows: DataFrame, weights: tuple[float, ...], most: int) -> DataFrame:
    """A row for each source: source_size, target, whole copies and the words left for the sample."""
    sizes = rows.groupBy("__source", "__no_source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy("__no_source", "__source")  # a row for each source
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    capped = sizes.withColumn("__w", weight.cast("double")).withColumn("__cap", F.col("source_size") * most)
    filling = Window.orderBy(F.col("__cap") / F.col("__w"), "__no_source", "__source")
    level = capped.withColumns(
        {
            "__full": F.coalesce(F.sum("__cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "__rest": F.sum("__w").over(filling.rowsBetween(0, Window.unboundedFollowing)),
            "__all": F.sum("source_size").over(Window.partitionBy()),
        }
    ).withColumn("__level", (F.col("__all") - F.col("__full")).cast("double") / F.col("__rest"))
    fits = F.when(F.col("__cap") / F.col("__w") >= F.col("__level"), F.col("__level"))
    water = level.withColumn("__level", F.max(fits).over(Window.partitionBy()))
    target = F.least(F.col("__cap").cast("double"), F.col("__level") * F.col("__w"))
    return water.select("__source", "__no_source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target")).withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    ).withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))


_BY = ["__source", "__no_source"]


def chances(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The plan with __most, the largest size that isn't certain, __slope, the chance for each word of a document, and __room, the
    words left for the sample once larger documents have their certain copy."""
    open_ = plan.filter("left > 0 and source_size > 0").select(*_BY, "left")
    sizes = rows.filter("size > 0").groupBy(*_BY, "size").agg(F.count("*").alias("__n")).join(open_, _BY)
    down = Window.partitionBy(*_BY).orderBy(F.desc("size"))  # a row for each distinct size
    larger = F.coalesce(F.sum(F.col("__n") * F.col("size")).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wide = F.lit(0).cast("decimal(38,0)") + F.col("size")
    squares = F.sum((wide * F.col("size") * F.col("__n")).cast("decimal(38,0)")).over(down.rowsBetween(0, Window.unboundedFollowing))
    at = sizes.withColumn("__room", F.col("left") - larger).withColumn("__slope", F.col("__room") / squares.cast("double"))
    first = at.filter(F.col("__slope") * F.col("size") < 1).groupBy(*_BY).agg(F.max_by(F.struct(F.col("size").alias("__most"), "__slope", "__room"), "size").alias("__c"))
    return plan.join(first.select(*_BY, "__c.*"), _BY, "left")


def pareto_rank(u: Column, chance: Column) -> Column:
    """Random odds divided by the odds of inclusion."""
    return (u / (1 - u)) / (chance / (1 - chance))


def _rank() -> Column:
    return pareto_rank(F.col("__u"), F.col("__slope") * F.col("size"))


def cuts(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The plan with each source's place in the order where its words are used up: __cut (rank, key), __words before it, and
    the key __round of the document that rounds the sum."""
    ranked = rows.join(plan.filter("__slope > 0"), _BY).filter("size > 0 and size <= __most").withColumn("__rank", _rank())
    bound, edges = ranked.withColumns({"__done": F.lit(0).cast("long"), "__step0": F.lit(0).cast("long")}), 1
    for _ in range(2):
        edges *= _FINE
        step = F.floor(F.col("__rank") / (F.col("__rank") + 1) * edges).cast("long")
        inside = bound.withColumn("__step", step)
        sums = inside.groupBy(*_BY, "__room", "__done", "__step").agg(F.sum("size").alias("__n"))
        upto = Window.partitionBy(*_BY).orderBy("__step")  # at most _FINE rows a source
        run = sums.withColumn("__end", F.col("__done") + F.sum("__n").over(upto)).filter(F.col("__end") > F.col("__room"))
        first = run.groupBy(*_BY).agg(F.min_by(F.struct("__step", (F.col("__end") - F.col("__n")).alias("__done")), "__step").alias("__at"))
        first = first.select(*_BY, F.col("__at.__step").alias("__step"), F.col("__at.__done").alias("__done"))
        bound = inside.drop("__done").join(first, [*_BY, "__step"]).drop("__step")
    upto = Window.partitionBy(*_BY).orderBy("__rank", "__key")  # the frame has all ties; rows of one of 16 million steps
    last = bound.withColumn("__end", F.col("__done") + F.sum("size").over(upto)).groupBy(*_BY).agg(
        F.min(F.when(F.col("__end") > F.col("__room"), F.struct("__rank", "__key"))).alias("__cut"),
        F.coalesce(F.max(F.when(F.col("__end") <= F.col("__room"), F.col("__end"))), F.max("__done")).alias("__words"),
    )
    last = stored(last, "cuts")  # a row for each source, as the plan: Spark then knows that it is small and broadcasts it
    beyond = ranked.join(last, _BY).filter(F.struct("__rank", "__key") >= F.col("__cut")).withColumn("__miss", F.abs(F.col("size") - (F.col("__room") - F.col("__words"))))
    nearer = beyond.filter(F.col("__miss") < F.col("__room") - F.col("__words"))
    rounding = nearer.groupBy(*_BY).agg(F.min_by("__key", F.struct("__miss", "__rank", "__key")).alias("__round"))
    return plan.join(last.join(rounding, _BY, "left"), _BY, "left")


def applied(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The drawn rows with source_size, target, copies and taken."""
    sampled = (F.col("size") > 0) & (F.col("size") <= F.col("__most")) & ((F.struct(_rank().alias("__rank"), F.col("__key")) < F.col("__cut")) | (F.col("__key") == F.col("__round")))
    extra = F.when(F.col("size") > 0, F.coalesce((F.col("size") > F.col("__most")) | sampled, F.lit(False)).cast("int")).otherwise(0)
    chosen = rows.join(plan, _BY).withColumn("copies", F.col("whole") + extra).withColumn("taken", F.col("size") * F.col("copies"))
    return chosen.drop(*_BY, "__key", "__u", "whole", "left", "__most", "__slope", "__room", "__cut", "__words", "__round")


def _planned(slim: DataFrame, weights: tuple[float, ...], most: int) -> DataFrame:
    plan = stored(targets(slim, weights, most), "targets")
    return stored(cuts(slim, stored(chances(slim, plan), "chances")), "mix")


def mix(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: int = 3) -> DataFrame:
    """The documents with size, source_size, target, copies and taken (words, repeats counted); sources in code-point order
    have the weights in turn. `most` bounds the copies of a document and each target."""
    return together(_mixed(docs, weights, most), docs.columns, *_ADDED)


def repeated(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: int = 3) -> DataFrame:
    """The documents as they are, each as often as the mix takes it."""
    taken = _mixed(docs, weights, most).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


def _mixed(docs: DataFrame, weights: tuple[float, ...], most: int) -> DataFrame:
    rows = drawn(apart(docs, doc_id=F.col("doc_id"), text=F.col("text"), source=F.col("source")))
    slim = stored(rows.select(*_BY, "__key", "__u", "size"), "drawn")
    return applied(rows, _planned(slim, weights, most))


def digest(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: int = 3) -> DataFrame:
    """The same decisions without the texts, which are read once."""
    slim = stored(drawn(docs.select("doc_id", "text", "source")).select(*_BY, "__key", "__u", "size", "doc_id", "source"), "drawn")
    return applied(slim, _planned(slim, weights, most))


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, '')) AS k
  FROM documents),
u AS (SELECT *, CAST(CAST('0x' || substr(md5(k), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0 AS u FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM u GROUP BY source),
w AS (SELECT *, 1.0::DOUBLE + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS w, source_size * 3 AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
        / sum(w) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w),
t AS (SELECT source, source_size, coalesce(least(cap::DOUBLE, (SELECT max(lev) FROM l WHERE cap / w >= lev) * w), 0.0) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS INTEGER) ELSE 0 END AS whole FROM t),
r AS (SELECT u.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS lft FROM u JOIN p ON u.source IS NOT DISTINCT FROM p.source),
z AS (SELECT source, size, max(lft) AS lft, count(*) * size AS words, count(*) * size::HUGEINT * size AS sq FROM r WHERE lft > 0 AND size > 0 GROUP BY source, size),
g AS (SELECT source, size, (lft - coalesce(sum(words) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS room,
        sum(sq) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS squares FROM z),
y AS (SELECT source, max(size) AS most, arg_max(room / squares, size) AS slope, arg_max(room, size) AS room FROM g WHERE room / squares * size < 1 GROUP BY source),
q AS (SELECT r.*, y.most, y.room, CASE WHEN size > 0 AND size <= y.most THEN (u / (1 - u)) / ((slope * size) / (1 - slope * size)) END AS rank
      FROM r LEFT JOIN y ON r.source IS NOT DISTINCT FROM y.source),
c AS (SELECT *, CASE WHEN rank IS NOT NULL THEN sum(size) OVER (PARTITION BY source, rank IS NULL ORDER BY rank, k RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS upto FROM q),
b AS (SELECT source, coalesce(max(CASE WHEN upto <= room THEN upto END), 0) AS words FROM c WHERE rank IS NOT NULL GROUP BY source),
m AS (SELECT c.source, arg_min(c.k, {'a': abs(size - (room - words)), 'r': rank, 'k': k}) AS rk
      FROM c JOIN b ON c.source IS NOT DISTINCT FROM b.source
      WHERE upto > room AND abs(size - (room - words)) < room - words GROUP BY c.source)
SELECT c.doc_id, c.size::BIGINT AS size, c.source_size, c.target,
       (c.size * (c.whole + CASE WHEN c.size > 0 AND (c.size > c.most OR c.upto <= c.room OR (c.rank IS NOT NULL AND c.k = coalesce(m.rk, ''))) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c LEFT JOIN m ON c.source IS NOT DISTINCT FROM m.source
"""
