"""What screens and exports read: a day's state, communities, graphs, documents; and the updates that go back."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpie.functions.text import folded
from kelpie.operators import graph, merge, selection

#: The most rows of a reduced model that go to every executor, and the most numbers in them.
MOST_MODEL_ROWS, MOST_MODEL_VALUES = 16_384, 1 << 25


def read_sorted(rows: DataFrame, order: list[str], deleted: str | None = None, with_deleted: bool = False, **natural_key: object) -> DataFrame:
    """Rows by their natural key (all, where none is given) in order; deleted ones only if asked for."""
    kept = rows.filter(selection.optional(**natural_key))
    return (kept if deleted is None or with_deleted else kept.filter(F.col(deleted).isNull())).orderBy(*order)


def day_state(activities: DataFrame, shots: DataFrame, overviews: DataFrame, tags: DataFrame, day: str) -> DataFrame:
    """The day's activities with their shots (a row each, one without shots for none), overview and tag."""
    of_day = activities.filter(selection.on_day("start_time", day))
    return of_day.join(shots, "activity_id", "left").join(overviews, "overview_id", "left").join(tags, "tag_id", "left")


def nested(parents: DataFrame, children: DataFrame, grandchildren: DataFrame, order: list[Column], most: int = 3) -> DataFrame:
    """parent_id and its document: for each of the first `most` children its name and the first `most` grandchildren, in order. Tables:
    (parent_id, name), (parent_id, child_id, name), (child_id, grandchild_id, name) and whatever `order` reads in each."""
    first = lambda rows, key: _ranked(rows, key, order).filter(F.col("__rn") <= most)
    listed = lambda *c: F.array_sort(F.collect_list(F.struct("__rn", *c)))
    inner = first(grandchildren, "child_id").groupBy("child_id").agg(F.transform(listed("name"), lambda x: F.struct(x["name"].alias("name"))).alias("items"))
    kids = first(children, "parent_id").join(inner, "child_id", "left").withColumn("items", F.coalesce("items", F.array().cast("array<struct<name:string>>")))
    outer = kids.groupBy("parent_id").agg(F.transform(listed("name", "items"), lambda x: F.struct(x["name"].alias("name"), x["items"].alias("items"))).alias("children"))
    none = F.array().cast("array<struct<name:string,items:array<struct<name:string>>>>")
    whole = parents.select("parent_id", "name").join(outer, "parent_id", "left").withColumn("children", F.coalesce("children", none))
    return whole.select("parent_id", F.to_json(F.struct("name", "children")).alias("document"))


def _ranked(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def community_payload(nodes: DataFrame, edges: DataFrame, claims: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows (community_id, node_id, kind, value, other_id, other_community) of all that a community's page holds: its members, their
    claims and sources, and links out and in with the other end. Flat rows, so a node with very many links stays spread."""
    member = nodes.select("community_id", "node_id", "name")
    row = lambda rows, kind, value, other=None, far=None: rows.select("community_id", "node_id", F.lit(kind).alias("kind"), value.alias("value"), (other if other is not None else F.lit(None).cast("long")).alias("other_id"), (far if far is not None else F.lit(None).cast("long")).alias("other_community"))
    far = nodes.select(F.col("node_id").alias("other_id"), F.col("community_id").alias("other_community"))
    parts = [row(member, "member", F.col("name")), row(member.join(claims, "node_id"), "claim", F.col("text")), row(member.join(sources, "node_id"), "source", F.col("path"))]
    for kind, near, other in (("link_out", "first_id", "second_id"), ("link_in", "second_id", "first_id")):
        ends = edges.select(F.col(near).alias("node_id"), F.col(other).alias("other_id"), F.col("type"))
        parts.append(row(member.join(ends, "node_id").join(far, "other_id"), kind, F.col("type"), F.col("other_id"), F.col("other_community")))
    return reduce(DataFrame.unionByName, parts)


def graph_view(nodes: dict[str, DataFrame], links: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Nodes (kind, id, label, rank, degree) and links (kind, source, target, weight) of a drawing. Nodes come as (id, label, rank) and keep
    the least rank of their repeats; links as (source, target, weight) between ids that carry their kind, both ends shown."""
    shown = reduce(DataFrame.unionByName, (f.select(F.lit(k).alias("kind"), F.concat(F.lit(f"{k}_"), F.col("id").cast("string")).alias("id"), "label", F.col("rank").cast("double").alias("rank")) for k, f in nodes.items()))
    once = shown.groupBy("kind", "id").agg(F.min("label").alias("label"), F.min("rank").alias("rank"))
    drawn = reduce(DataFrame.unionByName, (f.select(F.lit(k).alias("kind"), "source", "target", F.col("weight").cast("double").alias("weight")) for k, f in links.items()))
    kept = drawn.groupBy("kind", "source", "target").agg(F.sum("weight").alias("weight"))
    for end in ("source", "target"):
        kept = kept.join(once.select(F.col("id").alias(end)), end, "left_semi")
    degree = graph.degrees(kept.filter("source <> target").select(F.col("source").alias("first_id"), F.col("target").alias("second_id"), "weight"))
    degree = degree.select(F.col(degree.columns[0]).alias("id"), F.col(degree.columns[1]).alias("degree"))
    return once.join(degree, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0.0))), kept.select("kind", "source", "target", "weight")


def links_of(links: DataFrame, selected: object, visible: DataFrame | None = None) -> DataFrame:
    """The links at the selected node, and of those only between visible nodes if some are given; none without a selection."""
    at = links.filter(F.lit(False) if selected is None else (F.col("source") == F.lit(selected)) | (F.col("target") == F.lit(selected)))
    for end in ("source", "target") if visible is not None else ():
        at = at.join(visible.select(F.col("id").alias(end)).distinct(), end, "left_semi")
    return at.select(*links.columns)


def refresh_snapshot(activities: DataFrame, runs: DataFrame, candidates: DataFrame, memberships: DataFrame, tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The activities that have a summary and a vector, and the latest run's candidates with their tag and members, a row for each member."""
    ready = activities.filter("summary_vector is not null and summary <> ''")
    last = runs.orderBy(F.desc("created_at"), F.desc("run_id")).limit(1).select("run_id")
    return ready, candidates.join(last, "run_id", "left_semi").join(tags, "tag_id", "left").join(memberships, "candidate_id", "left")


def entities_once(mentions: DataFrame, id_col: str, kind: str, text: str, place: str) -> DataFrame:
    """Mentions without blank ones and repeats of kind and folded text in a row; the first stays."""
    said = mentions.withColumn(text, F.trim(F.regexp_replace(text, r"\s+", " "))).filter(F.col(text) != "")
    return merge.latest(said.withColumn("__folded", folded(F.col(text))), [id_col, kind, "__folded"], [F.col(place)]).drop("__folded")


def updated_columns(rows: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with single columns set: of updates (key, column, value as text, at) the latest of a column counts, a null value clears it."""
    set_ = [F.max_by(F.struct("value"), F.when(F.col("column") == c, F.struct("at", "value"))).alias(f"__{c}") for c in columns]
    joined = rows.join(updates.filter(F.col("column").isin(columns)).groupBy(key).agg(*set_), key, "left")
    given = {c: F.when(F.col(f"__{c}").isNotNull(), F.col(f"__{c}")["value"].cast(rows.schema[c].dataType)).otherwise(F.col(c)) for c in columns}
    return joined.withColumns(given).select(*rows.columns)


def synchronised(index: DataFrame, rows: DataFrame, changes: DataFrame, key: str, after: Column) -> DataFrame:
    """An index brought up to date: of the keys changed since, what rows still has goes in, and what it hasn't goes out."""
    dirty = changes.filter(F.col("at") > after).select(key).distinct()
    return index.join(dirty, key, "left_anti").unionByName(rows.join(dirty, key, "left_semi").select(*index.columns))


def deleted_below(chain: list[tuple[DataFrame, str, str]], gone: DataFrame) -> list[DataFrame]:
    """Each table of a chain (rows, their id, their parent's id) without what hangs on the ids gone, level by level. A row that goes by its
    parent's id is met with the ids gone once; other tables meet the ids that they lose, each once."""
    left = []
    for rows, key, parent in chain:
        above = gone.select(F.col(gone.columns[0]).alias(parent)).distinct()
        gone = rows.join(above, parent, "left_semi").select(key).distinct()
        left.append(rows.join(above if key == parent else gone, key, "left_anti").select(*rows.columns))
    return left


def written_back(rows: DataFrame, reduced: DataFrame, key: str, column: str) -> DataFrame:
    """Rows with the column from the batch; null where the batch has no row."""
    return rows.drop(column).join(reduced.select(key, column), key, "left").select(*rows.columns)


def changed_documents(rows: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """key, document and hash of the rows whose JSON differs from the known hash of the key, or that aren't known."""
    columns = [c for c in rows.columns if c != key]
    made = rows.select(key, F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("document")).withColumn("hash", F.sha2("document", 256))
    return made.join(known.select(key, "hash"), [key, "hash"], "left_anti").select(key, "document", "hash")


def reduced_by_model(rows: DataFrame, model: DataFrame, id_col: str, vec_col: str, k: int = 15, temperature: float = 0.05) -> DataFrame:
    """id and the reduced vector: the mean of the reduced vectors of the k most alike model rows (vector, reduced), weighed by the softmax of
    their cosines over the temperature; equal cosines go by id. Vectors that are null or of another size give null.

    The model is a fitted sample, bounded by MOST_MODEL_ROWS rows and MOST_MODEL_VALUES numbers (more are refused); it goes whole to
    every executor, and the rows stay where they are.
    """
    sizes = model.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("vector") + F.size("reduced")), F.lit(0)).alias("values")).first()
    if sizes["n"] > MOST_MODEL_ROWS or sizes["values"] > MOST_MODEL_VALUES:
        raise ValueError(f"a model of at most {MOST_MODEL_ROWS} rows and {MOST_MODEL_VALUES} numbers, not {sizes['n']} and {sizes['values']}")
    kept = model.select("id", "vector", "reduced").orderBy("id").toPandas()
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    stack = lambda name: np.stack(kept[name].to_list()).astype(np.float64) if len(kept) else np.zeros((0, 0))
    shared = rows.sparkSession.sparkContext.broadcast((unit(stack("vector")), stack("reduced")))

    @F.pandas_udf("array<double>")
    def reduce_(vectors: pd.Series) -> pd.Series:
        base, low = shared.value
        out = pd.Series([None] * len(vectors), index=vectors.index, dtype=object)
        fit = [i for i, v in enumerate(vectors) if v is not None and len(base) and len(v) == base.shape[1] and np.isfinite(np.asarray(v, dtype=np.float64)).all()]
        for at in range(0, len(fit), 256):
            some = fit[at : at + 256]
            alike = np.clip(unit(np.stack([vectors.iloc[i] for i in some]).astype(np.float64)) @ base.T, -1, 1)
            best = np.argsort(-alike, axis=1, kind="stable")[:, :k]
            near = np.take_along_axis(alike, best, axis=1) / temperature
            weight = np.exp(near - near.max(axis=1, keepdims=True))
            mean = ((weight / weight.sum(axis=1, keepdims=True))[:, :, None] * low[best]).sum(axis=1)
            for i, m in zip(some, mean, strict=True):
                out.iloc[i] = m.tolist()
        return out

    return rows.select(F.col(id_col).alias("id"), reduce_(F.col(vec_col)).alias("reduced"))
