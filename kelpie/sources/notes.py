"""Notes out of tables: pages and communities as markdown files, stale files, vectors as matrices of bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpie.functions.parsing import spaced, stripped
from kelpie.functions.text import file_name


def page_notes(pages: DataFrame) -> DataFrame:
    """file and text of captured pages (title, url, markdown, captured_at): named by time and a slug of the first eight words, else of the
    title, else of the last part of the address; the front matter says where it comes from."""
    words = F.array_join(F.slice(F.filter(F.split(spaced(F.regexp_replace(F.coalesce("markdown", F.lit("")), r"[#*_`>\[\]()-]+", " ")), " "), lambda w: w != ""), 1, 8), " ")
    last = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-z]+://[^/?#]+/(?:[^?#]*/)?([^/?#]+)/?(?:[?#]|$)", 1)
    source = F.coalesce(*(F.nullif(x, F.lit("")) for x in (words, stripped(F.col("title")), last)), F.lit("page"))
    parts = F.filter(F.split(F.regexp_replace(F.lower(source), r"[^\p{L}\p{N}]", "-"), "-"), lambda x: x != "")
    slug = F.coalesce(F.nullif(F.array_join(F.slice(parts, 1, 10), "-"), F.lit("")), F.lit("page"))
    file = F.concat(F.date_format("captured_at", "yyyy-MM-dd-HHmmss"), F.lit("-"), slug, F.lit(".md"))
    quoted = lambda name, value: F.concat(F.lit(f'{name}: "'), F.translate(value, '"\n', "' "), F.lit('"'))
    head = F.concat_ws("\n", F.lit("---"), quoted("title", F.coalesce("title", slug)), quoted("source_url", F.col("url")), quoted("captured_at", F.date_format("captured_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")), F.lit("---"), F.lit(""), stripped(F.coalesce("markdown", F.lit(""))), F.lit(""))
    return pages.select("page_id", file.alias("file"), head.alias("text"))


def community_file(community_id: Column, name: Column) -> Column:
    """The file of a community: its safe name, else its number."""
    safe = F.nullif(file_name(F.coalesce(name, F.lit(""))), F.lit(""))
    return F.concat(F.coalesce(safe, F.concat(F.lit("Community "), community_id.cast("string"))), F.lit(".md"))


def community_notes(communities: DataFrame, members: DataFrame, links: DataFrame, sources: DataFrame) -> DataFrame:
    """Lines (file, member, part, place, line) of one note for each community, to be ordered so: title and summary, then each member with
    its description, relationships and source notes. A note stays lines, so that no task has to hold a whole one.

    communities (community_id, name, summary), members (community_id, node_id, name, description), links (node_id, target_id, type), sources
    (node_id, path).
    """
    title = F.coalesce(F.nullif(stripped(F.col("name")), F.lit("")), F.concat(F.lit("Community "), F.col("community_id").cast("string")))
    summary = F.coalesce(F.nullif(stripped(F.col("summary")), F.lit("")), F.lit("No community summary yet."))
    named = communities.select("community_id", community_file(F.col("community_id"), F.col("name")).alias("file"), title.alias("title"), summary.alias("summary"))
    lines = lambda rows, part, *values: rows.select("file", "node_id", F.lit(part).alias("part"), F.posexplode(F.array(*values)).alias("place", "line"))
    of = members.join(named.select("community_id", "file"), "community_id").withColumnRenamed("name", "member_name")
    anchor = lambda c: F.concat(F.lit("node-"), c.cast("string"))
    about = F.coalesce(F.nullif(stripped(F.col("description")), F.lit("")), F.lit("No description yet."))
    top = lines(named.withColumn("node_id", F.lit(None).cast("long")), 0, F.concat(F.lit("# "), F.col("title")), F.col("summary"), F.lit("## Members"))
    each = lines(of, 1, F.concat(F.lit('<a id="'), anchor(F.col("node_id")), F.lit('"></a>')), F.concat(F.lit("### "), F.col("member_name")), about)
    target = of.select(F.col("node_id").alias("target_id"), F.col("member_name").alias("target_name"), F.col("file").alias("target_file"))
    joined = of.join(links, "node_id").join(target, "target_id")
    label = F.when(F.coalesce(F.trim("type"), F.lit("")) != "", F.concat_ws(" ", "member_name", F.trim("type"), "target_name")).otherwise(F.col("target_name"))
    place = F.concat(F.when(F.col("target_file") != F.col("file"), F.col("target_file")).otherwise(""), F.lit("#"), anchor(F.col("target_id")))
    item = lambda label, to: F.concat(F.lit("- ["), label, F.lit("](<"), to, F.lit(">)"))
    out = lambda rows, part, line: rows.select("file", "node_id", F.lit(part).alias("part"), F.lit(0).alias("place"), line.alias("line"))
    from_ = of.join(sources, "node_id")
    heads = [out(rows.select("file", "node_id").distinct(), part, F.lit(f"#### {head}")) for rows, part, head in ((joined, 2, "Relationships"), (from_, 4, "Source Notes"))]
    rest = [out(joined, 3, item(label, place)), out(from_, 5, item(F.col("path"), F.concat(F.lit("../"), F.col("path"))))]
    whole = top
    for part in (each, *heads, *rest):
        whole = whole.unionByName(part)
    return whole.withColumnRenamed("node_id", "member")


def write_notes(lines: DataFrame, folder: str) -> None:
    """Lines as text, a folder for each file: of a file that is written again nothing old stays, others are left alone. A large note is
    dealt to several tasks by range, and its parts keep the order."""
    ordered = lines.repartitionByRange("file", "member", "part", "place", "line").sortWithinPartitions("file", "member", "part", "place", "line")
    ordered.select("file", "line").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file").text(folder)


def stale(known: DataFrame, lines: DataFrame) -> DataFrame:
    """The known files that no note has any more."""
    return known.select("file").distinct().join(lines.select("file").distinct(), "file", "left_anti")


def matrices(vectors: DataFrame, id_col: str, vec_col: str, dimensions: int, block: int = 4096) -> DataFrame:
    """first_id, ids and data: vectors as float32 (little end first) in rows of one matrix for each block of at most `block` rows, by id. A
    vector of another size, or null, stops the job."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("v")).repartitionByRange("id").sortWithinPartitions("id")

    def stacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), block):
                part = batch.iloc[at : at + block]
                wrong = [i for i, v in zip(part["id"], part["v"], strict=True) if v is None or len(v) != dimensions]
                if wrong:
                    raise ValueError(f"not of {dimensions} numbers: {wrong[:5]}")
                data = np.stack(part["v"].to_list()).astype("<f4").tobytes()
                yield pd.DataFrame({"first_id": [part["id"].iloc[0]], "ids": [part["id"].to_numpy()], "data": [data]})

    return rows.mapInPandas(stacked, "first_id long, ids array<long>, data binary")
