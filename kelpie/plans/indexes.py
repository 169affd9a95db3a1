"""Text indexes of tables, kept beside the checkpoints: built by the first query that asks, used by all later ones."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.functions.stemming import stem, stems_sql
from kelpie.operators.neighbours import VectorIndex
from kelpie.operators.textindex import TextIndex
from kelpie.plans.storage import shared_root

#: What is indexed: the table, its id, and the rows.
CONTENTS = {
    "documents": ("documents", "doc_id", "true"),
    "turns": ("conversations", "conv_id * 1000 + turn", "true"),
    "openings": ("conversations", "conv_id", "turn = 0"),
    "benchmark": ("benchmark", "item_id", "true"),
}


def version_of(rows: DataFrame) -> str:
    """A hash of the names, sizes and times of the files that the rows are read from; no column is read."""
    files = rows.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    found = files.agg(F.count("*"), F.bit_xor(F.xxhash64("file_path", "file_size", "file_modification_time"))).first()
    return hashlib.md5(f"{found[0]} {found[1]}".encode()).hexdigest()


def kept_index(spark: SparkSession, sf_dir: str, name: str) -> TextIndex:
    """The index of one of CONTENTS for the table's files as they are now."""
    source, key, rows = CONTENTS[name]
    docs = spark.read.parquet(f"{sf_dir}/{source}.parquet")
    index = TextIndex(spark, f"{shared_root(spark)}/text-index-{name}-{version_of(docs)}")
    if not index.exists():
        index.build(docs.filter(rows).select(F.expr(key).alias("id"), "text"), "id", F.col("text"))
    return index


def kept_vectors(spark: SparkSession, sf_dir: str) -> VectorIndex:
    """The index of the embeddings for the table's files as they are now."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    index = VectorIndex(spark, f"{shared_root(spark)}/vector-index-{version_of(vectors)}")
    if not index.exists():
        index.build(vectors, "vec_id", "embedding")
    return index


def _terms_sql(text: str = "text") -> str:
    lowered = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"list_filter(regexp_split_to_array({lowered}, '[^a-z0-9\x{{80}}-\x{{10FFFF}}]+'), lambda t: t <> '')"


def rows_sql(name: str) -> str:
    source, key, rows = CONTENTS[name]
    return f"SELECT {key} AS id, text FROM {source} WHERE {rows}"


def postings_sql(*names: str) -> str:
    """CTEs t_NAME (id, t: terms), stems (term, stem) and p_NAME (id, stem, pos) for each of the contents."""
    terms = [f"t_{n} AS (SELECT id, {_terms_sql()} AS t FROM ({rows_sql(n)}))" for n in names]
    vocabulary = stems_sql(" UNION ALL ".join(f"SELECT unnest(t) AS term FROM t_{n}" for n in names))
    each = [f"p_{n} AS (SELECT id, stem, pos FROM (SELECT id, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM t_{n}) JOIN stems USING (term))" for n in names]
    return ", ".join([*terms, vocabulary, *each])


def ranked_sql(name: str, words: list[str] | str, hits: str | None = None, digits: int = 7) -> str:
    """CTEs after postings_sql, the last of which is h_NAME: id and rank of the rows with a word's stem; words, or SQL for stems."""
    hits = hits or name
    asked = words if isinstance(words, str) else ", ".join(f"'{stem(w)}'" for w in words)
    score = "greatest(ln((rows - d + 0.5) / (d + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / mean))"
    return f"""f_{hits} AS (SELECT id, stem, count(*) AS f FROM p_{name} WHERE stem IN ({asked}) GROUP BY ALL), d_{hits} AS (SELECT stem, count(*) AS d FROM f_{hits} GROUP BY 1),
s_{hits} AS (SELECT count(*) AS rows, avg(len(t)) AS mean FROM t_{name}), n_{hits} AS (SELECT id, len(t) AS n FROM t_{name}),
h_{hits} AS (SELECT id, round(-sum({score}), {digits}) AS rank FROM f_{hits} JOIN d_{hits} USING (stem) JOIN n_{hits} USING (id), s_{hits} GROUP BY id)"""
