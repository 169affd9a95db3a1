"""A training corpus from documents: toxic documents go, then those in no known language, then near copies; what stays is mixed
by source and packed into sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. Cases are those of the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.llm import langid, mixing, neardup, packing, toxicity
from kelpie.llm.common import apart, documents, stored
from kelpie.llm.queries import tokenizer_path


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that aren't predicted to be toxic."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.scored(apart(docs, text=F.col("text")), model).filter("toxicity.predicted = 0").select("row.*")


def in_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in a language that the corpus declares, by text, declared language and source."""
    model = langid.train_text(docs)
    rows = apart(docs, text=F.col("text"), lang=F.col("lang"), source=F.col("source"))
    found = langid.identify(rows, model, F.col("text"), F.col("lang"), F.lit(None).cast("string"), F.col("source"))
    return found.filter(langid.accepted()).select("row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id."""
    return neardup.without_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them."""
    return mixing.repeated(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids and their places in sequences."""
    return packing.pack(docs, tokenizer_path(), 1024).drop("ids")


STAGES = [
    ("toxicity", clean),
    ("language_id", in_known_language),
    ("near_dedup", one_of_each_group),
    ("mixing", mixed),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The stages' models aren't expressible in SQL; tests compare each stage with a plain version.
ORACLE_SQL = None
