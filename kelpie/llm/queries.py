"""The operators as queries over the tables of a folder, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.llm import ann, fim, hmm, langid, media, mixing, neardup, packing, resampling, sharding, token_counts, toxicity, vectorjoin
from kelpie.llm.common import documents

SHARDS = [f"shard-{k:04d}" for k in range(64)]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(documents(spark, sf_dir), tokenizer_path(), 1024)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = media.features(media.store(documents(spark, sf_dir)))
    first = F.transform(F.slice("keyframes", 1, 1), lambda k: F.format_string("%d-%d", k["first"], k["last"]))
    last = F.transform(F.slice("keyframes", -1, 1), lambda k: F.format_string("%d-%d", k["first"], k["last"]))
    feature = F.concat_ws(";", F.concat(F.lit("codec="), F.trim("codec")), F.format_string("duration=%d/%d", "duration", "timescale"), F.format_string("samples=%d", "n_samples"), F.format_string("keyframes=%d", "n_keyframes"), F.concat_ws("..", first, last))
    return seen.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), tokenizer_path())


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    c = langid.page_columns(pages)
    found = langid.identify(pages, langid.train_text(documents(spark, sf_dir)), c["text"], c["declared"], c["suffix"], c["host"])
    return found.select("page_id", "declared", "text_language", "language", "posterior", langid.accepted().alias("accepted"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.scored(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "toxicity.score", "toxicity.predicted", F.size("toxicity.passages").alias("n_passages"), "toxicity.passages")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    placed = sharding.place(docs, F.col("doc_id"), F.col("text"), SHARDS)
    return placed.select("doc_id", "slot", "shard", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.search(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5).select("query_id", "rank", "vec_id", "score")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(documents(spark, sf_dir)).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorjoin.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return resampling.resample(documents(spark, sf_dir), target).select("doc_id", "n_features", "weight", "score", "rank")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    listed = (op1_packing, op2_media_columns, op3_token_counts, op4_language_id, op5_mixing, op6_near_dedup, op7_toxicity, op8_sharding, op9_nearest_neighbours, op10_lm_scoring, op11_embedding_near_dedup, op12_resampling, op13_fill_in_middle)
    return {f.__name__: f for f in listed}


def oracle_sql() -> dict[str, str]:
    return {"op5_mixing": mixing.MIX_SQL, "op6_near_dedup": neardup.NEAR_SQL, "op11_embedding_near_dedup": vectorjoin.VECTOR_SQL, "op12_resampling": resampling.RESAMPLE_SQL, "op13_fill_in_middle": fim.FIM_SQL}
