"""Each stage on its own input, and the whole on a small folder."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from kelpie.llm import toxicity
from kelpie.llm.encoder import encoder
from kelpie.llm.queries import tokenizer_path

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = corpus_pipeline.documents(spark, FOLDER)
    model = toxicity.train(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        columns = docs.columns
        docs = corpus_pipeline.stored(stage(spark, docs, FOLDER), name)
        after = docs.collect()
        if name == "toxicity":
            bad = {r[0] for r in toxicity.scored(spark.createDataFrame(list(before.items()), "doc_id long, text string"), model).filter("toxicity.predicted = 1").select("doc_id").collect()}
            assert {r["doc_id"] for r in after} == before.keys() - bad
        if name == "language_id":
            assert {r["doc_id"] for r in after} == before.keys()
        if name == "near_dedup":
            from tests.llm.test_operators import jaccard_components

            assert {r["doc_id"] for r in after} == {i for i, (_, c) in jaccard_components(list(before.items())).items() if i == c}
        if name == "mixing":
            assert set(Counter(r["doc_id"] for r in after).values()) <= {1, 2, 3}
        if name != "packing":
            assert docs.columns == columns and all(before[r["doc_id"]] == r["text"] for r in after)
            last = Counter(r["doc_id"] for r in after)
            texts = {r["doc_id"]: r["text"] for r in after}
        else:
            sizes = {i: len(encoder(tokenizer_path()).encode(t)) + 1 for i, t in texts.items()}
            assert docs.agg(F.sum("length")).first()[0] == sum(sizes[i] * n for i, n in last.items())
