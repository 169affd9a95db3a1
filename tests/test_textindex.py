"""Stems against the published algorithm's examples, and the stored index against counting."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kelpie.functions import stemming
from kelpie.functions.stemming import stem, stemmed
from kelpie.operators import search, textindex
from kelpie.operators.textindex import TextIndex, analysed, terms_of, unpacked

#: Words and stems from the description of the algorithm.
STEMS = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing
conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi
sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic
differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis
hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal
electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop
adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog
communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas
controll control roll roll generalizations gener oscillators oscil""".split()


def test_stems(spark):
    pairs = list(zip(STEMS[::2], STEMS[1::2], strict=True))
    assert [(w, stem(w)) for w, _ in pairs] == pairs
    assert [stem(w) for w in ("", "is", "as", "море", "x" * 70 + "ing", "été")] == ["", "is", "as", "море", "x" * 70 + "ing", "été"]
    frame = spark.createDataFrame([(w,) for w, _ in pairs] + [(None,), ("cats",)], "w string")
    assert [r["s"] for r in frame.select(stemmed("w").alias("s")).collect()] == [*(s for _, s in pairs), None, "cat"]


def plain_ranks(rows: dict[int, str], words: list[str]) -> dict[int, float]:
    asked, counts = dict.fromkeys(t for w in words for t in terms_of(w)), {k: Counter(terms_of(t or "")) for k, t in rows.items()}
    mean = sum(sum(c.values()) for c in counts.values()) / len(counts)
    ranks: dict[int, float] = {}
    for w in asked:
        d = sum(w in c for c in counts.values())
        for k, c in counts.items():
            if w in c:
                idf = max(math.log((len(counts) - d + 0.5) / (d + 0.5)), 1e-6)
                ranks[k] = ranks.get(k, 0) - idf * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean))
    return ranks


def frame_of(spark, rows):
    return spark.createDataFrame(list(rows.items()), "id long, text string")


ROWS = {k: f"{'Quarterly invoices' if k % 3 else 'An invoice'} were approved, {'billing ' * (k % 5)}exports of été {k % 7}" for k in range(60)} | {90: None, 91: "", 92: "..!"}


def found(index, words):
    return {r["id"]: r["rank"] for r in index.ranked(words).collect()}


def test_ranks_equal_counting_after_build_updates_and_compaction(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "a"), shards=4, salts=2)
    assert not index.exists()
    index.build(frame_of(spark, ROWS), "id", F.col("text"))
    assert index.exists()
    assert index.size() == (len(ROWS), sum(len(terms_of(t or "")) for t in ROWS.values()))
    for words in (["invoice", "exporting"], ["Approve"], ["billing", "été", "billings"], ["nowhere"]):
        assert found(index, words) == pytest.approx(plain_ranks(ROWS, words))
    assert found(index, []) == found(index, ["..", ""]) == {}

    rows = {k: t for k, t in ROWS.items() if k % 10 != 1 or k > 60} | {2: "invoices invoiced", 100: "a new approval", 90: "billing"}
    dirty = spark.createDataFrame([(k,) for k in [*range(1, 60, 10), 2, 100, 90, 2, None]], "id long")
    index.update(dirty, frame_of(spark, rows), "id", F.col("text"))
    assert index.size() == (len(rows), sum(len(terms_of(t or "")) for t in rows.values()))
    for words in (["invoice", "exporting"], ["approval", "billing"]):
        assert found(index, words) == pytest.approx(plain_ranks(rows, words))
    # the new generation holds the dirty rows' postings alone, and nothing older is written anew
    new = spark.read.parquet(f"{index.path}/postings/gen=1").filter("term is not null").select(F.explode("ids").alias("id")).distinct()
    assert {r["id"] for r in new.collect()} == {2, 100, 90}

    # the same ids again change nothing but the generation
    before = found(index, ["invoice", "approval"])
    index.update(dirty, frame_of(spark, rows), "id", F.col("text"))
    assert found(index, ["invoice", "approval"]) == before
    assert index.last() == 2
    # an update that broke off before its sums doesn't count, and is made good by the next
    frame_of(spark, {5: "invoice " * 9}).select("id").write.parquet(f"{index.path}/gone/gen=3")
    assert found(index, ["invoice", "approval"]) == before
    rows[7] = "approvals approve"
    index.update(spark.createDataFrame([(7,)], "id long"), frame_of(spark, rows), "id", F.col("text"))
    assert found(index, ["invoice", "approval"]) == pytest.approx(plain_ranks(rows, ["invoice", "approval"]))
    merged = index.compact(str(tmp_path / "b"))
    assert merged.size() == index.size()
    assert merged.last() == 0
    assert found(merged, ["invoice", "approval"]) == pytest.approx(plain_ranks(rows, ["invoice", "approval"]))


def test_only_the_shards_asked_are_read(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "a"), shards=8).build(frame_of(spark, ROWS), "id", F.col("text"))
    plan = index.postings(["invoic"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "shard" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "In(term" in plan or "EqualTo(term" in plan


def test_phrases_equal_looking(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "a"), shards=4).build(frame_of(spark, ROWS), "id", F.col("text"))
    phrases = ["quarterly invoice", "export of été", "billing billing", "approve of", "", "invoice"]
    plain = {}
    for k, text in ROWS.items():
        held = f" {' '.join(terms_of(text or ''))} "
        n = sum(f" {' '.join(terms_of(p))} " in held for p in phrases if p)
        if n:
            plain[k] = n
    assert {r["id"]: r["phrases"] for r in index.phrases(phrases).collect()} == plain
    assert index.phrases([]).collect() == index.phrases(["", "..."]).collect() == []


def test_searches_without_words_give_no_rows(spark):
    docs = frame_of(spark, ROWS)
    assert search.bm25(docs, "id", F.col("text"), []).collect() == []
    assert search.phrase_hits(docs, "id", F.col("text"), [" "]).collect() == []


def test_expansion_takes_stems_of_the_first_hits(spark, tmp_path):
    rows = {1: "billing exports exports approvals", 2: "approval of quarterly things", 3: "exporting", 4: "unrelated"}
    docs = frame_of(spark, rows)
    index = TextIndex(spark, str(tmp_path / "a"), shards=2).build(docs, "id", F.col("text"))
    seen = [(r["id"], r["pass"]) for r in search.expanded(index, docs, "id", F.col("text"), ["billing"], [], 5).collect()]
    assert sorted(seen) == [(1, 0), (2, 1), (3, 1)]
    assert search.expanded(index, docs, "id", F.col("text"), ["nowhere"], [], 5).collect() == []


def test_packed_postings_hold_each_place_once(spark):
    want = {(k, t, tuple(p for p, x in enumerate(terms_of(text)) if x == t), len(terms_of(text))) for k, text in ROWS.items() if text for t in terms_of(text)}
    for at_once in (1, 25, 1 << 19):
        packed = analysed(frame_of(spark, ROWS).repartition(2), "id", F.col("text"), at_once)
        got = [(r["id"], r["term"], tuple(r["places"]), r["n"]) for r in unpacked(packed.filter("term is not null")).collect()]
        assert len(got) == len(want) and set(got) == want
        rows = packed.filter("term is null").select(F.explode(F.arrays_zip("ids", "ns")).alias("x")).select("x.*").collect()
        assert {r["ids"]: r["ns"] for r in rows} == {k: len(terms_of(t or "")) for k, t in ROWS.items()}


def test_phrases_send_postings_and_not_places(spark, tmp_path):
    """What is shuffled is a row a posting, not a row a place."""
    index = TextIndex(spark, str(tmp_path / "x")).build(spark.createDataFrame([(1, "of the " * 50), (2, "the of")], "id long, text string"), "id", F.col("text"))
    found = index.phrases(["of the", "the of", "the the"])
    assert {r["id"]: r["phrases"] for r in found.collect()} == {1: 2, 2: 1}
    assert found._jdf.queryExecution().executedPlan().toString().lower().count("explode(places") == 0


def test_building_shuffles_no_postings(spark, tmp_path):
    """A task writes the postings of the texts it reads itself, each shard's in one file, by term; ranking and counting read no places."""
    index = TextIndex(spark, str(tmp_path / "x"), shards=4).build(frame_of(spark, ROWS).repartition(3), "id", F.col("text"))
    files = index._read("postings", "term string, ids array<long>, gen int, shard int").filter("shard >= 0").select("shard", F.input_file_name().alias("f"), F.explode("ids").alias("id"))
    writers = files.select("id", F.regexp_extract("f", r"part-(\d+)", 1).alias("task")).groupBy("id").agg(F.count_distinct("task").alias("n"))
    assert {r["n"] for r in writers.collect()} == {1}
    for found in (index.ranked(["invoice", "billing"]), index.counts()):
        assert "places" not in found._jdf.queryExecution().executedPlan().toString()
    want = {(k, t): c for k, text in ROWS.items() for t, c in Counter(terms_of(text or "")).items()}
    assert {(r["id"], r["term"]): r["c"] for r in index.counts().collect()} == want


def test_a_worker_packs_a_bounded_number_of_words(spark):
    """As long as no single text is longer, a pack has about a million words, however many a task reads."""
    docs = spark.range(1100).coalesce(1).select("id", F.repeat(F.lit("of the "), 500).alias("text"))
    packs = analysed(docs, "id", F.col("text")).filter("term is null").select(F.aggregate("ns", F.lit(0).cast("long"), lambda s, n: s + n).alias("words")).collect()
    assert sum(r["words"] for r in packs) == 1_100_000
    assert max(r["words"] for r in packs) < (1 << 20) + 1000


def test_terms_are_told_apart_at_once():
    """All terms of many texts in one pass, as the pattern finds them one by one; a word that no rule changes isn't worked out."""
    draw = random.Random(5)
    texts = [bytes(draw.choices(b"aZ9 .\x00\xc3\xa9\n", k=draw.randint(0, 40))) for _ in range(300)]
    ns, found = textindex._words([t.translate(textindex._AS_TERMS) for t in texts])
    want = [textindex._TERM.findall(t.lower()) for t in texts]
    assert ns.tolist() == [len(w) for w in want]
    assert found.to_pylist() == [x for w in want for x in w]
    assert textindex._words([b"", b" "])[0].tolist() == [0, 0]
    before = stemming._stem.cache_info()
    assert [stem(w) for w in ("panda", "x9", "море", "")] == ["panda", "x9", "море", ""]
    assert stemming._stem.cache_info() == before


def test_counting_all_postings_is_compiled(spark, tmp_path):
    """No lambda for each posting: these aren't compiled."""
    index = TextIndex(spark, str(tmp_path / "x"), shards=2).build(frame_of(spark, ROWS), "id", F.col("text"))
    assert "lambda" not in index.counts()._jdf.queryExecution().executedPlan().toString()
