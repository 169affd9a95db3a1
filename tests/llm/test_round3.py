"""The embedding join, resampling and fill-in-middle against plain versions."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpie.llm import fim, langid, media, mixing, neardup, resampling, sharding, toxicity, vectorjoin
from kelpie.llm.encoder import Encoder
from kelpie.llm.queries import tokenizer_path

SPACE = r"\x20\x09-\x0D"


# --- vectors ----------------------------------------------------------------------------------


def plain_components(rows: list[tuple], limit: float) -> list[tuple]:
    """n_links, component and kept of rows (id, label, vector), each pair looked at."""
    up = list(range(len(rows)))

    def find(k: int) -> int:
        while up[k] != k:
            k = up[k]
        return k

    def real(row: tuple) -> bool:
        v = row[2]
        return None not in row and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)

    n = [0] * len(rows)
    for i, a in enumerate(rows):
        for j, b in enumerate(rows[:i]):
            if real(a) and real(b) and a[1] == b[1] and len(a[2]) == len(b[2]):
                x, y = (np.array(v, float) / np.abs(v).max() for v in (a[2], b[2]))
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= limit:
                    n[i], n[j] = n[i] + 1, n[j] + 1
                    up[find(i)] = find(j)
    least: dict[int, int] = {}
    for k, row in enumerate(rows):
        if row[0] is not None:
            least[find(k)] = min(row[0], least.get(find(k), row[0]))
    found = [(row[0], n[k], least.get(find(k))) for k, row in enumerate(rows)]
    return sorted((i, m, c, i is None or i == c) for i, m, c in found) if None not in [r[0] for r in rows] else sorted(((i, m, c, i is None or i == c) for i, m, c in found), key=repr)


def made_vectors() -> list[tuple]:
    rng = np.random.default_rng(3)
    rows: list[tuple] = []

    def add(label, vectors) -> None:
        rows.extend((len(rows) + k, label, [float(x) for x in v]) for k, v in enumerate(vectors))

    for label in range(3):
        centres = rng.normal(size=(6, 8))
        add(label, rng.normal(size=(40, 8)))
        add(label, np.concatenate([c + rng.normal(size=(30, 8)) * 0.12 for c in centres]))
    tight = rng.normal(size=8)
    add(0, tight + rng.normal(size=(70, 8)) * 0.01)  # settled as a whole
    add(1, tight + rng.normal(size=(70, 8)) * 0.01)  # another label
    add(2, [tight] * 40)
    add(2, [tight * 1e200, tight * 1e-200, -tight])
    add(None, [tight, tight])
    add(0, [[0.0] * 8, [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7, [], [1.0, 2.0], [2.0, 4.0], [2.0, -1.0]])
    rows.append((len(rows), 0, None))
    rows.append((len(rows), 0, [None] + [1.0] * 7))
    rows.append((5, 1, [float(x) for x in tight]))  # a repeated id
    rows.append((None, 1, [float(x) for x in tight]))
    return rows


@pytest.mark.parametrize("block", [8, 1024])
def test_embedding_join_equals_all_pairs(spark, block):
    rows = made_vectors()
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("grp", F.lit(1)).withColumn("number", F.lit("x"))
    found = vectorjoin.near_duplicates(frame, block=block)
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == sorted(plain_components(rows, 0.98), key=repr)


def test_intervals_are_settled_and_left(spark):
    rng = np.random.default_rng(4)
    near, far = rng.normal(size=8), rng.normal(size=8)
    rows = [(k, "a", (near + rng.normal(size=8) * 0.01).tolist()) for k in range(64)] + [(100 + k, "a", (far + rng.normal(size=8) * 0.01).tolist()) for k in range(64)]
    frame = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")
    assert {(r["n_links"], r["component_id"]) for r in vectorjoin.near_duplicates(frame, block=4).collect()} == {(63, 0), (63, 100)}
    box = lambda node, centre: (node, 4, node, centre, centre, centre, 0.01)
    kinds = "node long, weight long, leader long, low array<double>, high array<double>, centre array<double>, radius double"
    blocks = spark.createDataFrame([("a", *box(0, [0.0, 1.0])), ("a", *box(1, [0.0, 1.0])), ("a", *box(2, [1.0, 0.0]))], f"grp string, {kinds}")
    rest, wholes = vectorjoin.interval_pairs(blocks, 1, 2, 0.2)
    assert rest.count() == 0
    assert sorted((level, r["a"]["node"], r["b"]["node"]) for level, pairs in wholes for r in pairs.collect()) == [(0, 0, 0), (0, 0, 1), (0, 1, 1), (0, 2, 2)]


def test_embedding_join_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert vectorjoin.near_duplicates(empty).collect() == []
    useless = spark.createDataFrame([(3, None, [1.0]), (4, 1, None)], "vec_id long, label int, embedding array<float>")
    assert sorted(tuple(r) for r in vectorjoin.near_duplicates(useless).collect()) == [(3, 0, 3, True), (4, 0, 4, True)]


def test_halving_equals_one_product():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(90, 6)), np.repeat(rng.normal(size=(5, 6)), 40, 0) + rng.normal(size=(200, 6)) * 0.05])
    norms = np.linalg.norm(x, axis=1)
    axes = vectorjoin.axes_of(x / norms[:, None], 3)
    run = vectorjoin.Interval(x, vectorjoin.on_axes(x / norms[:, None], axes, 3), norms)
    out = np.zeros((len(x), len(x)), bool)
    vectorjoin.join(run, run, 0.98, out, same=True)
    assert ((out | out.T) == (x @ x.T / (norms[:, None] * norms) >= 0.98)).all()


# --- resampling -------------------------------------------------------------------------------


def plain_features(text: str | None, n: int) -> list[str]:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return [" ".join(words[k : k + size]) for size in range(1, n + 1) for k in range(len(words) - size + 1)]


def plain_resample(docs: list[tuple], target: list[str], n: int, buckets: int, least: int, percent: int) -> list[tuple]:
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, text in docs for f in plain_features(text, n))
    t = Counter(bucket(f) for text in target for f in plain_features(text, n))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (s_all + buckets) / ((s[b] + 1.0) * (t_all + buckets)))) for b in range(buckets)]
    rows = []
    for doc_id, text in docs:
        f = plain_features(text, n)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        score = None
        if doc_id is not None:
            h = int(hashlib.sha256(f"2024:{doc_id}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(plain_features(text, 1)), len(f), weight, score, None])
    open_ = sorted((r for r in rows if r[0] is not None and r[1] >= least), key=lambda r: (-r[4], r[0]))
    for k, r in enumerate(open_[: len(open_) * percent // 100]):
        r[5] = k + 1
    return sorted((tuple(r) for r in rows), key=repr)


def made_texts() -> list[tuple]:
    rng = np.random.default_rng(6)
    words = [f"w{k}" for k in range(60)] + ["Éa", "ÉA", "naïve", "日本", "X_y", "a.b", "B2"]
    rows = [(k, " ".join(rng.choice(words, int(rng.integers(1, 80))))) for k in range(120)]
    rows += [(200, None), (201, ""), (202, " .,; \t"), (203, "Word"), (None, "a b " * 30), (None, None), (7, rows[7][1]), (8, "other words " * 20)]
    rows.append((300, " ".join(rng.choice(words, 90000))))  # several chunks
    rows.append((301, "x" * 200000 + " y " + "Z" * 70000 + " end"))
    return rows


@pytest.mark.parametrize("n", [1, 3])
def test_resampling_equals_plain(spark, n):
    docs, target = made_texts(), ["w1 w2 w3 w4 日本 w2", "W5 " * 40, None, ""]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rank", F.lit(1)).withColumn("part", F.lit("p")).repartition(5)
    wanted = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    found = resampling.resample(frame, wanted, n=n, buckets=97, percent=30)
    rows = [(r["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in found.collect()]
    plain = plain_resample(docs, target, n, 97, 20, 30)
    assert sorted(rows, key=repr) == plain
    drawn = resampling.sample(frame, wanted, n=n, buckets=97, percent=30)
    assert drawn.columns == frame.columns
    ids = {r[0] for r in plain if r[5]}
    assert sorted(r["doc_id"] for r in drawn.collect()) == sorted(d for d, _ in docs if d in ids)


def test_resampling_of_nothing(spark):
    none, target = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([("a b",)], "text string")
    assert resampling.resample(none, target).collect() == []
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [r["rank"] for r in resampling.resample(some, none).collect()] == [None]


@pytest.mark.parametrize("n", [1, 2, 4])
@pytest.mark.parametrize("window", [1, 7, 40, 10**6])
def test_chunks_own_each_start_once(n, window):
    text = ("Aa bb, c-d é日本 " * 9 + "longword" * 9 + "  z").encode()
    total: Counter = Counter()
    for words, own in resampling.chunks(text, n, window):
        at, count = resampling.buckets_of(words, own, n, 1 << 30)
        total.update(dict(zip(at.tolist(), count.tolist(), strict=True)))
    assert total == Counter(zlib.crc32(f.encode()) % (1 << 30) for f in plain_features(text.decode(), n))


# --- fill-in-middle ---------------------------------------------------------------------------


@pytest.mark.parametrize("window", [1, 2, 5, 64])
def test_unit_ends_equal_matches(window):
    for text in ("", " ", "a", " a b ", "\t\n x  y z \x0b\x0c", "日本 é\U0001f600 \U0001f600é", "no-space-at-all" * 9, " " * 70 + "x" * 70 + "\r\n" * 40):
        assert fim.unit_ends(text, window).tolist() == [m.end() for m in re.finditer(fim.UNITS, text)]


def test_fill_in_middle_equals_plain(spark):
    texts = ["", None, " ", "one", "one two  three", "a <P> b", "<S", "<M>", "x<", "<P <S < M>", "日本 é \U0001f600 fin\n", "w " * 3000, "Q" * 5000, "< <P< S>< M"]
    docs = [(k, texts[k % len(texts)]) for k in range(600)] + [(None, "a b c d"), (3, "one"), (-5, "minus five is an id"), (2**40, "a large id too")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("form", F.lit(1)).withColumn("Output", F.lit("x")).withColumn("a.b`c", F.lit(2)).withColumn("held", F.lit(3)).withColumn("units", F.array(F.lit(1)))
    found = fim.fill_in_middle(frame, batch_bytes=4000)
    assert found.columns == ["doc_id", "text", "a.b`c", "held", "units", "n", "form", "prefix_chars", "middle_chars", "output"]

    def plain(doc_id, text):
        text = text or ""
        units = re.findall(fim.UNITS, text)
        n = len(units)
        if doc_id is None or not text or re.search("<[PSM]>", text):
            return n, "plain", None, None, text
        h = hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()
        g = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
        if g[2] % 100 >= 50:
            return n, "plain", None, None, text
        a, b = sorted((g[0] % (n + 1), g[1] % (n + 1)))
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        if g[3] % 100 < 80:
            return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
        return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"

    rows = found.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert sorted([(r["doc_id"], r["text"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in rows], key=repr) == sorted([(d, t, *plain(d, t)) for d, t in docs], key=repr)
    assert all(r["back"] == (r["text"] or "") for r in rows)
    assert {r["form"] for r in rows} == {"plain", "spm", "psm"}
    assert fim.digest(frame.limit(0)).collect() == []


# --- columns of any name, and files that say strange things ------------------------------------


INNER = ("whole", "left", "row", "__cut", "__hot", "__id", "__e", "__key", "__source", "__kept", "__n", "copies", "size", "declared", "language", "posterior", "toxicity", "copy", "slot", "shard")


def named_docs(spark):
    rows = [(i, f"the river runs by house {i % 7} and more words stand here", "en" if i % 3 else None, "ab"[i % 2]) for i in range(30)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({c: F.lit(f"kept {c}") for c in INNER}).withColumn("a.b", F.lit(1))


def kept_of(frame, replaced=()):
    first = frame.first()
    assert all(first[c] == f"kept {c}" for c in INNER if c not in replaced)


def test_no_inner_name_is_met(spark):
    docs = named_docs(spark)
    mixed = mixing.mix(docs)
    assert mixed.count() == 30
    kept_of(mixed, ("copies", "size"))
    again = mixing.repeated(docs)
    assert again.columns == docs.columns
    kept_of(again)
    kept_of(sharding.place(docs, F.col("doc_id"), F.col("text"), ["x", "y"], 101), ("slot", "shard"))
    alone = neardup.without_near_duplicates(docs)
    assert alone.columns == docs.columns
    kept_of(alone)
    found = langid.identify(docs, langid.train_text(docs), F.col("text"), F.col("lang"), F.lit(None).cast("string"), F.col("source"))
    kept_of(found, ("declared", "language", "posterior"))


def test_the_pipeline_keeps_columns_of_any_name(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = named_docs(spark)
    spark.createDataFrame([(i, 0, int(i % 9 == 0)) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        if out.count():
            kept_of(out)


def test_labels_above_0_are_toxic(spark):
    rows = [(i, "clean words of the day" if i % 2 else "vile words of spite") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, [2, -1, 0, 7][i % 4] if i % 2 == 0 else -(i % 3)) for i in range(40)], "doc_id long, toxic int")
    chosen = {r["doc_id"]: r["toxic"] for r in toxicity.training_labels(labels, 100).collect()}
    assert chosen and all(t == int(i % 2 == 0 and [2, -1, 0, 7][i % 4] > 0) for i, t in chosen.items())
    assert toxicity.scored(docs, toxicity.train(docs, labels)).count() == 40


def changed(data: bytes, mark: bytes, at: int, new: bytes) -> bytes:
    place = data.index(mark) + 4 + at
    return data[:place] + new + data[place + len(new) :]


def test_media_that_say_strange_things(spark):
    good = media.mux(media.padded(b"hello " * 50))
    version = good[good.index(b"mdhd") + 4]
    unknown = changed(good, b"mdhd", 24 if version == 1 else 16, b"\xff" * (8 if version == 1 else 4))
    rows = [(1, 300, good), (2, 300, None), (3, 300, unknown), (4, 300, b""), (5, 300, good[:50])]
    if b"co64" in good:
        rows.append((6, 300, changed(good, b"co64", 8, (2**63 - 1).to_bytes(8, "big"))))
    seen = {r["doc_id"]: r for r in media.features(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()}
    assert len(seen) == len(rows)
    assert seen[1]["payload_sha256"] == seen[3]["payload_sha256"] is not None
    assert seen[3]["duration"] is None and seen[1]["duration"] is not None
    assert all(seen[k]["payload_sha256"] is None for k in seen if k not in (1, 3))


def test_other_tokenizer_files_give_the_library_s_ids():
    other = Encoder(tokenizer_path("word_bpe_49k.json"))
    assert other.plain is None
    for text in ("Hello  World's é 123", "", "two\n\nlines"):
        assert other.encode(text).tolist() == other.tokenizer.encode(text, add_special_tokens=False).ids
    assert Encoder(tokenizer_path()).plain is not None
