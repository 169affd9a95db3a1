"""The operators against plain versions, on small fixtures with nulls, ties, repeated rows and extra columns."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kelpie.llm import ann, hmm, langid, media, mixing, neardup, packing, sharding, token_counts, toxicity
from kelpie.llm.common import word_hashes
from kelpie.llm.encoder import Encoder, encoder
from kelpie.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, slot string, tokens int, path int, comp int"
WORDS = "the of sea hill stone river green light over under winter summer bread water house road field cloud".split()


def some_docs(n=60, seed=1):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.randint(0, 60))), rng.choice(["en", "fr", None]), rng.choice(["a", "b", None]), 0, 1, "x", 2, 3, 4) for i in range(n)]
    base = rows[7][1] + " " + rows[8][1] + " some more words to be long enough for any shingle"
    rows += [(n, base, "en", "a", 0, 1, "x", 2, 3, 4), (n + 1, base.upper(), "en", "b", 0, 1, "x", 2, 3, 4), (n + 2, base + " end", None, "a", 0, 1, "x", 2, 3, 4)]
    rows += [(n + 3, None, "en", "a", 0, 1, "x", 2, 3, 4), (n + 4, "", None, None, 0, 1, "x", 2, 3, 4), (None, "no id here", "en", "b", 0, 1, "x", 2, 3, 4), rows[5], rows[5]]
    rows += [(n + 5, "lone", "en", "a", 0, 1, "x", 2, 3, 4), (n + 6, "Lone", "en", "a", 0, 1, "x", 2, 3, 4), (n + 7, "long " * 3000, "en", "a", 0, 1, "x", 2, 3, 4)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return some_docs()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab 'stre19.\n\t éß中² ")) | st.characters(codec="utf-8"), max_size=80))
def test_ids_are_those_of_the_tokenizers_library(text):
    enc = encoder(tokenizer_path())
    assert enc.encode(text).tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


def test_ids_of_whole_and_very_long_texts():
    enc = Encoder(tokenizer_path())
    texts = [r[1] or "" for r in some_docs()]
    texts += [f"{'x' * k}{blank * n}{after}" for k in (0, 3) for blank in (" ", "\n", " \n") for n in (2, 40_000, 65_536, 70_000) for after in ("", "y", "'s 1")]
    texts += ["word " * 50_000, "b" * 200_000, "<|endoftext|> it's we'll I'M\u00a0x\u2028\u2029 \x1c\x85", "\u0378 \u3000\u4e2d", "a1b2!? " * 20_000]
    assert [enc.encode(t).tolist() for t in texts] == [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_blanks_beyond_what_a_search_may_hold():
    enc = Encoder(tokenizer_path())
    assert len(enc.encode(" " * 1_500_000 + "x")) == 1_500_000


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.lists(st.integers(1, 40), max_size=80))
def test_plan_is_best_fit_decreasing(window, lengths):
    lengths = [min(x, window) for x in lengths]
    bins: list[int] = []
    for x in sorted(lengths, reverse=True):
        fit = [(window - b, i) for i, b in enumerate(bins) if window - b >= x]
        if fit:
            bins[min(fit)[1]] += x
        else:
            bins.append(x)
    planned = defaultdict(list)
    for length, low, high, per, first, offset in packing.best_fit_plan(Counter(lengths), window):
        for t in range(low, high):
            planned[first + (t - low) // per].append((offset + (t - low) % per * length, length))
    for parts in planned.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *(n for _, n in parts)])[:-1].tolist()
    assert sorted(sum(n for _, n in p) for p in planned.values()) == sorted(bins)


def test_pack_keeps_every_id_once(docs, rows, empty):
    got = [r.asDict() for r in packing.pack(docs, tokenizer_path(), 64).collect()]
    enc, whole, by_doc = encoder(tokenizer_path()), Counter(), defaultdict(list)
    for r in rows:
        whole[(r[0], tuple([*enc.encode(r[1] or "").tolist(), 0]))] += 1
    for r in got:
        by_doc[r["doc_id"]].append(r)
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] <= 64
    for (doc, ids), n in whole.items():
        for start in range(0, len(ids), 64):
            assert sum(p["start"] == start and tuple(p["ids"]) == ids[start : start + 64] for p in by_doc[doc]) >= n
    assert sum(r["length"] for r in got) == sum(len(i) * n for (_, i), n in whole.items())
    for parts in (sorted((r["offset"], r["length"]) for r in got if r["sequence_id"] == s) for s in {r["sequence_id"] for r in got}):
        assert [o for o, _ in parts] == np.cumsum([0, *(n for _, n in parts)])[:-1].tolist() and sum(n for _, n in parts) <= 64
    assert packing.pack(empty, tokenizer_path()).count() == 0


def test_media_round_trip(docs, rows, empty):
    got = media.features(media.store(docs)).collect()
    assert len(got) == len(rows)
    want = Counter((r[0], hashlib.sha256(media.padded((r[1] or "").encode())).hexdigest(), len((r[1] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["payload_sha256"], r["n_bytes"]) for r in got) == want
    assert all(r["fault"] is None and r["codec"] == "raw " and r["duration"] == r["payload_bytes"] for r in got)
    assert media.features(media.store(empty)).count() == 0


def test_media_digests_are_the_plain_ones(spark):
    texts = ["", "abc", "x" * 64, "y" * 5000, None]
    got = {r["doc_id"]: r for r in media.features(media.store(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        file, r = media.mux(payload), got[i]
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(payload[-64:]), len(file), hashlib.sha256(file).hexdigest())
        first = file.index(payload)
        assert [(k["first"], k["last"]) for k in r["keyframes"]] == [(first + c * 4096, first + c * 4096 + 63) for c in range(-(-len(payload) // 4096))]


def test_crafted_media(spark):
    deep = b""
    for _ in range(1500):
        deep = media._box(b"moov", deep)
    huge = media._box(b"moov", media._box(b"trak", media._box(b"mdia", media._box(b"minf", media._box(b"stbl", media._full(b"stsz", (2**32 - 1).to_bytes(4, "big") * 2), media._full(b"stco", b"\xff" * 8))))))
    wrong = media.mux(media.padded(b"z" * 700)).replace(b"stss\0\0\0\0\0\0\0\1\0\0\0\1", b"stss\0\0\0\0\0\0\0\1\0\0\0\0")
    got = media.features(spark.createDataFrame([(1, 1, deep), (2, 1, huge), (3, 1, wrong)], "doc_id long, n_bytes long, media binary")).collect()
    assert len(got) == 3 and all(r["fault"] and r["payload_bytes"] is None for r in got)


def test_faulty_media(spark):
    good = media.mux(media.padded(b"x" * 9000))
    files = [(1, 1, good), (2, 1, good[:-1]), (3, 1, b""), (4, 1, good[:100]), (5, 1, b"\0\0\0\4moov")]
    got = {r["doc_id"]: r for r in media.features(spark.createDataFrame(files, "doc_id long, n_bytes long, media binary")).collect()}
    assert got[1]["fault"] is None and [k["last"] - k["first"] for k in got[1]["keyframes"]] == [63, 63, 63]
    assert all(got[k]["fault"] for k in (2, 3, 4, 5))


def test_token_counts(spark, docs, rows, empty):
    enc = encoder(tokenizer_path())
    got = token_counts.token_counts(docs, tokenizer_path()).toPandas()
    sums = got.groupby("doc_id").agg(n=("n_tokens", "sum"), share=("token_share", "sum"))
    for r in rows:
        if r[0] is not None and r[0] != rows[5][0]:
            assert sums.n[r[0]] == len(enc.encode(r[1] or "")) and abs(sums.share[r[0]] - sums.n[r[0]]) < 1e-6
    text = "Ünï two\nthree, four"
    spans = spark.createDataFrame([(1, text, [(0, 2), (2, 7), (5, 99), (4, 4), None])], "doc_id long, text string, s array<struct<a:int,b:int>>")
    out = token_counts.token_counts(spans, tokenizer_path(), "s").orderBy("section").collect()
    pieces = [enc.tokenizer.id_to_token(i) for i in enc.encode(text).tolist()]
    edges = np.cumsum([0, *map(len, pieces)])  # a letter of a byte-level vocabulary is a byte
    for r in out:
        s, e = (len(text[: min(x, len(text))].encode()) for x in (r["char_start"], r["char_end"]))
        share = sum(max(0, min(e, y) - max(s, x)) / (y - x) for x, y in zip(edges, edges[1:], strict=False))
        begun = sum(s <= x < e for x in edges[:-1])
        crossing = sum(any(x < end < y for end in {s, e}) for x, y in zip(edges, edges[1:], strict=False)) if e > s else 0
        assert abs(share - r["token_share"]) < 1e-9 and (begun, crossing) == (r["n_tokens"], r["n_crossing"])
    assert len(out) == 4 and token_counts.token_counts(empty, tokenizer_path()).count() == 0


def test_language_id(spark, empty):
    rng = random.Random(2)
    said = {"en": "the and with that have from they this".split(), "fr": "les des une dans pour avec être où".split()}
    rows = [(i, " ".join(rng.choices(said[x], k=30)), x, "h1" if x == "en" else "h2") for i, x in enumerate(["en", "fr"] * 40)]
    rows += [(100, None, None, "h2"), (101, "", "en", None), (102, "12 34", None, None), (103, " ".join(rng.choices(said["fr"], k=30)), "en", "h1"), (104, "zqxj kvwq " * 40, "en", "h1")]
    train = spark.createDataFrame(rows[:80], "doc_id long, text string, lang string, source string")
    asked = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = langid.train_text(train)
    got = {r["doc_id"]: r for r in langid.identify(asked, model, F.col("text"), F.col("lang"), F.lit(None).cast("string"), F.col("source")).collect()}
    assert all(got[i]["language"] == x and got[i]["posterior"] > 0.9 for i, _, x, _ in rows[:80])
    assert got[100]["language"] == "fr" and got[101]["language"] == "en" and got[103]["language"] == "fr" and got[104]["language"] == "und"
    assert langid.identify(empty, model, F.col("text"), F.col("lang"), F.lit(None).cast("string"), F.col("source")).count() == 0
    assert {r["language"] for r in langid.identify(asked, langid.train_text(empty), F.col("text"), F.col("lang"), F.lit("x"), F.col("source")).collect()} == {"und"}


def test_mixing_is_its_sql(spark, docs, rows, empty):
    got = mixing.digest(docs).select("doc_id", "size", "source_size", "target", "taken").toPandas()
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    want = con.sql(mixing.MIX_SQL).df()
    key = lambda f: sorted(map(repr, f.astype(float).fillna(-1).values.tolist()))
    assert key(got) == key(want)
    full = mixing.mix(docs).toPandas()
    assert (full.taken <= 3 * full["size"]).all() and len(full) == len(rows)
    assert mixing.mix(empty).count() == 0


def test_mixing_has_unequal_chances(spark):
    """Over sources alike but for their names, longer documents are taken more often, the longest of all always."""
    rows = [(100 * k + i, " ".join(["w"] * n), f"s{k:03d}") for k in range(150) for i, n in enumerate([1, 4, 4, 16, 16, 60, 400])]
    got = mixing.digest(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    odd = got[(got.target % got.source_size > 0.45 * got.source_size)]
    extra = (odd.taken - odd["size"] * (odd.target // odd.source_size)).clip(upper=1).groupby(odd["size"]).mean()
    assert (got.taken <= 3 * got["size"]).all() and extra[60] > extra[4] + 0.1


def test_mixing_comes_near_targets(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randint(1, 40)), "s%d" % min(rng.randint(0, 9), 4)) for i in range(2000)]
    got = mixing.digest(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    by = got.assign(s=[dict((r[0], r[2]) for r in rows)[i] for i in got.doc_id]).groupby("s").agg(t=("target", "first"), k=("taken", "sum"))
    assert (abs(by.t - by.k) <= 20).all()  # half the longest document


def jaccard_components(rows):
    sets = {}
    for r in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or "").encode().split()
        sets.setdefault(r[0], set()).update([tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else []))
    ids, root = [i for i in sets if i is not None], {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("options", [{}, {"node_limit": 2, "block": 7}])
def test_near_duplicates(spark, docs, rows, empty, options):
    rng = random.Random(9)
    base = [rng.choice(WORDS) + str(rng.randint(0, 50)) for _ in range(120)]
    copies = []
    for i in range(40):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = f"new{rng.random()}"
        copies.append((500 + i, " ".join(words), "en", "a", 0, 1, "x", 2, 3, 4))
    every = docs.union(spark.createDataFrame(copies, SCHEMA))
    want = jaccard_components([*rows, *copies])
    got = neardup.near_duplicates(every, **options).collect()
    assert len(got) == len(rows) + len(copies)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    assert neardup.near_duplicates(empty).count() == 0
    left = neardup.without_near_duplicates(every, **options).toPandas()
    assert sorted(left.doc_id.dropna()) == sorted(i for i, (_, c) in want.items() if i == c) and left.doc_id.isna().sum() == 1


def test_repeated_ids_leave_one_row(spark):
    rows = spark.createDataFrame([(1, "one two three four five six"), (1, "one two three four five six"), (2, "one two three four five six"), (3, "else")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in neardup.without_near_duplicates(rows).collect()) == [1, 3]


def long_twins(n=2048):
    """Two texts of a and b alone that hashes by powers of a number modulo 2**64 can't tell apart."""
    one = "a"
    while len(one) < n:
        one += one.translate({97: 98, 98: 97})
    return one, one.translate({97: 98, 98: 97})


def test_long_words_of_equal_sums_stay_apart(spark):
    a, b = long_twins()
    enc = encoder(tokenizer_path())
    assert [enc.encode(x).tolist() for x in (a, b)] == [enc.tokenizer.encode(x, add_special_tokens=False).ids for x in (a, b)]
    assert len(set(word_hashes(f"{a} {b} {a}".encode()).tolist())) == 2
    rows = spark.createDataFrame([(k, f"one two three {x} five") for k, x in enumerate((a, b))], "doc_id long, text string")
    assert sorted(r["component_id"] for r in neardup.near_duplicates(rows).collect()) == [0, 1]
    assert {r["n_known"] for r in hmm.score(spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string"), states=2, rounds=1).collect()} == {2}


def test_segments_are_maximal():
    rng = np.random.default_rng(3)
    for _ in range(200):
        x = rng.integers(-5, 5, rng.integers(0, 30)).astype(float)
        got = toxicity.maximal_segments(x, 0.0)
        best = max([x[i:j].sum() for i in range(len(x)) for j in range(i + 1, len(x) + 1)], default=0.0)
        assert toxicity.highest_segment(x) == max(0.0, best) and max([s for *_, s in got], default=0.0) == max(0.0, best)
        for a, b, s in got:
            assert s == x[a : b + 1].sum() and all(x[a : k + 1].sum() > 0 for k in range(a, b + 1)) and all(x[k : b + 1].sum() > 0 for k in range(a, b + 1))
        assert all(b < c for (_, b, _), (c, *_) in zip(got, got[1:], strict=False))


def test_toxicity(spark, empty):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 6 == 0
        words = rng.choices(WORDS, k=rng.randint(20, 80))
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), "vile" + rng.choice(["ness", "ly", "r", "st", "one"]))
        rows.append((i, " ".join(words)))
        labels.append((i, None if i % 50 == 7 else int(toxic)))
    docs = spark.createDataFrame([*rows, (None, "x"), (900, None), (901, ""), rows[0]], "doc_id long, text string")
    known = spark.createDataFrame([*labels, labels[0], (None, 1)], "doc_id long, toxic int")
    got = toxicity.scored(docs, toxicity.train(docs, known)).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h"), "toxicity.*").toPandas()
    fresh = got[got.h & (got.doc_id < 600)]
    assert ((fresh.predicted == 1) == (fresh.doc_id % 6 == 0)).mean() > 0.97 and got.score.between(0, 1).all()
    assert (got[got.doc_id.isin([900, 901])].predicted == 0).all() and len(got) == 604
    none = toxicity.train(docs, known.filter("toxic = 0"))
    assert set(toxicity.scored(docs, none).select("toxicity.predicted").toPandas().predicted) == {0}
    assert toxicity.scored(empty, toxicity.train(empty, known)).count() == 0


def test_toxicity_is_the_plain_rule(spark):
    """Score, passages and prediction of each document by a plain version of segments, sums and curve over the same model."""
    rng = random.Random(15)
    texts = [" ".join(rng.choices([*WORDS, "vileness", "vilest"], [1] * len(WORDS) + [0.4 if i % 3 == 0 else 0.0] * 2, k=rng.randint(0, 90))) for i in range(240)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, int("vile" in t)) for i, t in enumerate(texts)], "doc_id long, toxic int"))

    def plain(text):
        scores = model.words(text.encode())
        spans = []

        def cut(low, high):  # the best segment, then what lies on either side of it
            best = max(((scores[i:j].sum(), -(j - i), -i, i, j) for i in range(low, high) for j in range(i + 1, high + 1)), default=(0,))
            if best[0] > 0:
                spans.append((best[3], best[4] - 1, best[0]))
                cut(low, best[3])
                cut(best[4], high)

        cut(0, len(scores))
        if not spans:
            return 1 / (1 + math.exp(10.0 * model.slope - model.offset)), []
        floor = math.log(model.scale * len(scores))
        each = sorted((model.decay * x - floor for *_, x in spans), reverse=True)
        found = [each[0]]
        for r in range(2, len(each) + 1):
            t = sum(each[:r])
            if each[r - 1] > 0 and t >= r * (r - 1):
                found.append(t - (r - 1) * math.log(t) + math.lgamma(r + 1) + math.lgamma(r) - (r - 1) * math.log(2))
        passages = sorted((a, b) for a, b, x in spans if model.decay * x - floor >= math.log(100))
        return 1 / (1 + math.exp(-max(-40, min(40, model.slope * max(found) + model.offset)))), passages

    got = toxicity.scored(docs.limit(80), model).select("doc_id", "toxicity.*").collect()
    for r in got:
        score, passages = plain(texts[r["doc_id"]])
        assert abs(score - r["score"]) < 1e-6 and r["predicted"] == int(score >= 0.5)
        assert sorted((p["first_word"], p["last_word"]) for p in r["passages"]) == passages
    assert any(r["passages"] for r in got)


def test_segments_take_linear_time():
    import time

    def took(n):
        x = np.tile([1.0, -1.5, 2.0, -2.5], n // 4) - np.linspace(0, 1e-3, n)
        begun = time.perf_counter()
        toxicity.maximal_segments(x)
        return time.perf_counter() - begun

    took(4000)
    assert took(64000) < 40 * max(took(8000), 1e-3)


def test_language_id_is_the_plain_rule(spark):
    rng = random.Random(12)
    said = {"en": "the and with that have from they this".split(), "fr": "les des une dans pour avec sont nous".split()}
    rows = [(i, " ".join(rng.choices(said[x], k=rng.randint(0, 6))), rng.choice([x, "en-GB", None, "xx"]), rng.choice(["a", "b", None]), f"h{rng.randint(0, 5)}") for i, x in enumerate(rng.choices(["en", "fr"], k=90))]
    frame = spark.createDataFrame(rows, "doc_id long, text string, declared string, suffix string, host string")
    model = langid.train_text(spark.createDataFrame([(" ".join(v), k) for k, v in said.items()], "text string, lang string"))
    found = {r["doc_id"]: r for r in langid.identify(frame, model, F.col("text"), F.col("declared"), F.col("suffix"), F.col("host")).collect()}
    k, say = len(model.languages), lambda d: None if d is None else d.split("-")[0].lower()
    texts = {}
    for i, text, *_ in rows:
        at = langid.trigrams(text.encode())
        sums = model.logs[at].sum(0, dtype=float) * min(1, 60 / len(at)) if len(at) else None
        texts[i] = None if sums is None else sums - sums.max()
    votes = {i: None if t is None else int(t.argmax()) for i, t in texts.items()}
    prior = np.array([1.0] * (k - 1) + [0.01]) + np.bincount([v for v in votes.values() if v is not None], minlength=k)
    prior /= prior.sum()

    def by(place, value, but=None):
        return np.bincount([votes[r[0]] for r in rows if place(r) == value and votes[r[0]] is not None and r[0] != but], minlength=k).astype(float)

    for i, _, declared, suffix, host in rows:
        smooth = lambda n, p: (n + 10 * p) / (n.sum() + 10)
        of_suffix = prior if suffix is None else smooth(by(lambda r: r[3], suffix), prior)
        first = smooth(by(lambda r: r[4], host, i), of_suffix)
        says = np.zeros(k) if declared is None else np.log(smooth(by(lambda r: say(r[2]), say(declared)), prior) / prior)
        logs = np.log(first) + says + (0 if texts[i] is None else texts[i])
        chance = np.exp(logs - logs.max())
        assert found[i]["language"] == model.languages[int(logs.argmax())] and abs(found[i]["posterior"] - 1 / chance.sum()) < 1e-9
        assert found[i]["declared"] == say(declared)


def test_places_are_the_plain_ones(spark):
    """Each shard takes its next free slot in turns; a row goes to the slot of its key's hash."""
    names, slots = ["a", "b", "c"], 13
    owner, places = {}, {n: [(sharding._number(n, "offset") + t * (sharding._number(n, "skip") % 12 + 1)) % slots for t in range(slots)] for n in names}
    while len(owner) < slots:
        for n in names:
            if len(owner) < slots:
                owner[next(p for p in places[n] if p not in owner)] = n
    rows = spark.range(200).select("id", F.concat(F.lit("t"), F.col("id")).alias("text"))
    want = {r["id"]: r["h"] for r in rows.select("id", F.xxhash64(F.col("id").cast("string"), F.lit(False)).alias("h")).collect()}
    got = sharding.place(rows, F.col("id"), F.col("text"), names, slots).collect()
    assert len(got) == 200 and all(r["slot"] == want[r["id"]] % slots and r["shard_name"] == owner[r["slot"]] for r in got)


def test_lookup_table_and_places(spark, docs, rows, empty):
    names = [f"s{k}" for k in range(7)]
    table = sharding.lookup_table(names, 1009)
    assert max(np.bincount(table)) - min(np.bincount(table)) <= 1
    moved = (np.array(names)[table] != np.array(names[:-1])[sharding.lookup_table(names[:-1], 1009)]).mean()
    assert moved < 0.35
    for bad in (([], 7), (["a", "a"], 7), (["a"], 8)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)
    got = sharding.place(docs, F.col("doc_id"), F.col("text"), names, 1009).toPandas()
    assert len(got) == len(rows) and (table[got.slot] == got.shard).all()
    assert got[got.doc_id == rows[5][0]].shard.nunique() == 1
    hot = spark.range(4000).select(F.lit("k").alias("key"), F.col("id").cast("string").alias("v"))
    spread = sharding.place(hot, F.col("key"), F.col("v"), names, 1009).groupBy("shard").count().toPandas()
    assert spread["count"].max() < 2000 and sharding.place(empty, F.col("doc_id"), F.col("text"), names, 1009).count() == 0


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    rows = [(i, [float(v) for v in x[i]]) for i in range(len(x))]
    odd = [(2000, None), (2001, [0.0] * 16), (2050, [float("nan")] * 16), (2003, [1.0] * 3), (2004, [None] + [1.0] * 15), (None, rows[1][1]), (2100, rows[1][1]), (2101, rows[1][1])]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = ann.search(frame, frame.filter("vec_id % 50 = 0"), k=5, block=512).toPandas()
    whole = {i: np.array(v, float) for i, v in rows + odd if i is not None and v and None not in v and len(v) == 16 and np.isfinite(v).all() and any(v)}
    ids = np.array(sorted(whole))
    units = np.array([whole[i] / np.linalg.norm(whole[i]) for i in ids])
    hit = 0
    asked = [i for i in ids if i % 50 == 0]
    for q in asked:
        s = units @ (whole[q] / np.linalg.norm(whole[q]))
        order = [k for k in np.lexsort((ids, -np.round(s, 12))) if ids[k] != q][:5]
        mine = got[got.query_id == q].sort_values("rank")
        assert list(mine["rank"]) == [1, 2, 3, 4, 5] and (np.diff(mine.score) <= 0).all()
        hit += len(set(ids[order]) & set(mine.vec_id))
        assert np.allclose(mine.score, [s[np.searchsorted(ids, i)] for i in mine.vec_id], rtol=0, atol=1e-12)
    assert hit / (5 * len(asked)) >= 0.9 and set(got.query_id) == set(asked)
    few = frame.filter("vec_id in (0, 50, 3)")
    assert ann.search(few, few.filter("vec_id % 50 = 0")).count() == 4
    assert ann.search(frame.limit(0), frame.limit(0)).count() == 0


def test_block_finds_all_within_a_radius():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 1 << 16, (500, 4)).astype(np.uint16)
    block = ann.Block(codes)
    for q in range(20):
        apart = ann._ONES[codes ^ codes[q]].sum(1, dtype=np.int64)
        for r in (0, 3, 20, 27, 30, 64):
            assert block.within(codes[q], r).tolist() == np.flatnonzero(apart <= r).tolist()


def test_forward_is_exact():
    rng = np.random.default_rng(4)
    chain = hmm.Chain(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3))
    docs = [rng.integers(0, 5, n) for n in (1, 4, 4, 9, 2, 17, 30)]
    for d, got in zip(docs, hmm.log10_likelihoods(np.concatenate(docs), np.array([len(d) for d in docs]), chain), strict=True):
        a = chain.first * chain.emits[:, d[0]]
        for c in d[1:]:
            a = a @ chain.steps * chain.emits[:, c]
        assert abs(math.log10(a.sum()) - got) < 1e-9


def test_baum_welch_counts_and_growth():
    rng = np.random.default_rng(6)
    lengths = np.array([12] * 19 + [7])
    texts, share = rng.integers(0, 6, lengths.sum()), np.full(6, 1 / 6)
    chain = hmm.updated(rng.random(2), rng.random((2, 2)), rng.random((2, 6)), share)
    before = -np.inf
    for _ in range(6):
        first, steps, emits, logs = hmm.expected_of_texts(texts, lengths, chain)
        assert abs(emits.sum() - len(texts)) < 1e-2 and abs(first.sum() + steps.sum() - len(texts)) < 1e-2
        assert logs > before - 0.5
        before, chain = logs, hmm.updated(first, steps, emits, share * 1e-3)


def test_scores(docs, rows, empty):
    got = hmm.score(docs, states=2, rounds=2, frequent=16, tail=8).toPandas()
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    words = lambda t: [*"".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split(), b""]
    counts = Counter(w for r in rows if not out(r[0]) for w in words(r[1]))
    total = sum(counts.values())
    want = sorted((-1 if r[0] is None else r[0], out(r[0]), len(words(r[1])), sum(counts[w] > 0 for w in words(r[1])), round(sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (len(counts) + 1))) for w in words(r[1])), 6)) for r in rows)
    mine = sorted(zip(got.doc_id.fillna(-1).astype(int), got.held_out, got.n_tokens, got.n_known, got.base_score.round(6), strict=True))
    assert [tuple(map(float, x)) for x in mine] == [tuple(map(float, x)) for x in want]
    assert (got.score < 0).all() and (got.train_tokens == total).all()
    assert hmm.score(empty).count() == 0


def test_whole_texts_are_trained():
    """The counts are those of the plain recursions over each whole text: one first state a text, and all steps within it."""
    rng = np.random.default_rng(9)
    chain = hmm.Chain(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3))
    docs = [rng.integers(0, 5, n) for n in (1, 150, 4, 300, 4, 65)]
    first, steps, emits, logs = hmm.expected_of_texts(np.concatenate(docs).astype("<u2"), np.array([len(d) for d in docs]), chain)
    want, moves, made, likely = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 5)), 0.0
    for d in docs:
        a, b = [chain.first * chain.emits[:, d[0]]], [np.ones(3)]
        for c in d[1:]:
            a.append(a[-1] @ chain.steps * chain.emits[:, c])
        for c in d[:0:-1]:
            b.insert(0, chain.steps @ (chain.emits[:, c] * b[0]))
        chance = a[-1].sum()
        likely += math.log(chance)
        want += a[0] * b[0] / chance
        for t, c in enumerate(d):
            made[:, c] += a[t] * b[t] / chance
            if t:
                moves += chain.steps * np.outer(a[t - 1], chain.emits[:, c] * b[t]) / chance
    for got, right in ((first, want), (steps, moves), (emits, made), (logs, likely)):
        assert np.allclose(got, right, rtol=1e-3, atol=1e-3)
    assert abs(first.sum() - len(docs)) < 1e-3 and abs(steps.sum() - sum(len(d) - 1 for d in docs)) < 0.05


def test_score_is_the_plain_rule(spark, monkeypatch):
    """The score is the likelihood of the classes under the trained chain, and of each word in its class."""
    kept = {}
    whole = hmm.trained
    monkeypatch.setattr(hmm, "trained", lambda texts, classes, *a: kept.setdefault("chain", whole(kept.setdefault("texts", texts), kept.setdefault("classes", classes), *a)))
    rng = random.Random(3)
    texts = [" ".join(rng.choices([*WORDS, "ox", "emu"], k=rng.randint(0, 30))) for _ in range(40)]
    got = {r["doc_id"]: r["score"] for r in hmm.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), states=3, rounds=2, frequent=6, tail=4).collect()}
    chain, classes = kept["chain"], kept["classes"]
    counts = Counter(w for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 != 1 for w in [*t.split(), ""])

    def kind(word):
        block = hmm.encoded([0], [False], [word.encode()], 0, 4)
        return int(classes.of(np.frombuffer(block["words"], np.uint64), np.frombuffer(block["endings"], np.uint16))[1 if word else 0])

    kinds = {w: kind(w) for w in [*WORDS, "ox", "emu", ""]}
    room = {k: sum(counts[w] for w in counts if kinds[w] == k) + 0.5 * (sum(kinds[w] == k for w in counts) + 1) for k in range(classes.number)}
    for i, t in enumerate(texts):
        words = [*t.split(), ""]
        a = chain.first * chain.emits[:, kinds[words[0]]]
        for w in words[1:]:
            a = a @ chain.steps * chain.emits[:, kinds[w]]
        want = math.log10(a.sum()) + sum(math.log10((counts[w] + 0.5) / room[kinds[w]]) for w in words)
        assert abs(want - got[i]) < 1e-6


def test_scores_do_not_depend_on_partitions(docs):
    one, two = ({(r["doc_id"], r["n_tokens"]): r["score"] for r in hmm.score(docs.repartition(n), states=2, rounds=2, frequent=16, tail=8).collect()} for n in (1, 5))
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-3 * abs(one[k]) for k in one)


def test_rare_languages_and_suffixes_count(spark):
    """The rarest of 70 declared languages has a model, and the rarest of over 4096 suffixes its chances."""
    rng = random.Random(8)
    said = {f"l{k:02d}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(6)] for k in range(70)}
    rows = [(i, " ".join(rng.choices(said[x], k=30)), x) for i, x in enumerate([y for y in said for _ in range(1 if y == "l69" else 2)])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    none = F.lit(None).cast("string")
    model = langid.train_text(frame)
    assert len(model.languages) == 71
    got = {r["doc_id"]: r["language"] for r in langid.identify(frame, model, F.col("text"), none, none, none).collect()}
    assert all(got[i] == x for i, _, x in rows)
    en, fr = "the and with that have from they this", "les des une dans pour avec sont nous"
    model = langid.train_text(spark.createDataFrame([(en, "en"), (fr, "fr")], "text string, lang string"))
    pages = [(i, en, f"s{i % 4200}") for i in range(8400)] + [(9000, fr, "zz"), (9001, None, "zz")]
    pages = spark.createDataFrame(pages, "doc_id long, text string, suffix string")
    found = langid.identify(pages, model, F.col("text"), none, F.col("suffix"), none, weight_of_prior=0.01)
    assert {r["doc_id"]: r["language"] for r in found.filter("doc_id >= 9000").collect()} == {9000: "fr", 9001: "fr"}
