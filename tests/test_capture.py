"""Streams of capture: any split into batches gives the batch result, and the rules each for itself."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpie.functions import images
from kelpie.streaming import capture

COLUMNS = "key long, id long, at timestamp, kind string, code long, text string, look binary"


def run(machine, events, idle=3_600_000):
    """The machine over all events of each key at once."""
    out = []
    for key in sorted({e[0] for e in events}):
        mine = sorted((ms, i, tuple(rest)) for k, i, ms, *rest in events if k == key)
        state, _, given = capture.taken(machine, machine.start(), None, mine, idle)
        out += [(key, *row) for row in given + machine.end(state)]
    return out


def shown(rows):
    return sorted(tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in rows)


def one_user(*events):
    return [(1, k, ms, kind, code, text, look) for k, (ms, kind, code, text, look) in enumerate(events)]


def test_rules():
    e = one_user(
        (0, "said", None, "nobody hears", None), (1000, "activate", None, "Mail", None), (1500, "activate", None, "Notes", None), (1600, "press", 4, None, None),
        (1700, "release", 4, "h", None), (1800, "release", 4, "x", None), (1900, "said", None, "good", None), (1950, "said", None, "day", None),
        (2100, "activate", None, "loginwindow", None), (3500, "activate", None, "Mail", None), (9000, "pause", None, "SLEEP", None), (9100, "pause", None, "SLEEP", None),
        (9200, "said", None, "asleep", None), (11000, "activate", None, "Mail", None), (12000, "seen", None, "Chat", None),
    )
    assert [r[1:5] for r in run(capture.Capture(), e)] == [("Mail", 1000, "h", "good day"), ("Mail", 11000, "", ""), ("Chat", 12000, "", "")]


def test_shots():
    dark, bright = bytes(90000), bytes([90]) * 90000
    e = one_user((0, "activate", None, "A", dark), *((1000 * k, "shot", None, None, bright if k % 2 else dark) for k in range(1, 13)), (14000, "shot", None, None, dark), (15000, "shot", -200000, None, bright))
    held = list(range(1))
    for k in range(1, 13):
        held.append(k)
        if len(held) > 9:
            del held[5]
    assert run(capture.Capture(), e)[0][5] == held  # the look of number 13 is that of 12, number 14 is late


def test_looks_are_boxes():
    rng = np.random.default_rng(1)
    for height, width in ((300, 300), (600, 900), (75, 100), (311, 457)):
        pixels = rng.integers(0, 256, (height, width), dtype=np.uint8)
        got = np.frombuffer(images.look_of(pixels.tobytes(), width, height), np.uint8).reshape(300, 300)
        for r, c in ((0, 0), (17, 299), (150, 149)):
            total = weight = 0.0
            for y in range(height):
                dy = min((r + 1) * height / 300, y + 1) - max(r * height / 300, y)
                if dy <= 0:
                    continue
                for x in range(width):
                    dx = min((c + 1) * width / 300, x + 1) - max(c * width / 300, x)
                    if dx > 0:
                        total, weight = total + dy * dx * int(pixels[y, x]), weight + dy * dx
            assert abs(int(got[r, c]) - total / weight) <= 0.51
    assert images.look_of(b"abc", 2, 2) is None and images.difference(None, b"a") == float("inf") and images.alike(bytes([5]), bytes([10])) and not images.alike(bytes([5]), bytes([11]))


def test_looks_of_a_column(spark):
    rows = [(1, bytes([7]) * 12, 4, 3), (2, None, 4, 3), (3, b"x", 4, 3)]
    got = {r["i"]: r["l"] for r in spark.createDataFrame(rows, "i int, p binary, w int, h int").select("i", images.look("p", "w", "h").alias("l")).collect()}
    assert bytes(got[1]) == bytes([7]) * 90000 and got[2] is None and got[3] is None


def streamed(spark, tmp_path, events, columns, start, parts, seed):
    """What a stream gives whose files hold the events in parts, each shuffled and mixed with its neighbours' events."""
    rng = random.Random(seed)
    order = sorted(events, key=lambda e: e[2] + rng.randint(0, 40_000))
    source = f"{tmp_path}/in{seed}"
    size = -(-len(order) // parts)
    chunks = [order[k : k + size] for k in range(0, len(order), size)] + [[(-1, 0, 10**10, *[None] * (len(events[0]) - 3))]]  # a late clock
    for chunk in chunks:
        frame = spark.createDataFrame([(k, i, ms, *rest) for k, i, ms, *rest in chunk], columns.replace("timestamp", "long")).withColumn("at", F.timestamp_millis("at"))
        frame.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(columns).option("maxFilesPerTrigger", 1).parquet(source)
    name = f"got{abs(hash((str(tmp_path), seed)))}"
    query = start(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/at{seed}").trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.exception() is None
    return [tuple(r) for r in spark.table(name).filter("key >= 0").collect()]


def made_events(seed, n=160):
    rng, out = random.Random(seed), []
    for i in range(n):
        kind = rng.choice(["activate", "activate", "seen", "press", "press", "release", "said", "shot", "pause"])
        text = {"pause": rng.choice(["PAUSED", "SLEEP"]), "release": rng.choice("abc"), "said": rng.choice(["yes", "no", ""])}.get(kind, rng.choice(["Mail", "Notes", "x.loginwindow"]))
        out.append((rng.randint(1, 3), i, rng.randint(1, 600_000) + (8_000_000 if i % 10 == 0 else 0), kind, rng.randint(1, 3) if kind in ("press", "release") else None, text, bytes([rng.choice([0, 3, 60])]) * 4))
    return out


@pytest.mark.parametrize(("parts", "seed"), [(1, 1), (4, 2)])
def test_any_split_gives_the_batch_result(spark, tmp_path, parts, seed):
    events = made_events(5)
    got = streamed(spark, tmp_path, events, COLUMNS, capture.activities, parts, seed)
    assert shown(got) == shown(run(capture.Capture(), events))


def test_builds_are_told_once(spark, tmp_path):
    kinds = ["started", "file_created", "chunk_requested", "node_created", "scanned", "file_indexed", "node_embedded", "chunk_processed", "communities", "file_indexed", "communities"]
    events = [(1, k, 1000 * k + 500, kind, True) for k, kind in enumerate(kinds)]
    events += [(2, k, 1000 * k + 500, kind, False) for k, kind in enumerate(["started", "node_created", "scanned", "communities", "started", "scanned"])]
    events += [(3, k, 1000 * k + 500, kind, True) for k, kind in enumerate(["started", "file_created", "scanned", "failed", "file_indexed"])]
    events += [(4, 0, 500, "scanned", True), (5, 0, 500, "started", True), (5, 1, 501, "edge_created", None), (5, 2, 502, "scanned", True)]
    want = [(1, 8500), (2, 3500), (2, 5500)]
    assert run(capture.Builds(), events) == want
    for parts, seed in ((1, 3), (5, 4)):
        got = streamed(spark, tmp_path, events, "key long, id long, at timestamp, kind string, described boolean", capture.completed_builds, parts, seed)
        assert sorted(got) == want
