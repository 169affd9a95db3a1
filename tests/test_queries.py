"""Each query against its SQL, and the operators on small fixtures."""

import datetime as dt
import glob
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kelpie import catalog
from kelpie.functions import text as tx
from kelpie.functions import vectors as vx
from kelpie.operators import analytics, graph, merge, search
from kelpie.sources import files, html
from kelpie.streaming import activity

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS FROM '{f}'")
    return con


def rows_of(frame):
    columns = sorted(frame.columns)

    def plain(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return "null"
        if hasattr(v, "year"):
            return str(pd.Timestamp(v))
        return repr(float(v)) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)

    return columns, sorted(tuple(map(plain, r)) for r in frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_is_its_sql(spark, tables, name):
    got = catalog.queries()[name](spark, FOLDER).toPandas()
    if name in catalog.oracle_sql():
        assert rows_of(got) == rows_of(tables.sql(catalog.oracle_sql()[name]).df())
    else:
        assert len(got)


def at(day, hour):
    return dt.datetime(2024, 1, day, hour)


def test_time_per_tag(spark):
    rows = [(100, at(12, 9), "editor", 1), (101, at(12, 10), "browser", None), (102, at(12, 12), "PAUSED", 0)]
    frame = spark.createDataFrame(rows, "id long, start_time timestamp_ntz, application string, tag_id long")
    assert {r["tag_id"]: r["seconds"] for r in analytics.time_per_tag_day(frame).collect()} == {1: 3600, None: 7200}
    rows = [(1, at(7, 9), "editor", 1), (2, at(7, 17), "PAUSED", None), (3, at(13, 9), "browser", None), (4, at(13, 11), "PAUSED", None)]
    frame = spark.createDataFrame(rows, "id long, start_time timestamp_ntz, application string, tag_id long")
    assert analytics.tracked_share(analytics.time_per_tag_day(frame)).first()["tracked"] == 0.25


def test_upsert_rules(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k long, name string, made long")
    new = spark.createDataFrame([(2, None, 9), (3, "c", 7)], "k long, name string, made long")
    got = merge.upserted(old, new, ["k"], keep_old=("made",))
    assert sorted(map(tuple, got.collect())) == [(1, "a", 5), (2, "b", 6), (3, "c", 7)]
    reset = merge.upserted(old, new, ["k"], rules={"made": F.when(F.col("n.name").isNull(), F.col("o.made")).otherwise(0)})
    assert {r["k"]: r["made"] for r in reset.collect()} == {1: 5, 2: 6, 3: 0}


def test_due_jobs(spark):
    now = dt.datetime(2024, 1, 1, 12)
    jobs = [("new", None, None, True), ("held", None, now + dt.timedelta(hours=1), True), ("fresh", now, None, True), ("old", now - dt.timedelta(hours=2), now, True), ("off", None, None, False)]
    frame = spark.createDataFrame([(n, 3600, s, lease, e) for n, s, lease, e in jobs], "name string, interval_seconds long, last_success_at timestamp, lease_until timestamp, enabled boolean")
    assert {r["name"] for r in merge.due(frame, F.lit(now)).collect()} == {"new", "old"}


def test_text_search_order(spark):
    docs = spark.createDataFrame([(40, "Quarterly billing export approval billing billing"), (41, "Gardening notes with billing once among many other words here"), (42, "nothing"), (43, None)], "id long, t string")
    assert [r["id"] for r in search.bm25(docs, "id", F.col("t"), ["billing", "export", "approval"]).orderBy("rank").collect()] == [40, 41]


def test_vectors(spark):
    frame = spark.createDataFrame([(1, [0.1, 0.2, 0.3]), (2, [0.9, 0.8, 0.7]), (3, [0.0, 0.0, 0.0]), (4, [1.0])], "id long, v array<float>")
    assert [r["id"] for r in search.top_k(frame, "id", "v", [0.1, 0.2, 0.3], 2).collect()] == [1, 2]
    bits = frame.select(vx.quantized_bits(F.array(*[F.lit(1.0 if i in (0, 33) else -1.0) for i in range(40)]))).first()[0]
    assert bits == [1, 2]
    assert frame.filter("id = 1").select(vx.quantized_u8(F.col("v"), F.lit(0.1), F.lit(0.3))).first()[0] == [0, 128, 255]
    with pytest.raises(ValueError):
        vx.distance(F.col("v"), F.col("v"), "other")


def test_reachability_on_a_cycle(spark):
    edges = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (1, 3, 1), (8, 9, 1)], "first_id long, second_id long, weight long")
    assert sorted(r["id"] for r in graph.reachable(edges, spark.range(1, 2)).collect()) == [1, 2, 3]


def test_text_functions(spark):
    row = spark.createDataFrame([("  Ünïted \n States ", "# Hello, World!", "<think>a</think> b <think>c", "a\n\n  \nb")], "a string, b string, c string, d string").select(
        tx.normalized_name(F.col("a")), tx.slug(F.col("b")), tx.without_thinking(F.col("c")), tx.paragraphs(F.col("d")), tx.slug(F.lit("!!")), tx.token_estimate(F.lit("one two three"))
    ).first()
    assert tuple(row) == ("united states", "hello-world", "b", ["a", "b"], "section", 4)


def test_markdown():
    page = "<html><head><title>T</title></head><body><nav>no</nav><article><h2>Head</h2><p>One <a href='/x'>link</a>.</p><ul><li>a</li><li>b</li></ul></article></body></html>"
    assert html.to_markdown(page) == "## Head\n\nOne [link](/x).\n\n- a\n- b"
    assert html.to_markdown(None) == ""


def test_folder_changes_and_sections(spark, tmp_path):
    (tmp_path / "a.md").write_text("intro\n# One\ntext\n# One\nmore [[b|B]]")
    (tmp_path / ".hidden").write_text("x")
    scanned = files.scan(spark, str(tmp_path))
    assert scanned.count() == 1
    path = scanned.first()["path"]
    known = spark.createDataFrame([(path, "other", None), ("gone.md", "x", None)], "path string, checksum string, deleted_at timestamp")
    assert {r["path"]: r["change"] for r in files.changes(scanned, known).collect()} == {path: "changed", "gone.md": "gone"}
    parts = files.anchors(scanned.withColumn("text", F.col("content").cast("string")), "path", F.col("text")).orderBy("section").collect()
    assert [(p["key"], p["start_line"], p["end_line"]) for p in parts] == [("document", 1, 1), ("one", 2, 3), ("one-2", 4, 5)]


def test_streams(spark, tmp_path):
    source, start = str(tmp_path / "in"), dt.datetime(2024, 1, 1)
    rows = [(1, start + dt.timedelta(seconds=s), a, 1.0) for s, a in ((0, "x"), (5, "x"), (9, "y"), (20, "x"), (7300, "z"), (99999, "end"))]
    spark.createDataFrame(rows, "user_id long, ts timestamp, application string, value double").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("user_id long, ts timestamp, application string, value double").parquet(source)
    for name, frame in (("acts", activity.activities(stream)), ("cnts", activity.counts(stream.withColumnRenamed("application", "event_type")))):
        run = frame.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        run.awaitTermination(120)
    got = {(r["application"], r["n_events"]) for r in spark.sql("SELECT * FROM acts").collect()}
    assert {("x", 2), ("y", 1), ("x", 1), ("z", 1)} <= got
    assert spark.sql("SELECT sum(n) FROM cnts").first()[0] >= 5
