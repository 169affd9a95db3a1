"""Operators of records on small fixtures: nulls, ties, empty tables."""

import datetime as dt

from pyspark.sql import functions as F

from kelpie.plans import record_queries as r


def test_day_list(spark):
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 2, 3),), (dt.datetime(2024, 1, 2, 9),), (None,)], "start_time timestamp_ntz")
    days = {x.day for x in r.day_list(rows, "2024-01-05").collect()}
    assert days == {dt.date(2024, 1, 2), dt.date(2024, 1, 5)}
    assert [x.day for x in r.day_list(rows.limit(0), "2024-01-05").collect()] == [dt.date(2024, 1, 5)]


def test_counters(spark):
    rows = spark.createDataFrame([(1, None), (2, 5)], "a int, b int")
    counts = {"rows": F.count("*"), "sum": F.sum("b")}
    got = r.counters(one=(rows, counts), two=(rows.limit(0), {"none": F.sum("a"), "left": F.count("*")})).first()
    assert got.asDict() == {"rows": 2, "sum": 5, "none": 0, "left": 0}


def test_best_of_groups(spark):
    rows = spark.createDataFrame([("b", 1), ("a", 1), ("a", 3), ("c", 2), (None, 0), ("d", None)], "g string, rank int")
    assert [tuple(x) for x in r.best_of_groups(rows, "g", "rank", 2).collect()] == [("a", 1), ("b", 1)]
    assert r.best_of_groups(rows.limit(0), "g", "rank", 2).collect() == []


def test_normalised(spark):
    rows = spark.createDataFrame([(2.0,), (4.0,), (3.0,), (None,)], "v double")
    assert sorted(str(x.s) for x in r.normalised(rows, "v", "s").collect()) == ["0.0", "0.5", "1.0", "None"]
    assert {x.s for x in r.normalised(rows.filter("v = 2"), "v", "s").collect()} == {1.0}
    assert r.normalised(rows.limit(0), "v", "s").collect() == []


def test_linked_to(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (1, 2), (None, 2)], "one int, two int")
    wanted = spark.createDataFrame([(2,), (2,), (None,)], "one int")
    assert {tuple(x) for x in r.linked_to(links, "one", "two", wanted).collect()} == {(1, 2), (2, 3), (None, 2)}
    assert r.linked_to(links, "one", "two", wanted.limit(0)).collect() == []


def test_numbered_names(spark):
    rows = spark.createDataFrame([(i, " One" if i % 2 else "one ") for i in range(300)] + [(900, "two"), (901, None), (902, None)], "id int, name string")
    got = {x.id: x.unique_name for x in r.numbered_names(rows, "id", "name").collect()}
    assert sorted(got[i] for i in range(300)) == sorted(["one", *(f"one {n}" for n in range(2, 301))]) and got[900] == "two"
    assert got[901] is None and got[902] is None
    assert r.numbered_names(rows.limit(0), "id", "name").collect() == []
