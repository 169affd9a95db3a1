"""Filters, scopes and orders that queries over activities and knowledge share."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Types of entities that are kept, and the bounds of limits.
ENTITY_TYPES = ("organization", "person", "place", "product")
MOST_TREES, MOST_GRAPH = 50, 10


def on_day(column: str, day: str) -> Column:
    """From the day's start to before the next day's: a range that a scan can be pruned by."""
    begin = datetime.date.fromisoformat(day)
    return (F.col(column) >= F.lit(str(begin)).cast("timestamp_ntz")) & (F.col(column) < F.lit(str(begin + datetime.timedelta(1))).cast("timestamp_ntz"))


def between_dates(column: str, first: str, last: str) -> Column:
    """By date, both ends included."""
    return F.to_date(column).between(F.lit(first).cast("date"), F.lit(last).cast("date"))


def optional(**values: object) -> Column:
    """Columns equal the values given; None asks nothing."""
    asked = F.lit(True)
    for name, value in values.items():
        if value is not None:
            asked &= F.col(name) == F.lit(value)
    return asked


def other_than(column: str, value: str) -> Column:
    """Not that value; null isn't it."""
    return F.coalesce(F.col(column), F.lit("")) != value


def in_list(column: str, values: list) -> Column:
    """Whether the column is in the list; an empty list matches nothing."""
    return F.col(column).isin(values) if values else F.lit(False)


def clamped(value: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def candidates_for(limit: int) -> int:
    """How many candidates a source gives for so many results."""
    return min(max(3 * limit, 9), 45)


def valid_entity(name: Column, kind: Column) -> Column:
    """Of a kept type, with a capital letter or a digit in its name."""
    return F.coalesce(F.lower(kind).isin(*ENTITY_TYPES) & name.rlike(r"[\p{Lu}\p{N}]"), F.lit(False))


def not_blank(text: str) -> Column:
    return F.coalesce(F.trim(text) != "", F.lit(False))


def missing_work(rows: DataFrame, summary: str, vector: str, tag: str, group: str) -> DataFrame:
    """The rows that lack a step, and which: vector, tag or group, the first that is missing."""
    has = {c: F.col(c).isNotNull() for c in (vector, tag, group)}
    step = F.when(not_blank(summary) & ~has[vector], "vector").when(has[vector] & ~has[tag], "tag").when(has[tag] & ~has[group], "group")
    return rows.withColumn("step", step).filter("step is not null")


def page_after(rows: DataFrame, id_col: str, after: int, size: int = 200) -> DataFrame:
    """The next rows by id."""
    return rows.filter(F.col(id_col) > after).orderBy(id_col).limit(size)


def all_but_newest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Every row of a key but its first in the order."""
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__rn > 1").drop("__rn")


def latest_first(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The last n rows, the newest first."""
    return rows.orderBy(*(F.desc(c) for c in order)).limit(n)


def seeds_first(rows: DataFrame, seeds: DataFrame, key: str, n: int, *order: Column) -> DataFrame:
    """n rows, those of the seeds before others."""
    marked = rows.join(seeds.select(key).distinct().withColumn("__seed", F.lit(1)), key, "left").withColumn("seed", F.col("__seed").isNotNull()).drop("__seed")
    return marked.orderBy(F.desc("seed"), *order, key).limit(n)


def difference(ids: DataFrame, gone: DataFrame) -> DataFrame:
    """Distinct ids that aren't among the others."""
    return ids.distinct().join(gone.distinct(), ids.columns, "left_anti")
