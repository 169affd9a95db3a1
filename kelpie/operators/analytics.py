"""Time analytics over activities (id, start_time, application, tag_id, ...): durations are implied by what starts next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INACTIVE = ("PAUSED", "SLEEP")


def with_duration(activities: DataFrame, *by: str) -> DataFrame:
    """Seconds to the next start of the day; null for the last of a day. Ties go by id."""
    day = Window.partitionBy(F.to_date("start_time"), *by).orderBy("start_time", "id")
    seconds = lambda c: F.unix_timestamp(c.cast("timestamp"))
    return activities.withColumns({"day": F.to_date("start_time"), "seconds": seconds(F.lead("start_time").over(day)) - seconds(F.col("start_time"))})


def time_per_tag_day(activities: DataFrame) -> DataFrame:
    """Seconds by day and tag; inactive spans count as ends, not as time."""
    active = with_duration(activities).filter(~F.col("application").isin(*INACTIVE))
    return active.groupBy("day", "tag_id").agg(F.sum("seconds").alias("seconds"))


def tracked_share(per_day: DataFrame) -> DataFrame:
    """Tracked seconds against 40 hours a week, and the share that has a tag."""
    total, untagged = F.sum("seconds"), F.sum(F.when(F.col("tag_id").isNull(), F.col("seconds")))
    weeks = F.greatest((F.datediff(F.max("day"), F.min("day")) + 1) / 7, F.lit(1.0))
    return per_day.agg((total / (weeks * 40 * 3600)).alias("tracked"), (1 - F.coalesce(untagged, F.lit(0)) / total).alias("tagged"))


def dense_days(per_day: DataFrame) -> DataFrame:
    """Seconds of every day from the first to the last, 0 where there are none."""
    totals = per_day.groupBy("day").agg(F.sum("seconds").alias("seconds"))
    days = totals.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).select(F.explode(F.sequence("lo", "hi")).alias("day"))
    return days.join(totals, "day", "left").select("day", F.coalesce("seconds", F.lit(0)).alias("seconds"))


def islands(rows: DataFrame, key: str, by: list[str], order: list[str]) -> DataFrame:
    """Rows with `island`, the number of the run of equal keys that they are in."""
    w = Window.partitionBy(*by).orderBy(*order)
    changed = (~F.col(key).eqNullSafe(F.lag(key).over(w))) | (F.row_number().over(w) == 1)
    return rows.withColumn("__new", changed.cast("long")).withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def sessions(events: DataFrame) -> DataFrame:
    """Runs of one application of a user, as activities with start, end and number of events."""
    runs = islands(events, "application", ["user_id"], ["start_time", "id"])
    return runs.groupBy("user_id", "island", "application").agg(F.min("start_time").alias("start_time"), F.max("start_time").alias("end_time"), F.count("*").alias("n_events"))


def compacted(activities: DataFrame, shortest: int = 30) -> DataFrame:
    """Without inner activities of at most `shortest` seconds, then runs of one application merged: what the first has is kept."""
    w = Window.partitionBy("user_id").orderBy("start_time", "id")
    seconds = F.unix_timestamp(F.lead("start_time").over(w).cast("timestamp")) - F.unix_timestamp(F.col("start_time").cast("timestamp"))
    inner = F.lag("id").over(w).isNotNull() & F.lead("id").over(w).isNotNull()
    kept = activities.withColumn("__drop", inner & (seconds <= shortest)).filter("not __drop").drop("__drop")
    runs = islands(kept, "application", ["user_id"], ["start_time", "id"])
    first = lambda c: F.min_by(c, F.struct("start_time", "id")).alias(c)
    return runs.groupBy("user_id", "island").agg(F.min("start_time").alias("start_time"), first("id"), first("application"), F.count("*").alias("merged"))


def nearest_rank(column: str, share: float) -> Column:
    """The smallest value of a column that at least such a share of the rows doesn't exceed."""
    return F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY `{column}`)")


def timeline(activities: DataFrame, group: str) -> DataFrame:
    """Blocks of a user's day in seconds of the day: each activity but sleep lasts until the next starts, and adjacent blocks of one
    group are one. A day's last activity has no end and gives no block."""
    awake = activities.filter("application <> 'SLEEP'").withColumn("day", F.to_date("start_time"))
    w = Window.partitionBy("user_id", "day").orderBy("start_time", "id")
    second = lambda c: (F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)).cast("long")
    spans = awake.withColumns({"from_second": second("start_time"), "to_second": F.lead(second("start_time")).over(w)}).filter("to_second is not null")
    runs = islands(spans, group, ["user_id", "day"], ["start_time", "id"])
    return runs.groupBy("user_id", "day", group, "island").agg(F.min("from_second").alias("from_second"), F.max("to_second").alias("to_second")).drop("island")


def group_durations(activities: DataFrame, group: str, edited: DataFrame | None = None) -> DataFrame:
    """Positive seconds of each group of a user until whatever is next that day, and the edited ones (group, seconds) over them."""
    spans = with_duration(activities, "user_id").filter(F.col(group).isNotNull())
    sums = spans.groupBy(group).agg(F.sum(F.greatest(F.coalesce("seconds", F.lit(0)), F.lit(0))).alias("seconds"))
    if edited is None:
        return sums
    return sums.join(edited.select(group, F.col("seconds").alias("__edited")), group, "left").select(group, F.coalesce("__edited", "seconds").alias("seconds"))


def day_tag_maps(per_day: DataFrame, label: Column) -> DataFrame:
    """For each day its seconds by label, as a list by name without regard to case, 'Untagged' last."""
    named = per_day.groupBy("day", F.coalesce(label, F.lit("Untagged")).alias("label")).agg(F.sum("seconds").alias("seconds"))
    entry = F.struct((F.col("label") == "Untagged").alias("last"), F.lower("label").alias("key"), "label", "seconds")
    return named.groupBy("day").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.struct(e["label"], e["seconds"])).alias("tags"))


def valid_on(tags: DataFrame, day: Column) -> DataFrame:
    """Rows created by a day and not deleted before it."""
    return tags.filter((F.col("create_date") <= day) & (F.col("delete_date").isNull() | (F.col("delete_date") >= day)))


def by_first_start(activities: DataFrame, group: str) -> DataFrame:
    """The groups with the start of their first activity and their place in that order, ties by group; a row a group meets in one task."""
    firsts = activities.groupBy(group).agg(F.min("start_time").alias("first_start"))
    return firsts.withColumn("place", F.row_number().over(Window.orderBy("first_start", group)))
