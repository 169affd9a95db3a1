"""What happens to captured events before they are activities: rules that look at the rows of one key in order.

Rules that need only neighbours are windows. Those that carry a state walk the rows of each key in order, partition by partition,
and hold the state of one key at a time, so no key's rows have to fit in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values, in seconds and numbers: the shortest time between activations, how late a shot may come, how many are held.
THROTTLE, LATEST, MOST_SHOTS = 1.0, 120.0, 9


def walked(rows: DataFrame, key: str, order: list[str], start: Callable[[], object], step: Callable[[object, dict], tuple[object, list[dict]]], end: Callable[[object], list[dict]], schema: str) -> DataFrame:
    """The rows that `step` gives for each row of a key in order, with the state it carries, and those that `end` gives for the last
    state of the key."""
    kinds = _arrow(schema)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, out = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                if at is None or row[key] != at[0]:
                    if at is not None:
                        out += end(state)
                    at, state = (row[key],), start()
                state, made = step(state, row)
                out += made
            if out:
                yield pa.RecordBatch.from_pylist(out, kinds)
                out = []
        if at is not None and (out := end(state)):
            yield pa.RecordBatch.from_pylist(out, kinds)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(walk, schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in schema.split(", "))])


def _no_rows(_: object) -> list[dict]:
    return []


def throttled(activations: DataFrame, key: str) -> DataFrame:
    """key, id and at of the activations (at in seconds) that come no sooner than a second after the last that was accepted."""

    def step(last, row):
        if last is not None and row["at"] - last < THROTTLE:
            return last, []
        return row["at"], [row]

    return walked(activations.select(key, "id", "at"), key, ["at", "id"], lambda: None, step, _no_rows, f"{key} long, id long, at double")


def held_shots(shots: DataFrame, key: str) -> DataFrame:
    """key and id of the shots that a key's bounded buffer holds at the end: beyond nine, the one in the middle goes, the first never."""

    def step(held, row):
        held.append(row)
        if len(held) > MOST_SHOTS:
            del held[max(1, len(held) // 2)]
        return held, []

    return walked(shots.select(key, "id", "at"), key, ["at", "id"], list, step, lambda held: [{key: r[key], "id": r["id"]} for r in held], f"{key} long, id long")


def admitted(shots: DataFrame, key: str, arrival: str, at: str, alike: Column | None = None) -> DataFrame:
    """The shots that aren't over two minutes older than the newest that arrived before, nor near duplicates."""
    before = Window.partitionBy(key).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    late = F.coalesce(F.max(at).over(before) - F.col(at) > LATEST, F.lit(False))
    kept = shots.withColumn("__late", late).filter("not __late").drop("__late")
    return kept if alike is None else kept.filter(~alike)


def paired_keys(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The releases (kind 'release') that follow a press of the same code without another release between."""
    same = Window.partitionBy(key, "code").orderBy(*order)
    return events.withColumn("__before", F.lag("kind").over(same)).filter("kind = 'release' and __before = 'press'").drop("__before")


def typed_text(presses: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The characters of each activity's presses, in order."""
    typed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "chars"))), lambda x: x["chars"]), "")
    return presses.groupBy(group).agg(typed.alias("typed"))


def said_text(pieces: DataFrame, group: str, order: list[str], inactive: Column) -> DataFrame:
    """What was said during each activity, parted by blanks; what was said while inactive is left out."""
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "text"))), lambda x: F.trim(x["text"])), " ")
    return pieces.filter(~inactive & (F.trim("text") != "")).groupBy(group).agg(said.alias("said"))


def single_markers(rows: DataFrame, key: str, order: list[str], kind: str, markers: tuple[str, ...]) -> DataFrame:
    """The rows without markers that follow the same marker."""
    before = F.lag(kind).over(Window.partitionBy(key).orderBy(*order))
    again = F.col(kind).isin(*markers) & F.coalesce(F.col(kind) == F.col("__before"), F.lit(False))
    return rows.withColumn("__before", before).withColumn("__again", again).filter("not __again").drop("__before", "__again")


def final_rows(rows: DataFrame, key: str, order: list[str], offset: int, ready: Column) -> DataFrame:
    """The rows at least `offset` from their key's end that are ready."""
    back = F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc(c) for c in order)))
    return rows.withColumn("__back", back).filter((F.col("__back") > offset) & ready).drop("__back")


def first_writes(rows: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """Of each key and field the first value that isn't null."""
    return rows.groupBy(key).agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in fields))


def trailing_counts(events: DataFrame, at: str, kind: str, seconds: int = 60) -> DataFrame:
    """The events with how many of their kind came in the seconds up to them, and the rate a second."""
    last = Window.partitionBy(kind).orderBy(at).rangeBetween(-seconds + 1, 0)
    return events.withColumn("recent", F.count("*").over(last)).withColumn("rate", F.col("recent") / seconds)


def backlog(queued: DataFrame, active: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Of each key in any of the three its numbers of queued, active and done rows."""
    counts = [rows.groupBy(key).agg(F.count("*").alias(name)) for name, rows in (("queued", queued), ("active", active), ("done", done))]
    every = counts[0].join(counts[1], key, "full").join(counts[2], key, "full")
    return every.na.fill(0, ["queued", "active", "done"])


def completed_builds(events: DataFrame) -> DataFrame:
    """build and items of the builds (build, kind: scanned, queued, finished) whose scan ended and that have nothing pending, and
    when the last event came (at)."""
    n = lambda kind: F.sum((F.col("kind") == kind).cast("long"))
    sums = events.groupBy("build").agg(n("scanned").alias("scans"), n("queued").alias("items"), n("finished").alias("finished"), F.max("at").alias("at"))
    return sums.filter("scans > 0 and finished >= items").select("build", "items", "at")


def new_chunks(chunks: DataFrame, store: DataFrame, file: str) -> DataFrame:
    """Chunks whose hash is new: of a file's equal chunks the first by ordinal, without those that the store has for the file."""
    first = F.row_number().over(Window.partitionBy(file, "hash").orderBy("ordinal"))
    return chunks.withColumn("__n", first).filter("__n = 1").drop("__n").join(store.select(file, "hash"), [file, "hash"], "left_anti")


def not_stale(requests: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Requests of their key's current generation (key, generation)."""
    return requests.join(current.select(key, F.col("generation").alias("__now")), key).filter("generation = __now").drop("__now")
