"""Captured events as a stream with typed state, timers and expiry.

Events wait in the state until the watermark has passed them and are then taken in order, so that any split of the events into batches,
in any order that the watermark bears, gives what the events give all at once. A timer stands at the earliest event that waits, or where
a key that has been idle is closed and its state removed.

`activities` follows the rules of capture: activations within a second of the last accepted are dropped; an application other than the
last begins an activity; a release counts if its key was pressed, and its characters and what is said go to the activity unless it is a
pause; pauses don't follow themselves; shots that come over two minutes late or look like the last kept are dropped, and beyond nine the
one in the middle goes. Activities are final when three others have begun, or when the user has been idle.
`completed_builds` tells once when a build's scan is over and nothing of it is pending.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

from kelpie.functions.images import alike

#: Milliseconds between activations, how late a shot may be, how many shots are held, how many activities are open.
THROTTLE, LATEST, MOST_SHOTS, OPEN = 1000, 120_000, 9, 3
PAUSES = ("PAUSED", "SLEEP")

EVENT = "kind string, code long, text string, look binary"
STATE = "activated long, pressed array<long>, open array<struct<application:string,start:long,typed:string,said:string,shots:array<long>,times:array<long>,look:binary>>"
ACTIVITY = "key long, application string, start long, typed string, said string, shots array<long>"


class Capture:
    """The rules of capture for one user. Times are milliseconds."""

    event, state, out = EVENT, STATE, ACTIVITY

    def start(self) -> tuple:
        return (None, [], [])

    def step(self, state: tuple, at: int, id_: int, event: tuple) -> tuple[tuple, list[tuple]]:
        activated, pressed, open_ = state[0], list(state[1]), [tuple(x) for x in state[2]]
        kind, code, text, look = event
        inactive = bool(open_) and open_[-1][0] in PAUSES
        if kind == "activate" and (activated is None or at - activated >= THROTTLE):
            activated = at
            self._begin(open_, text, at, id_, look)
        elif kind == "seen":
            if open_ and open_[-1][0] == text and not inactive:
                self._shot(open_, at, id_, look)
            else:
                self._begin(open_, text, at, id_, look)
        elif kind == "shot" and open_ and not inactive:
            self._shot(open_, code if code is not None else at, id_, look)
        elif kind == "press" and code not in pressed:
            pressed.append(code)
        elif kind == "release" and code in pressed:
            pressed.remove(code)
            if open_ and not inactive:
                open_[-1] = (*open_[-1][:2], open_[-1][2] + (text or ""), *open_[-1][3:])
        elif kind == "said" and open_ and not inactive and text:
            said = open_[-1][3]
            open_[-1] = (*open_[-1][:3], f"{said} {text}" if said else text, *open_[-1][4:])
        elif kind == "pause" and not (open_ and open_[-1][0] == text):
            open_.append((text, at, "", "", [], [], None))
        final, open_ = open_[: max(len(open_) - OPEN, 0)], open_[max(len(open_) - OPEN, 0) :]
        return (activated, pressed, open_), self.rows(final)

    @staticmethod
    def _begin(open_: list, application: str, at: int, id_: int, look: bytes | None) -> None:
        if not application.endswith("loginwindow") and not (open_ and open_[-1][0] == application):
            open_.append((application, at, "", "", [id_], [at], look))

    @staticmethod
    def _shot(open_: list, at: int, id_: int, look: bytes | None) -> None:
        *head, shots, times, last = open_[-1]
        if alike(last, look) or (times and times[-1] - at > LATEST):
            return
        shots, times = [*shots, id_], [*times, at]
        if len(shots) > MOST_SHOTS:
            gone = max(1, len(shots) // 2)
            del shots[gone], times[gone]
        open_[-1] = (*head, shots, times, look)

    @staticmethod
    def rows(open_: list) -> list[tuple]:
        """Activities as they are given out; pauses aren't."""
        return [(a[0], a[1], a[2], a[3], list(a[4])) for a in open_ if a[0] not in PAUSES]

    def end(self, state: tuple) -> list[tuple]:
        return self.rows([tuple(x) for x in state[2]])


class Builds:
    """The counters of one build."""

    event = "kind string, described boolean"
    state = "files long, chunks long, nodes long, dirty boolean, scanned boolean"
    out = "key long, at long"
    #: What raises and lowers each counter.
    MORE, LESS = {"file_created": 0, "chunk_requested": 1, "node_created": 2, "node_updated": 2}, {"file_indexed": 0, "chunk_processed": 1, "node_embedded": 2}

    def start(self) -> None:
        return None

    def step(self, state: tuple | None, at: int, id_: int, event: tuple) -> tuple[tuple | None, list[tuple]]:
        kind, described = event
        if kind == "started":
            state = (0, 0, 0, False, False)
        elif state is None or kind == "failed":
            return None, []
        else:
            counts, dirty, scanned = list(state[:3]), state[3], state[4]
            if kind in self.MORE and (described or not kind.startswith("node")):
                counts[self.MORE[kind]] += 1
            if kind in self.LESS:
                counts[self.LESS[kind]] = max(counts[self.LESS[kind]] - 1, 0)
            dirty = kind in ("node_created", "edge_created") or (dirty and kind != "communities")
            state = (*counts, dirty, scanned or kind == "scanned")
        asks = kind in self.LESS or kind in ("started", "communities", "scanned")
        if asks and state[4] and not any(state[:3]) and not state[3]:
            return None, [(at,)]
        return state, []

    def end(self, state: tuple | None) -> list[tuple]:
        return []


def taken(machine: Any, state: Any, last: int | None, events: list[tuple], idle: int) -> tuple[Any, int | None, list[tuple]]:
    """The state and last time after events (at, id, event) in order, and what was given out; where the key was idle it was closed."""
    given: list[tuple] = []
    for at, id_, event in events:
        if last is not None and at - last > idle:
            given += machine.end(state)
            state = machine.start()
        state, rows = machine.step(state, at, id_, event)
        given, last = given + rows, at
    return state, last, given


class InOrder(StatefulProcessor):
    """Takes a key's events in order through a machine."""

    def __init__(self, machine: Any, idle: int) -> None:
        self.machine, self.idle = machine, idle
        self.columns = [c.split()[0] for c in machine.out.split(", ")]

    def init(self, handle) -> None:  # noqa: ANN001
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long, id long", self.machine.event)
        self.held = handle.getValueState("held", self.machine.state)
        self.times = handle.getValueState("times", "last long, timer long")

    def _timer(self, last: int | None, timer: int | None, wanted: int | None) -> None:
        if timer != wanted:
            if timer is not None and timer in set(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if wanted is not None:
                self.handle.registerTimer(wanted)
        self.times.update((last, wanted))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        first = None
        names = [c.split()[0] for c in self.machine.event.split(", ")]
        for frame in rows:
            frame = frame.astype(object).where(frame.notna(), None)
            for at, id_, *event in zip(frame["ms"], frame["id"], *(frame[n] for n in names), strict=True):
                self.waiting.updateValue((int(at), int(id_)), tuple(int(v) if n == "code" and v is not None else v for n, v in zip(names, event, strict=True)))
                first = int(at) if first is None else min(first, int(at))
        last, timer = self.times.get() if self.times.exists() else (None, None)
        waits = timer if timer is not None and (last is None or timer != last + self.idle) else None
        if first is not None:
            self._timer(last, timer, first if waits is None else min(first, waits))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        waiting = sorted((tuple(k), tuple(v)) for k, v in self.waiting.iterator()) if self.waiting.exists() else []
        due = [(at, id_, event) for (at, id_), event in waiting if at <= now]
        last, _ = self.times.get() if self.times.exists() else (None, None)
        state = tuple(self.held.get()) if self.held.exists() else self.machine.start()
        state, last, given = taken(self.machine, state, last, due, self.idle)
        for at, id_, _ in due:
            self.waiting.removeKey((at, id_))
        left = [k[0] for k, _ in waiting[len(due) :]]
        if not left and last is not None and last + self.idle <= now:  # closed; nothing of the key stays
            given += self.machine.end(state)
            self.held.clear()
            self.waiting.clear()
            self.times.clear()
        else:
            if state is None:
                self.held.clear()
            else:
                self.held.update(state)
            self._timer(last, None, min(left) if left else last + self.idle if last is not None else None)
        if given:
            yield pd.DataFrame([(key[0], *row) for row in given], columns=self.columns)

    def close(self) -> None:
        pass


def in_order(events: DataFrame, machine: Any, late: str, idle: int) -> DataFrame:
    """What a machine gives for the events (key, id, at: a timestamp, and the machine's) of each key. State needs the RocksDB store,
    which is set for the session where nothing is."""
    conf, name = events.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in conf.get(name):
        conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    timed = events.selectExpr("*", "unix_millis(at) as ms").withWatermark("at", late)
    return timed.groupBy("key").transformWithStateInPandas(InOrder(machine, idle), machine.out, "append", "EventTime")


def activities(events: DataFrame, late: str = "2 minutes", idle: int = 3_600_000) -> DataFrame:
    """Final activities of events (key, id, at, kind: activate, seen, press, release, said, shot or pause, code, text, look)."""
    return in_order(events, Capture(), late, idle)


def completed_builds(events: DataFrame, late: str = "2 minutes", idle: int = 86_400_000) -> DataFrame:
    """key and at (milliseconds) of builds, once each time they are complete, from events (key, id, at, kind, described)."""
    return in_order(events, Builds(), late, idle)
