"""Keyed state with timers: an outbox with a visibility timeout, and idempotency claims that expire.

Both take events in the order of their time stamps, whatever the order they arrive in: a
key's events wait in its state until the watermark has passed them, and a timer at the
earliest of what is due next (an event, or the end of a wait) goes through all that is
due, in order. So a result depends on the events alone and not on the batches that they
came in, and a restart from the checkpoint gives the same rows. What the watermark hasn't
passed yet stays in the state and comes with a later run. Times are in milliseconds.

Events of a null key or time are left out; events of equal time go by their number;
an unknown kind, or none, counts as a failure. State is held in RocksDB, see with_rocksdb().
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds for which a taken message is invisible, the longest wait after a failure (2^n), tries, seconds for which a finished message is remembered.
VISIBILITY, MOST_WAIT, MOST_TRIES, REMEMBERED = 600, 600, 5, 7 * 24 * 3600
#: Seconds for which a claim holds, and for which a result is kept.
CLAIM, RESULT = 60, 86400

# the process on the driver that reads a processor's state schema doesn't see the files sent to executors, so processors travel by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_rocksdb(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep their state in RocksDB, so the caller's settings stay."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    own.conf.set("spark.sql.session.timeZone", "UTC")
    return own


class InOrder(StatefulProcessor):
    """Goes through a key's events and the ends of its waits in order of time. A subclass gives the fields of its state, its start, and what an event and an end of a wait do."""

    fields, gives = "", ()

    def start(self, at: int) -> tuple:
        raise NotImplementedError

    def event(self, now: tuple, at: int, kind: str) -> tuple[tuple | None, list[tuple]]:
        """The state after an event, and rows (at, event, ...) to give out."""
        raise NotImplementedError

    def due(self, now: tuple) -> int | None:
        """When the state changes by itself, if no event comes first."""
        raise NotImplementedError

    def wake(self, now: tuple, at: int) -> tuple[tuple | None, list[tuple]]:
        """The state after that, None: forgotten."""
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.fields)
        self.waiting = handle.getListState("waiting", "at long, seq long, kind string")
        self.timer = handle.getValueState("timer", "at long")

    def _next_timer(self, at: int | None) -> None:
        before = self.timer.get()[0] if self.timer.exists() else None
        if at == before:
            return
        if before is not None:
            self.handle.deleteTimer(before)
        if at is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        more = [(r.at, r.seq, r.kind) for r in rows]
        self.waiting.appendList(more)
        before = self.timer.get()[0] if self.timer.exists() else None
        first = min(x[0] for x in more)
        if before is None or first < before:
            self._next_timer(first)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        past = timerValues.getCurrentWatermarkInMs()
        todo = sorted(self.waiting.get(), key=lambda x: (x[0], x[1])) if self.waiting.exists() else []
        now = tuple(self.held.get()) if self.held.exists() else None
        out: list[tuple] = []
        done = 0
        while True:
            end = None if now is None else self.due(now)
            at = todo[done][0] if done < len(todo) else None
            if end is not None and end < past and (at is None or end <= at):
                now, rows = self.wake(now, end)
            elif at is not None and at < past:
                now, rows = self.event(self.start(at) if now is None else now, at, todo[done][2])
                done += 1
            else:
                break
            out += rows
        if done == len(todo):
            self.waiting.clear()
        elif done:
            self.waiting.put([tuple(x) for x in todo[done:]])
        if now is None:
            self.held.clear()
        else:
            self.held.update(now)
        # the timer that brought us here is spent
        self.timer.clear()
        ahead = [x for x in (end, at) if x is not None]
        if ahead:
            self._next_timer(min(ahead))
        names = ["key", "at", "event", *self.gives]
        return iter([Row(**dict(zip(names, (*key, *r), strict=True))) for r in out])

    def close(self) -> None:
        pass


class Outbox(InOrder):
    """Each event is a worker that asks for the message, and what came of it: ok, fail or lost (no answer, as the worker died). A message is ready, pending (invisible until the end of its wait), delivered or dead."""

    fields, gives = "status string, tries int, visible long", ("tries", "visible_at")

    def start(self, at):
        return ("ready", 0, at)

    def event(self, now, at, kind):
        status, tries, visible = now
        if status in ("delivered", "dead"):
            return now, [(at, "gone", tries, None)]
        if status == "pending":
            return now, [(at, "refused", tries, visible)]
        if kind == "ok":
            return ("delivered", tries + 1, at + REMEMBERED * 1000), [(at, "delivered", tries + 1, None)]
        if kind == "lost":
            # taken, so invisible; the try isn't counted, as nobody reports it
            return ("pending", tries, at + VISIBILITY * 1000), [(at, "taken", tries, at + VISIBILITY * 1000)]
        tries += 1
        if tries >= MOST_TRIES:
            return ("dead", tries, at + REMEMBERED * 1000), [(at, "dead", tries, None)]
        again = at + min(2**tries, MOST_WAIT) * 1000
        return ("pending", tries, again), [(at, "retry", tries, again)]

    def due(self, now):
        return now[2] if now[0] != "ready" else None

    def wake(self, now, at):
        status, tries, _ = now
        return (None, []) if status != "pending" else (("ready", tries, at), [(at, "visible", tries, at)])


class Claims(InOrder):
    """Each event is a request with a key: claim asks for the right to run it, finish brings its result, fail gives it back."""

    fields, gives = "status string, until long", ("until",)

    def start(self, at):
        return ("free", at)

    def event(self, now, at, kind):
        status, until = now
        if kind == "claim":
            if status in ("free", "lapsed"):
                return ("claimed", at + CLAIM * 1000), [(at, "run" if status == "free" else "taken over", at + CLAIM * 1000)]
            return now, [(at, "busy" if status == "claimed" else "replayed", until)]
        if status == "done":
            return now, [(at, "ignored", until)]
        if kind == "finish":
            return ("done", at + RESULT * 1000), [(at, "stored", at + RESULT * 1000)]
        return None, [(at, "released", None)]

    def due(self, now):
        # a lapsed claim is remembered as long as a result, to tell a take-over from a first run
        return now[1]

    def wake(self, now, at):
        return (("lapsed", at + RESULT * 1000), []) if now[0] == "claimed" else (None, [])


def _in_order(events: DataFrame, key: str, ts: str, seq: str, kind: str, late: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    rows = events.select(F.col(key).alias("key"), F.col(ts).alias("_ts"), F.unix_millis(ts).alias("at"), F.col(seq).cast("long").alias("seq"), F.col(kind).alias("kind"))
    rows = rows.where("key is not null and _ts is not null")
    return rows.withWatermark("_ts", late).groupBy("key").transformWithState(processor, schema, "append", "eventTime")


def outbox_log(events: DataFrame, key: str, ts: str, seq: str, kind: str, late: str = "1 hour") -> DataFrame:
    """(key, at, event, tries, visible_at) of a stream: delivered, retry, taken, dead, refused or gone for each event, and visible when a wait has ended. Dead letters are the rows of that event."""
    return _in_order(events, key, ts, seq, kind, late, Outbox(), "key long, at long, event string, tries int, visible_at long")


def claim_log(events: DataFrame, key: str, ts: str, seq: str, kind: str, late: str = "1 hour") -> DataFrame:
    """(key, at, event, until) of a stream: run, taken over, busy or replayed for each claim, stored, released or ignored for each end. A key's state goes once its result or lapsed claim is out of date."""
    return _in_order(events, key, ts, seq, kind, late, Claims(), "key long, at long, event string, until long")
