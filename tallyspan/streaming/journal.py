"""A journal of job events, checked record by record.

Each instance writes a header and then events numbered without a gap, with
times that never fall.  An invocation that begins must end with the record of
the same id before its deadline; no other record extends it.  Any break of
these rules is an error of the instance that stays: disorder is never mended
by sorting.  ``watch`` keeps that state in Structured Streaming; ``deadlines``
and ``sequence_errors`` are the same questions asked of a finished journal.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

SCHEMA = "instance string, seq bigint, elapsed_ms bigint, event string, phase string, invocation bigint, limit_ms bigint"
OUTPUT = "instance string, seq bigint, status string, detail string"


def deadlines(rows: DataFrame, key: str, id: str, order: list[str], ms: str, begins: Column, ends: Column, limit: int) -> DataFrame:
    """key, opened, never_ended, late: invocations of each key, those no later end of their id closes, and those it closes past the limit."""
    # Read backwards, the next end is the last one seen: one pass over each invocation's rows.
    backwards = Window.partitionBy(key, id).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    closed = rows.withColumn("_end", F.last_value(F.when(ends, F.col(ms)), ignoreNulls=F.lit(True)).over(backwards)).where(begins)
    return closed.groupBy(key).agg(F.count(F.lit(1)).alias("opened"), F.count(F.when(F.col("_end").isNull(), 1)).alias("never_ended"), F.count(F.when(F.col("_end") > F.col(ms) + limit, 1)).alias("late"))


def sequence_errors(rows: DataFrame) -> DataFrame:
    """instance, seq, error: the first record of each instance that breaks the sequence; ``no end`` if none does and the last isn't terminal.

    ``rows`` hold ``arrived``, the order in which the journal holds them.
    """
    w = Window.partitionBy("instance").orderBy("arrived")
    place = F.row_number().over(w)
    why = (
        F.when((place == 1) & (F.col("event") != "header"), "no header")
        .when((place > 1) & (F.col("event") == "header"), "second header")
        .when(F.col("seq") != place - 1, "gap in sequence")
        .when(F.col("elapsed_ms") < F.lag("elapsed_ms").over(w), "time falls")
        .when(F.lag("event").over(w) == "terminal", "event after the end")
    )
    held = rows.withColumn("error", why)
    first = held.where("error is not null").groupBy("instance").agg(F.min(F.struct("arrived", "seq", "error")).alias("e")).select("instance", "e.seq", "e.error")
    last = rows.groupBy("instance").agg(F.max(F.struct("arrived", "seq", "event")).alias("l"))
    unended = last.join(first.select("instance"), "instance", "left_anti").where("l.event <> 'terminal'").select("instance", "l.seq", F.lit("no end").alias("error"))
    return first.unionByName(unended)


class Watch:
    """One instance's state: what a record does to it, and which deadlines a time passes."""

    def __init__(self, held: tuple | None = None):
        if held is None:
            held = (0, 0, None, False, None, [], [], None)
        self.next_seq, self.last_ms, self.phase, self.ended, self.error = held[:5]
        self.open = dict(zip(held[5], held[6], strict=True))
        self.offset = held[7]

    def anchor(self, wall_ms: int, elapsed_ms: int) -> None:
        """How far the watcher's clock is ahead of the instance's, at most: records arrive late, never early."""
        ahead = wall_ms - elapsed_ms
        self.offset = ahead if self.offset is None else min(self.offset, ahead)

    def fail(self, seq: int, why: str) -> list[tuple]:
        self.error = why
        return [(seq, "error", why)]

    def take(self, r) -> list[tuple]:
        """Rows (seq, status, detail) that a record gives; an instance in error gives no more."""
        if self.error:
            return []
        if self.ended:
            return self.fail(r.seq, "event after the end")
        if "error" in r.__fields__ and r["error"]:
            return self.fail(self.next_seq, r["error"])
        if r.seq != self.next_seq:
            return self.fail(r.seq, "gap in sequence")
        if (r.seq == 0) != (r.event == "header"):
            return self.fail(r.seq, "no header" if r.seq == 0 else "second header")
        if r.elapsed_ms < self.last_ms:
            return self.fail(r.seq, "time falls")
        self.next_seq, self.last_ms = r.seq + 1, r.elapsed_ms
        out = self.passed(r.seq, r.elapsed_ms, keep=r.invocation if r.event == "end" else None)
        if r.event == "phase":
            if self.open:
                return self.fail(r.seq, "phase changes while an invocation is open")
            self.phase = r.phase
        elif r.event == "begin":
            if r.invocation in self.open:
                return self.fail(r.seq, "invocation begins twice")
            self.open[int(r.invocation)] = int(r.elapsed_ms + r.limit_ms)
        elif r.event == "end":
            if r.invocation not in self.open:
                return self.fail(r.seq, "end without a beginning")
            until = self.open.pop(int(r.invocation))
            late = until < 0 or r.elapsed_ms > until
            out.append((r.seq, "late" if late else "done", str(int(r.invocation))))
        elif r.event == "terminal":
            if self.open:
                return self.fail(r.seq, "ends with an open invocation")
            self.ended = True
            out.append((r.seq, "ended", None))
        return out

    def passed(self, seq: int, now: int, keep: int | None = None) -> list[tuple]:
        """Invocations whose deadline this time passes; each is told once."""
        over = [i for i, until in self.open.items() if 0 <= until < now and i != keep]
        for i in over:
            self.open[i] = -1
        return [(seq, "overdue", str(i)) for i in over]


INSTANCE = "next_seq bigint, last_ms bigint, phase string, ended boolean, error string, offset bigint"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Watcher(StatefulProcessor):
    """The state of each instance: one value, a map of its open invocations, and a timer for each deadline.

    A deadline is a time of the instance's own clock.  Its timer stands at that
    time on the watcher's clock, as far as the difference is known; whenever a
    record shows the difference to be smaller, all timers move up.
    """

    def __init__(self, wake: bool):
        self._wake = wake

    def init(self, handle) -> None:
        self._handle = handle
        self._instance = handle.getValueState("instance", INSTANCE)
        self._open = handle.getMapState("open", "invocation bigint", "until bigint")

    def close(self) -> None:
        pass

    def _loaded(self) -> Watch:
        held = tuple(self._instance.get()) if self._instance.exists() else (0, 0, None, False, None, None)
        pairs = [(k[0], v[0]) for k, v in self._open.iterator()] if self._open.exists() else []
        return Watch((*held[:5], [k for k, _ in pairs], [v for _, v in pairs], held[5]))

    def _stored(self, watch: Watch, before: dict) -> None:
        self._instance.update((watch.next_seq, watch.last_ms, watch.phase, watch.ended, watch.error, watch.offset))
        for gone in before.keys() - watch.open.keys():
            self._open.removeKey((gone,))
        for k, until in watch.open.items():
            if before.get(k) != until:
                self._open.updateValue((k,), (until,))

    def _timers(self, watch: Watch) -> None:
        """Exactly the timers that the open invocations ask for now."""
        if not self._wake:
            return
        silent = watch.error or watch.ended or watch.offset is None
        wanted = set() if silent else {until + watch.offset + 1 for until in watch.open.values() if until >= 0}
        held = set(self._handle.listTimers())
        for at in held - wanted:
            self._handle.deleteTimer(at)
        for at in wanted - held:
            self._handle.registerTimer(at)

    @staticmethod
    def _rows(key: tuple, found: list[tuple]) -> Iterator[Row]:
        return iter([Row(instance=key[0], seq=seq, status=status, detail=detail) for seq, status, detail in found])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        watch, wall = self._loaded(), int(time.time() * 1000)
        before, found = dict(watch.open), []
        rows = list(rows)
        if rows and "at" in rows[0].__fields__:
            rows.sort(key=lambda r: (r["file"], r["at"]))  # the order in which the journal holds them
        for r in rows:
            watch.anchor(wall, int(r["elapsed_ms"] or 0))
            found += watch.take(r)
        self._stored(watch, before)
        self._timers(watch)
        return self._rows(key, found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        watch = self._loaded()
        before = dict(watch.open)
        found = watch.passed(watch.next_seq - 1, expiredTimerInfo.getExpiryTimeInMs() - watch.offset)
        self._stored(watch, before)
        return self._rows(key, found)


def _stateful(spark) -> None:
    """State that is read key by key lives in RocksDB; a session that names another store keeps it and is told so by Spark."""
    if not spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)


def watch(stream: DataFrame, wake: bool = False) -> DataFrame:
    """instance, seq, status, detail: what each record of a stream of ``SCHEMA`` settles, in the order in which records arrive.

    A stream with ``file`` and ``at``, as ``tail`` gives, is taken in the order
    of the file; one with ``error`` breaks its instance at a record that has one.
    With ``wake``, for streams that run on, every open invocation has a timer,
    and one whose instance falls silent is told overdue once the watcher's
    clock passes its deadline, by the instance's last record; it isn't told
    again.  A query that ends when all input is read has no one to wake it, and
    would never end with ``wake``: ``unended`` says what it left open.
    """
    _stateful(stream.sparkSession)
    return stream.groupBy("instance").transformWithState(Watcher(wake), OUTPUT, "append", "ProcessingTime" if wake else "None")


def unended(spark, checkpoint: str) -> DataFrame:
    """instance, next_seq, error: instances that a watching query left in error or without a terminal record, from its state."""
    read = lambda name: spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
    held = read("instance").select("key.instance", "value.next_seq", "value.ended", "value.error")
    return held.where("not ended or error is not null").select("instance", "next_seq", F.coalesce("error", F.lit("no end")).alias("error"))


class Pacer(StatefulProcessor):
    """One timer for each key, which every line that shows progress sets anew."""

    def __init__(self, wait_ms: int):
        self._wait = wait_ms

    def init(self, handle) -> None:
        self._handle = handle
        self._held = handle.getValueState("progress", "n bigint, last string")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n, last = tuple(self._held.get()) if self._held.exists() else (0, None)
        moved = not self._held.exists()  # the wait for the first progress begins with the first line
        for r in rows:
            if r["progress"]:
                n, last, moved = n + 1, r["line"], True
        self._held.update((n, last))
        if moved:
            for at in list(self._handle.listTimers()):
                self._handle.deleteTimer(at)
            self._handle.registerTimer(int(time.time() * 1000) + self._wait)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        n, last = tuple(self._held.get())
        return iter([Row(key=key[0], n=n, last=last)])


def paced(stream: DataFrame, key: str, line: str, progress: Column, wait_ms: int) -> DataFrame:
    """key, n, last: keys that show no progress for ``wait_ms``, with how many lines showed some and the last of those.

    Lines without progress don't restart the wait.  A key that goes on after
    that, by a line with progress, may stall again.
    """
    _stateful(stream.sparkSession)
    lines = stream.select(F.col(key).cast("string").alias("key"), F.col(line).cast("string").alias("line"), F.coalesce(progress, F.lit(False)).alias("progress"))
    return lines.groupBy("key").transformWithState(Pacer(wait_ms), "key string, n bigint, last string", "append", "ProcessingTime")


def idle_spans(rows: DataFrame, key: str, at: str, progress: Column, wait: str) -> DataFrame:
    """key, first, last, n: sessions of lines that count as progress; a pause longer than ``wait`` ends one."""
    held = rows.where(progress).select(key, F.col(at).cast("timestamp").alias("_at"))
    found = held.groupBy(key, F.session_window("_at", wait).alias("s")).agg(F.min("_at").alias("first"), F.max("_at").alias("last"), F.count(F.lit(1)).alias("n"))
    return found.select(key, "first", "last", "n")
