"""Followed commands as byte streams: chunks that cut lines, line ends and characters anywhere, with typed state per capture and side.

`transformWithState` keeps, for each side of each capture, the line that has no end yet, the number of the chunk that comes next, chunks that came
too early, and the state of the operator that takes the lines. Chunks may come in any order and any number of batches. A timer per side flushes what
is held after `idle` milliseconds without a chunk; a shorter one, after the command's exit was seen, ends a side whose pipe stays open (`incomplete`). Timers
run on processing time, or on event time, where a replay gives the same rows whatever the batches: a gap of `idle` within a batch flushes as well.

A line of 64 KiB turns its side into plain passage for good; from then on bytes go out as they come.

Chunks: capture_id, side, seq (from 0), at (timestamp), bytes (null: none), ended (the pipe is closed), exited (the command has ended).
Rows out: capture_id, side, line_no, line (bytes), raw (bytes in passage rather than a line), incomplete.
State needs the RocksDB provider: start queries within `state_store(spark)`.
"""

from __future__ import annotations

import contextlib
import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from sparkfold.streaming import live

#: A line of so many bytes ends the shortening of its side.
LONGEST = 64 * 1024
#: Milliseconds without a chunk after which held output is shown, and after an exit until an open pipe is given up.
IDLE, GRACE = 2000, 500
#: Bytes of chunks that came too early and wait in memory; the rest waits in the state store.
EARLY = 4 << 20

_OUT = "capture_id long, side string, line_no long, line binary, raw boolean, incomplete boolean"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextlib.contextmanager
def state_store(spark: SparkSession):
    """Queries started within keep their state in RocksDB; the session's setting comes back afterwards."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


class Shown:
    """What becomes of lines. step(state, line_no, line, out) for a line, step(state, None, None, out) for a flush; `state` is a dict of plain values and
    `out` takes (line_no, text). `held` tells whether a flush would show anything."""

    def __init__(self, fresh: dict, step: Callable, held: Callable[[dict], bool] = lambda state: False):
        self.fresh, self.step, self.held = fresh, step, held


class Side(StatefulProcessor):
    """Lines of one side of one capture, and what `shown` makes of them; without it, the lines themselves."""

    def __init__(self, shown: Shown | None = None, idle: int = IDLE, grace: int = GRACE, longest: int = LONGEST):
        self.shown, self.idle, self.grace, self.longest = shown, idle, grace, longest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.side = handle.getValueState("side", "partial binary, line_no long, next long, last long, raw boolean, done boolean, exited boolean")
        self.early = handle.getMapState("early", "seq long", "at long, bytes binary, ended boolean, exited boolean")
        self.own = handle.getValueState("own", "value string")

    def _load(self) -> None:
        self.partial, self.no, self.next, self.last, self.raw, self.done, self.exited = self.side.get() if self.side.exists() else (b"", 0, 0, None, False, False, False)
        self.partial = bytes(self.partial)
        if self.shown:
            self.state = json.loads(self.own.get()[0]) if self.own.exists() else dict(self.shown.fresh)
        self.out: list[tuple] = []

    def _store(self) -> None:
        self.side.update((self.partial, self.no, self.next, self.last, self.raw, self.done, self.exited))
        if self.shown:
            self.own.update((json.dumps(self.state),))

    def _rows(self, key: tuple) -> Iterator[Row]:
        for no, line, raw, incomplete in self.out:
            yield Row(capture_id=key[0], side=key[1], line_no=no, line=line, raw=raw, incomplete=incomplete)

    def _flush(self) -> None:
        if self.shown:
            said: list[tuple] = []
            self.shown.step(self.state, None, None, said)
            self.out += [(no, text.encode("utf-8", "surrogateescape"), False, False) for no, text in said]

    def _line(self, line: bytes) -> None:
        if self.shown:
            said: list[tuple] = []
            self.shown.step(self.state, self.no, line.decode("utf-8", "surrogateescape"), said)
            self.out += [(no, text.encode("utf-8", "surrogateescape"), False, False) for no, text in said]
        else:
            self.out.append((self.no, line, False, False))
        self.no += 1

    def _pass(self, data: bytes) -> None:
        if data:
            self.out.append((self.no, data, True, False))
            self.no += 1

    def _feed(self, data: bytes) -> None:
        if self.raw:
            self._pass(data)
            return
        parts = (self.partial + data).split(b"\n")
        for k, line in enumerate(parts):
            if len(line) >= self.longest:
                self._flush()
                self.raw, self.partial = True, b""
                self._pass(b"\n".join(parts[k:]))
                return
            if k + 1 < len(parts):
                self._line(line)
        self.partial = parts[-1]

    def _end(self, incomplete: bool = False) -> None:
        if self.done:
            return
        if self.partial:
            self._line(self.partial)
            self.partial = b""
        self._flush()
        self.done = True
        if incomplete:
            self.out.append((self.no, b"", False, True))

    def _take(self, at: int, data: bytes | None, ended: bool | None, exited: bool | None) -> None:
        if self.last is not None and at - self.last >= self.idle and not self.done:
            self._flush()  # as the timer would have done between batches
        self.last = at
        self._feed(bytes(data or b""))
        self.exited = self.exited or bool(exited)
        if ended:
            self._end()
        self.next += 1

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        self._load()
        early, held = {}, 0
        for r in rows:
            at = r.ms
            if r.seq < self.next:
                continue  # known already
            if r.seq > self.next:
                if held < EARLY:
                    early[r.seq] = (at, r.bytes, r.ended, r.exited)
                    held += len(r.bytes or b"")
                else:
                    self.early.updateValue((r.seq,), (at, r.bytes, r.ended, r.exited))
                continue
            self._take(at, r.bytes, r.ended, r.exited)
            while self.next in early:
                self._take(*early.pop(self.next))
            yield from self._rows(key)
            self.out = []
        while True:
            if self.next in early:
                self._take(*early.pop(self.next))
            elif self.early.exists() and self.early.containsKey((self.next,)):
                chunk = (self.next,)
                self._take(*self.early.getValue(chunk))
                self.early.removeKey(chunk)
            else:
                break
        for seq, chunk in early.items():
            self.early.updateValue((seq,), chunk)
        yield from self._rows(key)
        self._wait(timerValues)
        self._store()

    def _wait(self, timers) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if self.done or self.last is None:
            return
        by_event = timers.getCurrentWatermarkInMs() >= 0 and self.clock == "EventTime"
        now = self.last if by_event else timers.getCurrentProcessingTimeInMs()
        if self.exited:
            self.handle.registerTimer(max(now + self.grace, timers.getCurrentWatermarkInMs() + 1 if by_event else 0))
        elif self.shown and self.shown.held(self.state):
            self.handle.registerTimer(max(now + self.idle, timers.getCurrentWatermarkInMs() + 1 if by_event else 0))

    clock = "ProcessingTime"

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._load()
        if self.exited:
            self._end(incomplete=True)
        else:
            self._flush()
        yield from self._rows(key)
        self._store()

    def close(self) -> None:
        pass


def sides(chunks: DataFrame, shown: Shown | None = None, clock: str = "ProcessingTime", idle: int = IDLE, grace: int = GRACE, longest: int = LONGEST) -> DataFrame:
    """What `shown` makes of the lines of each capture and side. With the clock "EventTime", `chunks` must have a watermark on `at`."""
    processor = Side(shown, idle, grace, longest)
    processor.clock = clock
    return chunks.withColumn("ms", F.unix_millis("at")).groupBy("capture_id", "side").transformWithState(processor, _OUT, "Append", clock)


def log_runs() -> Shown:
    """Runs of lines that differ only in their timestamp, as one line with their number."""

    def flush(own: dict, out: list) -> None:
        if own["n"]:
            out.append((own["first"], own["line"] + (f" ×{own['n']}" if own["n"] > 1 else "")))
        own["n"] = 0

    def step(own: dict, no: int | None, line: str | None, out: list) -> None:
        if line is None:
            flush(own, out)
            return
        clean = live.without_escapes(line).rstrip(" \t\n\f\r")
        mark = live.without_time(clean)
        if clean and own["n"] and mark == own["line"]:
            own["n"] += 1
            return
        flush(own, out)
        if clean:
            own.update(first=no, line=mark, n=1)

    return Shown({"first": 0, "line": "", "n": 0}, step, lambda own: own["n"] > 0)


def type_checks() -> Shown:
    """Diagnostics of a type checker that watches; that all is well comes once per change. A line of an unknown shape ends the shortening for good."""
    return Shown({"clean": False, "detail": False, "raw": False}, lambda own, no, line, out: None if line is None else live.tsc_step(own, no, line, out))


def test_frames() -> Shown:
    """Frames of a test runner that watches, each up to the next clearing of the screen or to silence, where they differ from the frame before."""
    return Shown({"frame": [], "last": "", "raw": False, "no": 0}, live.frame_step, lambda own: bool(own["frame"]))


class ByteCounter(StreamingQueryListener):
    """Bytes in and bytes shown of queries whose streams are counted(); they come with each batch's progress, without a second pass."""

    def __init__(self) -> None:
        self.bytes: dict[str, dict[str, int]] = {}
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        own = self.bytes.setdefault(str(event.progress.id), {"in": 0, "shown": 0})
        for name, row in event.progress.observedMetrics.items():
            if name in own:
                own[name] += row["n"] or 0

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.runId))


def counted(df: DataFrame, name: str, column: str) -> DataFrame:
    """`df`, whose bytes in `column` a ByteCounter sees under `name` (in, or shown)."""
    return df.observe(name, F.sum(F.octet_length(column)).alias("n"))
