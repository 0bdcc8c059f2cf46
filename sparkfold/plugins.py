"""Forms that users register: functions of one request, with the guards that a foreign form needs.

A plugin is a function of a request {version, argv, exit_code, stdout_b64, stderr_b64} to a response: {version: 1, result: "decline"}, or {version, result:
"transform", evidence, stdout_b64, stderr_b64}. Whatever else it does (an error, other fields, base64 that is not canonical, output that
is not smaller, a lossy form of a failed command), the original stays. So it does of a plugin that takes longer than its time, ends its process, answers with more than the
bound, or more than once: in a table of captures, plugins run in a process of their own beside the task, which is ended and begun anew when that happens.
"""

from __future__ import annotations

import base64
import contextlib
import json
import multiprocessing
import os
import signal
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVIDENCE = {"fact-complete": "FactComplete", "potentially-lossy": "PotentiallyLossy"}
MOST_BYTES = 16 << 20
#: Seconds that a request may take, and bytes of its response (two streams in base64, and their frame).
SECONDS, RESPONSE = 10.0, 2 * (MOST_BYTES * 4 // 3) + 65_536


class Isolated:
    """Plugins in a process of their own. answer() gives the response as a value, or None where there was none in time, or more than one."""

    def __init__(self, registered: dict[str, Callable[[dict], dict]], seconds: float = SECONDS, most: int = RESPONSE):
        self.registered, self.seconds, self.most = registered, seconds, most
        self.child, self.pipe = None, None

    def _serve(self, pipe) -> None:
        while True:
            name, request = json.loads(pipe.recv_bytes())
            try:
                said = json.dumps(self.registered[name](request))
            except BaseException:  # noqa: BLE001 - a foreign function may raise anything
                said = "null"
            pipe.send_bytes(said.encode())

    def _begin(self) -> None:
        here, there = multiprocessing.Pipe()
        self.child = multiprocessing.get_context("fork").Process(target=self._serve, args=(there,), daemon=True)
        self.child.start()
        there.close()
        self.pipe = here

    def end(self) -> None:
        if self.child is not None:
            with contextlib.suppress(ProcessLookupError):
                os.kill(self.child.pid, signal.SIGKILL)
            self.child.join()
            self.pipe.close()
            self.child = None

    def answer(self, name: str, request: dict) -> dict | None:
        if self.child is None:
            self._begin()
        try:
            self.pipe.send_bytes(json.dumps([name, request]).encode())
            if self.pipe.poll(self.seconds):
                said = json.loads(self.pipe.recv_bytes(self.most))
                if not self.pipe.poll(0):  # one answer to one request
                    return said
        except (OSError, EOFError, ValueError):
            pass
        self.end()
        return None


def _decoded(text) -> bytes:
    raw = base64.b64decode(text, validate=True)
    if base64.b64encode(raw).decode() != text:
        raise ValueError("not canonical")
    return raw


def checked(plugin: Callable[[dict], dict], argv: list[str], stdout: str, stderr: str, exit_code: int) -> tuple[str, str, str] | None:
    """(stdout, stderr, evidence) of a plugin that keeps the rules, or None."""
    before = stdout.encode(), stderr.encode()
    try:
        r = plugin({"version": 1, "argv": list(argv), "exit_code": exit_code, "stdout_b64": base64.b64encode(before[0]).decode(), "stderr_b64": base64.b64encode(before[1]).decode()})
        if r["version"] != 1 or r["result"] != "transform" or len(r) != 5 or r["evidence"] not in EVIDENCE or (exit_code and r["evidence"] != "fact-complete"):
            return None
        after = _decoded(r["stdout_b64"]), _decoded(r["stderr_b64"])
        if sum(map(len, after)) > MOST_BYTES or sum(map(len, after)) >= sum(map(len, before)):
            return None
        return after[0].decode(), after[1].decode(), EVIDENCE[r["evidence"]]
    except Exception:  # noqa: BLE001 - a foreign function may raise anything, and then the original stays
        return None


def conforms(plugin: Callable[[dict], dict]) -> dict[str, bool]:
    """Four cases: long text of success and of failure, empty text, bytes of all kinds. Whether it answered each by the rules, be it by declining."""

    def fine(stdout: str, code: int) -> bool:
        try:
            r = plugin({"version": 1, "argv": ["x"], "exit_code": code, "stdout_b64": base64.b64encode(stdout.encode()).decode(), "stderr_b64": ""})
        except Exception:  # noqa: BLE001
            return False
        return r == {"version": 1, "result": "decline"} or checked(lambda _: r, ["x"], stdout, "", code) is not None

    return {"success": fine("PASS a\n" * 50, 0), "failure": fine("WARN b\n" * 50, 1), "empty": fine("", 0), "bytes": fine("".join(map(chr, range(256))) * 4, 0)}


def apply(captures: DataFrame, registered: dict[str, Callable[[dict], dict]], plugin: Column, key: str = "capture_id", seconds: float = SECONDS, most: int = RESPONSE) -> DataFrame:
    """key, out_stdout, out_stderr, plugin_id, evidence of captures (argv, stdout, stderr, exit_code); null plugin_id where the original stays."""
    rows = captures.select(F.col(key).alias("key"), "argv", F.coalesce("stdout", F.lit("")).alias("stdout"), F.coalesce("stderr", F.lit("")).alias("stderr"), F.coalesce("exit_code", F.lit(0)).alias("exit_code"), plugin.alias("plugin"))
    kind = dict(rows.dtypes)["key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beside = Isolated(registered, seconds, most)
        try:
            for b in batches:
                out = []
                for r in b.to_pylist():
                    ask = lambda request, name=r["plugin"]: beside.answer(name, request)
                    got = checked(ask, r["argv"] or [], r["stdout"], r["stderr"], r["exit_code"]) if r["plugin"] in registered else None
                    out.append((got[0], got[1], r["plugin"], got[2]) if got else (r["stdout"], r["stderr"], None, "ByteExact"))
                yield pa.record_batch([b.column(0), *(pa.array([o[c] for o in out], pa.string()) for c in range(4))], names=["key", "out_stdout", "out_stderr", "plugin_id", "evidence"])
        finally:
            beside.end()

    return rows.mapInArrow(run, f"key {kind}, out_stdout string, out_stderr string, plugin_id string, evidence string").withColumnRenamed("key", key)


def disposition(supported: Column, project: Column, matched: Column, scope: Column, plugin: Column, path: Column, pinned: Column, trusted: Column, current: Column) -> Column:
    """Why a command line goes to a plugin or not. `project`: absent, approved, unapproved, invalid or ambiguous; `matched`: whether a binding takes
    the line, of `scope`; `path`, `pinned`, `trusted` and `current` digests of the registered plugin."""
    mine = scope == "project"
    return (
        F.when(supported, "core-route").when(matched & mine & (project == "unapproved"), "repo-unapproved").when(project == "invalid", "invalid-config").when(project == "ambiguous", "ambiguous").when(~matched, "no-match")
        .when(plugin.isNull(), "invalid-config").when(path.isNull(), "untrusted").when(pinned & ~trusted.eqNullSafe(current), "integrity-mismatch").otherwise("active")
    )
