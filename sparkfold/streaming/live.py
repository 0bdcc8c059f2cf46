"""Steps of the operators on followed commands (sides.py runs them on byte streams), job states, and which operator takes a command."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparkfold.captures import runners
from sparkfold.captures.shape import plain
from sparkfold.operators.commands import logical
from sparkfold.plans.policy import base

_ANSI = re.compile(r"\x1b(?:\[[^@-~]*[@-~]?|\][^\x07\x1b]*(?:\x07|\x1b\\)?|[\s\S])?")
_TIME = re.compile(r"^\d{4}-\d{2}-\d{2}(?: \d{2}:\d{2}:\d{2})?[^ \t]*[ \t]*")


def without_escapes(line: str) -> str:
    return _ANSI.sub("", line)


def without_time(line: str) -> str:
    return _TIME.sub("", line)


def transitions(stream: DataFrame) -> DataFrame:
    """`stream` has capture_id, line_no, job, status. A row for each change of a job's status, `job: old->new`, and for its first one."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = json.loads(state.get[0]) if state.exists else {}
        out = []
        rows = sorted(r for f in frames for r in zip(f["line_no"].tolist(), f["job"].tolist(), f["status"].tolist()))
        for no, job, status in rows:
            was = known.get(job)
            if was != status:
                out.append((key[0], no, f"{job}: {status}" if was is None else f"{job}: {was}->{status}"))
                known[job] = status
        state.update((json.dumps(known),))
        yield pd.DataFrame(out, columns=["capture_id", "line_no", "change"])

    return stream.groupBy("capture_id").applyInPandasWithState(step, "capture_id long, line_no long, change string", "known string", "append", GroupStateTimeout.NoTimeout)


def kind(argv: Column) -> Column:
    """Which live operator takes a followed command, behind its runners: tsc, jest, gh, logs, compose logs, or raw for logs whose metadata was asked for."""

    def told(a: Column) -> Column:
        command = base(F.get(a, 0))
        compose = (command == "docker-compose") | ((command == "docker") & (F.get(a, 1) == "compose"))
        kept = F.exists(a, lambda x: F.regexp_like(x, F.lit(r"^(?:-t|(?:--timestamps|--details|--prefix|--no-log-prefix)(?:=.*)?)$")))
        by_name = F.when(command == "tsc", "tsc").when(command.isin("jest", "vitest"), "jest").when(command == "gh", "gh")
        return by_name.when(kept, "raw").when(F.coalesce(compose, F.lit(False)), "compose").otherwise("logs")

    return F.transform(F.array(F.coalesce(logical(argv)["argv"], argv)), told)[0]


def tsc_step(own: dict, no: int | None, line: str | None, out: list) -> None:
    core = plain(line).strip(" \t\n\f\r")
    if own["raw"] or (not core and own["detail"]):
        out.append((no, line))
    elif core.startswith("Found 0 errors"):
        out += [(no, "clean (0 errors)")] * (not own["clean"])
        own.update(clean=True, detail=False)
    elif core.startswith("Found ") and "error" in core:
        out.append((no, core))
        own.update(clean=False, detail=False)
    elif "error TS" in core:
        m = re.match(r"(.*?) - error (TS[^:]*:.*)$", core)
        out.append((no, f"{m[1]} {m[2]}" if m else core))
        own.update(clean=False, detail=True)
    elif core and own["detail"]:
        out.append((no, line))
    elif core and not re.search("Starting compilation in watch mode|File change detected. Starting incremental compilation", core):
        own["raw"] = True
        out.append((no, line))


#: A frame of so many bytes, or one that is none of a test runner, turns a stream into plain passage for good.
FRAME = 512 * 1024


def frame_step(own: dict, no: int | None, line: str | None, out: list) -> None:
    def flush() -> None:
        text, own["frame"] = "".join(f"{x}\n" for x in own["frame"]), []
        if not text:
            return
        if re.search(r"Test Suites:|Test Files|^Tests:", text, re.M):
            shown = runners.jest(text)
            out.extend((own["no"], x) for x in shown.removesuffix("\n").split("\n") if shown != own["last"])
            own["last"] = shown
        else:
            out.extend((own["no"], x) for x in text.removesuffix("\n").split("\n"))
            own.update(raw=True, last="")

    if line is None:
        flush()
        return
    clear = re.search(r"\x1b\[(?:2J|H)", line)
    if clear and not own["raw"]:
        flush()
        line = line if own["raw"] else line[clear.start() :]
    own["no"] = no
    if own["raw"]:
        out.append((no, line))
    elif sum(len(x.encode()) + 1 for x in own["frame"]) + len(line.encode()) + 1 > FRAME:
        out.extend((no, x) for x in [*own["frame"], line])
        own.update(frame=[], last="", raw=True)
    else:
        own["frame"].append(line)
