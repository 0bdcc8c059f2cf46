"""Command lines, policies, plugins, and the live operators step by step and over several batches."""

import datetime
import json
import time

from pyspark.sql import functions as F

from sparkfold import plugins
from sparkfold.operators import commands
from sparkfold.plans import examples, guards, policy, registry, routes
from sparkfold.streaming import live, sides


def _programs(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    out = [[] for _ in texts]
    for r in commands.invocations(df, "k", "text").orderBy("k", "ord").collect():
        out[r.k].append((r.program, r.arguments))
    return out


def test_words(spark):
    cases = {"": None, "a\nb": None, "x" * 257: None, "''": [""], r"a\ b": ["a b"], "a'b c'\"d\\\"e\"": ["ab cd\"e"], "a 'open": None, "a | b": None, "echo $x": None, '"a`b"': None, " ls\t-l ": ["ls", "-l"], "'$x' y": ["$x", "y"], "é": ["é"]}
    df = spark.createDataFrame([(k, t) for k, t in enumerate(cases)], "k long, text string")
    assert [r.words for r in commands.words(df, "k", "text").orderBy("k").collect()] == list(cases.values())
    long = spark.createDataFrame([(1, "ls " + "'a' " * 50_000)], "k long, text string")
    assert len(commands.words(long, "k", "text").first().words) == 50_001


def test_what_runs(spark):
    got = _programs(spark, "sh -lc 'cd x; time y'", "sh", "# x", "", "bash -c \"sh -c 'git status && zsh -c ls'; pwd\"", "A=1 env -i B=2 /usr/bin/make -j", "'open", "x 2>&1 | y", "exec env", "bash -c 'if x'", None)
    assert got == [[("time", ["y"])], [], [], [], [("git", ["status"]), ("ls", []), ("pwd", [])], [("make", ["-j"])], [], [("x", ["2>&1"]), ("y", [])], [], [], []]
    df = spark.createDataFrame([(1, "short -v -- git log"), (2, "/bin/short pytest -q")], "k long, text string")
    assert [(r.program, r.arguments) for r in commands.invocations(df, "k", "text", ("short",)).orderBy("k").collect()] == [("git", ["log"]), ("pytest", ["-q"])]


def test_what_runs_without_joins(spark):
    """Keys stay with their rows: a join here was made a broadcast that grew with the table."""
    df = spark.range(100).select("id", F.when(F.col("id") % 2 == 0, "bash -c 'sh -c \"a; b\" && c'; d").otherwise("e").alias("text"))
    found = commands.invocations(df, "id", "text")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    assert sorted(map(tuple, found.select("id", "ord", "program").collect())) == sorted((k, i, p) for k in range(100) for i, p in enumerate("e" if k % 2 else "abcd"))


def test_runners(spark):
    lines = [[], ["npx"], ["uv", "run", "-x", "a"], ["/usr/bin/npx", "-yy"], ["poetry", "-qq", "run", "a"], ["npx", "-pq", "-y", "b", "-c"], ["poetry", "-q", "run", "--", "a", "-x"], ["uv", "run", "--with=x", "--", "uvx", "--from", "y", "z"], ["pnpm", "-rw", "exec", "a"], None]
    got = commands.unwrapped(spark.createDataFrame([(k, a) for k, a in enumerate(lines)], "k long, argv array<string>"), "k", "argv").orderBy("k").collect()
    none = (None, None)
    assert [(r.argv, r.chain) for r in got] == [([], []), none, none, none, (["a"], ["poetry run"]), (["b", "-c"], ["npx"]), (["a", "-x"], ["poetry run"]), (["z"], ["uv run", "uvx"]), (["a"], ["pnpm exec"]), none]


def test_records(spark):
    deep = {"x": [{"y": {"type": "tool_use", "name": "a/b.Shell", "input": {"cmd": "z", "command": "a", "command_line": 3}}}, 1, "s"], "type": "other"}
    inner = {"type": "function_call", "name": "shell", "arguments": json.dumps({"cmd": "in"}), "more": {"type": "tool_use", "name": "bash", "input": {"cmd": "never"}}}
    script = {"type": "custom_tool_call", "name": "exec", "input": "tools.exec_command({\"cmd\": \"a \\\"b\\\"\"}); tools.exec_command({x: 1, command : 'c'})"}
    rows = [json.dumps(deep), "no", json.dumps({"type": "tool_use", "name": "Read", "input": {"command": "x"}}), json.dumps([[[inner]]]), json.dumps(script), json.dumps(script | {"input": json.dumps({"cmd": "j"})}), None, "[]", json.dumps([deep, deep])]
    for _ in range(150):
        rows[2] = f'{{"d": {rows[2]}}}' if _ else json.dumps({"type": "function_call", "name": "f.bash", "arguments": {"cmd": "low"}})
    df = spark.createDataFrame(list(enumerate(rows)), "k long, line string")
    got = sorted((r.k, r.command) for r in commands.tool_calls(df, "k", "line").collect())
    assert got == [(0, "a"), (0, "z"), (2, "low"), (3, "in"), (4, 'a "b"'), (4, "c"), (5, "j"), (8, "a"), (8, "z")]
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") != "-1"


def test_tables_of_commands(spark):
    df = spark.createDataFrame([(1, "git status"), (None, "a | b"), (1, "git status"), (2, None), (3, "")], "id long, found string")
    assert sorted((r.id or 0, r.words, r.read_only) for r in commands.words(df, "id", "found").collect()) == [(0, None, False), (1, ["git", "status"], True), (1, ["git", "status"], True), (2, None, False), (3, None, False)]
    assert sorted((r.id or 0, r.ord, r.program) for r in commands.invocations(df, "id", "found").collect()) == [(0, 0, "a"), (0, 1, "b"), (1, 0, "git"), (1, 0, "git")]
    assert commands.words(df.limit(0), "id", "found").count() == 0


def test_policies_of_odd_command_lines(spark):
    df = spark.createDataFrame([([],), (["git"],), (None,), ([""],), (["a/b/jq", "."],), (["ls", "--", "-l"],)], "argv array<string>")
    got = df.select(policy.passthrough(F.col("argv")).alias("p"), routes.operator_of(F.col("argv")).alias("f"), policy.stream(F.col("argv")).alias("s")).collect()
    assert [(r.p, r.f, r.s) for r in got] == [(False, None, "capture"), (False, None, "capture"), (False, None, "capture"), (False, None, "capture"), (True, None, "capture"), (False, "ls", "capture")]


SCHEMA = "capture_id long, argv array<string>, stdout string, stderr string, exit_code int, lossless boolean"


def _shown(spark, rows):
    df = spark.createDataFrame([(k, a.split(" ") if isinstance(a, str) else a, o, e, c, False) for k, (a, o, e, c) in enumerate(rows)], SCHEMA)
    return [(r.out_stdout, r.out_stderr, r.filter_name, r.evidence) for r in registry.registry(df).orderBy("capture_id").collect()]


def test_registry(spark):
    log = "commit " + "a" * 40 + "\n\n    s\n"
    same = lambda o, e="": (o, e, "passthrough", "ByteExact")
    rows = [
        ("git log", log, "", 0), ("git log", log, "", 1), ("sh -c x", log, "", 0), (["sh", "-lc", "-i"], log, "", 0), ("tool", "same\n" * 2000, "e", 0), ("tool", log, "", 0), (None, "x", None, None), ([], None, "e\n", 0),
        ("git status --short", " M a/b.rs\n M a/c.rs\n?? d\n", "", 0), ("git status", "strange words\n", "", 0), ("git status", "", "", 0), ("make", "", "", 2), ("git log --oneline", "abc1234 x\n", "", 0),
    ]
    want = [
        ("aaaaaaa s\n", "", "git", "PotentiallyLossy"), same(log), ("aaaaaaa s\n", "", "git", "PotentiallyLossy"), same(log), ("same ×2000\n", "e", "generic", "FactComplete"), same(log), same("x"), same("", "e\n"),
        (" M a/b.rs\n M c.rs\n?? d\n", "", "git", "FactComplete"), same("strange words\n"), same("(no changes; git status exited 0 with no output)\n"), same("(make exited 2 with no output)\n"), same("abc1234 x\n"),
    ]
    assert _shown(spark, rows) == want
    assert registry.registry(spark.createDataFrame([], SCHEMA)).collect() == []


def test_registry_never_says_passed_of_a_failure(spark):
    same = lambda o, e="": (o, e, "passthrough", "ByteExact")
    unknown, load = "not a recognized test report\n", "ImportError while loading conftest\n"
    rows = [(c, o, e, 1) for c in ("cargo test", "npx jest", "uv run pytest", "go test ./...", "node --test", "npm test") for o, e in ((unknown, ""), ("", load))]
    rows += [("jest", "PASS a\nTests: 3 passed\n", "", 1), ("jest", "PASS a\nTests: 3 passed\n", "", 0), ("jest", "PASS a\nTests: 3 passed\n", "warning\n", 0), ("npm install", "weird line\n", "", 0), ("yarn list", "yarn list v1\n├─ a@1\n│  └─ b@2\n└─ c@3\n", "", 0)]
    got = _shown(spark, rows)
    assert got[:12] == [same(unknown), same("", load)] * 6
    assert got[12:] == [same("PASS a\nTests: 3 passed\n"), ("all tests passed\n", "", "test-tools", "FactComplete"), same("PASS a\nTests: 3 passed\n", "warning\n"), same("weird line\n"), ("yarn list v1\ndeps +2: a@1, c@3\nnested rows x1\n", "", "package", "PotentiallyLossy")]


def test_registry_keeps_streams_apart(spark):
    refs = "From h:x\n   1111111..2222222  main -> origin/main\n"
    rows = [("git pull", "Already up to date.\n", refs, 0), ("git pull", "odd\n", refs, 0), ("git fetch", "x\n", refs, 0), ("git merge", "Already up to date.\n", "warning: x\n", 0), ("git push", "to stdout\n", "Everything up-to-date\n", 0)]
    refs_out = "< 1111111..2222222 main -> origin/main\n"
    assert [r[:2] for r in _shown(spark, rows)] == [("@ up-to-date\n", refs_out), ("odd\n", refs_out), ("x\n", refs), ("Already up to date.\n", "warning: x\n"), ("to stdout\n", "= up-to-date\n")]


def test_registry_over_line_tables(spark):
    tsc = "".join(f"a{k}.ts:1:2 - error TS1: no\n" for k in range(4))
    rows = [
        ("uv run npx tsc", tsc, "", 2), ("docker compose logs", "web | x\nweb | x\n", "", 0), ("kubectl logs p", "2024-01-01T10:00:00Z up\n2024-01-01T10:00:01Z up\n", "", 0), ("rg x", "a:1:x\na:2:y\n", "", 0), ("find . -name x", "a/1\na/2\na/3\n", "", 0),
        ("cmake --build b", "[ 50%] Building\nchatter\n", "", 0), ("terraform plan", "Plan: 1 to add\nx\n", "", 0), ("gh pr list --json a", '{ "a" : [1, 2] }\n', "", 0), ("ps aux", "a  b\na  b\n", "", 0), ("gh pr checks 3", "j\tfail\t1m\thttps://x\n", "", 1), ("pip list", "Package  Version\n-------  ---\na  1\n", "", 0), ("ctest", "words\n", "", 0),
    ]
    got = [r[0] for r in _shown(spark, rows)]
    assert got == ["TS1 x4: a0.ts:1:2, a1.ts:1:2, a2.ts:1:2, ... (1 more)\nno\n", "web| x ×2\n", "up ×2\n", "a:1:x\n:2:y\n", "a/ (3 entries: 1, 2, 3)\n", "[ 50%] Building\n", "Plan: 1 to add\n", '{"a":[1,2]}\n', "a b\n~ x1\n", "1 checks: 1 fail\nj\tfail\t1m\thttps://x\n", "a 1\n", "words\n"]


def test_examples_name_forms_that_exist():
    from sparkfold.captures.registry import FORMS

    known = set(FORMS) | set(registry.OPERATORS) | {"script_test"}
    assert {r[1] for r in examples.LINES if r[1]} <= known and {r.operator for r in routes.ROUTES} <= known and {r[0] for r in guards.LOOKS} <= known and set(routes.SEEN) <= known


def test_plugins_conform():
    import base64

    b = lambda t: base64.b64encode(t.encode()).decode()
    half = lambda r: {"version": 1, "result": "transform", "evidence": "fact-complete", "stdout_b64": b(base64.b64decode(r["stdout_b64"]).decode()[:3]), "stderr_b64": ""}
    decline = lambda r: {"version": 1, "result": "decline"}
    assert plugins.conforms(decline) == dict.fromkeys(("success", "failure", "empty", "bytes"), True)
    assert plugins.conforms(half) == {"success": True, "failure": True, "empty": False, "bytes": True}
    assert not any(plugins.conforms(lambda r: {}).values())
    assert plugins.checked(lambda r: half(r) | {"evidence": "potentially-lossy"}, [], "long text", "", 1) is None and plugins.checked(half, [], "long text", "", 1) == ("lon", "", "FactComplete")


def _hangs(request):
    time.sleep(60)


def _dies(request):
    import os

    os._exit(3)


def _short(request):
    import base64

    return {"version": 1, "result": "transform", "evidence": "fact-complete", "stdout_b64": base64.b64encode(b"ok").decode(), "stderr_b64": ""}


def _large(request):
    return {"x": "y" * 100_000}


def test_plugins_that_hang_die_or_say_too_much(spark):
    names = ["hangs", "good", "dies", "good", "large", "good", "unknown", None]
    df = spark.createDataFrame([(k, ["x"], "a long text", "", 0, n) for k, n in enumerate(names)], "capture_id long, argv array<string>, stdout string, stderr string, exit_code int, plugin string").coalesce(1)
    got = plugins.apply(df, {"hangs": _hangs, "dies": _dies, "good": _short, "large": _large}, F.col("plugin"), seconds=1.0, most=50_000).orderBy("capture_id").collect()
    assert [(r.out_stdout, r.plugin_id) for r in got] == [("ok", "good") if n == "good" else ("a long text", None) for n in names]


class _Twice(plugins.Isolated):
    """A process that answers one request twice."""

    def _serve(self, pipe):
        pipe.send_bytes(b"{}")
        pipe.send_bytes(b"{}")
        pipe.recv_bytes()


def test_a_second_answer_is_refused():
    beside = _Twice({})
    beside._begin()
    time.sleep(0.5)
    assert beside.answer("x", {}) is None and beside.child is None


def _steps(step, fresh, rows):
    out = []
    for k, line in enumerate(rows):
        step(fresh, None if line is None else k, line, out)
    return out


def test_type_check_steps():
    rows = ["Starting compilation in watch mode...", "", "a.ts:1:2 - error TS1: no", "", "  x = 1", "Found 1 error. Watching", "", "File change detected. Starting incremental compilation...", "Found 0 errors.", "Found 0 errors.", "odd", "Found 0 errors."]
    assert _steps(live.tsc_step, {"clean": False, "detail": False, "raw": False}, rows) == [(2, "a.ts:1:2 TS1: no"), (3, ""), (4, "  x = 1"), (5, "Found 1 error. Watching"), (8, "clean (0 errors)"), (10, "odd"), (11, "Found 0 errors.")]


def test_frame_steps():
    fresh = lambda: {"frame": [], "last": "", "raw": False, "no": 0}
    assert _steps(live.frame_step, fresh(), ["FAIL a", "Tests: 1 failed", "\x1b[2JFAIL a", "Tests: 1 failed", None, "\x1b[HPASS x", "Tests: 2 passed", None]) == [(1, "FAIL a"), (1, "Tests: 1 failed"), (6, "all tests passed")]  # the second frame says the same
    assert _steps(live.frame_step, fresh(), ["words", None, "more"]) == [(0, "words"), (2, "more")]
    big = "x" * (live.FRAME // 2)
    assert [k for k, _ in _steps(live.frame_step, fresh(), [big, big, "y"])] == [1, 1, 2]


def _written(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_transitions_over_batches(spark, tmp_path):
    """The same rows in one file and in three, read one file at a time."""
    rows, made, schema = ["run", "run", "fail", "fail", "pass", "pass"], [], "capture_id long, line_no long, job string, status string"
    for parts in (1, 3):
        path, size = str(tmp_path / f"in{parts}"), len(rows) // parts
        for p in range(parts):
            _written(spark, path, [(7, k, "j", s) for k, s in list(enumerate(rows))[p * size : (p + 1) * size]], schema)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        query = live.transitions(stream).writeStream.format("parquet").option("path", str(tmp_path / f"out{parts}")).option("checkpointLocation", str(tmp_path / f"state{parts}")).trigger(availableNow=True).start()
        assert query.awaitTermination(60)
        made.append(sorted(map(tuple, spark.read.parquet(str(tmp_path / f"out{parts}")).collect())))
    assert made[0] == made[1] and made[0]


CHUNKS = "capture_id long, side string, seq long, at timestamp, bytes binary, ended boolean, exited boolean"


def _at(ms):
    return datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(milliseconds=ms)


def _sides(spark, tmp_path, batches, shown=None, **more):
    """Rows out of batches of chunks (capture, side, seq, ms, bytes, ended, exited), each run to its end from the same checkpoint, on event time."""
    at = str(tmp_path / f"sides{len(list(tmp_path.iterdir()))}")
    for batch in batches:
        _written(spark, at + "/in", [(c, s, q, _at(ms), b, e, x) for c, s, q, ms, b, e, x in batch], CHUNKS)
        stream = spark.readStream.schema(CHUNKS).parquet(at + "/in").withWatermark("at", "0 seconds")
        with sides.state_store(spark):
            query = sides.sides(stream, shown, "EventTime", **more).writeStream.format("parquet").option("path", at + "/out").option("checkpointLocation", at + "/state").trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    return sorted((r.capture_id, r.side, r.line_no, bytes(r.line), r.raw, r.incomplete) for r in spark.read.parquet(at + "/out").collect())


def test_lines_of_cut_streams(spark, tmp_path):
    text = "é one\r\n\nthree\nno end".encode()
    cut = [(1, "out", k, k, text[3 * k : 3 * k + 3], 3 * k + 3 >= len(text), False) for k in range(-(-len(text) // 3))]
    other = [(1, "err", 0, 0, b"a\nleft", False, False), (2, "out", 0, 0, None, False, False), (2, "out", 1, 1, b"x" * 70 + b"\nnext\nmore", False, False), (2, "out", 2, 2, b"\nrest", True, False)]
    want = [(1, "err", 0, b"a", False, False), *[(1, "out", k, x, False, False) for k, x in enumerate(text.split(b"\n"))], (2, "out", 0, b"x" * 70 + b"\nnext\nmore", True, False), (2, "out", 1, b"\nrest", True, False)]
    assert _sides(spark, tmp_path, [cut[::-1] + other], longest=64) == want
    # Chunks that come too early wait for those before them, also over batches; known ones are not taken twice.
    later = [cut[1:4], cut[:1] + cut[:1] + other, cut[4:]]
    shifted = [[(c, s, q, 1000 * k + ms, b, e, x) for c, s, q, ms, b, e, x in batch] for k, batch in enumerate(later)]
    assert _sides(spark, tmp_path, shifted, longest=64) == want


def test_silence_and_exits_by_timers(spark, tmp_path):
    """Time is advanced by another capture's chunks."""
    clock = lambda ms: (9, "out", ms, ms, b"", False, False)
    busy = [(1, "out", 0, 0, b"up\nup\n", False, False), (2, "out", 0, 0, b"part", False, True), (3, "out", 0, 0, b"up\n", False, False)]
    first = _sides(spark, tmp_path, [[*busy, clock(1)], [clock(1500)]], sides.log_runs())
    assert first == [(2, "out", 0, b"part", False, False), (2, "out", 1, b"", False, True)]  # the grace of an exit is over, two seconds are not
    later = [(1, "out", 1, 9000, b"up\n", True, False)]
    got = _sides(spark, tmp_path, [[*busy, clock(1)], [clock(1500)], [clock(4000)], [*later, (3, "out", 1, 9000, b"", True, False)]], sides.log_runs())
    assert [r for r in got if r[0] != 2] == [(1, "out", 0, "up ×2".encode(), False, False), (1, "out", 2, b"up", False, False), (3, "out", 0, b"up", False, False)]


def test_type_checks_and_frames_over_batches(spark, tmp_path):
    rows = [b"a.ts:1:2 - error TS1: no\n", b"Found 1 error.\n", b"Found 0 errors.\n", b"Found 0 errors.\n", b"b.ts:1:2 - error TS2: x\n", b"Found 0 errors.\n"]
    chunks = [(1, "out", k, k, b, k == 5, False) for k, b in enumerate(rows)]
    whole, parts = (_sides(spark, tmp_path, b, sides.type_checks()) for b in ([chunks], [chunks[:2], chunks[2:3], chunks[3:]]))
    assert whole == parts and [r[3] for r in whole] == [b"a.ts:1:2 TS1: no", b"Found 1 error.", b"clean (0 errors)", b"b.ts:1:2 TS2: x", b"clean (0 errors)"]
    frames = [b"\x1b[2JFAIL a\nTests: 1 failed\n", b"\x1b[2JFAIL a\nTests: 1 failed\n", b"\x1b[HPASS x\nTests: 2 passed\n"]
    chunks = [(1, "out", k, 100 * k, b, k == 2, False) for k, b in enumerate(frames)]
    assert [r[2:4] for r in _sides(spark, tmp_path, [chunks[:1], chunks[1:]], sides.test_frames())] == [(1, b"FAIL a"), (1, b"Tests: 1 failed"), (5, b"all tests passed")]


def test_live_kinds(spark):
    lines = ["tsc -w", "npx tsc", "uv run jest --watch", "gh run watch", "docker compose logs -f", "docker logs -f x", "docker logs -f --timestamps x", "kubectl logs -f --prefix=true x"]
    got = spark.createDataFrame([(k, x.split()) for k, x in enumerate(lines)], "k long, argv array<string>").orderBy("k").select(live.kind(F.col("argv")).alias("kind")).collect()
    assert [r.kind for r in got] == ["tsc", "tsc", "jest", "gh", "compose", "logs", "raw", "raw"]


def test_captures_are_dealt_out_once(spark):
    """Lines were shuffled for the operator's windows, then its bodies and the captures for two joins; on a gigabyte this filled the disks."""
    rows = [("git status", "On branch m\nUntracked files:\n\tq\n", "", 0), ("git status", "On branch n\n", "", 1), ("git remote -v", "o\tu (fetch)\n", "", 0), ("make", "x\n", "", 0)]
    df = registry.registry(spark.createDataFrame([(k, a.split(" "), o, e, c, False) for k, (a, o, e, c) in enumerate(rows)], SCHEMA))
    assert [r.out_stdout for r in sorted(df.collect())] == ["# m\n? q\n", "On branch n\n", "o u (fetch)\n", "x\n"]
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].split("\n")
    assert sum(" Exchange " in x and "ReusedExchange" not in x for x in plan) == 2 and sum("ReusedExchange" in x for x in plan) >= 2


def test_scripts_print_the_same_at_once(spark):
    """Bodies of all scripts from one grouping are those that the lines of each, numbered and put together again, give."""
    from sparkfold.functions import lines as L
    from sparkfold.plans import scripts
    from sparkfold.sources.tables import table, views

    views(spark, "/root/testdata/sf0.001")
    table(spark, "/root/testdata/sf0.001", "orders").createOrReplaceTempView("dealt_orders")
    some = tuple(s for s in scripts.SCRIPTS if s.name in ("git_log", "git_push", "git_switch", "jest", "ls_columns", "git_pull", "du_rows", "gh_view"))
    got = {(r.capture_id, s.name): r[s.name] for r in spark.sql(scripts.bodies(some)).collect() for s in some}
    want = {(r.capture_id, s.name): r.body for s in some for r in L.render(spark.sql(scripts.sql(s, False, True))).collect()}
    assert len(some) == 8 and got == want


def test_command_lines_are_asked_once(spark):
    """Each capture's command line was held against every route; lines that are given are asked once, others where they are, with the same answers."""
    rows = [("git status", "On branch m\nUntracked files:\n\tq\n", "", 0), ("sh -c x", "On branch m\nUntracked files:\n\tq\n", "", 0), ("git config -l", " a=b \n", "", 0), ("pytest --co", "collected 3 items\n", "", 0)]
    df = spark.createDataFrame([(k, a.split(" "), o, e, c, False) for k, (a, o, e, c) in enumerate(rows)] + [(9, None, "x", None, None, False)], SCHEMA)
    some = spark.createDataFrame([(rows[k][0].split(" "),) for k in (0, 1, 0, 3)], "argv array<string>")
    want = {r.capture_id: (r.command, r.operator) for r in registry.routed(df).collect()}
    assert {r.capture_id: (r.command, r.operator) for r in registry.routed(df, some).collect()} == want
    assert [want[k][1] for k in (0, 1, 2, 3, 9)] == ["git_status", "git_status", "trimmed", None, None]


def test_hints_lose_no_form(spark):
    """Patterns of shells' output are tried only where a substring hints at them: each branch still tells its form."""
    bodies = {
        "cargo_test": ["test result: ok", "x\n running 3 tests"], "jest": ["a\nTest Suites: 1", "Test Files 2", "Tests: 3"], "js_test": ["a\n  3 passing", "4 failing (1)", "x\n # tests 3"],
        "go_test": ["x\n=== RUN", "--- FAIL: x", "x\nBenchmarkX", "x\nok  \tp", "=== FUZZ"], "pytest": ["x test session starts", "1 passed in 2", "failed in 3", "collected 3 items"],
        "install": ["added 3\npackages", "up to date, audited 3", "npm WARN x", "Packages: +3", "3 packages installed [1s]", "success Saved x", "Package operations: 3", "Lock file operations: 2", "Nothing to install", "Your requirements could not be resolved"],
        "tsc": ["Found 0 errors", "a: error TS1: x", "Found 3 errors in 2 files"], "pre_commit": ["check....Passed"], "helm_list": ["NAME NAMESPACE REVISION"], "helm_history": ["REVISION UPDATED STATUS"], "docker_stats": ["CONTAINER ID  NAME  CPU %"], "generic": ["z" * 5000],
    }
    rows = [(form, x) for form, some in bodies.items() for x in some]
    got = spark.createDataFrame(rows, "form string, body string").select("form", "body", registry.by_content(F.col("body")).alias("told")).collect()
    assert [(r.body, r.told) for r in got] == [(x, form) for form, x in rows]


def test_printed_texts_are_made_without_lambdas_over_orders(spark):
    """A lambda over each customer's orders was not compiled and took half of the writing; the one that is left only splits the projection."""
    from sparkfold.plans import scripts

    some = tuple(s for s in scripts.SCRIPTS if s.name in ("git_log", "git_push", "jest"))
    assert scripts.bodies(some).count("transform(") == 1
