import random

from pyspark.sql import functions as F

from sparkfold.functions import lines as L
from sparkfold.functions import text as T
from sparkfold.operators import checks, generic, git, keep, listing, logs, shell
from sparkfold.plans import catalog, guards, queries, usage
from sparkfold.streaming import live


def _lines(spark, *texts):
    return L.lines(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "capture_id long, body string"))


def _out(df, *by):
    return [r.line for r in df.orderBy("capture_id", *(by or ("line_no",))).collect()]


def test_generic_keeps_short_and_json_bodies_out(spark):
    long = "line\n" * 900
    df = spark.createDataFrame([(0, "x" * 4096), (1, "x" * 4097), (2, '{"a":' + " " * 5000), (3, "\x00" + "x" * 5000), (4, long), (5, "")], "capture_id long, body string")
    assert {r.capture_id for r in generic.compact(df).select("capture_id").distinct().collect()} == {1, 4}
    assert generic.rendered(generic.compact(df)).where("capture_id = 4").first().body == "line ×900\n"


def test_generic_repeats_and_blank_lines(spark):
    body = "a\n\nb  \tc\nb c\n\n\x1b[1ma\x1b[0m\nd\na\n" + "z" * 4100 + "\n"
    df = spark.createDataFrame([(0, body)], "capture_id long, body string")
    assert generic.rendered(generic.compact(df)).first().body == "a ×3\n\nb c ×2\nd\n" + "z" * 4100 + "\n"


def test_logs_collapse_runs(spark):
    t = _lines(spark, "2024-01-01T00:00:00Z INFO up\n2024-01-01T00:00:01Z INFO up\n\n2024-01-01T00:00:02Z INFO up\nplain\n")
    assert [(r.line, r.n) for r in logs.collapse(t).orderBy("line_no").collect()] == [("INFO up", 2), ("INFO up", 1), ("plain", 1)]
    t = _lines(spark, "web  | 2024-01-01 00:00:00 ok\nweb  | 2024-01-01 00:00:09 ok\ndb | x")
    assert [(r.line, r.n) for r in logs.collapse(t, compose=True).orderBy("line_no").collect()] == [("web| ok", 2), ("db| x", 1)]


def test_git_operators(spark):
    assert _out(git.status_short(_lines(spark, " M src/a.rs\n M src/b.rs\n?? src/c.rs\nR  src/x -> src/y\n"))) == [" M src/a.rs", " M b.rs", "?? src/c.rs", "R  src/x -> src/y"]
    assert _out(git.reflog(_lines(spark, "abcdef1 HEAD@{0}: commit: x\nabcdef1 main@{1}: reset\nodd\nabcdef1 HEAD@{2}: y"))) == ["abcdef1 @0 commit: x", "~ main@1 reset", "odd", "abcdef1 @2 y"]
    assert _out(git.branches(_lines(spark, "* main\n  dev\n  remotes/origin/main\n  remotes/origin/old"))) == ["* main =o", "  dev", "  remotes/origin/old"]
    assert _out(git.remotes(_lines(spark, "origin\tu (fetch)\n", "bad line\n")), "line_no") == ["origin u (fetch)", "bad line", ""]
    assert _out(git.shortlog(_lines(spark, "   12\tAnn B\n"))) == ["12 Ann B"]
    assert _out(git.log(_lines(spark, "commit " + "0123456789" * 4 + "\nAuthor: x\n\n    Subject here\n\n    body\n"))) == ["0123456 Subject here"]
    assert _out(git.diff(_lines(spark, "diff --git a/f b/f\nindex 1..2\n--- a/f\n+++ b/f\n@@ -1,2 +1,2 @@ fn\n-a\n+b\n c\n"))) == ["d f", "@1,2|1,2 fn", "-a", "+b", " c", ""]


def test_listings(spark):
    some = "\n".join([*[f"a.txt:{k}:x" for k in range(12)], *[f"b.txt:{k}:y" for k in range(9)]])
    assert _out(listing.grep(_lines(spark, some, "a:1\nb:2")), "ord")[:5] == ["a.txt:0:x", "a.txt:1:x", "a.txt:2:x", "a.txt: ... 9 more matches", "b.txt:0:y"]
    assert _out(listing.find(_lines(spark, "d/a\nd/b\nd/c\nd/e\nd/f\ntop\n")), "parent", "ord") == ["top", "d/ (5 entries: a, b, c; 1 omitted; last: f; --raw for all)"]
    assert _out(listing.rg(_lines(spark, "a.rs:1:x\na.rs:2:y\nb.rs:3:z"))) == ["a.rs:1:x", ":2:y", "b.rs:3:z"]
    assert _out(listing.rg_files(_lines(spark, "s/a\ns/b\nt"))) == ["s/a", ":b", "t"]
    whole = spark.createDataFrame([(0, "".join(f"{k}\n" for k in range(9))), (1, "\n".join(map(str, range(10)))), (2, "a\n\x01" * 9), (3, "a\nb\n"), (4, ""), (5, None)], "capture_id long, body string")
    got = listing.file_slice(whole).orderBy("capture_id", "line_no").collect()
    assert [r.line for r in got if r.capture_id == 0] == ["0", "1", "2", "3", "... 2 lines omitted ...", "6", "7", "8"]
    assert [r.line for r in got if r.capture_id == 1] == ["0", "1", "2", "3", "... 3 lines omitted ...", "7", "8", "9"]
    assert [sum(r.capture_id == k for r in got) for k in (2, 3, 4, 5)] == [10, 2, 0, 0]


def test_checks(spark):
    t = "a.ts:1:1 - error TS1: no x\nb.ts:2:1 - error TS1: no x\nc.ts:3:1 - error TS1: no x\nd.ts:4:1 - error TS1: no x\ne.ts:1:1 - error TS2: y\nFound 5 errors\n"
    assert _out(checks.tsc(_lines(spark, t)), "ord", "sub") == ["TS1 x4: a.ts:1:1, b.ts:2:1, c.ts:3:1, ... (1 more)", "no x", "e.ts:1:1 TS2: y", "Found 5 errors"]
    assert _out(checks.gh_checks(_lines(spark, "a\tpass\t1s\thttps://x\nb\tfail\t2s\t\nc\tpass\t1s\t\t")), "ord") == ["3 checks: 2 pass, 1 fail", "b\tfail\t2s\t"]
    assert _out(checks.gh_checks(_lines(spark, "a\tpass\t1s\thttps://x\nodd")), "ord") == ["a\tpass\t1s\thttps://x", "odd"]
    assert _out(checks.pip_table(_lines(spark, "Package Version\n------- ---\nabc   1.0\n"))) == ["abc 1.0"]
    assert [(r.line, r.repeats) for r in checks.columns(_lines(spark, "u  1  /bin/x\nu  2  /bin/y\nu  2  /bin/y\nplain")).orderBy("line_no").collect()] == [("u 1 x", 0), ("~ 2 y", 1), ("plain", 0)]


def test_text_functions(spark):
    df = spark.createDataFrame([("x",)], "s string")
    one = lambda c: df.select(c.alias("v")).first().v
    assert one(T.json_minify(F.lit('{ "a" : "b \\" c" , "n": 0.50 }'))) == '{"a":"b \\" c","n":0.50}\n'
    assert one(T.json_minify(F.lit("{bad"))) is None and one(T.json_minify(F.lit("1"))) is None
    assert one(T.mask_secret(F.lit("API_KEY"), F.lit("abcdef"))) == "ab****ef" and one(T.mask_secret(F.lit("PATH"), F.lit("y" * 101))) == "y" * 50 + "..."
    assert one(T.shell_quote(F.lit("it's"))) == "'it'\\''s'" and one(T.shell_quote(F.lit("a/b-c=1"))) == "a/b-c=1"
    assert one(T.canonical_unbase64(F.lit("Zg=="))) == b"f" and one(T.canonical_unbase64(F.lit("Zh=="))) is None
    assert one(T.human_size(F.lit(1536))) == "1.5K"


def test_guards_and_reports(spark):
    c = spark.createDataFrame([(1, "long", "", 0, False, "l", "", "f", "PotentiallyLossy"), (2, "long", "", 1, False, "l", "", "f", "PotentiallyLossy"), (3, "", "", 3, False, "", "", "f", "FactComplete"), (4, "long", "", 0, True, "l", "", "f", "FactComplete")], "capture_id long, stdout string, stderr string, exit_code int, lossless boolean, out_stdout string, out_stderr string, filter_name string, evidence string")
    got = {r.capture_id: (r.filter_name, r.shown_stdout) for r in guards.guarded(c).collect()}
    assert got == {1: ("f", "l"), 2: ("passthrough", "long"), 3: ("f", "(CMD exited 3 with no output)"), 4: ("passthrough", "long")}
    u = spark.createDataFrame([("uv", ["run", "npx", "tsc"]), ("git", ["-C", "x", "log"]), ("nano", [])], "command string, arguments array<string>")
    assert {(r.command, r.chain) for r in usage.effective(u).collect()} == {("tsc", "uv run > npx"), ("git", ""), ("nano", "")}
    assert [r.subcommand for r in usage.git_counts(u).collect()] == ["log"]
    assert {r.command for r in catalog.uncovered(spark).collect()} == {"poetry", "npx"}


def test_kept_lines(spark):
    df = spark.createDataFrame([(0, "noise\nPlan: 1 to add\n"), (1, "noise"), (2, "")], "capture_id long, body string")
    assert [r.body for r in keep.keep(df, "plan").orderBy("capture_id").collect()] == ["Plan: 1 to add\n", "plan ok\n", ""]
    hooks = "black....................Passed\nruff.....................Failed\n- hook id: ruff\nchatter\na.py:1: bad\n"
    assert _out(keep.pre_commit(_lines(spark, hooks))) == ["ruff Failed", "- hook id: ruff", "a.py:1: bad", "passed: 1 hook"]
    assert _out(keep.docker_stats(_lines(spark, "CONTAINER ID NAME CPU %\nabc web 1% 2MiB / 3GiB 4% x y"))) == ["web 1% 2MiB/3GiB 4%"]


def test_kept_lines_by_blocks(spark):
    """Line by line, as of one body; a body of a whole capture outgrew an executor."""
    said = ["+ a", "OpenTofu will perform the following actions:", " + b ", "\x1b[1merror: x\x1b[0m", "", "Executed 4 tests", "~ c # forces replacement", "[ 5%] y", "Plan: 1", "  # d will be e"]
    texts = {1: said, 2: said[2:], 3: ["noise"], 4: said * 3}
    rows = [(k, n, line) for k, lines_ in texts.items() for n, line in enumerate(lines_)]
    table, bodies = spark.createDataFrame(rows, "capture_id long, line_no long, line string"), spark.createDataFrame([(k, "\n".join(x) + "\n") for k, x in texts.items()], "capture_id long, body string")
    tools = tuple(keep.RULES)
    want = {(r.capture_id, x): r.body for x in tools for r in keep.keep(bodies, x).collect()}
    got = keep.keep_lines(table, tools, "line_no", F.floor(F.col("line_no") / 4)).collect()
    assert len(got) == len(want) and {(r.capture_id, r.tool): r.body for r in got} == want


def test_tsc_by_blocks(spark):
    """Lines that no one has numbered, block by block, as in one capture; the windows over a whole capture outgrew a task."""
    rng, rows = random.Random(8), []
    for capture in range(12):
        for at in rng.sample(range(-40, 400), 0 if capture == 11 else rng.randint(1, 120)):
            said = rng.choice(["x" * 39 + "é" + rng.choice("ab"), "y" * 38 + rng.choice(["é", "è"]), rng.choice(["", "z"]), "w: v "])
            diagnostic = f"{rng.choice(['', chr(27) + '[31m'])}f{at}.ts:1 - error TS{rng.randint(1, 4 + 9 * (capture % 3))}: {said}"
            rows.append((capture, at // 7, at % 7, rng.choice([diagnostic, diagnostic, "error TS9 odd", " ", "", "Found 2 errors", "f.ts - error TS3 no colon"]) if capture % 5 else rng.choice(["", "odd"])))
    table = spark.createDataFrame(rows, "capture_id long, a long, b long, line string")
    numbers = {}
    for k, capture in enumerate(sorted(rows)):
        numbers.setdefault(capture[0], k)
    one = spark.createDataFrame([(c, k - numbers[c], line) for k, (c, _, _, line) in enumerate(sorted(rows))], "capture_id long, line_no long, line string")
    want = sorted(map(tuple, checks.tsc(one).collect()))
    assert sorted(map(tuple, checks.tsc_rows(table, ("a", "b"), F.floor(F.col("a") / 3)).collect())) == want
    assert {w[3] for w in want if w[0] % 5 == 0} == {"no type errors"} and any(" x3: " in w[3] for w in want) and any("TS3 no colon" in w[3] for w in want)


def test_tsc_errors_sorts_no_whole_capture(spark):
    """Lines are numbered by blocks of a capture; a window by capture alone took all of its lines into one task."""
    plan = queries.tsc_errors(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    ranks = [x for x in plan.split("\n") if "row_number()" in x]
    assert ranks and all("[block#" in x for x in ranks)


def test_shell_and_trees(spark):
    df = spark.createDataFrame([("a && b 'x;y' | c 2>&1; d",), ("it's",), ("",)], "s string")
    assert [r.v for r in df.select(shell.chain(df.s).alias("v")).collect()] == [["a ", " b 'x;y' ", " c 2>&1", " d"], None, [""]]
    add = "The following paths are ignored by one of your .gitignore files:\n\tout\n  (use -f)\n\nfatal: pathspec 'zz' did not match\nwarning: CRLF will be replaced by LF in f.txt.\nThe file will have its original line endings in x\n"
    assert _out(shell.git_add(_lines(spark, add))) == ["! out", "! zz", "! f.txt"]
    assert _out(shell.worktrees(_lines(spark, "/a/b   abcdef12  [main]\n/c (bare)\n"))) == ["/a/b abcdef12 [main]", "/c (bare)"]


def test_live_transitions(spark, tmp_path):
    spark.createDataFrame([(1, 0, "a", "run"), (1, 1, "a", "run"), (1, 2, "a", "ok")], "capture_id long, line_no long, job string, status string").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("capture_id long, line_no long, job string, status string").parquet(str(tmp_path / "in"))
    q = live.transitions(s).writeStream.format("memory").queryName("moves").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.change for r in spark.table("moves").collect()) == ["a: ok", "a: run", "a: run->ok"][1:]
