"""Captures told by example: what a command prints about rows of a table, and what of it must be shown.

A script has parts: lines before, for each row, and after. A line is (what is printed, what is shown), either may be None; with a
third element, an SQL condition, only where it holds. `{name}` in a line stands for one of FIELDS. Captures of which `odd` holds have a line of an unknown shape
in front and must stay as they are. Captures are one per customer (or supplier), so they are as many as the data are large, each of
a bounded size. One SQL text per dialect builds what is printed and what must be shown from the same rows, so the expected
result comes from the script alone, not from the code that is checked.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import groupby

#: Expressions for `{name}`, in SQL that both dialects read.
FIELDS = {
    "id": "CAST(o_orderkey AS VARCHAR(20))", "d": "CAST(o_orderkey % 10 AS VARCHAR(9))", "e": "CAST(o_orderkey % 3 AS VARCHAR(9))", "cust": "CAST(o_custkey AS VARCHAR(20))", "st": "lower(o_orderstatus)",
    "sha": "concat(md5(CAST(o_orderkey AS VARCHAR(20))), '01234567')", "sha7": "substr(md5(CAST(o_orderkey AS VARCHAR(20))), 1, 7)", "n": "CAST(count(*) AS VARCHAR(20))", "even": "CAST(sum(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END) AS VARCHAR(20))",
    "odd": "CAST(sum(CASE WHEN o_orderkey % 2 = 1 THEN 1 ELSE 0 END) AS VARCHAR(20))", "first": "CAST(min(o_orderkey) AS VARCHAR(20))", "last": "CAST(max(o_orderkey) AS VARCHAR(20))", "tab": "chr(9)", "esc": "chr(27)",
    "csha": "concat(md5(concat('c', CAST(o_custkey AS VARCHAR(20)))), '01234567')", "csha7": "substr(md5(concat('c', CAST(o_custkey AS VARCHAR(20)))), 1, 7)",
}
EVEN, ODD = "o_orderkey % 2 = 0", "o_orderkey % 2 = 1"
ANY_ODD, NONE_ODD = "max(o_orderkey % 2) = 1", "max(o_orderkey % 2) = 0"


@dataclass(frozen=True)
class Script:
    name: str
    form: str  # a form of captures, or module.function of an operator on line tables
    head: tuple = ()
    each: tuple = ()
    tail: tuple = ()
    odd: str | None = None  # a line that no capture of this form has
    stream: str = "stdout"


def _expression(line: str | None, condition: str | None) -> str:
    if line is None:
        return "CAST(NULL AS VARCHAR(9))"
    parts = [p for p in re.split(r"(\{\w+\})", line) if p]
    sql = [FIELDS[p[1:-1]] if re.fullmatch(r"\{\w+\}", p) else "'" + p.replace("'", "''") + "'" for p in parts] or ["''"]
    text = f"concat({', '.join(sql)}, '')"
    return f"CASE WHEN {condition} THEN {text} END" if condition else text


_IS_ODD = "capture_id % 7 = 3"


def _part(lines: tuple, side: int, order: str, grouped: bool, spark: bool) -> str:
    items = ", ".join(_expression(x[side], x[2] if len(x) > 2 else None) for x in lines)
    array = f"array({items})" if spark else f"[{items}]"
    rows = f"SELECT o_custkey AS capture_id, CAST({order} AS BIGINT) AS o, {array} AS a FROM orders" + " GROUP BY o_custkey" * grouped
    return f"SELECT capture_id, o, posexplode(a) AS (i, line) FROM ({rows})" if spark else f"SELECT capture_id, o, unnest(range(len(a))) AS i, unnest(a) AS line FROM ({rows})"


def sql(script: Script, expected: bool, spark: bool) -> str:
    """(capture_id, line_no, line) of what is printed, or of what must be shown."""

    def side(which: int) -> str:
        parts = [(script.head, "-1", True), (script.each, "o_orderkey", False), (script.tail, "9000000000000000", True)]
        return " UNION ALL ".join(_part(p, which, o, g, spark) for p, o, g in parts if p)

    def numbered(rows: str) -> str:
        return f"SELECT capture_id, CAST(row_number() OVER (PARTITION BY capture_id ORDER BY o, i) - 1 AS BIGINT) AS line_no, line FROM ({rows}) AS r WHERE line IS NOT NULL"

    if not script.odd:
        return numbered(side(int(expected)))
    strange = f"SELECT DISTINCT o_custkey AS capture_id, CAST(-2 AS BIGINT) AS o, 0 AS i, '{script.odd}' AS line FROM orders"
    printed = f"SELECT * FROM ({side(0)} UNION ALL SELECT * FROM ({strange}) AS s WHERE {_IS_ODD}) AS p"
    if not expected:
        return numbered(printed)
    return numbered(f"SELECT * FROM ({side(1)}) AS x WHERE NOT ({_IS_ODD}) UNION ALL SELECT * FROM ({printed}) AS y WHERE {_IS_ODD}")


def _text(lines: tuple) -> str:
    """What is printed of `lines` as one text, each line ended by a line feed, in as few concatenations as there are conditions."""

    def joined(texts: list[str]) -> str:
        parts = [p for p in re.split(r"(\{\w+\})", "".join(texts)) if p]
        return "concat(" + ", ".join(f"coalesce({FIELDS[p[1:-1]]}, '')" if re.fullmatch(r"\{\w+\}", p) else "'" + p.replace("'", "''") + "'" for p in parts) + ")"

    runs = [(condition, [x[0] + "\n" for x in run]) for condition, run in groupby((x for x in lines if x[0] is not None), lambda x: x[2] if len(x) > 2 else None)]
    parts = [joined(texts) if condition is None else f"CASE WHEN {condition} THEN {joined(texts)} ELSE '' END" for condition, texts in runs]
    return f"concat({', '.join(parts)})" if len(parts) > 1 else "".join(parts) or "''"


def bodies(these: tuple[Script, ...]) -> str:
    """capture_id and what each script prints of it, a column of its name, null if it prints nothing: all from one grouping of the orders, whose texts are made
    where they were brought together."""
    each, parts, texts = [], [], []
    for k, s in enumerate(these):
        each += [f"'each_{k}', {_text(s.each)}"] * bool(s.each)
        parts += [f"{_text(rows)} AS {name}_{k}" for name, rows in (("head", s.head), ("tail", s.tail)) if rows]
        strange = [f"CASE WHEN {_IS_ODD.replace('capture_id', 'o_custkey')} THEN {_text(((s.odd, None),))} ELSE '' END"] if s.odd else []
        every = strange + [f"head_{k}"] * bool(s.head) + [f"array_join(o_rows.each_{k}, '')"] * bool(s.each) + [f"tail_{k}"] * bool(s.tail)
        texts.append(f"nullif(concat({', '.join(every)}), '') AS {s.name}")
    # Texts are made order by order in one projection. Where there is a lambda, Spark writes it as many short methods; all in one would be too long for the JVM to compile.
    made = f"SELECT o_custkey, transform(array(o_orderkey), x -> x)[0] AS o_orderkey, named_struct({', '.join(each) or repr('none') + ', 0'}) AS o_texts FROM dealt_orders"
    grouped = f"SELECT {', '.join(['o_custkey', 'sort_array(collect_list(struct(o_orderkey, o_texts))).o_texts AS o_rows', *parts])} FROM ({made}) GROUP BY o_custkey"
    return f"SELECT o_custkey AS capture_id, {', '.join(texts)} FROM ({grouped})"


def same(*lines: str) -> tuple:
    """Lines that are shown as they are printed."""
    return tuple((x, x) for x in lines)


def gone(*lines: str) -> tuple:
    return tuple((x, None) for x in lines)


SCRIPTS = (
    Script("git_status", "git.status", head=(("On branch c{cust}", "# c{cust} +{n}"), ("Your branch is ahead of 'origin/x' by {n} commits.", None), ("", None), ("Changes not staged for commit:", None), ("  (use \"git add\" to update)", None)),
        each=(("{tab}modified:   f{id}.rs", "M f{id}.rs", EVEN), ("{tab}deleted:    g{id}.rs", "d g{id}.rs", ODD)),
        tail=(("", None), ("You have unmerged paths.", "! You have unmerged paths."), ("Untracked files:", None), ("{tab}n/a1.c", "? n/a1.c..a6.c"), *gone(*(f"{{tab}}n/a{k}.c" for k in range(2, 7))), ("{tab}m/x", "? m/x"), ("{tab}m/y", "? y"), ("{tab}m/z", "? z"))),
    Script("git_log", "git.log", each=(("commit {sha}", None), ("Author: A <a@b.c>", None), ("Date:   now", None), ("", None), ("    order {id}", "{sha7} order {id} [Fixes: #{d}; Signed-off-by: s{e}]", EVEN), ("    Change {id}", "{sha7} Change {id}", ODD), ("", None),
        ("    some body", None), ("    Fixes: #{d}", None, EVEN), ("    Signed-off-by: s{e}", None, EVEN), ("", None))),
    Script("git_log_stat", "git_log_stat", each=(("commit {sha}", None), ("", None), ("    order {id}", "{sha7} order {id}"), ("", None), (" a/x.rs | 2 +-", "  a/x.rs | 2 +-", ODD), (" 1 file changed", "  1 file changed", ODD), (" src/a.rs | 3 ++-", "  src/ (4 files, +5 -2)", EVEN),
        (" src/b.rs | 1 +", None, EVEN), (" src/c.rs | 1 -", None, EVEN), (" src/d.rs | 2 ++", None, EVEN), (" img.png | Bin 0 -> 9 bytes", "  img.png | Bin 0 -> 9 bytes", EVEN), (" old => new.rs | 1 +", "  old => new.rs | 1 +", EVEN),
        (" 6 files changed, 6 insertions(+)", "  6 files changed, 6 insertions(+)", EVEN))),
    Script("git_show", "git_show", head=(("commit {csha}", None), ("Merge: 123 456", None), ("Author: x", None), ("", None), ("    subject {cust}", "{csha7} subject {cust}"), (None, "p 123 456"), ("    more", "  more"), ("", ""), ("diff --git a/x b/x", "d x"), ("index 1..2 100644", None), ("--- a/x", None), ("+++ b/x", None)),
        each=(("@@ -{id},2 +{id},3 @@ fn f{d}", "@{id},2|{id},3 fn f{d}"), (" a{id}", " a{id}"), ("+b{e}", "+b{e}"))),
    Script("git_diff", "git.diff", each=(("diff --git a/s{id} b/s{id}", "d s{id}", EVEN), ("diff --git a/s{id} b/t{id}", "d s{id} -> t{id}", ODD), ("similarity index 90%", None, ODD), ("rename from s{id}", None, ODD), ("rename to t{id}", None, ODD), ("index 1..2", None), ("--- a/s{id}", None), ("+++ b/s{id}", None),
        ("@@ -1,2 +1,2 @@", "@1,2|1,2"), ("-{esc}[31mold{esc}[m", "-old"), ("+new {d}", "+new {d}"), ("Binary files a/q and b/q differ", "B", EVEN))),
    Script("git_branch_verbose", "git_branch", head=(("* main     {csha7} [origin/main: gone] last of {cust}", "* main {csha7} @origin/main gone last of {cust}"),), each=(("  b{id}  {sha7} work {id}", "b{id} {sha7} work {id} =o", EVEN), ("  l{id}  {sha7} [origin/l] x", "l{id} {sha7} @origin/l x", ODD), ("  remotes/origin/b{id} {sha7} work", None, EVEN),
        ("  remotes/origin/q{id}", " remotes/origin/q{id}", ODD))),
    Script("git_commit", "git_commit", head=(("[c{cust} (root-commit) {csha7}] add {n}", "c {csha7} c{cust} add {n}"), (" {n} files changed, {even} insertions(+), {odd} deletions(-)", "+{even}/-{odd} files={n}")), each=((" create mode 100644 top{id}", "+ top{id}", EVEN), (" delete mode 100644 old{id}", "- old{id}", ODD)),
        tail=((" create mode 100644 d/x1", "+ d/ x3"), *gone(" create mode 100644 d/x2", " create mode 100644 d/x3"))),
    Script("git_merge", "git_merge", head=(("Updating 0123456789..abcdef0123", "@ ff 0123456..abcdef0"), ("Fast-forward", None), (" lib/a | 3 ++-", "lib/ x3"), (" lib/b | 2 ++", None), (" lib/c | 2 ++", None)), each=((" f{id} | {d} ++", "f{id} |{d}"), ("CONFLICT (content): Merge conflict in c{id}", "! conflict c{id}", EVEN)),
        tail=((" {n} files changed, {even} insertions(+)", "+{even}/-0 files={n}"),)),
    Script("git_blame", "git_blame", head=(("{csha} (Bo 2024-01-02 10:00:00 +0000 1) x", "b {csha7} 2024-01-02 Bo"), (None, " x"), ("{csha} (Bo 2024-01-02 10:00:00 +0000 2) y", " y"), ("{csha} (Bo 2024-01-02 10:00:00 +0000 3) z", " z"), ("{csha} (Bo 2024-01-02 10:00:00 +0000 4) w", " (+1)")),
        each=(("{sha} (w{id} 2024-01-02 10:00:00 +0000 {d}) code {id}", "b {sha7} 2024-01-02 w{id}"), (None, " code {id}"))),
    Script("git_checkout", "git.checkout", each=(("M{tab}f{id}", "M f{id}", EVEN), ("D{tab}f{id}", "d f{id}", ODD), ("some chatter", None))),
    Script("git_switch", "git.checkout", stream="stderr", head=(("Switched to branch 'b{cust}'", "^ b{cust}"),), each=(("HEAD is now at {sha} did {id}", "^ detached {sha7} did {id}", EVEN), ("Previous HEAD position was x", None, ODD)), tail=(("Your branch is up to date with 'origin/b{cust}'.", "= origin/b{cust}"),)),
    Script("git_fetch", "git.fetched", stream="stderr", head=(("remote: Enumerating objects: {n}, done.", None), ("From host:x", None)), each=(("   {sha}..{sha}  b{id} -> origin/b{id}", "< {sha7}..{sha7} b{id} -> origin/b{id}", EVEN), (" * [new branch]      n{id} -> origin/n{id}", "+ new n{id} -> origin/n{id}", ODD), (" - [deleted]         (none) -> origin/g{id}", "- deleted (none) -> origin/g{id}", ODD))),
    Script("git_push", "git.pushed", stream="stderr", odd="hint: something else", head=(("Counting objects: {n}, done.", None), ("To host:x", None)), each=(("   {sha}..{sha}  b{id} -> b{id}", "> {sha7}..{sha7} b{id}", EVEN), (" ! [rejected]        r{id} -> r{id} (fetch first)", "! rejected r{id} -> r{id} (fetch first)", ODD))),
    Script("git_pull", "git_pull", head=(("Updating {csha7}..abcdef0", "@ fast-forward {csha7}..abcdef0"), ("Fast-forward", None)), each=((" f{id} | 2 +-", None),), tail=((" {n} files changed, {even} insertions(+), {odd} deletions(-)", "+{even}/-{odd} files={n}"),)),
    Script("git_rebase", "git_rebase", each=(("Applying: step {id}", "r step {id}"), ("CONFLICT (content): Merge conflict in f{id}", "! conflict f{id}", ODD), ("Using index info", None)), tail=(("Successfully rebased and updated refs/heads/b{cust}.", "@ rebased b{cust}"),)),
    Script("git_stash", "git_stash", tail=(("Saved working directory and index state WIP on b{cust}: {csha7} did it", "$ b{cust} {csha7} did it"),)),
    Script("git_stack_log", "git_stack_log", odd="plain text", each=(("◉  b{id}", "◉  b{id}"), ("│  {d} hours ago", None), ("│", None), ("│  {sha7} - did {id}", "│  {sha7} - did {id}"))),
    Script("cargo_test", "cargo_test", head=(("Compiling x", None), ("Finished y", "Finished y"), ("Running z", "Running z"), ("running {n} tests", "running {n} tests")), each=(("note: run with a backtrace", None), ("error[E{id}]: bad", "error[E{id}]: bad", ODD), ("  --> src/x.rs:{d}:1", "--> src/x.rs:{d}:1", ODD), ("", None)),
        tail=(("failures:", None), ("    a::b", None), ("", None), ("test result: FAILED. {even} passed; {odd} failed; 0 ignored; finished in 0.0{n}s", "res {even}p {odd}f 0.0{n}s"))),
    Script("jest", "jest", each=(("PASS src/p{id}.js", None, EVEN), ("  ✓ works (3 ms)", None, EVEN), ("FAIL src/f{id}.js", "FAIL src/f{id}.js", ODD), ("  ● adds {id}", "● adds {id}", ODD), ("    Expected: {d}", "Expected: {d}", ODD), ("", None)), tail=(("Test Suites: {odd} failed, {n} total", "Test Suites: {odd} failed, {n} total", ANY_ODD),
        ("Test Suites: {n} passed", None, NONE_ODD), (None, "all tests passed", NONE_ODD), ("Time: 3 s", None))),
    Script("mocha", "js_test", each=(("    ✔ fine {id}", None),), tail=(("  {even} passing (3ms)", "{even} passing (3ms)"), ("  {odd} failing", "{odd} failing"), ("", None), ("  1) suite {cust}", "1) suite {cust}"), ("     Error: x", "     Error: x"))),
    Script("node_test", "js_test", head=(("TAP version 13", None),), each=(("ok {d} - fine {id}", None, EVEN), ("  ---", None, EVEN), ("  duration_ms: 1", None, EVEN), ("  ...", None, EVEN), ("not ok {d} - bad {id}", "not ok {d} - bad {id}", ODD), ("  error: e{id}", "  error: e{id}", ODD), ("  ...", "  ...", ODD)),
        tail=(("# tests {n}", "# tests {n}"), ("# pass {even}", "# pass {even}"), ("# fail {odd}", "# fail {odd}"))),
    Script("go_test", "go_test", each=(("=== RUN   T{id}", None), ("    x_test.go:{d}: got {id}", "x_test.go:{d}: got {id}", ODD), ("--- FAIL: T{id} (0.00s)", "--- FAIL: T{id} (0.00s)", ODD), ("--- PASS: T{id} (0.00s)", None, EVEN)), tail=(("FAIL{tab}pkg/c{cust}{tab}0.1s", "FAIL{tab}pkg/c{cust}{tab}0.1s", ANY_ODD), ("ok  {tab}pkg/c{cust}{tab}0.1s", None, NONE_ODD),
        (None, "all tests passed", NONE_ODD))),
    Script("pytest", "pytest", head=(("collected {n} items", "collected {n} items", ANY_ODD), ("collected {n} items", None, NONE_ODD), ("", None)), each=(("tests/t{id}.py .", None, EVEN), ("", None), (">       check({id})", ">       check({id})", ODD), ("E       AssertionError: {id}", "E       AssertionError: {id}", ODD), ("", None)),
        tail=(("==== {odd} failed, {even} passed in 1s ====", "{odd} failed, {even} passed in 1s", ANY_ODD), ("==== {even} passed in 1s ====", None, NONE_ODD), (None, "all tests passed", NONE_ODD))),
    Script("nextest", "nextest",
        head=(("    Starting {n} tests across 2 binaries", None),), each=(("        PASS [   0.01s] t{id}", None),), tail=(("        FAIL [   0.02s] z", "        FAIL [   0.02s] z"), ("    because", "    because"), ("        PASS [   0.02s] y", None), ("     Summary [   1s] {n} tests run: 1 failed", "     Summary [   1s] {n} tests run: 1 failed"))),
    Script("rspec", "rspec", each=(("progress {id}", None),), tail=(("Failures:", "Failures:"), ("  1) c{cust}", "  1) c{cust}"), ("Finished in 1s", "Finished in 1s"), ("{n} examples, 1 failure", "{n} examples, 1 failure"))),
    Script("dotnet_test", "dotnet_test", head=(("Test run for x.dll", None), ("Starting test execution, please wait...", None)), each=(("  ran {id}", None),), tail=(("Passed!  - Failed: 0, Passed: {n}, Skipped: 0, Total: {n}", "Passed!  - Failed: 0, Passed: {n}, Skipped: 0, Total: {n}"),)),
    Script("playwright", "playwright", head=(("Running {n} tests using 4 workers", "Running {n} tests using 4 workers"),), each=(("  ✓ t{id}", None), ("    Error: e{id}", "Error: e{id}", ODD), ("    at f{id}:1", "at f{id}:1", ODD)), tail=(("  {even} passed (1s)", "{even} passed (1s)"),)),
    Script("native_build", "native_build", head=(("make[1]: Entering directory 'x'", None),), each=(("   Compiling c{id} v0.1", None), ("gcc -c f{id}.c", None, EVEN), ("[{d}/10] CXX f{id}", None), ("src/x.c:{id}: warning: w", "src/x.c:{id}: warning: w", ODD)), tail=(("    Finished dev [unopt]", None), ("[10/10] LINK x", None),
        (None, "cargo: Finished dev; {n} crates"), (None, "Compiled {even} (make)", "sum(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END) > 0"), (None, "built 10 (ninja)"))),
    Script("frontend_build", "frontend_build", head=(("vite v5.0 building for production...", "vite v5.0 building for production..."), ("transforming...", None), ("Tasks:  1", None)), each=(("note {id}", "note {id}", ODD), ("cache hit, replaying logs {id}", None)), tail=(("dist/a.js   10.50 kB │ gzip: 3 kB", None), ("dist/b.js   2.1 MB │ gzip: 1 MB", None),
        ("asset m.js 900 bytes [emitted]", None), ("✓ built in 3s", "✓ built in 3s"), (None, ""), (None, "assets x3; largest:"), (None, "- dist/b.js 2.1 MB"), (None, "- dist/a.js 10.50 kB"), (None, "- asset m.js 900 bytes [emitted]"))),
    Script("esbuild", "esbuild", each=(("  out/f{id}.js   {d}.5kb", "out/f{id}.js {d}.5kb"), ("chatter about it", None), ("✘ [ERROR] Error: no {id}", "✘ [ERROR] Error: no {id}", ODD)), tail=(("⚡ Done in {n}ms", "Done in {n}ms"),)),
    Script("gradle", "gradle", each=(("> Task :a{id}", None, EVEN), ("> Task :a{id} FAILED", "> Task :a{id} FAILED", ODD), ("    at x.Y.z(Y.java:{d})", "at x.Y.z(Y.java:{d})", ODD), ("noise", None), ("", None)), tail=(("* What went wrong:", "* What went wrong:"), ("> no {cust}", "> no {cust}"), ("* Try:", None), ("> Run with x", None),
        ("BUILD FAILED in 1s", "BUILD FAILED in 1s"))),
    Script("maven", "maven", each=(("[INFO] Compiling {id}", None), ("[ERROR] X{id}.java", "[ERROR] X{id}.java", ODD), ("  symbol: y{id}", "symbol: y{id}", ODD), ("  other", None), ("[WARNING] w{id}", "[WARNING] w{id}", EVEN)), tail=(("[INFO] BUILD FAILURE", "BUILD FAILURE"), ("[INFO] Total time: 1 s", "[INFO] Total time: 1 s"))),
    Script("package_tool", "package_tool", head=(("Preparing packages...", None),), each=((" + p{id}==1.{d}", " + p{id}==1.{d}"), ("   fetching", None)), tail=(("Done in 1s", "Done in 1s"),)),
    Script("prisma", "prisma", head=(("Environment variables loaded from .env", None), ("Prisma schema loaded from x", None), ("", None)), each=(("Applying migration `m{id}`", "Applying migration `m{id}`"), ("", ""))),
    Script("rake_tasks", "rake_tasks", each=(("rake t{id}  # does {d}", "rake t{id}  # does {d}"),)),
    Script("npm_install", "npm_install", each=(("npm WARN w{id}", "npm WARN w{id}", ODD), ("npm notice n{id}", None)), head=((None, "deprecated x2: @s/a, b"), ("npm WARN deprecated @s/a@1.0.0: old", None), ("npm WARN deprecated b@2: x", None)),
        tail=(("added {n} packages in 2s", "added {n} packages in 2s"), ("found 0 vulnerabilities", "found 0 vulnerabilities"))),
    Script("pnpm_install", "pnpm_install", head=((" WARN  w{cust}", "WARN  w{cust}"), ("Progress: resolved 1", None)), each=(("WARN e{id}", "WARN e{id}", ODD),), tail=(("added {n} packages", None), ("dependencies:", None), ("+ a 1.0.0 (2.0.0 is available)", None), ("+ b 2.0.0", None), ("", None), ("devDependencies:", None), ("+ c 3", None), (None, "deps +2: a 1.0.0, b 2.0.0"), (None, "dev +1: c 3"),
        (None, "added {n} packages"))),
    Script("yarn_install", "yarn_install", head=(("yarn add v1", None),), each=(("warning w{id}", "warning w{id}", ODD), ("[1/4] step", None)), tail=(("success Saved lockfile.", None), ("info Direct dependencies", None), ("└─ a@1.0", None), ("info All dependencies", None), ("├─ z@9", None), (None, "deps +1: a@1.0"), ("success Saved {n} new dependencies.", "success Saved {n} new dependencies."),
        ("Done in 1s.", "Done in 1s."))),
    Script("composer_install", "install", head=(("Loading composer repositories with package information", None), ("Using version ^1.{n} for a/b", "Using version ^1.{n} for a/b"), ("Package operations: {n} installs", "Package operations: {n} installs")), each=(("  - Installing a/p{id} (1.0)", None), ("warning {id}", "warning {id}", ODD)), tail=(("No security vulnerability advisories found", "No security vulnerability advisories found"),)),
    Script("package_tree", "package_tree", head=(("app@1.{n} /x", "app@1.{n} /x"), (None, "deps +2: a@1, b@2"), (None, "nested rows x{n}"), ("├── a@1", None)), each=(("│ └── n{id}@1", None),), tail=(("└── b@2", None),)),
    Script("pnpm_outdated", "pnpm_outdated", odd="┌ oops", head=(("┌─────┬─────┬─────┐", None), ("│ Package │ Current │ Latest │", "Package Current Latest"), ("├─────┼─────┼─────┤", None)), each=(("│ p{id}   │ 1.{d} │ 2.0 │", "p{id} 1.{d} 2.0"),), tail=(("└─────┴─────┴─────┘", None),)),
    Script("pip_install", "pip_install", head=((None, "Collecting 1: a"), (None, "Downloaded {n} files"), (None, "Satisfied 2: b, ... (+1)"), (None, "Installing 2: a, c"), ("Collecting a", None), ("Requirement already satisfied: b in /x", None), ("Requirement already satisfied: b (from c)", None)), each=(("  Downloading p{id}.whl (1 kB)", None), ("     ---- 1.0 MB/s eta 0:00:01", None), ("note {id}", "note {id}", ODD)),
        tail=(("Installing collected packages: a, c", None), ("Successfully installed a-1 c-2", "Successfully installed a-1 c-2"))),
    Script("uv_tree", "uv", head=(("Resolved {n} packages in 1ms", "Resolved {n} packages in 1ms"),), each=(("├── p{id} v1.{d}", "├── p{id} v1.{d}", EVEN), (" + p{id}==1", " + p{id}==1", ODD), ("downloading", None))),
    Script("ls_long", "ls_long", odd="what is this", head=(("total {n}", None), ("drwxr-xr-x  2 u g 64 Jan  1 10:00 .", None)), each=(("-rw-r--r--  1 u g {id} Jan  1 10:00 a file {id}", "a file {id}", EVEN), ("drwxr-xr-x  2 u g 64 Jan  1 10:00 d{id}", "d{id}/", ODD))),
    Script("ls_recursive", "ls", head=((".:", None), ("one", "./one"), ("two", "./two"), ("", None)), each=(("d{id}:", "d{id}/ (4 entries: a, b, c; 1 omitted; --raw for all)"), ("a", None), ("b", None), ("c", None), ("d", None), ("", None))),
    Script("ls_columns", "ls_columns", tail=(("b{cust}  c{cust}{tab}a{cust}", "a{cust}"), (None, "b{cust}"), (None, "c{cust}"))),
    Script("find_long", "find_long", odd="find: no", head=(("  1  8 -rw-r--r--  1 u g 9 Jan  1 10:00 a/w", "a/ (5 entries: s, t/, u; 1 omitted; last: w; --raw for all)"), ("  2  8 drwxr-xr-x  1 u g 9 Jan  1 10:00 a/t", None),
        ("  3  8 -rw-r--r--  1 u g 9 Jan  1 10:00 a/s", None), ("  4  8 -rw-r--r--  1 u g 9 Jan  1 10:00 a/u", None), ("  5  8 -rw-r--r--  1 u g 9 Jan  1 10:00 a/v", None)), tail=(("  9  8 -rw-r--r--  1 u g 9 Jan  1 10:00 z{cust}/only", "z{cust}/only"),)),
    Script("tree", "trees.tree", head=((".", "."),), each=(("├── d{id}", "  d{id}/ (4 files: a, b, c; 1 omitted; --raw for all)"), ("│   ├── a", None), ("│   ├── b", None), ("│   ├── c", None), ("│   └── e", None)), tail=(("└── last", "  last"), ("", None), ("{n} directories, 9 files", "{n} directories, 9 files"))),
    Script("tree_pipe", "trees.drawn", head=((".", "."), ("├── z", "  z")), each=(("├── f{id}", "~f{id}"),)),
    Script("difference", "difference", odd="Only in x: y", each=(("{id}c{id}", "@{id}c{id}"), ("< old {d}", "-old {d}"), ("---", None), ("> new {d}", "+new {d}"))),
    Script("unified_difference", "difference", odd="Only in x: y", each=(("--- a{id}", "--- a{id}"), ("+++ b{id}", "+++ b{id}"), ("@@ -1,2 +{id},2 @@ f", "@1,2|{id},2 f"), (" same", " same"), ("-x{d}", "-x{d}"), ("+y{d}", "+y{d}"))),
    Script("wc", "listing.word_counts", each=(("  {d}  {id}   {e} f{id}.txt", "{d} {id} {e} f{id}.txt"), ("none", "none", ODD))),
    Script("du_rows", "du_rows", odd="du: denied", each=(("{id}K{tab}/a/{id}", "{id}K{tab}/a/{id}", "o_orderkey < 100"), ("1234{tab}/c{id}", "1200{tab}/c{id}"))),
    Script("curl_trace", "curl_trace", head=(("* Trying 1.2.3.4:80...", "* Trying 1.2.3.4:80..."), ("* TLSv1.3 (OUT)", None), ("* Server certificate:", None), ("*  subject: x", None), ("> GET /c{cust} HTTP/1.1", "> GET /c{cust} HTTP/1.1"), ("{ [5 bytes data]", None)), each=(("< x-{id}: {d}", "< x-{id}: {d}"),)),
    Script("curl", "curl", stream="stderr", head=(("> GET /c{cust} HTTP/1.1", "curl GET h{cust}.x/c{cust} -> HTTP/1.1 200 OK text/html len={n}"), ("> Host: h{cust}.x", None), ("< HTTP/1.1 200 OK", None), ("< Content-Type: text/html; charset=x", None), ("< Content-Length: {n}", None)), each=(("* note {id}", None),)),
    Script("gh_view", "gh_view", odd="no fields", head=(("title:{tab}T{cust}", "#{n} OPEN T{cust}"), ("state:{tab}OPEN", None), ("labels:{tab}", None), ("author:{tab}a{cust}", "author:{tab}a{cust}"), ("number:{tab}{n}", None), ("--", None)), each=(("body {id}", "body {id}"), ("", ""))),
    Script("gh_run_list", "headed.run_list", head=(("STATUS     TITLE    WORKFLOW  BRANCH  EVENT  ID    ELAPSED  AGE", "STATUS TITLE WORKFLOW BRANCH EVENT ID ELAPSED AGE"),), each=(("completed  fix {d}    ci        main    push   123   1m       2d", "completed fix {d} ci main push 123 1m 2d"),)),
    Script("gh_run_view", "gh_run_view", head=(("main · 1", "main · 1"), ("", None), ("JOBS", "JOBS"), (None, "✓ {even} passed", "sum(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END) > 0")), each=(("✓ j{id} in 1s", None, EVEN), ("X j{id} in 2s", "X j{id} in 2s", ODD), ("  ✓ set up", None, ODD), (None, "  ✓ 1 steps passed", ODD), ("  X run {d}", "  X run {d}", ODD)),
        tail=(("", None), ("ANNOTATIONS", "ANNOTATIONS"), ("X exit 1", "X exit 1  [×2: a, b]"), ("a: x#1", None), ("X exit 1", None), ("b: y#2", None), ("", None), ("To see what failed, try: x", "To see what failed, try: x"))),
    Script("gh_pr_list", "headed.pr_list", head=(("Showing {n} of {n} open pull requests in a/b", "Showing {n} of {n} open pull requests in a/b"), ("", None)), each=(("#{id}  title {d}  branch", "#{id}  title {d}  branch"), ("loading", None))),
    Script("gh_table", "headed.ragged", head=(("NAME        STATE  AGE", "NAME{tab}STATE{tab}AGE"),), each=(("n{d}          open   {e}d", "n{d}{tab}open{tab}{e}d", EVEN), ("a longer name {d}  shut   {e}d", "a longer name {d}{tab}shut{tab}{e}d", ODD)), tail=(("Showing {n}  of  {n}", "Showing {n} of {n}"),)),
    Script("acli_table", "headed.single_blanks", each=(("T{id}    open{tab}x  {d}", "T{id} open x {d}"),)),
    Script("acli_view", "acli_view", head=(("Key: K-{cust}", "Key: K-{cust}"), ("chatter", None), ("Description:", "Description:"), ("   said {n}", "  said {n}"), ("more of it", None), ("Fields:", "Fields:")), each=(("F{id}:", "F{id}:"), ("  v{d}", "  v{d}"))),
    Script("pup_table", "headed.bars", head=(("+----+----+", None), ("| ID | N |", "ID{tab}N"), ("|----|---|", None)), each=(("| {id} | {d} |", "{id}{tab}{d}"),), tail=(("+----+----+", None), ("{n} rows", "{n} rows"))),
    Script("sqlite_table", "headed.ruled", head=(("id          n", "id{tab}n"), ("----------  --", None)), each=(("k{d}          {e}", "k{d}{tab}{e}"),)),
    Script("mypy", "mypy", odd="Traceback", each=(("f{id}.py:{d}: error: bad", "f{id}.py:{d}: error: bad"), ("    x = {id}", "    x = {id}")), tail=(("Found {n} errors in 1 file", "Found {n} errors in 1 file"),)),
    Script("ruff_concise", "ruff", each=(("f{id}.py:{d}:1: E501 long", "f{id}.py"), (None, "  {d}:1 E501 long"), ("f{id}.py:9:1: F401 unused", "  9:1 F401 unused", ODD), ("chatter", None)), tail=(("Found {n} errors.", "Found {n} errors."),)),
    Script("ruff_full", "ruff", each=(("E501 Line {id}", "E501 Line {id}"), (" --> f{id}.py:{d}:1", " --> f{id}.py:{d}:1"), ("  |", "  |")), tail=(("Found {n} errors.", "Found {n} errors."), ("after", None))),
    Script("golangci_lint", "golangci_lint", each=(("f{id}.go:{d}:1: unused x (errcheck)", "f{id}.go:{d}:1: unused x (errcheck)"), ("{tab}x := {id}", "{tab}x := {id}"), ("level=info", None)), tail=(("{n} issues:", "{n} issues:"), ("* errcheck: 1", None))),
    Script("rubocop", "rubocop", head=(("Inspecting {n} files", None), ("Offenses:", None), ("", None)), each=(("f{id}.rb:{d}:1: C: Style/X: bad", "f{id}.rb:{d}:1: C: Style/X: bad"), ("x = {id}", "x = {id}"), ("", None)), tail=(("{n} files inspected, {n} offenses detected", "{n} files inspected, {n} offenses detected"),)),
    Script("lint", "lint", each=(("/src/f{id}.js", "/src/f{id}.js", ODD), ("/src/f{id}.js", None, EVEN), ("  {d}:1   error   no {id}  no-x", "{d}:1 error no {id} no-x", ODD), ("", None)), tail=(("✖ {odd} problems", "✖ {odd} problems"),)),
    Script("prettier", "prettier", head=((None, "[warn] c{cust}"), (None, "formatted 2: a.js, b.js"), ("a.js 12ms", None), ("b.js 1ms", None)), each=(("u{id}.js 3ms (unchanged)", None),), tail=(("[warn] c{cust}", None),)),
    Script("plan_actions", "keep_body.plan", head=(("Terraform will perform the following actions:", "Terraform will perform the following actions:"),), each=(("  # x.r{id} will be updated in-place", "# x.r{id} will be updated in-place"), ("      ~ size = {d} -> 9 # forces replacement", "~ size = {d} -> 9 # forces replacement"), ("        id = {id}", None)), tail=(("Plan: 0 to add, {n} to change", "Plan: 0 to add, {n} to change"),)),
    Script("git_config", "git.trimmed", each=(("  user.n{id}=v {d}  ", "user.n{id}=v {d}"), ("", None))),
    Script("git_remotes", "git.remotes", each=(("r{id}{tab}https://h/{d}.git (fetch)", "r{id} https://h/{d}.git (fetch)"),), odd="bad line"),
    Script("git_shortlog", "git.shortlog", each=(("   {d}{tab}A{id} B", "{d} A{id} B"),)),
    Script("git_worktrees", "shell.worktrees", each=(("/w/t{id}     {sha7} [b{d}]", "/w/t{id} {sha7} [b{d}]", EVEN), ("/w/t{id}  {sha7} (detached HEAD)", "/w/t{id}  {sha7} (detached HEAD)", ODD))),
    Script("git_add", "shell.git_add", head=(("The following paths are ignored by one of your .gitignore files:", None), ("{tab}ig{cust}", "! ig{cust}"), ("", None)), each=(("fatal: pathspec 'p{id}' did not match any files", "! p{id}", EVEN), ("warning: CRLF will be replaced by LF in w{id}.", "! w{id}", ODD))),
    Script("helm_list", "tables.helm_list", head=(("NAME NAMESPACE REVISION UPDATED STATUS CHART APP", None),), each=(("r{id}  ns{d}  {e}  2024-01-02 10:00:00.0 +0000 UTC  deployed  c-1.{d}  2.{e}", "r{id} ns{d} r{e} deployed c-1.{d} 2.{e}"),)),
    Script("helm_history", "tables.helm_history", head=(("REVISION UPDATED STATUS CHART APP DESCRIPTION", None),), each=(("{id}  Mon Jan 1 10:00:00 2024  superseded  c-1.{d}  2.{e}  Install complete", "r{id} superseded c-1.{d} 2.{e} Install complete"),)),
    Script("helm_status", "tables.helm_status", head=(("NAME: r{cust}", "NAME: r{cust}"), ("LAST DEPLOYED: now", None), ("STATUS: deployed", "STATUS: deployed"), ("NOTES:", "NOTES:")), each=(("open port {id}", "open port {id}"), ("", None))),
    Script("docker_stats", "keep.docker_stats", head=(("CONTAINER ID  NAME  CPU %  MEM USAGE / LIMIT  MEM %", None),), each=(("abc{id}  web-{id}  {d}.1%  {e}MiB / 2GiB  {d}.5%  1B / 2B", "web-{id} {d}.1% {e}MiB/2GiB {d}.5%"),)),
    Script("psql_rows", "tables.psql", head=((" id | n ", "id{tab}n"), ("----+---", None)), each=((" {id} | {d} ", "{id}{tab}{d}"),), tail=(("({n} rows)", "({n} rows)"),)),
    Script("pre_commit", "keep.pre_commit", each=(("check {id}............Passed", None, EVEN), ("lint {id}.......Failed", "lint {id} Failed", ODD), ("- hook id: h{id}", "- hook id: h{id}", ODD), ("some words", None, ODD)), tail=((None, "passed: 1 hook", "sum(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END) = 1"), (None, "passed: {even} hooks", "sum(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END) > 1"))),
)
