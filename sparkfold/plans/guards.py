"""Routing by content and the guards around it, as projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfold.functions import text as T

#: Bytes from which a body is not looked into.
MOST = 16 * 1024 * 1024
#: Substrings that hint at a tool's output (fixed values).
SIGNALS = {
    "js_test": (" passing", " failing", "# tests "),
    "go_test": ("--- ", "=== ", "Benchmark", "FAIL\t", "ok  \t"),
    "npm_install": ("Done in ", "Lock file operations:", "Nothing to install", "No security vulnerability", "Packages: ", "Package operations:", "Your requirements could not be resolved", "added ", "audited ", "npm ", "packages installed", "success Saved ", "up to date"),
    "tsc": ("Found ", "error TS"),
    "jest": ("Test",),
    "pytest": ("collected ", "failed in ", "passed in ", "test session starts"),
    "cargo_test": ("test",),
}


def signal(name: str, body: Column) -> Column:
    needles = SIGNALS[name]
    out = F.contains(body, F.lit(needles[0]))
    for n in needles[1:]:
        out = out | F.contains(body, F.lit(n))
    return out


def signals(bodies: DataFrame, key: str = "capture_id", body: str = "body") -> DataFrame:
    return bodies.select(key, *[signal(k, F.col(body)).alias(k) for k in SIGNALS])


def first_line(body: Column) -> Column:
    """The first line that is not empty; null if there is none."""
    line = F.regexp_extract(body, r"^\n*([^\n]*)", 1)
    return F.when(line != "", line)


def route(body: Column) -> Column:
    """Which operator takes a piped body; the first that recognises it. A body at the size limit passes as it is."""
    line = F.coalesce(first_line(body), F.lit(""))
    table = F.startswith(line, F.lit("CONTAINER ID")) | F.startswith(line, F.lit("NAME")) & F.contains(line, F.lit("STATUS")) & (F.contains(line, F.lit("READY")) | F.contains(line, F.lit("IMAGE")) & F.contains(line, F.lit("SERVICE")))
    curl = F.regexp_like(body, F.lit(r"(?m)^[*<>]"))
    tsc = F.contains(body, F.lit("error TS")) | F.contains(body, F.lit("Found 0 errors")) | F.contains(body, F.lit("Found ")) & F.contains(body, F.lit(" errors in "))
    return (
        F.when(F.octet_length(body) >= MOST, "passthrough")
        .when(F.regexp_like(line, F.lit(r"^[* ] [^ ]")) & (F.length(line) >= 3), "git_branch")
        .when(F.regexp_like(line, F.lit(r"^[0-9A-Fa-f]{7} [^ ]+?@\{\d+\}: ")), "git_reflog")
        .when(F.startswith(line, F.lit("diff --git ")), "git_diff")
        .when(signal("tsc", body) & tsc, "tsc")
        .when(table, "container")
        .when(curl, "curl")
        .when(T.compactible(body), "generic")
        .otherwise("passthrough")
    )


def guarded(captures: DataFrame) -> DataFrame:
    """What is shown of captures (stdout, stderr, exit_code, lossless, out_stdout, out_stderr, filter_name, evidence). A compact form that may have
    lost something is not shown of a failed command, nor any of a lossless one, nor one that is null."""
    c = captures
    shorter = F.col("out_stdout").isNotNull() & F.col("out_stderr").isNotNull()
    changed = shorter & ((F.col("out_stdout") != F.col("stdout")) | (F.col("out_stderr") != F.col("stderr")))
    raw = F.col("lossless") | ~shorter | (changed & (F.col("exit_code") != 0) & (F.col("evidence") == "PotentiallyLossy"))
    c = c.withColumn("raw", raw)
    out = c.withColumn("shown_stdout", F.when(F.col("raw"), F.col("stdout")).otherwise(F.col("out_stdout"))).withColumn("shown_stderr", F.when(F.col("raw"), F.col("stderr")).otherwise(F.col("out_stderr")))
    quiet = (F.col("shown_stdout") == "") & (F.col("shown_stderr") == "")
    hint = F.format_string("(CMD exited %d with no output)", "exit_code")
    return out.select(
        "capture_id", F.when(F.col("raw"), "passthrough").otherwise(F.col("filter_name")).alias("filter_name"), F.when(F.col("raw"), "ByteExact").otherwise(F.col("evidence")).alias("evidence"),
        F.when(quiet, hint).otherwise(F.col("shown_stdout")).alias("shown_stdout"), "shown_stderr",
    )


def one_stream(captures: DataFrame) -> DataFrame:
    """The one stream with content, and which; none where both have some, as no single-stream operator may choose."""
    both = (F.col("stdout") != "") & (F.col("stderr") != "")
    side = F.when(both, None).when(F.col("stdout") != "", "stdout").otherwise("stderr")
    return captures.select("capture_id", side.alias("side"), F.when(side == "stdout", F.col("stdout")).when(side == "stderr", F.col("stderr")).alias("body"))


#: Forms by what a body looks like: (form, pattern in its first line that is not empty, pattern anywhere), in order (fixed values).
LOOKS = (
    ("git_status", r"^(?:On branch |HEAD detached |\s*(?:interactive rebase in progress|You have unmerged paths|You are currently ))", ""), ("git_branch", r"^[* ] [^ ].*", ""), ("git_show", r"^commit [0-9a-fA-F]{40}(?:[ \t]|$)", r"(?m)^diff --git a/"), ("git_diff", r"^diff --git ", ""),
    ("git_log", r"^commit [0-9a-fA-F]{40}(?:[ \t]|$)", ""), ("git_commit", r"^\[.* [0-9a-fA-F]{7}\]", ""), ("git_merge", r"^(?:Merge made by|Updating .*\.\.|Already up to date)", ""), ("git_blame", r"^\^?[0-9a-fA-F]{7,}\s*\(", ""),
    ("cargo_test", "", r"test result:|(?m)^\s*running .* test"), ("jest", "", r"Test Suites:|Test Files|(?m)^Tests:"), ("js_test", "", r"(?m)^\s*\d+ (?:passing|failing)(?:$| \()|(?m)^\s*# tests "), ("go_test", "", r"=== RUN|--- (?:FAIL|PASS):|(?m)^(?:Benchmark|ok  \t|FAIL\t)|=== FUZZ"),
    ("pytest", "", r"test session starts|(?:passed|failed) in |collected .* item"), ("docker_ps", r"^CONTAINER ID|^NAME.*IMAGE.*SERVICE.*STATUS", ""), ("kubectl_pods", r"^NAME.*READY.*STATUS", ""),
    ("install", "", r"added (?s:.*)packages|up to date.*(?:audited|packages)|audited (?s:.*)packages|npm error|npm ERR!|npm WARN|Packages: [+-]|Already up to date| packages installed \[|success Saved |Package operations:|Lock file operations:|Nothing to install|Your requirements could not be resolved"),
    ("tree_pipe", "", r"^(?![ \t]).*\n?(?:.*\n){0,5}?(?:[├└│]|(?:\|   |    )*(?:\|-- |`-- ))"), ("ls_long", r"^(?:total \d+$|[dlcbps-][rwxsStT-]{9})", ""), ("find_long", r"^\s*\d+\s+\d+\s+[dlcbps-][rwxsStT-]{9}", ""), ("du", r"^[ \t]*\d+(?:\.\d*)?[KMGTPEkmgtpe]?[bB]?\t.", ""),
    ("curl_trace", r"^[*<>]", r"(?m)^> [A-Z]+ "),
)

#: Forms of LOOKS whose pattern needs one of the substrings of SIGNALS.
HINTED = {name: name for name in ("cargo_test", "jest", "js_test", "go_test", "pytest")} | {"install": "npm_install"}


def looks_like(body: Column, line: Column | None = None) -> Column:
    """The form that a body's content calls for; null for none, and for a body at the size limit. `line`: its `first_line`, where that is at hand."""
    line = F.coalesce(first_line(body) if line is None else line, F.lit(""))
    out = F.when(F.octet_length(body) >= MOST, F.lit(None).cast("string"))
    for form, first, anywhere in LOOKS:
        rule = F.regexp_like(line, F.lit(first)) if first else F.lit(True)
        hinted = HINTED.get(form)  # a pattern with many branches is only tried on a body that has a substring which it needs
        rule = rule & signal(hinted, body) if hinted else rule
        out = out.when(rule & F.regexp_like(body, F.lit(anywhere)) if anywhere else rule, form)
    return out.when(T.compactible(body), "generic")
