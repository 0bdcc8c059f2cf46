"""One registry over all operators: a table of captures is routed once, kept by route, and each operator that has captures reads its own part.

A route is a projection over the command line, behind its runners (routes.py), or over the content where a shell ran it. Captures with a route
are written once, in a folder per operator; an operator's sub-plan reads that folder alone, and operators without captures are not planned at all. Operators
take a body and give a body: those on line tables explode their own bodies, others are projections. What one does not know comes back as it was.
The guards follow: a lossy form is not shown of a command that failed, and a command that shows nothing says so.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sparkfold.captures.registry import FORMS
from sparkfold.functions import lines as L
from sparkfold.functions import text as T
from sparkfold.operators import captured, checks, commands, git, headed, keep, listing, logs, shell, tables, trees
from sparkfold.plans import guards, policy, routes
from sparkfold.sources.tables import scratch

FACTS, LOSSY = "FactComplete", "PotentiallyLossy"


@dataclass(frozen=True)
class Operator:
    """run(row, body) -> (row, body) of the captures that it knows. `failed`: evidence for a command that failed, None if it is not for those."""

    family: str
    run: Callable[[DataFrame], DataFrame]
    evidence: str = FACTS
    failed: str | None = None
    stream: str = ""  # the one that it takes; else the one that has text, and standard output where both have


def by_lines(operator: Callable[..., DataFrame], *order: str, line: Column | None = None, **more) -> Callable[[DataFrame], DataFrame]:
    """An operator on line tables as one on bodies. `order`: columns that its lines stand in order of; `line`: what is said of a row."""
    order = order or ("line_no",)

    def run(bodies: DataFrame) -> DataFrame:
        # A body is never null, so the outer form gives the same lines; the other one has its input filtered before captures are dealt out.
        table = bodies.select("row", F.posexplode_outer(F.split(F.regexp_replace("body", r"\n\z", ""), "\n")).alias("line_no", "line"))
        out = operator(table, key="row", **more).select("row", F.struct(*order).alias("at"), (F.col("line") if line is None else line).alias("line"))
        return L.render(out, "row", "line", "at")

    return run


def kept(tool: str) -> Callable[[DataFrame], DataFrame]:
    def run(bodies: DataFrame) -> DataFrame:
        return keep.keep(bodies, tool, "row").where("body <> ''")

    return run


def minified(bodies: DataFrame) -> DataFrame:
    return bodies.select("row", T.json_minify(F.col("body")).alias("body")).where("body IS NOT NULL")


def sliced(bodies: DataFrame) -> DataFrame:
    return L.render(listing.file_slice(bodies, "row"), "row")


def _times(table: DataFrame, key: str, compose: bool = False) -> DataFrame:
    return logs.collapse(table, compose, key).withColumn("line", F.concat("line", F.when(F.col("n") > 1, F.concat(F.lit(" ×"), F.col("n").cast("string"))).otherwise("")))


def _repeats(table: DataFrame, key: str) -> DataFrame:
    more = F.concat(F.lit("\n~ x"), F.col("repeats").cast("string"))
    return checks.columns(table, key).withColumn("line", F.concat("line", F.when(F.col("repeats") > 0, more).otherwise("")))


def _buildkit(table: DataFrame, key: str) -> DataFrame:
    return keep.buildkit(table, key).withColumn("line_no", F.lit(0))


OPERATORS = {
    "git_status": Operator("git", by_lines(git.status)),
    "git_log": Operator("git", by_lines(git.log), LOSSY),
    "git_checkout": Operator("git", by_lines(git.checkout)),
    "git_fetch": Operator("git", by_lines(git.fetched)),
    "git_push": Operator("git", by_lines(git.pushed), stream="stderr"),
    "git_status_short": Operator("git", by_lines(git.status_short)),
    "git_branches": Operator("git", by_lines(git.branches)),
    "git_reflog": Operator("git", by_lines(git.reflog)),
    "git_add": Operator("git", by_lines(shell.git_add)),
    "trimmed": Operator("git", by_lines(git.trimmed)),
    "git_remotes": Operator("git", by_lines(git.remotes)),
    "git_shortlog": Operator("git", by_lines(git.shortlog)),
    "git_worktrees": Operator("git", by_lines(shell.worktrees)),
    "git_diff": Operator("git", by_lines(git.diff)),
    "tsc": Operator("test-tools", by_lines(checks.tsc, "ord", "sub"), FACTS, FACTS),
    "ctest": Operator("test-tools", kept("ctest"), LOSSY),
    "cmake": Operator("build", kept("cmake"), LOSSY, FACTS),
    "swift": Operator("build", kept("swift"), LOSSY, FACTS),
    "dotnet": Operator("build", kept("dotnet"), LOSSY, FACTS),
    "buildkit": Operator("build", by_lines(_buildkit), LOSSY),
    "pip_table": Operator("package", by_lines(checks.pip_table)),
    "grep": Operator("listing", by_lines(listing.grep, "ord"), LOSSY),
    "rg_matches": Operator("listing", by_lines(listing.rg)),
    "rg_files": Operator("listing", by_lines(listing.rg_files)),
    "find_paths": Operator("listing", by_lines(listing.find, "parent", "ord"), LOSSY),
    "find_files": Operator("listing", by_lines(listing.find, "parent", "ord", noun="files"), LOSSY),
    "tree": Operator("listing", by_lines(trees.tree), LOSSY),
    "tree_pipe": Operator("listing", by_lines(trees.drawn)),
    "wc": Operator("listing", by_lines(listing.word_counts)),
    "file_slice": Operator("listing", sliced, LOSSY),
    "service_logs": Operator("infra", by_lines(_times)),
    "compose_logs": Operator("infra", by_lines(_times, compose=True)),
    "gh_checks": Operator("infra", by_lines(checks.gh_checks, "ord"), FACTS, FACTS),
    "helm_list": Operator("infra", by_lines(tables.helm_list), LOSSY),
    "helm_history": Operator("infra", by_lines(tables.helm_history), LOSSY),
    "helm_status": Operator("infra", by_lines(tables.helm_status), LOSSY),
    "docker_stats": Operator("infra", by_lines(keep.docker_stats), LOSSY),
    "docker_ps": Operator("infra", by_lines(headed.docker_ps)),
    "docker_images": Operator("infra", by_lines(headed.docker_images)),
    "kubectl_pods": Operator("infra", by_lines(headed.kubectl_pods)),
    "gh_table": Operator("infra", by_lines(headed.ragged)),
    "gh_run_list": Operator("infra", by_lines(headed.run_list)),
    "gh_pr_list": Operator("infra", by_lines(headed.pr_list)),
    "acli_table": Operator("infra", by_lines(headed.single_blanks)),
    "pup_table": Operator("data", by_lines(headed.bars), LOSSY),
    "sqlite_table": Operator("data", by_lines(headed.ruled), LOSSY),
    "json": Operator("data", minified, LOSSY),
    "grid": Operator("data", by_lines(tables.grid), LOSSY),
    "psql": Operator("data", by_lines(tables.psql), LOSSY),
    "columns": Operator("data", by_lines(_repeats), LOSSY),
    "pre_commit": Operator("diagnostics", by_lines(keep.pre_commit), FACTS, FACTS),
    "plan": Operator("diagnostics", kept("plan"), FACTS, FACTS),
}
#: Forms of whole captures (both streams); where an operator has the name, it comes first.
WHOLE = {name: name for name in FORMS if name not in OPERATORS}
#: What a shell's output looks like, by an operator's own mark, in order; then what forms look like.
_SHELL_MARKS = ("git_status_short", "git_reflog", "tsc", "helm_list", "helm_history", "docker_stats", "pre_commit")
#: What a body must begin with, or have, for its mark to be looked for; a pattern is tried at every character.
_BEGINS, _HAS = {"helm_list": "NAME", "helm_history": "REVISION", "docker_stats": "CONTAINER ID"}, {"pre_commit": "..."}


def by_content(body: Column, line: Column | None = None) -> Column:
    """The operator that a body's content calls for; null for none. `line`: its first line with text, where that is at hand."""
    out = F.when(F.octet_length(body) >= guards.MOST, F.lit(None).cast("string"))
    for name in _SHELL_MARKS:
        hint = F.startswith(body, F.lit(_BEGINS[name])) if name in _BEGINS else F.contains(body, F.lit(_HAS[name])) if name in _HAS else guards.signal(name, body) if name in guards.SIGNALS else F.lit(True)
        out = out.when(hint & F.regexp_like(body, F.lit(routes.SEEN[name])), name)
    return out.otherwise(guards.looks_like(body, line))


def _js_runner(body: Column) -> Column:
    return F.when(F.regexp_like(body, F.lit(routes.SEEN["jest"])), "jest").otherwise("js_test")


def _asked(line: Column) -> Column:
    """What a command line says by itself: the operator that it names, whether its output stays as it is, whether a shell ran it."""
    argv = F.coalesce(commands.logical(line)["argv"], line)
    return F.struct(routes.operator_of(argv).alias("named"), policy.passthrough(argv).alias("silent"), policy.in_shell(argv).alias("shell"))


def routed(captures: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """row, capture_id, command, stdout, stderr, exit_code and the operator for each capture, null for none. Streams of 16 MiB and more have none. `lines`: a small
    table of command lines (argv), which are asked once instead of with each capture; others are asked where they are."""
    has = set(captures.columns)
    stream = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in has else F.lit("")
    t = captures.select(
        "capture_id", "argv", stream("stdout").alias("stdout"), stream("stderr").alias("stderr"), F.coalesce(F.col("exit_code").cast("int"), F.lit(0)).alias("exit_code"), F.coalesce("lossless", F.lit(False)).alias("lossless"),
    )
    if lines is None:
        t = t.withColumn("asked", _asked(F.col("argv")))
    else:
        once = lines.select(F.col("argv").alias("line")).distinct().withColumn("known", _asked(F.col("line")))
        t = t.join(F.broadcast(once), F.col("argv") == F.col("line"), "left").withColumn("asked", F.when(F.col("known").isNull(), _asked(F.col("argv"))).otherwise(F.col("known")))
    out = F.col("stdout")
    small = F.greatest(F.octet_length("stdout"), F.octet_length("stderr")).between(1, guards.MOST - 1)
    t = t.withColumn("named", F.when(~F.col("lossless") & small, F.col("asked.named"))).withColumn("first", F.when(F.col("asked.shell") & small, guards.first_line(out)))
    told = F.when(~F.col("lossless") & small & ~F.col("asked.silent"), F.when(F.col("asked.shell"), by_content(out, F.col("first"))).when(T.compactible(out), "generic"))
    body = F.when(out == "", F.col("stderr")).otherwise(out)
    seen = F.when(F.col("named").isNull(), False)
    for name, pattern in routes.SEEN.items():  # each capture is held against its own pattern only
        seen = seen.when(F.col("named") == name, F.regexp_like(out, F.lit(pattern)) | F.regexp_like(F.col("stderr"), F.lit(pattern)))
    operator = F.when(~seen.otherwise(True), told).when(F.col("named") == "script_test", _js_runner(body)).when((F.col("named") == "pup_table") & F.regexp_like(body, F.lit(r"\A\s*[{\[]")), "json").otherwise(F.col("named"))
    # A lambda, though it changes nothing: with one Spark writes the projection as many short methods, else as one too long for the JVM to compile.
    command = F.transform(F.slice("argv", 1, 2), lambda x: x)
    return t.select(F.monotonically_increasing_id().alias("row"), "capture_id", command.alias("command"), "stdout", "stderr", "exit_code", operator.alias("operator"))


#: What is kept of a capture besides its part.
_KEPT = ("row", "capture_id", "command", "stdout", "stderr", "exit_code")


#: Bytes of text that one task takes of an operator's captures; their lines and windows are several times as many.
_TEXT = 16 << 20


def _applied(part: DataFrame, op: Operator, tasks: int) -> DataFrame:
    """_KEPT with got_stdout, got_stderr, family and got_evidence of one operator's captures; what is got is null where it does not know one. It takes the one stream
    that has text; where both have, the first alone. Captures are dealt out once, whole, by `row`: lines, windows and the join stay where their capture lies."""
    evidence = F.when(F.col("exit_code") == 0, op.evidence).otherwise(op.failed)
    mine = part.where("row is not null" if op.failed is not None else "row is not null and exit_code = 0").select(*_KEPT).repartition(tasks, "row")
    on_err = (F.col("stdout") == "") & (F.col("stderr") != "") if not op.stream else F.lit(op.stream == "stderr")
    # Always true. As it names every column, both readers of `mine` ask for the same rows, and one exchange serves them.
    there = F.coalesce(*[F.col(c).isNotNull() | (F.col("row") >= 0) for c in _KEPT[1:]], F.lit(True))
    bodies = mine.select("row", F.when(there, F.when(on_err, F.col("stderr")).otherwise(F.col("stdout"))).alias("body"))
    got = op.run(bodies).select("row", F.col("body").alias("got"))
    both = mine.join(got, "row", "left")
    known = F.col("got").isNotNull()
    out = both.select(
        *_KEPT, F.when(known, F.when(on_err, F.col("stdout")).otherwise(F.col("got"))).alias("got_stdout"), F.when(known, F.when(on_err, F.col("got")).otherwise(F.col("stderr"))).alias("got_stderr"),
        F.lit(op.family).alias("family"), F.when(known, evidence).alias("got_evidence"),
    )
    return out if op.failed is not None else out.unionByName(_as_they_are(part.where("row is null or exit_code <> 0")))


def _as_they_are(part: DataFrame) -> DataFrame:
    return part.select(*_KEPT, *[F.lit(None).cast("string").alias(c) for c in ("got_stdout", "got_stderr", "family", "got_evidence")])


def _compacted(part: DataFrame) -> DataFrame:
    """The same of captures with forms of whole captures, in one pass where they lie: a capture's other columns go with it as its key."""
    spoilt = [name for name in WHOLE if FORMS[name].failed == LOSSY]  # not shown of a failed command, so not asked
    form = F.when((F.col("exit_code") == 0) | ~F.col("part").isin(*spoilt), F.col("part"))
    done = captured.compact(part.withColumn("own", F.struct("row", "capture_id", "command", "exit_code")), form, "own")
    evidence = F.when(F.col("filter_name") != "passthrough", F.col("evidence"))
    return done.select("own.*", F.col("out_stdout").alias("stdout"), F.col("out_stderr").alias("stderr"), F.col("out_stdout").alias("got_stdout"), F.col("out_stderr").alias("got_stderr"), F.col("filter_name").alias("family"), evidence.alias("got_evidence"))


def hint(command: Column, exit_code: Column) -> Column:
    """What is said of a command that shows nothing."""
    name = F.coalesce(F.nullif(policy.base(F.get(command, 0)), F.lit("")), F.lit("command"))
    clean = (exit_code == 0) & (name == "git") & F.get(command, 1).isin("status", "diff")
    return F.when(clean, F.format_string("(no changes; git %s exited 0 with no output)\n", F.get(command, 1))).otherwise(F.format_string("(%s exited %d with no output)\n", name, exit_code))


def registry(captures: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """capture_id, out_stdout, out_stderr, filter_name, evidence of captures (capture_id, argv, stdout, stderr, exit_code, lossless). `lines`: as in `routed`."""
    spark, path = captures.sparkSession, scratch(captures.sparkSession)
    t = routed(captures, lines)
    seen = Observation()
    sized = t.observe(seen, F.count("*").alias("n"), F.sum(F.octet_length("stdout") + F.octet_length("stderr")).alias("bytes"))
    sized.withColumn("part", F.coalesce("operator", F.lit("none"))).drop("operator").write.partitionBy("part").option("compression", "zstd").option("parquet.enable.dictionary", "false").parquet(path)
    schema = t.drop("operator").withColumn("part", F.lit("")).schema
    store = spark.read.schema(schema).parquet(path)
    present = {r["part"]: r["count"] for r in store.groupBy("part").count().orderBy("part").collect()}  # as many as there are operators, at most
    each = (seen.get["bytes"] or 0) / max(1, seen.get["n"])  # bytes of a capture
    whole, native = [name for name in present if name in WHOLE], [name for name in present if name in OPERATORS]
    t = _as_they_are(store.where(~F.col("part").isin(*whole, *native)))
    if whole:
        t = t.unionByName(_compacted(store.where(F.col("part").isin(*whole))))
    for name in native:
        t = t.unionByName(_applied(store.where(F.col("part") == name), OPERATORS[name], 1 + int(present[name] * each / _TEXT)))
    # A failed command is only shown whole, or by a form that loses nothing.
    taken = F.col("got_evidence").isNotNull() & ((F.col("exit_code") == 0) | (F.col("got_evidence") != LOSSY))
    t = t.withColumn("taken", F.coalesce(taken, F.lit(False)))
    t = t.withColumn("out_stdout", F.when(F.col("taken"), F.col("got_stdout")).otherwise(F.col("stdout"))).withColumn("out_stderr", F.when(F.col("taken"), F.col("got_stderr")).otherwise(F.col("stderr")))
    quiet = (F.col("out_stdout") == "") & (F.col("out_stderr") == "")
    return t.select(
        "capture_id", F.when(quiet, hint(F.col("command"), F.col("exit_code"))).otherwise(F.col("out_stdout")).alias("out_stdout"), "out_stderr",
        F.when(F.col("taken"), F.col("family")).otherwise("passthrough").alias("filter_name"), F.when(F.col("taken"), F.col("got_evidence")).otherwise("ByteExact").alias("evidence"),
    )
