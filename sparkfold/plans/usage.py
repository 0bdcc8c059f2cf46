"""Reports on which commands were run, how they are covered, and what compaction saved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfold.operators import commands
from sparkfold.plans import catalog, routes


def covered_by(command: Column, arguments: Column) -> Column:
    """auto-wrap, transparent-runner, wrapper-only or unlisted."""
    words = F.array_join(F.concat(F.array(command), arguments), " ")
    runner = F.lit(False)
    for r in catalog.RUNNERS:
        runner = runner | (words == r) | F.startswith(words, F.lit(r + " "))
    return F.when(command.isin(*catalog.AUTO_WRAP), "auto-wrap").when(runner, "transparent-runner").when(command.isin(*catalog.WRAPPER), "wrapper-only").otherwise("unlisted")


def command_counts(usage: DataFrame, least: int = 1) -> DataFrame:
    """command, n, coverage (mixed where its runs differ)."""
    t = usage.withColumn("c", covered_by(F.col("command"), F.col("arguments")))
    g = t.groupBy("command").agg(F.count("*").alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi")).where(F.col("n") >= least)
    return g.select("command", "n", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("mixed").alias("coverage"))


def git_subcommand(arguments: Column) -> Column:
    """The first argument that is no option, nor the value of one that takes a value apart."""
    takes = ("-C", "--git-dir", "--work-tree", "--repo", "--hostname")
    kept = F.filter(arguments, lambda x, i: ~F.startswith(x, F.lit("-")) & ~F.coalesce(F.get(arguments, i - 1).isin(*takes), F.lit(False)))
    return F.get(kept, 0)


def git_counts(usage: DataFrame) -> DataFrame:
    t = usage.where("command = 'git'").withColumn("subcommand", git_subcommand(F.col("arguments"))).where("subcommand is not null")
    return t.groupBy("subcommand").agg(F.count("*").alias("n")).withColumn("coverage", F.when(F.col("subcommand").isin(*catalog.GIT_SUBCOMMANDS), "catalogued").otherwise("unlisted"))


def behind_runners(usage: DataFrame) -> DataFrame:
    """argv and chain (its names with ` > ` between) of each command line behind up to four runners; one that cannot be told stays as it is."""
    typed = F.concat(F.array("command"), "arguments")
    found = commands.unwrapped(usage.select(typed.alias("typed"), typed.alias("line")), "typed", "line")
    return found.select(F.coalesce("argv", "typed").alias("argv"), F.coalesce(F.array_join("chain", " > "), F.lit("")).alias("chain"))


def effective(usage: DataFrame) -> DataFrame:
    """command and chain behind runners, counted."""
    return behind_runners(usage).groupBy(F.get("argv", 0).alias("command"), "chain").agg(F.count("*").alias("n"))


def _behind(usage: DataFrame) -> DataFrame:
    """The same with command, how it is routed, the form that takes it, and whether a family knows it."""
    t = behind_runners(usage)
    command, arguments = F.get("argv", 0), F.slice("argv", 2, F.greatest(F.size("argv"), F.lit(1)))
    route = F.when(F.col("chain") != "", "transparent-runner").otherwise(covered_by(command, arguments))
    return t.withColumn("command", command).withColumn("route", route).withColumn("form", routes.operator_of(F.col("argv"))).withColumn("known", command.isin([c for f in catalog.FAMILIES.values() for c in f]))


def effective_records(usage: DataFrame, least: int = 1) -> DataFrame:
    """command, n, routing_coverage, compaction_coverage (mixed where its runs differ), dispatchable (runs that a form takes), and chains with their
    numbers, of commands run `least` times or more behind their runners."""
    t = _behind(usage)
    compaction = F.when(F.col("known"), "catalogued-route").when(F.col("route") == "unlisted", "not-catalogued").otherwise("route-undeclared")
    one = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).otherwise("mixed")
    # Two steps: by chain first, so that the list of chains is as long as there are chains, not runs.
    by_chain = t.withColumn("compaction", compaction).groupBy("command", "chain", "route", "compaction").agg(F.count("*").alias("n"), F.count("form").alias("d"))
    chains = by_chain.where("chain <> ''").groupBy("command", "chain").agg(F.sum("n").alias("n")).groupBy("command").agg(F.array_join(F.array_sort(F.collect_list(F.concat("chain", F.lit(" x"), F.col("n").cast("string")))), ", ").alias("chains"))
    g = by_chain.groupBy("command").agg(F.sum("n").alias("n"), one("route").alias("routing_coverage"), one("compaction").alias("compaction_coverage"), F.sum("d").alias("dispatchable")).where(F.col("n") >= least)
    return g.join(chains, "command", "left").withColumn("chains", F.coalesce("chains", F.lit("")))


def runner_chains(usage: DataFrame, least: int = 1) -> DataFrame:
    """chain, n and dispatchable of command lines behind runners."""
    return _behind(usage).where("chain <> ''").groupBy("chain").agg(F.count("*").alias("n"), F.count("form").alias("dispatchable")).where(F.col("n") >= least)


def totals(usage: DataFrame) -> DataFrame:
    """source (null for all together), n, and how many runs no catalog lists."""
    t = usage.withColumn("unlisted", (covered_by(F.col("command"), F.col("arguments")) == "unlisted").cast("long"))
    return t.rollup("source").agg(F.count("*").alias("n"), F.sum("unlisted").alias("unlisted"))


def as_json(report: DataFrame) -> DataFrame:
    """One JSON text per row, its keys in order."""
    return report.select(F.to_json(F.struct(*sorted(report.columns))).alias("json"))


def first_difference(x: Column, y: Column) -> Column:
    """The first character (from 1) at which two unequal strings differ; where one is the other's beginning, the one behind it. Each of the 31 steps
    keeps the half that differs, so all together read each string about twice, whatever its length."""
    rest = (1 << 31) - 1

    def state(x: Column, y: Column, at: Column) -> Column:
        return F.struct(x.alias("x"), y.alias("y"), at.alias("at"))

    def step(s: Column, _: Column) -> Column:
        h = F.ceil(F.greatest(F.length(s["x"]), F.length(s["y"])) / 2).cast("int")
        a, b = F.substring(s["x"], F.lit(1), h), F.substring(s["y"], F.lit(1), h)
        return F.when(a != b, state(a, b, s["at"])).otherwise(state(F.substring(s["x"], h + 1, F.lit(rest)), F.substring(s["y"], h + 1, F.lit(rest)), s["at"] + h))

    return F.aggregate(F.sequence(F.lit(1), F.lit(31)), state(x, y, F.lit(1)), step, lambda s: s["at"])


def parity(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """case_id, verdict (equal, differs, only in baseline, only in candidate), first differing character (from 1). A null body is one of its own: equal to
    another null, different from any text at once."""
    x = baseline.select("case_id", F.col("body").alias("x"), F.lit(True).alias("old"))
    j = x.join(candidate.select("case_id", F.col("body").alias("y"), F.lit(True).alias("new")), "case_id", "full_outer")
    verdict = F.when(F.col("new").isNull(), "only in baseline").when(F.col("old").isNull(), "only in candidate").when(F.col("x").eqNullSafe(F.col("y")), "equal").otherwise("differs")
    first = F.when(F.col("x").isNull() | F.col("y").isNull(), 1).otherwise(first_difference(F.col("x"), F.col("y")))
    return j.withColumn("verdict", verdict).select("case_id", "verdict", F.when(F.col("verdict") == "differs", first).cast("long").alias("first_difference"))


def reduction_gate(report: DataFrame, least_percent: int = 10) -> DataFrame:
    return report.withColumn("passes", (F.col("raw_bytes") - F.col("displayed_bytes")) * 100 >= F.col("raw_bytes") * least_percent)


def longest_prefix(usage: DataFrame, bindings: DataFrame, key: str = "row_id") -> DataFrame:
    """key, plugin, scope of the binding that takes each command line: a project's before a user's, then the longest prefix. bindings (scope, prefix,
    plugin) are few and are sent to every task by their checked size alone (Spark's own threshold)."""
    line = F.array_join(F.concat(F.array("command"), "arguments"), " ")
    own = bindings.select("scope", "plugin", F.array_join("prefix", " ").alias("p"), F.get("prefix", 0).alias("command"))
    j = usage.select(key, "command", line.alias("line")).join(own, "command").where("line = p or startswith(line, p || ' ')")
    first = F.row_number().over(Window.partitionBy(key).orderBy(F.when(F.col("scope") == "project", 0).otherwise(1), F.desc(F.length("p")), "plugin"))
    return j.withColumn("i", first).where("i = 1").select(key, "plugin", "scope")
