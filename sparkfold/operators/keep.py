"""Tools whose compact form is the lines that matter, kept as they are. One projection per body: no shuffle, no Python.

Each tool's rules are substrings with or without regard to case, line beginnings and line ends (all fixed values), and a
pattern for what these cannot say.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfold.functions import lines as L
from sparkfold.functions import text as T


@dataclass(frozen=True)
class Rule:
    starts: tuple[str, ...] = ()
    ends: tuple[str, ...] = ()
    has: tuple[str, ...] = ()
    has_any_case: tuple[str, ...] = ()
    pattern: str = ""
    trim: bool = False  # both ends, else only the right one
    nothing: str = ""  # said where nothing was kept of a body
    begins: str = ""  # from the first line that has this on,
    then: str = ""  # lines of this pattern stay too


RULES = {
    "ctest": Rule(starts=("100% tests passed", "Total Test time"), has_any_case=("tests failed", "error"), pattern=r"^(?!.*Passed)(?=.*%)(?=.*#)", trim=True),
    "cmake": Rule(starts=("-- Configuring done", "-- Generating done", "-- Build files have been written to:"), has_any_case=("error", "warning"), pattern=r"^\[.*%"),
    "swift": Rule(
        has=("** BUILD FAILED **", "** BUILD SUCCEEDED **", "** TEST FAILED **", "** TEST SUCCEEDED **", "SwiftCompile", "CompileSwift", "Failing tests:", "Test Suite", "Executed "), has_any_case=("error:", "warning:"), nothing="ok",
    ),
    "uv": Rule(starts=("Resolved ", "Prepared ", "Installed ", "Uninstalled ", "Audited ", "error:", "warning:", "+", "-", "├──", "└──")),
    "dotnet": Rule(
        starts=("Restored ", "Failed ", "Expected:", "Actual:"), ends=(" Error(s)", " Warning(s)"), has=(" error CS", " warning CS", "Assert."),
        has_any_case=(": error ", ": warning ", "build failed", "build succeeded", "restore failed", "restore succeeded", "test run failed", "error message:", "stack trace:", "failed!", "passed!", "failed:", "passed:", "total tests:", "failed tests:", "format complete", "formatted code file", "would be formatted"),
        pattern=r"^\[xUnit\.net .*\[FAIL\]|^at .*\.cs:line ",
    ),
    "plan": Rule(starts=("Plan: ", "No changes.", "Terraform will perform", "OpenTofu will perform", "+ resource ", "- resource ", "~ resource ", "-/+ resource "), pattern=r"^(?:│ )?(?:Error|Warning): |^# .* (?:will|must) be ", trim=True, nothing="plan ok",
                 begins="will perform the following actions", then=r"# forces replacement|^(?:-/\+|~|\+|-) "),
}


def matters(line: Column, rule: Rule) -> Column:
    """One pattern for all words of the rule, as lambdas run without code generation and each predicate would trim and fold the line anew."""
    any_of = lambda words: "(?:" + "|".join(map(re.escape, words)) + ")"
    parts = [("^[ \t\n\f\r]*" if rule.trim or rule.ends else "^") + any_of(rule.starts)] if rule.starts else []
    parts += [any_of(rule.ends) + "$"] if rule.ends else []
    parts += [any_of(rule.has)] if rule.has else []
    parts += [f"(?i:{any_of(rule.has_any_case)})"] if rule.has_any_case else []
    out = F.regexp_like(line, F.lit("|".join(parts))) if parts else F.lit(False)
    return out | F.regexp_like(T.trim_ascii(line), F.lit(rule.pattern)) if rule.pattern else out


def keep(bodies: DataFrame, tool: str, key: str = "capture_id", body: str = "body") -> DataFrame:
    """key, body: the lines of each body that matter to `tool`, or its word for nothing."""
    rule = RULES[tool]
    clean = lambda x: T.trim_ascii(T.strip_ansi(x)) if rule.trim else F.rtrim(T.strip_ansi(x), F.lit(" \t\n\f\r"))
    rows = F.transform(F.split(F.col(body), "\n"), clean)
    kept = F.filter(rows, lambda x: matters(x, rule))
    if rule.begins:
        at = F.array_position(F.transform(rows, lambda x: F.contains(x, F.lit(rule.begins))), True).cast("int")  # outside of lambdas: once for a body
        head, rest = F.slice(rows, F.lit(1), at - 1), F.slice(rows, at, F.size(rows))
        later = F.concat(F.filter(head, lambda x: matters(x, rule)), F.filter(rest, lambda x: matters(x, rule) | F.regexp_like(x, F.lit(rule.then))))
        kept = F.when(at > 0, later).otherwise(kept)
    text = F.nullif(F.array_join(F.transform(kept, lambda x: F.concat(x, F.lit("\n"))), ""), F.lit(""))
    return bodies.select(key, F.coalesce(text, F.when(F.col(body) == "", "").otherwise(F.lit(f"{rule.nothing}\n" if rule.nothing else ""))).alias("body"))


def keep_lines(table: DataFrame, tools: tuple[str, ...], order: str, block: Column, key: str = "capture_id") -> DataFrame:
    """key, tool, body: what `keep` makes of each capture's lines (key, order, line) for each tool, without a body of all of them. Lines are judged where they
    lie, and those kept are put together by `block`, a value that only grows with `order`, then block by block."""
    def clean(rule: Rule) -> Column:
        return T.trim_ascii(F.col("bare")) if rule.trim else F.rtrim("bare", F.lit(" \t\n\f\r"))

    t = table.withColumn("block", block).withColumn("bare", T.strip_ansi(F.col("line")))
    by_tool = F.array(*[F.when(matters(clean(RULES[x]), RULES[x]), F.struct(F.lit(x).alias("tool"), clean(RULES[x]).alias("v"))) for x in tools])
    kept = t.select(key, "block", order, F.explode(by_tool).alias("x")).where("x is not null").select(key, "block", order, "x.tool", "x.v")
    for x in tools:
        rule = RULES[x]
        if rule.begins:  # other lines stay too, from the first one that says so
            own = t.select(key, "block", order, F.lit(x).alias("tool"), clean(rule).alias("v"))
            first = own.where(F.contains("v", F.lit(rule.begins))).groupBy(key).agg(F.min(order).alias("first"))
            later = own.where(F.regexp_like("v", F.lit(rule.then)) & ~matters(F.col("v"), rule)).join(first, key).where(F.col(order) >= F.col("first"))
            kept = kept.unionByName(later.drop("first"))
    text = F.concat(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "v"))), lambda x: x["v"]), "\n"), F.lit("\n"))
    blocks = kept.groupBy(key, "tool", "block").agg(text.alias("text"))
    every = table.select(key).distinct().select(key, F.explode(F.array(*map(F.lit, tools))).alias("tool"))  # those without a line kept have a word for it
    whole = F.sort_array(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("block", "text"))))
    out = blocks.unionByName(every, allowMissingColumns=True).groupBy(key, "tool").agg(F.array_join(F.transform(whole, lambda x: x["text"]), "").alias("body"))
    nothing = F.coalesce(*[F.when(F.col("tool") == x, f"{RULES[x].nothing}\n") for x in tools if RULES[x].nothing], F.lit(""))
    return out.select(key, "tool", F.coalesce(F.nullif("body", F.lit("")), nothing).alias("body"))


def buildkit(table: DataFrame, key: str = "capture_id") -> DataFrame:
    """key, line: number of build steps done and the last image's name; a capture with a line of another shape, or without a step done, gives none."""
    t = table.where("line <> ''")
    done = F.when(F.regexp_like("line", F.lit(r"^#\S*(?=\s).* DONE(?: .*)?$")), F.regexp_extract("line", r"^(#\S*)", 1))
    image = F.when(F.contains("line", F.lit("naming to ")), F.struct("line_no", F.regexp_replace(F.regexp_extract("line", r"naming to (.*)$", 1), " done$", "").alias("name")))
    g = t.groupBy(key).agg(F.bool_and(F.regexp_like("line", F.lit(r"^#\S*\s"))).alias("ok"), F.countDistinct(done).alias("n"), F.max(image).alias("image")).where("ok and n > 0")
    return g.select(key, F.concat(F.lit("BuildKit: "), F.col("n").cast("string"), F.lit(" steps completed"), F.when(F.col("image").isNotNull(), F.concat(F.lit("\nimage: "), F.col("image.name"))).otherwise("")).alias("line"))


def pre_commit(table: DataFrame, key: str = "capture_id") -> DataFrame:
    """key, line_no, line: failed hooks with what tells why, and how many passed."""
    t = table.withColumn("line", F.rtrim(T.strip_ansi(F.col("line")), F.lit(" \t\n\f\r"))).withColumn("status", F.regexp_extract("line", r"\.{3,}(Passed|Failed|Skipped)$", 1))
    t = t.withColumn("last", L.carried(F.when(F.col("status") != "", F.col("status")), key))
    low = F.lower("line")
    why = F.startswith("line", F.lit("- hook id:")) | F.startswith("line", F.lit("- exit code:")) | F.contains(low, F.lit("error")) | F.contains(low, F.lit("failed")) | F.regexp_like("line", F.lit(r":")) & F.regexp_like("line", F.lit(r"\.py|\.yaml|\.yml|\.toml|\.json"))
    out = F.when(F.col("status") == "Failed", F.regexp_replace("line", r"[ \t]*\.{3,}Failed$", " Failed")).when((F.col("status") == "") & (F.col("last") == "Failed") & why, F.col("line"))
    # How many passed is said with the last line, from the same rows in the same order.
    every = L.ordered(key).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumn("out", out).withColumn("n", F.count_if(F.col("status") == "Passed").over(every)).withColumn("at_end", F.row_number().over(L.ordered(key)) == F.count("*").over(every))
    t = t.where("out is not null or at_end and n > 0")
    passed = F.concat(F.lit("passed: "), F.col("n").cast("string"), F.when(F.col("n") == 1, " hook").otherwise(" hooks"))
    own, last = F.struct("line_no", F.col("out").alias("line")), F.struct((F.col("line_no") + F.lit(1 << 30)).alias("line_no"), passed.alias("line"))
    said = F.when(F.col("at_end") & (F.col("n") > 0), F.array(own, last)).otherwise(F.array(own))
    return t.select(key, F.explode(said).alias("x")).select(key, "x.line_no", "x.line").where("line is not null")


def docker_stats(table: DataFrame, key: str = "capture_id") -> DataFrame:
    """key, line_no, line: `name cpu memory/limit percent` of each row under a header that begins with a container id."""
    t = table.where("line <> '' and line_no > 0").withColumn("f", F.filter(F.split("line", r"[ \t]+"), lambda x: x != ""))
    t = t.withColumn("bad", F.max(F.expr("size(f) < 7 or f[4] <> '/'")).over(Window.partitionBy(key))).where("not bad")  # a join would make the fields twice
    return t.select(key, "line_no", F.expr("concat(f[1], ' ', f[2], ' ', f[3], '/', f[5], ' ', f[6])").alias("line"))
