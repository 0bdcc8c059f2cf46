"""Command lines in tables: words, what really runs behind wrappers, shells and runners, the commands that session records hold. All as native columns.

Words are cut by patterns whose alternatives cannot match at the same place, so no text makes them step back. Lists of words travel as one text with a
separator that no command line has, so that options are skipped by one pattern each.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfold.functions import text as T
from sparkfold.operators import shell
from sparkfold.plans import policy
from sparkfold.sources.tables import written

#: Between the words of a command line in one text, and after the last.
SEP = "\x01"

_QUOTED = r"""\\[\s\S]|'[^']*+'|"(?:[^"\\]++|\\[\s\S])*+\""""
_ANY_WORD = rf"""(?:[^\s'"\\]++|{_QUOTED})++"""
#: A word that a shell would only split off: no metacharacter, no expansion, no line end.
_PLAIN_WORD = r"""(?:[^\s;|&<>`(){}*?\[\]~#$'"\\]++|\\[^\r\n]|'[^'\r\n]*+'|"(?:[^"`$\\\r\n]++|\\[^\r\n])*+")++"""
_PIECE = rf"""({_QUOTED}|[^'"\\]++)"""


def _unquoted(word: Column, escapes: str) -> Column:
    """The word without its quotes; `escapes`: what a backslash between double quotes takes its meaning from."""
    inner = lambda p: F.substring(p, F.lit(2), F.length(p) - 2)
    piece = lambda p: F.when(p.startswith("'"), inner(p)).when(p.startswith('"'), F.regexp_replace(inner(p), rf"\\({escapes})", "$1")).when(p.startswith("\\"), F.substring(p, 2, 1)).otherwise(p)
    return F.array_join(F.transform(F.regexp_extract_all(word, F.lit(_PIECE), F.lit(1)), piece), "")


def plain_words(text: Column) -> Column:
    """Words of one plain command; null where a shell would do more than split it, a quote has no end, or the first word is over 256 bytes."""
    whole = F.regexp_like(text, F.lit(rf"\A[ \t\f]*+(?:{_PLAIN_WORD}(?:[ \t\f]++|\z))++\z"))
    words = F.transform(F.regexp_extract_all(text, F.lit(f"({_PLAIN_WORD})"), F.lit(1)), lambda w: _unquoted(w, r"[\s\S]"))
    return F.when(whole & (F.octet_length(F.get(words, 0)) <= 256), words)


#: Programs that only read, their subcommands, and options by which they would do more (fixed values).
_READERS, _GIT_READS = ("cat", "du", "jq", "ls", "ps"), ("blame", "diff", "log", "show", "status")
_BANNED = {
    "tree": r"^(?:-o|--output(?:=|$))", "rg": r"^(?:(?:--hostname-bin|--pre|--pre-glob)(?:=|$)|--search-zip$|-z$)", "find": r"^(?:-delete$|-exec|-fls|-fprint|-ok)",
    "git": r"^(?:(?:--ext-diff|--textconv|--pretty|--output)(?:=|$)|--show-signature$|.*%G)",
}


def read_only(words: Column) -> Column:
    """Whether a command can only read."""
    rest = lambda n: F.slice(words, n, F.greatest(F.size(words), F.lit(1)))
    clean = lambda args, program: ~F.exists(args, lambda a: F.regexp_like(a, F.lit(_BANNED[program])))
    program, pager = F.get(words, 0), F.coalesce(F.get(words, 1) == "--no-pager", F.lit(False))
    sub = F.when(pager, F.get(words, 2)).otherwise(F.get(words, 1))
    git = F.coalesce(sub.isin(*_GIT_READS), F.lit(False)) & F.when(pager, clean(rest(4), "git")).otherwise(clean(rest(3), "git"))
    out = F.when(program.isin(*_READERS), True).when(program == "git", git)
    for name in ("tree", "rg", "find"):
        out = out.when(program == name, clean(rest(2), name))
    return F.coalesce(out, F.lit(False))


def words(df: DataFrame, key: str, command: str) -> DataFrame:
    """key, words (null where a shell would do more than split), read_only."""
    found = df.select(F.col(key), plain_words(F.col(command)).alias("words"))
    return found.select(key, "words", read_only(F.col("words")).alias("read_only"))


#: Words that are no command of their own, and shells (fixed values).
BUILTINS = ("cd", "export", "popd", "pushd", "set", "source", "unset")
KEYWORDS = ("case", "do", "done", "elif", "else", "esac", "fi", "for", "function", "if", "in", "then", "until", "while")
SHELLS = ("bash", "sh", "zsh", "fish")


def _heads(wrappers: tuple[str, ...]) -> str:
    """What may stand before a program: assignments, programs that run another one, and what those take."""
    assigned, path = r"[A-Za-z_]\w*+=", rf"(?:[^{SEP}]*/)?"
    out = [rf"{assigned}[^{SEP}]*+{SEP}", rf"{path}(?:command|exec){SEP}", rf"{path}env{SEP}(?:(?:{assigned}|-)[^{SEP}]*+{SEP})*+"]
    if wrappers:
        out.append(rf"{path}(?:{'|'.join(map(re.escape, wrappers))}){SEP}(?:-(?!-{SEP})[^{SEP}]*+{SEP})*+(?:--{SEP})?")
    return rf"^(?:{'|'.join(out)})*+"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, as lambdas share no expressions."""
    return F.transform(F.array(value), body)[0]


def _part(part: Column, wrappers: tuple[str, ...]) -> Column:
    """kind, program, arguments, inner of one command of a chain. Kinds: run, nothing, shell (`inner` is what it runs), odd (cannot be told)."""
    split = F.transform(F.regexp_extract_all(part, F.lit(f"({_ANY_WORD})"), F.lit(1)), lambda w: _unquoted(w, r"""["\\]"""))
    joined = F.regexp_replace(F.array_join(F.transform(split, lambda w: F.concat(w, F.lit(SEP))), ""), _heads(wrappers), "")

    def told(words: Column, rest: Column, name: Column) -> Column:
        flag = F.array_min(F.filter(F.transform(rest, lambda w, i: F.when((i > 0) & w.isin("-c", "-lc", "-cl"), i)), lambda i: i.isNotNull()))
        inner = F.when(name.isin(*SHELLS), F.get(rest, flag + 1))
        kind = F.when((words == "") | name.isin(*BUILTINS), "nothing").when(name.isin(*KEYWORDS) | name.startswith("#"), "odd").when(name.isin(*SHELLS), F.when(inner.isNull(), "odd").otherwise("shell")).otherwise("run")
        return F.struct(kind.alias("kind"), name.alias("program"), F.slice(rest, 2, F.greatest(F.size(rest), F.lit(1))).alias("arguments"), inner.alias("inner"))

    named = lambda words, rest: _let(F.regexp_extract(F.get(rest, 0), r"([^/]*)$", 1), lambda name: told(words, rest, name))
    return _let(joined, lambda words: _let(F.split(F.regexp_replace(words, f"{SEP}$", ""), SEP), lambda rest: named(words, rest)))


def invocations(df: DataFrame, key: str, command: str, wrappers: tuple[str, ...] = ()) -> DataFrame:
    """key, ord, program, arguments of all that each command line runs, behind assignments, wrappers and shells; none where that cannot be told.
    Commands within shells are put in their place in rounds, one for each depth that the table has. A row keeps its key, so nothing is joined or
    shuffled. `wrappers`: programs that only run another one."""

    def parts(text: Column) -> Column:
        odd = F.array(F.struct(F.lit("odd").alias("kind"), F.lit("").alias("program"), F.array().cast("array<string>").alias("arguments"), F.lit(None).cast("string").alias("inner")))
        return F.coalesce(F.transform(F.filter(F.transform(shell.chain(text), T.trim_ascii), lambda p: p != ""), lambda p: _part(p, wrappers)), odd)

    has = lambda kind: F.exists("found", lambda x: x["kind"] == kind)
    todo, out = df.select(F.col(key).alias("key"), parts(F.col(command)).alias("found")), None
    while True:
        level = written(todo).where(~has("odd"))
        one = level.where(~has("shell")).select("key", F.posexplode(F.filter("found", lambda x: x["kind"] == "run")).alias("ord", "x"))
        out = one if out is None else out.unionByName(one)
        todo = level.where(has("shell"))
        if todo.isEmpty():
            break
        todo = todo.select("key", F.flatten(F.transform("found", lambda x: F.when(x["kind"] == "shell", parts(x["inner"])).otherwise(F.array(x)))).alias("found"))
    return out.select(F.col("key").alias(key), F.col("ord").cast("long").alias("ord"), "x.program", "x.arguments")


#: Fields that hold a command, and names of tools that run one (fixed values).
COMMAND_FIELDS = ("command", "cmd", "shell_command", "command_line")
SHELL_TOOLS = ("bash", "exec_command", "shell", "shell_command")
#: A call within a script, with a flat object whose field holds the command between quotes.
_SCRIPT_CALL = r"""tools\.exec_command\s*\(\s*\{[^{}]*?\b(?:cmd|command)\b\W??\s*:\s*("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')"""


def _fields(value: str) -> str:
    """SQL: the commands that an object's fields hold."""
    one = lambda f: f"CASE WHEN schema_of_variant(try_variant_get({value}, '$.{f}')) = 'STRING' THEN try_variant_get({value}, '$.{f}', 'string') END"
    return f"filter(array({', '.join(map(one, COMMAND_FIELDS))}), x -> x IS NOT NULL)"


def tool_calls(df: DataFrame, key: str, line: str) -> DataFrame:
    """key, command: each command of a record (JSON text, or a variant) once. Records that are no JSON have none. A recursive query goes down into the parts of a record, up to those
    that are tool calls; the session's bound on its rows is lifted for the time that it runs, and its result is written."""
    spark, row = df.sparkSession, F.monotonically_increasing_id()
    record = F.col(line) if dict(df.dtypes)[line] == "variant" else F.try_parse_json(F.col(line))
    rows = written(df.select(F.col(key).alias("key"), row.alias("row"), record.alias("v")).where("v IS NOT NULL"))
    text = lambda f: f"try_variant_get(v, '$.{f}', 'string')"
    tool = f"lower(regexp_extract({text('name')}, '([^/.]*)$', 1)) IN ({', '.join(map(repr, SHELL_TOOLS))})"
    calls = "coalesce(try_variant_get(v, '$.type', 'string') IN ('function_call', 'custom_tool_call', 'tool_use'), false)"
    query = f"""
        WITH RECURSIVE parts(row, v) MAX RECURSION LEVEL 10000 AS (
            SELECT row, v FROM {{rows}}
            UNION ALL SELECT parts.row, e.value FROM parts, LATERAL variant_explode(parts.v) e
            WHERE NOT {calls.replace("(v,", "(parts.v,")} AND schema_of_variant(e.value) RLIKE '^(OBJECT|ARRAY)<')
        SELECT row, {text("type")} AS type, {text("name")} AS name, {tool} AS shell, try_variant_get(v, '$.arguments') AS arguments, try_variant_get(v, '$.input') AS input FROM parts WHERE {calls}"""
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit, None)
    spark.conf.set(limit, "-1")
    try:
        found = written(spark.sql(query, rows=rows))
    finally:
        spark.conf.unset(limit) if before is None else spark.conf.set(limit, before)
    is_text = lambda c: F.schema_of_variant(c) == "STRING"
    as_text = lambda c: F.try_variant_get(c, "$", "string")
    found = found.withColumn("given", F.when(F.col("type") == "tool_use", F.col("input")).when(F.col("type") == "function_call", F.when(is_text(F.col("arguments")), F.try_parse_json(as_text(F.col("arguments")))).otherwise(F.col("arguments"))).otherwise(F.try_parse_json(F.when(is_text(F.col("input")), as_text(F.col("input"))))))
    unquoted = lambda m: F.replace(F.replace(F.substring(m, F.lit(2), F.length(m) - 2), F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n"))
    script = F.transform(F.regexp_extract_all(as_text(F.col("input")), F.lit(_SCRIPT_CALL), F.lit(1)), unquoted)
    scripted = (F.col("type") == "custom_tool_call") & F.coalesce(F.col("name").isin("functions.exec", "exec"), F.lit(False)) & is_text(F.col("input"))
    commands = F.when(scripted & F.col("given").isNull(), script).when(scripted | (F.col("type") != "custom_tool_call") & F.coalesce("shell", F.lit(False)), F.expr(_fields("given")))
    once = found.select("row", F.explode(commands).alias("command")).distinct()
    return once.join(rows.select("row", "key"), "row").select(F.col("key").alias(key), "command")


_UV = ("--project", "--directory", "--python", "--package", "--with", "--with-editable", "--with-requirements", "--env-file", "--group", "--extra")
_UV_FLAGS = ("--isolated", "--active", "--no-sync", "--locked", "--frozen", "--no-project", "--all-extras", "--no-dev", "--no-progress", "--offline")
#: Runner: (its own word or none, options with a value, flags) (fixed values). Any other option before the command hides it.
RUNNERS = {
    "uv": ("run", _UV, _UV_FLAGS), "uvx": (None, (*_UV, "--from"), _UV_FLAGS), "poetry": ("run", ("-C", "--directory", "-P", "--project"), ("--no-interaction", "--no-ansi", "-q", "--quiet")),
    "pnpm": ("exec", ("-C", "--dir", "-F", "--filter", "--workspace-concurrency"), ("-r", "--recursive", "-w", "--workspace-root", "--parallel", "--stream", "--aggregate-output", "--use-stderr")),
    "npx": (None, ("-p", "--package", "-w", "--workspace", "--allow-scripts"), ("-y", "--yes", "--no", "--workspaces", "--include-workspace-root", "--strict-allow-scripts", "--dangerously-allow-all-scripts")),
    "bunx": (None, ("--package", "--cwd"), ("--bun", "--no-install", "--silent", "--help", "--version")),
}


def _peeling(name: str) -> str:
    """Pattern of a runner's command line: its options, its own word, then, as the first group, the command."""
    word, values, flags = RUNNERS[name]
    either = lambda xs: "|".join(map(re.escape, xs))
    letters = "".join(f[1] for f in flags if len(f) == 2)
    options = [rf"(?:{either(values)}){SEP}[^{SEP}]*+", rf"(?:{either(flags)})", rf"(?:{either([v for v in values if len(v) > 2])})=[^{SEP}]*+"]
    options += [rf"-[{letters}]{{2,}}"] if letters else []
    options += [rf"(?:{either(short)})[^{SEP}]++"] if (short := [v for v in values if len(v) == 2]) else []
    many = rf"(?:(?:{'|'.join(options)}){SEP})*"
    own = rf"{word}{SEP}" if word else ""
    lead = own + many if name == "uv" else many + own
    return rf"^[^{SEP}]*+{SEP}{lead}(?:--{SEP})?([^-{SEP}][\s\S]*+)$"


def _runner(j: Column) -> Column:
    """The name of the runner that this command line begins with; empty for none."""
    name = F.regexp_extract(j, rf"^(?:[^{SEP}]*/)?([^/{SEP}]*+){SEP}", 1)
    is_uv, is_pnpm = F.regexp_like(j, F.lit(rf"^[^{SEP}]*+{SEP}run{SEP}")), F.contains(j, F.lit(f"{SEP}exec{SEP}"))
    return F.when(name.isin(*RUNNERS) & ((name != "uv") | is_uv) & ((name != "pnpm") | is_pnpm), name).otherwise("")


def logical(argv: Column, layers: int = 4) -> Column:
    """(argv, chain): the command behind up to four runners, and their names. Null where that cannot be told. One fold over the layers, so that the
    expression is as long as one layer."""
    said = {r: f"{r} {w}" if w else r for r, (w, _, _) in RUNNERS.items()}

    def layer(state: Column, _: Column) -> Column:
        def peeled(r: Column) -> Column:
            j, label = state["j"], r
            for name in RUNNERS:
                j = F.when(r == name, F.nullif(F.regexp_extract(state["j"], _peeling(name), 1), F.lit(""))).otherwise(j)
                label = F.when(r == name, said[name]).otherwise(label)
            return F.struct(j.alias("j"), F.when(r == "", state["chain"]).otherwise(F.concat(state["chain"], F.array(label))).alias("chain"))

        return F.transform(F.array(_runner(state["j"])), peeled)[0]

    start = F.struct(F.array_join(F.transform(argv, lambda w: F.concat(w, F.lit(SEP))), "").alias("j"), F.array().cast("array<string>").alias("chain"))

    def done(state: Column) -> Column:
        words = F.when(F.size(state["chain"]) == 0, argv).otherwise(F.split(F.regexp_replace(state["j"], f"{SEP}$", ""), SEP))
        return F.when(state["j"].isNotNull() & (_runner(state["j"]) == ""), F.struct(words.alias("argv"), state["chain"].alias("chain")))

    return F.aggregate(F.array(*[F.lit(k) for k in range(layers)]), start, layer, done)


def unwrapped(df: DataFrame, key: str, argv: str) -> DataFrame:
    """key, argv and chain behind runners; both null where that cannot be told."""
    return df.select(F.col(key).alias("key"), logical(F.col(argv)).alias("x")).select(F.col("key").alias(key), "x.argv", "x.chain")


def rewritten(argv: Column, supported: Column, prefix: str) -> Column:
    """A command line for a shell, with the prefix where it is supported and not there yet."""
    text = F.array_join(F.transform(argv, T.shell_quote), " ")
    return F.when(supported & (policy.base(F.get(argv, 0)) != prefix), F.concat(F.lit(prefix + " "), text)).otherwise(text)
