"""What a command line asks for: a form that may be shortened, an answer for a machine, or a stream. All as projections over `argv`.

The lists are fixed values. A policy holds for its commands if any of its parts does: `words` are options as they are; `options` are
(long, short, whether the short one takes its value joined); `second` are first arguments; `prefixes` are beginnings of options; `values` are
(long, short, whether listed values are the ones that matter or those that do not, values); `letters` are flags within a bundle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    commands: tuple[str, ...]
    always: bool = False
    words: tuple[str, ...] = ()
    options: tuple[tuple[str, str, bool], ...] = ()
    second: tuple[str, ...] = ()
    third: tuple[tuple[str, str], ...] = ()  # first and second argument
    prefixes: tuple[str, ...] = ()
    values: tuple[tuple[str, str, bool, tuple[str, ...]], ...] = ()
    letters: str = ""
    other_letters: str = ""  # any flag but these in a bundle
    only: tuple[str, ...] = ()  # any option but these


_DIAGNOSTICS = ("mypy", "ruff", "eslint", "biome", "pre-commit", "prettier", "terraform", "tofu")
_SHORT_HELP = (
    "make", "ninja", "cargo", "go", "zig", "npm", "pnpm", "yarn", "bun", "webpack", "turbo", "next", "dotnet", "gradle", "gradlew", "mvn", "mvnw", "swift", "xcodebuild", "uv", "uvx", "vite", "esbuild", "cmake", "ctest", "playwright",
    "poetry", "npx", "composer", "pip", "pip3", "mypy", "ruff", "eslint", "biome", "pre-commit", "prettier", "terraform", "tofu", "curl", "docker", "docker-compose", "kubectl", "gh", "acli", "helm", "pytest", "jq",
)
_PACKAGES = ("npm", "pnpm", "yarn", "bun", "composer", "pip", "pip3", "uv", "uvx")

QUERY = (
    Policy((), words=("--help", "--version"), second=("help", "version")), Policy(_SHORT_HELP, words=("-h", "-V")),
    Policy(("pytest",), words=("--collect-only", "--co", "--fixtures", "--fixtures-per-test", "--markers", "--trace-config")), Policy(("ruff",), second=("rule", "config", "linter", "help", "version")),
    Policy(("prettier",), words=("--support-info", "--find-config-path", "--file-info")), Policy(("tsc",), words=("--showConfig", "--listFilesOnly")),
    Policy(_DIAGNOSTICS, options=(("--format", "", False), ("--output", "", False), ("--json", "", False))),
    Policy(("dotnet",), prefixes=("--getproperty:", "-getproperty:", "/getproperty:", "--getitem:", "-getitem:", "/getitem:", "--gettargetresult:", "-gettargetresult:", "/gettargetresult:")),
)
MACHINE = (
    Policy(("rg",), words=("--json", "--vimgrep", "-c", "--count", "--count-matches", "-l", "--files-with-matches", "--files-without-match", "--files", "--type-list", "-0", "--null", "--null-data", "-o", "--only-matching", "--passthru", "--stats"), options=(("--replace", "-r", True),)),
    Policy(("kubectl",), words=("--raw", "--no-headers", "--show-labels", "--output-watch-events", "--timestamps", "--prefix", "--json", "--jq"), options=(("--output", "-o", True), ("--template", "", False), ("--label-columns", "-L", True), ("--sort-by", "", False))),
    Policy(("helm",), options=(("--output", "-o", True),), second=("get",)),
    Policy(("docker", "docker-compose"), words=("--progress=rawjson", "-q", "--quiet", "--no-trunc"), options=(("--format", "", False),), values=(("--progress", "", True, ("rawjson",)),)), Policy(("docker-compose",), second=("config",)),
    Policy(("docker",), second=("inspect",), third=(("compose", "config"), *((o, "inspect") for o in ("container", "image", "network", "node", "plugin", "secret", "service", "volume", "manifest", "context")))),
    Policy(("aws",), options=(("--output", "", False), ("--query", "", False), ("--cli-binary-format", "", False), ("--generate-cli-skeleton", "", False))), Policy(("jq",), always=True),
    Policy(("ps",), words=("--headers", "--no-headers", "-w", "-ww"), options=(("--format", "-o", True), ("", "-O", True), ("--cols", "", False), ("--columns", "", False), ("--width", "", False))),
    Policy(("psql",), words=("-A", "--no-align", "-t", "--tuples-only", "-z", "--field-separator-zero", "-0", "--record-separator-zero", "--csv", "-H", "--html", "-x", "--expanded"), options=(("--field-separator", "-F", True), ("--record-separator", "-R", True), ("--pset", "-P", True)), letters="Atz0Hx"),
    Policy(("systemctl",), words=("--value", "--no-legend", "--plain", "--full", "--show-types"), options=(("--property", "-p", True), ("--output", "-o", True)), second=("show", "is-active", "is-enabled", "is-failed")),
    Policy(_PACKAGES, words=("--ndjson", "--parseable", "--porcelain", "--json-stream"), options=(("--json", "", False), ("--format", "", False), ("--reporter", "", False))),
    Policy(("gh",), options=(("--jq", "", True), ("--template", "", True))),
    Policy(("sqlite3",), words=("-csv", "-html", "-json", "-line", "-list", "-markdown", "-noheader", "-quote", "-tabs"), options=(("-separator", "", False), ("-nullvalue", "", False))),
)
_REPORTERS = ("list", "line", "dot")
EXACT = (
    Policy(("cargo",), words=("--json",)), Policy(("cargo", "nextest"), values=(("--message-format", "", True, ("json*", "libtest-json*")),)), Policy(("go",), words=("-json",), values=(("-json", "", False, ("false",)),)),
    Policy(("jest", "vitest"), words=("--json",), options=(("--outputFile", "", False),), values=(("--reporter", "", False, _REPORTERS), ("--reporters", "", False, _REPORTERS))), Policy(("pip", "pip3"), second=("freeze", "show", "check", "inspect")),
    Policy(("ctest",), words=("-N", "--print-labels", "-D", "-M", "-T", "-S"), options=(("--show-only", "", False), ("--output-junit", "", False))),
    Policy(("playwright",), words=("--list",), options=(("--output", "", False),), values=(("--reporter", "", False, _REPORTERS),)),
    Policy(("rspec",), options=(("--out", "-o", True),), values=(("--format", "-f", False, ("progress", "documentation")),)), Policy(("rubocop",), options=(("--out", "-o", True),), values=(("--format", "-f", False, _REPORTERS),)),
    Policy(("golangci-lint",), options=(("--out-format", "", False),), prefixes=("--output.",)),
    Policy(("dotnet",), options=(("--logger", "-l", True), ("--results-directory", "", False), ("--output", "-o", True), ("--artifacts-path", "", False), ("--report", "", False), ("--report-formats", "", False))),
    Policy(("gt", "graphite"), words=("--json",), options=(("--format", "", False),)),
    Policy(("diff",), words=("-c", "-u", "-e", "--ed", "-f", "--forward-ed", "-n", "--rcs", "-y", "--side-by-side", "--left-column", "--suppress-common-lines", "-q", "--brief", "--normal", "--expand-tabs", "-t", "--initial-tab", "-T", "--strip-trailing-cr", "--ifdef"),
           options=(("--context", "-C", True), ("--unified", "-U", True), ("", "-D", True), ("--color", "", False), ("--palette", "", False), ("--tabsize", "", False), ("--line-format", "", False), ("--old-line-format", "", False), ("--new-line-format", "", False), ("--unchanged-line-format", "", False))),
    Policy(("head", "tail"), words=("-q", "--quiet", "--silent", "-v", "--verbose", "-z", "--zero-terminated"), options=(("--bytes", "-c", True), ("--lines", "-n", True))),
    Policy(("psql",), words=("--echo-all", "--echo-errors", "--echo-hidden", "--single-line"), options=(("--output", "-o", True), ("--log-file", "-L", True)), values=(("--command", "-c", True, ("\\copy*", "copy*", "COPY*", "Copy*")),)),
    Policy(("curl",), words=("-vv", "-vvv"), options=(("--trace", "", False), ("--trace-ascii", "", False), ("--trace-config", "", False), ("--write-out", "-w", True), ("--config", "-K", True), ("--stderr", "", False))),
    Policy(("cat", "bat", "batcat"), prefixes=("-",)),
    Policy(("grep",), words=("-c", "--count", "-l", "--files-with-matches", "-L", "--files-without-match", "-o", "--only-matching", "-q", "--quiet", "-b", "--byte-offset", "-z", "--null-data", "-Z", "--null", "-a", "--text", "-I", "--binary-files"), prefixes=("-A", "-B", "-C", "--after-context", "--before-context", "--context")),
    Policy(("find",), words=("-ls", "-fls", "-printf", "-fprintf", "-print0", "-fprint0", "-exec", "-execdir", "-ok", "-okdir", "-delete", "-D")),
    Policy(("tree",), only=("-a", "-d", "-L", "-I", "-P", "--dirsfirst", "--noreport", "--prune")),
    Policy(("ls",), other_letters="1ACFRadmpx", only=("--all", "--almost-all", "--directory", "--recursive", "--classify", "--format=across", "--format=commas", "--format=horizontal", "--format=single-column", "--format=vertical")),
    Policy(("git",), options=(("--format", "", False), ("--pretty", "", False))),
)


def base(command: Column) -> Column:
    """The name behind the last slash, of either kind."""
    return F.regexp_extract(command, r"([^/\\]*)$", 1)


def options(argv: Column) -> Column:
    """The arguments up to `--`."""
    rest = F.slice(argv, 2, F.greatest(F.size(argv), F.lit(1)))
    end = F.array_position(rest, "--").cast("int")
    return F.when(end > 0, F.slice(rest, F.lit(1), end - 1)).otherwise(rest)


def has_option(args: Column, long: str, short: str = "", joined: bool = False) -> Column:
    def one(x: Column) -> Column:
        out = F.lit(False)
        if long:
            out = (x == long) | F.startswith(x, F.lit(long + "="))
        if short:
            out = out | ((F.startswith(x, F.lit(short)) & ~F.startswith(x, F.lit("--"))) if joined else (x == short))
        return out

    return F.exists(args, one)


def option_values(args: Column, long: str, short: str = "") -> Column:
    """Values of an option, apart or joined."""

    def one(x: Column, i: Column) -> Column:
        out = F.when((x == long) | (x == short if short else F.lit(False)), F.get(args, i + 1)).when(F.startswith(x, F.lit(long + "=")), F.substring(x, len(long) + 2, 1 << 30))
        return out.when(F.startswith(x, F.lit(short)) & ~F.startswith(x, F.lit("--")), F.substring(x, len(short) + 1, 1 << 30)) if short else out

    return F.filter(F.transform(args, one), lambda v: v.isNotNull() & (v != ""))


def _among(listed: bool, values: tuple[str, ...]):
    """Whether a value is (or is not) one of the listed; a star stands for any end."""
    pattern = "^(?:" + "|".join(w.replace("\\", "\\\\").replace("*", ".*") for w in values) + ")$"
    return lambda v: F.regexp_like(v, F.lit(pattern)) if listed else ~F.regexp_like(v, F.lit(pattern))


def _holds(p: Policy, command: Column, argv: Column, args: Column) -> Column:
    out = F.lit(p.always)
    if p.words:
        out = out | F.arrays_overlap(args, F.array(*map(F.lit, p.words)))
    for long, short, joined in p.options:
        out = out | has_option(args, long, short, joined)
    if p.second:
        out = out | F.coalesce(F.get(argv, 1).isin(*p.second), F.lit(False))
    for a, b in p.third:
        out = out | F.coalesce((F.get(argv, 1) == a) & (F.get(argv, 2) == b), F.lit(False))
    if p.prefixes:
        out = out | F.exists(args, lambda x: F.regexp_like(F.lower(x) if "getitem" in "".join(p.prefixes) else x, F.lit("^(?:" + "|".join(q.replace(".", r"\.") for q in p.prefixes) + ")")))
    for long, short, listed, values in p.values:
        out = out | F.exists(option_values(args, long, short), _among(listed, values))
    if p.letters:
        out = out | F.exists(args, lambda x: F.regexp_like(x, F.lit(rf"^-(?!-)(?=..).*[{p.letters}]")))
    if p.only:
        bundle = F.regexp_like
        fine = lambda x: x.isin(*p.only) | (bundle(x, F.lit(rf"^-[{p.other_letters}]+$")) if p.other_letters else F.lit(False)) | F.startswith(x, F.lit("--classify=")) | F.startswith(x, F.lit("--indicator-style="))
        out = out | F.exists(args, lambda x: F.regexp_like(x, F.lit("^-.")) & ~fine(x))
    return out


def once(argv: Column, rules: Callable[[Column, Column, Column], Column]) -> Column:
    """rules(command, argv, args), with the command's name and its options found once for all rules: a list of rules is too long for generated code, which
    would share them."""
    said = F.struct(base(F.get(argv, 0)).alias("command"), argv.alias("argv"), options(argv).alias("args"))
    return F.transform(F.array(said), lambda x: rules(x["command"], x["argv"], x["args"]))[0]


def by_command(rules: list, command: Column, of: Callable[[tuple], Column]) -> Column:
    """of(the rules of the command that is there, in order); null where no rule names it. Other commands' rules are not asked."""
    names: dict[tuple, list[str]] = {}
    for name in dict.fromkeys(c for r in rules for c in r.commands):
        names.setdefault(tuple(k for k, r in enumerate(rules) if name in r.commands), []).append(name)
    out = F.when(F.lit(False), of(()))
    for which, commands in names.items():
        out = out.when(command.isin(*commands), of(tuple(rules[k] for k in which)))
    return out


def asks(argv: Column, policies: tuple[Policy, ...]) -> Column:
    def rules(command: Column, argv: Column, args: Column) -> Column:
        def any_of(some) -> Column:
            out = F.lit(False)
            for p in some:
                out = out | _holds(p, command, argv, args)
            return out

        own = by_command([p for p in policies if p.commands], command, any_of)
        return F.coalesce(any_of([p for p in policies if not p.commands]) | own, F.lit(False))

    return once(argv, rules)


def passthrough(argv: Column) -> Column:
    """Help, output for machines, or output whose bytes are promised."""
    return asks(argv, (*QUERY, *MACHINE, *EXACT))


_SERVERS = ("vite", "next", "nuxt", "webpack")
_SCRIPTS = ("npm", "pnpm", "yarn", "bun", "bunx", "deno")


def stream(argv: Column) -> Column:
    """capture, stream (followed and shortened as it comes) or inherit (left alone, as it is a dialogue or has no end)."""
    command, args, sub = base(F.get(argv, 0)), options(argv), F.coalesce(F.get(argv, 1), F.lit(""))
    has = lambda *w: F.arrays_overlap(args, F.array(*map(F.lit, w)))
    compose = (command == "docker-compose") | ((command == "docker") & (sub == "compose"))
    follows = (command.isin("docker", "kubectl", "docker-compose")) & F.array_contains(argv, "logs") & (has("-f", "--follow") | has_option(args, "--follow"))
    watched = (command == "tsc") & has("--watch", "-w") | command.isin("jest", "vitest") & has("--watch", "--watchAll", "-w") | (command == "gh") & (sub == "run") & (F.coalesce(F.get(argv, 2), F.lit("")) == "watch")
    capable, script, server = command.isin("jest", "vitest", "tsc", "webpack", "nodemon"), command.isin(*_SCRIPTS), command.isin(*_SERVERS)
    long_lived = (
        (has("--watch", "--watchAll") & (capable | script | server)) | (has("-w") & capable) | ((sub == "watch") & (script | command.isin("cargo", "gh"))) | ((command == "go") & (sub == "run"))
        | (sub.isin("dev", "serve", "start") & (script | server)) | ((command == "bunx") & has("dev", "serve", "start", "watch"))
        | (sub.isin("run", "exec", "task") & F.coalesce(F.get(argv, 2).isin("dev", "serve", "start", "watch"), F.lit(False)) & script) | command.isin("nodemon", "watchman")
        | ((command == "docker") & ((sub == "run") | ((sub == "stats") & ~has("--no-stream")))) | ((command == "vite") & ~sub.isin("build", "optimize")) | ((command == "esbuild") & has("--watch", "--serve"))
        | ((command == "rubocop") & has("--lsp", "--mcp", "--server")) | ((command == "rspec") & has("--bisect")) | (command.isin("gt", "graphite") & has("--interactive"))
        | ((command == "prisma") & (sub == "migrate") & F.coalesce(F.get(argv, 2).isin("dev", "reset"), F.lit(False))) | ((command == "playwright") & (has("--ui", "--debug", "--headed") | sub.isin("show-report", "show-trace", "codegen")))
        | ((command == "psql") & ~(has("-l", "--list", "-f", "--help", "--version") | has_option(args, "--command", "-c", True) | has_option(args, "--file", "-f", True)))
    )
    return F.when(follows | watched, "stream").when(long_lived | (compose & F.array_contains(argv, "up") & ~has("-d", "--detach")), "inherit").otherwise("capture")


def in_shell(argv: Column) -> Column:
    """A shell that runs one text, no dialogue: its output is told by content."""
    return base(F.get(argv, 0)).isin("sh", "bash", "zsh") & F.array_contains(argv, "-c") & ~F.arrays_overlap(argv, F.array(*map(F.lit, ("-i", "--interactive", "-l", "--login"))))
