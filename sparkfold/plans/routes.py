"""Which operator a command line's output goes to, as one projection over `argv`: the first route that holds.

A route names its commands, its first and second arguments, options of which one must be there, and options that ask for another output, which
leave it alone. `seen` is a pattern that the stream must have, as an operator only takes what it knows. All lists are fixed values.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkfold.plans.policy import by_command, has_option, once, passthrough


@dataclass(frozen=True)
class Route:
    operator: str
    commands: tuple[str, ...]
    first: tuple[str, ...] = ()
    second: tuple[str, ...] = ()
    one_of: tuple[str, ...] = ()
    unless: tuple[str, ...] = ()
    unless_arg: str = ""  # a pattern that no argument may have
    despite_policy: bool = False  # asked for in a form that only this operator takes


_GIT, _GH, _DOCKER = ("git",), ("gh",), ("docker",)
_COMPOSE = ("docker-compose",)
_PACKAGERS, _INSTALL = ("npm", "pnpm", "yarn", "bun"), ("install", "i", "ci", "add", "remove", "rm")
_STATUS = ("--porcelain", "-z")
_SUMMARY = ("--name-only", "--name-status", "--compact-summary")
_LOG = (*_SUMMARY, "--oneline", "--no-walk", "--abbrev-commit", "--graph", "-p", "--patch", "-u")
_SHOW = (*_SUMMARY, "--no-patch", "--raw", "-s")
_BLAME = ("-s", "--porcelain", "-p", "--line-porcelain", "--incremental", "-e", "--show-email")
_BLOB = r"^[^-].*:|^:"

ROUTES = (
    Route("git_status_short", _GIT, ("status",), one_of=("--short", "-s"), unless=_STATUS),
    Route("git_status", _GIT, ("status",), unless=(*_STATUS, "--short", "-s")),
    Route("git_diff", _GIT, ("diff",), unless=(*_SUMMARY, "--stat", "--shortstat", "--summary", "--patch-with-stat")),
    Route("git_log_stat", _GIT, ("log",), one_of=("--stat", "--shortstat"), unless=_LOG),
    Route("git_log", _GIT, ("log",), unless=(*_LOG, "--stat", "--shortstat")),
    Route("git_log_stat", _GIT, ("show",), one_of=("--stat", "--shortstat"), unless=_SHOW, unless_arg=_BLOB),
    Route("git_show", _GIT, ("show",), unless=(*_SHOW, "--stat", "--shortstat"), unless_arg=_BLOB),
    Route("git_branch", _GIT, ("branch",), one_of=("-v", "-vv", "--verbose")),
    Route("git_branches", _GIT, ("branch",), unless=("-v", "-vv", "--verbose")),
    Route("git_reflog", _GIT, ("reflog",)),
    Route("git_commit", _GIT, ("commit",)),
    Route("git_merge", _GIT, ("merge",)),
    Route("git_blame", _GIT, ("blame",), unless=_BLAME),
    Route("git_add", _GIT, ("add",)),
    Route("git_checkout", _GIT, ("checkout", "switch")),
    Route("git_fetch", _GIT, ("fetch",)),
    Route("git_push", _GIT, ("push",)),
    Route("git_pull", _GIT, ("pull",)),
    Route("git_rebase", _GIT, ("rebase",)),
    Route("git_stash", _GIT, ("stash",)),
    Route("trimmed", _GIT, ("config",), one_of=("--list", "-l"), unless=("--null", "-z")),
    Route("trimmed", _GIT, ("tag",), unless=("--column",)),
    Route("git_remotes", _GIT, ("remote",)),
    Route("git_shortlog", _GIT, ("shortlog",)),
    Route("git_worktrees", _GIT, ("worktree",), unless=_STATUS),
    Route("git_grep", _GIT, ("grep",)),
    Route("git_stack_log", ("gt", "graphite"), ("log",)),
    Route("git_status", ("gt", "graphite"), ("status",)),
    Route("nextest", ("nextest",), ("run",)),
    Route("nextest", ("cargo",), ("nextest",), ("run",)),
    Route("cargo_test", ("cargo",), ("test", "bench")),
    Route("jest", ("jest", "vitest")),
    Route("js_test", ("mocha",)),
    Route("js_test", ("node",), one_of=("--test",)),
    Route("script_test", _PACKAGERS, ("test",)),
    Route("go_test", ("go",), ("test",)),
    Route("pytest", ("pytest",)),
    Route("tsc", ("tsc",)),
    Route("rspec", ("rspec",)),
    Route("dotnet_test", ("dotnet",), ("test",)),
    Route("dotnet", ("dotnet",), ("build", "format", "restore")),
    Route("ctest", ("ctest",)),
    Route("cmake", ("cmake",)),
    Route("swift", ("swift",), ("build", "test")),
    Route("swift", ("xcodebuild",)),
    Route("playwright", ("playwright",), ("test",)),
    Route("grep", ("grep",)),
    Route("rg_matches", ("rg",)),
    Route("find_files", ("find",), one_of=("f",), unless=("d",)),
    Route("find_paths", ("find",)),
    Route("tree", ("tree",)),
    Route("ls_columns", ("ls",), one_of=("-C",)),
    Route("ls", ("ls",)),
    Route("du", ("du",), one_of=("-s",)),
    Route("du_rows", ("du",)),
    Route("wc", ("wc",)),
    Route("difference", ("diff",)),
    Route("file_slice", ("head", "tail")),
    Route("native_build", ("make", "ninja")),
    Route("native_build", ("cargo", "go", "zig"), ("build", "check")),
    Route("frontend_build", ("vite", "next", "nuxt", "turbo"), ("build", "run")),
    Route("frontend_build", ("webpack",)),
    Route("esbuild", ("esbuild",)),
    Route("gradle", ("gradle", "gradlew")),
    Route("maven", ("mvn", "mvnw")),
    Route("prisma", ("prisma",), ("migrate",)),
    Route("rake_tasks", ("rake",), ("-T", "--tasks", "-D", "-P", "-W")),
    Route("package_tree", ("npm", "yarn", "pnpm"), ("ls", "list")),
    Route("package_tree", ("bun",), ("pm",), ("ls",)),
    Route("pnpm_outdated", ("pnpm",), ("outdated",)),
    Route("install", _PACKAGERS, _INSTALL),
    Route("install", ("composer",), ("install", "require", "update", "upgrade", "remove", "create-project")),
    Route("pip_install", ("pip", "pip3"), ("install",)),
    Route("pip_table", ("pip", "pip3"), ("list", "outdated")),
    Route("uv", ("uv",), ("sync", "add", "remove", "lock", "tree", "pip")),
    Route("package_tool", ("uvx", "poetry", "npx", "bunx")),
    Route("curl", ("curl",), one_of=("-v", "--verbose")),
    Route("docker_stats", _DOCKER, ("stats",), one_of=("--no-stream",)),
    Route("buildkit", _DOCKER, ("build", "buildx")),
    Route("buildkit", _DOCKER, ("compose",), ("build",)),
    Route("buildkit", _COMPOSE, ("build",)),
    Route("docker_ps", _DOCKER, ("ps",)),
    Route("docker_ps", _COMPOSE, ("ps",)),
    Route("docker_ps", _DOCKER, ("compose",), ("ps",)),
    Route("docker_images", _DOCKER, ("images",)),
    Route("compose_logs", _DOCKER, ("compose",), ("logs",)),
    Route("compose_logs", _COMPOSE, ("logs",)),
    Route("service_logs", ("docker", "kubectl"), ("logs",)),
    Route("kubectl_pods", ("kubectl",), ("get",), ("pods", "pod", "po")),
    Route("json", ("acli", "gh"), one_of=("--json",), unless=("--jq", "-q", "--template", "-t")),
    Route("gh_checks", _GH, ("pr",), ("checks",)),
    Route("gh_view", _GH, ("pr", "issue"), ("view",)),
    Route("gh_run_list", _GH, ("run",), ("list",)),
    Route("gh_run_view", _GH, ("run",), ("view",)),
    Route("gh_pr_list", _GH, ("pr",), ("list",)),
    Route("gh_table", _GH, ("search",)),
    Route("gh_table", _GH, ("release", "issue"), ("list",)),
    Route("acli_view", ("acli",), ("jira",), ("workitem",), one_of=("view",)),
    Route("acli_table", ("acli",), ("jira", "confluence")),
    Route("pup_table", ("pup",)),
    Route("helm_list", ("helm",), ("list", "ls")),
    Route("helm_history", ("helm",), ("history",)),
    Route("helm_status", ("helm",), ("status",)),
    Route("grid", ("aws",), one_of=("--output", "--output=table"), unless_arg="^--query", despite_policy=True),
    Route("psql", ("psql",)),
    Route("sqlite_table", ("sqlite3",)),
    Route("outline", ("cat", "bat", "batcat")),
    Route("mypy", ("mypy",)),
    Route("ruff", ("ruff",)),
    Route("golangci_lint", ("golangci-lint",), ("run",)),
    Route("rubocop", ("rubocop",)),
    Route("lint", ("eslint", "biome")),
    Route("pre_commit", ("pre-commit",)),
    Route("prettier", ("prettier",)),
    Route("plan", ("terraform", "tofu"), ("plan",)),
    Route("columns", ("ps", "df", "systemctl", "docker", "kubectl", "gh")),
)

#: What a stream must show for an operator to take it; others know their text by themselves.
SEEN = {
    "git_reflog": r"\A\n*[0-9A-Fa-f]{7} [^ \n]+?@\{\d+\}: ",
    "git_status_short": r"\A\n*[ MADRCU?!T][ MADRCU?!T] \S",
    "git_branches": r"\A\n*[* +] \S",
    "cargo_test": r"test result:|(?m:^\s*running .* test)",
    "jest": r"Test Suites:|Test Files|(?m:^\s*Tests:)",
    "js_test": r"(?m:^\s*\d+ (?:passing|failing)(?:$| \())|(?m:^\s*# tests )",
    "script_test": r"Test Suites:|Test Files|(?m:^\s*Tests:)|(?m:^\s*\d+ (?:passing|failing)(?:$| \())|(?m:^\s*# tests )",
    "go_test": r"=== RUN|--- (?:FAIL|PASS):|(?m:^(?:Benchmark\S*\s|ok  \t|FAIL\t))|=== FUZZ",
    "pytest": r"test session starts|(?:passed|failed) in |collected .* item",
    "tsc": r"error TS|Found 0 errors|Found (?s:.*) errors in ",
    "ctest": r"tests passed, \d+ tests failed|Total Test time",
    "cmake": r"(?m:^-- (?:Configuring done|Generating done|Build files))|(?m:^\[ *\d+%\])",
    "swift": r"\*\* (?:BUILD|TEST) |Test Suite|Executed \d|(?:Swift)?Compil",
    "dotnet": r"(?i: error\(s\)|build (?:succeeded|failed)|restored? |format complete|would be formatted|: (?:error|warning) )",
    "plan": r"Plan: |No changes\.|will perform the following actions|(?m:^(?:│ )?Error: )",
    "install": r"added (?s:.*)packages|up to date|audited (?s:.*)packages|npm error|npm ERR!|npm WARN|Packages: [+-]|Already up to date| packages installed \[|success Saved |Package operations:|Lock file operations:|Nothing to install|could not be resolved|Done in ",
    "pip_table": r"\A\s*Package\s+Version",
    "rg_matches": r"\A\n*[^{ \t\n][^\n]*?:\d+:",
    "find_paths": r"\A(?![ \t])(?![\s\S]*(?:\n[ \t]|\x00))\s*\S",
    "find_files": r"\A(?![ \t])(?![\s\S]*(?:\n[ \t]|\x00))\s*\S",
    "helm_list": r"\ANAME\s+NAMESPACE\s+REVISION",
    "helm_history": r"\AREVISION\s+UPDATED\s+STATUS",
    "helm_status": r"\ANAME: (?s:.*)\nSTATUS: ",
    "docker_stats": r"\ACONTAINER ID\s+NAME\s+CPU %",
    "docker_ps": r"\A\n*(?:CONTAINER ID|NAME.*IMAGE.*SERVICE.*STATUS)",
    "docker_images": r"\A\n*REPOSITORY.*TAG.*IMAGE ID",
    "kubectl_pods": r"\A\n*NAME.*READY.*STATUS",
    "pre_commit": r"(?m:\.{3,}(?:Passed|Failed|Skipped)\s*$)",
    "columns": r"(?m:\S {2,}\S)",
    "git_status": r"(?m:^(?:On branch |HEAD detached |interactive rebase in progress|You have unmerged paths|You are currently |nothing to commit))",
    "git_log": r"\A\n*commit [0-9a-f]{7,40}",
    "git_log_stat": r"\A\n*commit [0-9a-f]{7,40}",
    "git_show": r"\A\n*commit [0-9a-f]{7,40}",
    "git_diff": r"\A\n*diff --(?:git|cc|combined) ",
}


def _rule(r: Route, argv: Column, args: Column) -> Column:
    out = F.lit(True)
    out = out & F.get(argv, 1).isin(*r.first) if r.first else out
    out = out & F.get(argv, 2).isin(*r.second) if r.second else out
    if r.one_of:
        out = out & F.arrays_overlap(args, F.array(*map(F.lit, r.one_of)))
    if r.unless:
        shut = F.arrays_overlap(args, F.array(*map(F.lit, r.unless)))
        for long in (o for o in r.unless if o.startswith("--")):
            shut = shut | has_option(args, long)
        out = out & ~shut
    if r.unless_arg:
        out = out & ~F.exists(args, lambda a: F.regexp_like(a, F.lit(r.unless_arg)))
    return F.coalesce(out, F.lit(False))


def operator_of(argv: Column) -> Column:
    """The operator for a command line; null for none, and for a command line whose output must stay as it is."""
    def rules(command: Column, argv: Column, args: Column) -> Column:
        def first(some) -> Column:
            out = F.when(F.lit(False), F.lit(""))
            for r in some:
                out = out.when(_rule(r, argv, args), r.operator)
            return out

        return F.struct(by_command(ROUTES, command, first).alias("plain"), by_command([r for r in ROUTES if r.despite_policy], command, first).alias("always"))

    found = once(argv, rules)
    return F.coalesce(found["always"], F.when(~passthrough(argv), found["plain"]))
