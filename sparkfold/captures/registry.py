"""All forms by name: which streams they take, and what their result is worth as evidence."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from sparkfold.captures import builds, diagnostics, generic, git, listings, packages, runners, services, tabular
from sparkfold.plans import routes

FACTS, LOSSY = "FactComplete", "PotentiallyLossy"


@dataclass(frozen=True)
class Form:
    """streams(stdout, stderr, exit_code) -> the two shorter streams, or None for no change. `evidence`: of a command that succeeded, and of
    one that failed (None: a failure stays as it is)."""

    family: str
    streams: Callable[[str, str, int], tuple[str, str] | None]
    evidence: str = FACTS
    failed: str | None = None


def _known(text: str, got: str | None) -> str | None:
    """A form that leaves nothing of a text did not know it."""
    return None if got is None or (not got.strip() and text.strip()) else got


def _out(f: Callable[[str], str | None]):
    """For standard output alone; the other stream stays."""

    def streams(stdout: str, stderr: str, exit_code: int) -> tuple[str, str] | None:
        got = _known(stdout, f(stdout))
        return None if got is None else (got, stderr)

    return streams


def _each(on_out: Callable[[str], str | None], on_err: Callable[[str], str | None]):
    """Each stream by its own form; facts stay on the stream that they came on."""

    def streams(stdout: str, stderr: str, exit_code: int) -> tuple[str, str] | None:
        out, err = _known(stdout, on_out(stdout)), _known(stderr, on_err(stderr))
        return None if out is None and err is None else (stdout if out is None else out, stderr if err is None else err)

    return streams


def _single(f: Callable[[str, str], str | None], seen: str = ""):
    """The one stream that has text is shortened where it is; two that have stay as they are, and so does one without the mark `seen`."""
    mark = re.compile(routes.SEEN[seen]) if seen else None

    def streams(stdout: str, stderr: str, exit_code: int) -> tuple[str, str] | None:
        text = stdout or stderr
        if (stdout and stderr) or (mark and not mark.search(text)):
            return None
        got = _known(text, f(stdout, stderr))
        if got is None or (exit_code and got == runners.PASSED):  # nothing passed where the command failed
            return None
        return ("", got) if stderr else (got, "")

    return streams


def _strict(f, empty: bool = False):
    return lambda stdout, stderr, exit_code: diagnostics.strict(f, stdout, stderr, exit_code, empty)


FORMS: dict[str, Form] = {
    "git_log_stat": Form("git", _out(git.log_stat), LOSSY), "git_show": Form("git", _out(git.show), LOSSY),
    "git_branch": Form("git", _out(git.branch)), "git_commit": Form("git", _out(git.commit)), "git_merge": Form("git", _single(git.merge)), "git_blame": Form("git", _out(git.blame), LOSSY),
    "git_pull": Form("git", _each(git.pull, git.pull_refs)), "git_rebase": Form("git", _single(git.rebase)),
    "git_stash": Form("git", _single(git.stash)), "git_grep": Form("git", _out(lambda text: text), "ByteExact"), "git_stack_log": Form("git", _out(git.stack_log), LOSSY),
    "cargo_test": Form("test-tools", _single(runners.cargo, "cargo_test"), FACTS, FACTS), "jest": Form("test-tools", _single(runners.jest, "jest"), FACTS, FACTS), "js_test": Form("test-tools", _single(runners.js_test, "js_test"), FACTS, FACTS),
    "go_test": Form("test-tools", _single(runners.go, "go_test"), FACTS, FACTS), "pytest": Form("test-tools", _single(runners.pytest, "pytest"), FACTS, FACTS), "nextest": Form("test-tools", _out(runners.nextest), FACTS, FACTS),
    "rspec": Form("test-tools", _out(runners.rspec), FACTS, FACTS), "dotnet_test": Form("test-tools", _out(runners.dotnet_test), FACTS, FACTS), "playwright": Form("test-tools", _single(runners.playwright), LOSSY, LOSSY),
    "native_build": Form("build", _single(builds.native), LOSSY, FACTS), "frontend_build": Form("build", _single(builds.frontend), LOSSY, FACTS), "esbuild": Form("build", _single(builds.esbuild), LOSSY, LOSSY),
    "gradle": Form("build", _single(builds.gradle), LOSSY, FACTS), "maven": Form("build", _single(builds.maven), LOSSY, FACTS), "package_tool": Form("build", _single(builds.package_tool), LOSSY, FACTS),
    "prisma": Form("build", _single(builds.prisma), LOSSY, FACTS), "rake_tasks": Form("build", _out(builds.rake), LOSSY, FACTS),
    "npm_install": Form("package", _single(packages.npm), LOSSY, FACTS), "pnpm_install": Form("package", _single(packages.pnpm), LOSSY, FACTS), "yarn_install": Form("package", _single(packages.bun_yarn), LOSSY, FACTS),
    "install": Form("package", _single(packages.install, "install"), LOSSY, FACTS), "package_tree": Form("package", _out(packages.tree), LOSSY), "pnpm_outdated": Form("package", _out(packages.pnpm_outdated)),
    "pip_install": Form("package", _single(packages.pip_install), LOSSY), "uv": Form("package", _single(packages.uv), LOSSY),
    "ls_long": Form("listing", _out(listings.ls_long), LOSSY), "ls": Form("listing", _out(listings.ls), LOSSY), "ls_columns": Form("listing", _out(lambda text: listings.ls(text, True)), LOSSY),
    "find_long": Form("listing", _out(listings.find_long), LOSSY), "difference": Form("listing", _out(listings.difference), FACTS, FACTS),
    "du": Form("listing", _out(listings.du), LOSSY), "du_rows": Form("listing", _out(lambda text: listings.du(text, False)), LOSSY),
    "curl": Form("infra", lambda o, e, code: (services.curl(o, e), "") if e else None), "curl_trace": Form("infra", _out(services.curl_trace)), 
    "gh_view": Form("infra", _out(services.view)), "gh_run_view": Form("infra", _out(services.run_view)),
    "acli_view": Form("infra", _out(services.ticket)),
    "outline": Form("data", _out(tabular.outline), LOSSY),
    "fold_prefixes": Form("data", _out(tabular.fold_prefixes)), "fold_blanks": Form("data", _out(tabular.fold_blanks)),
    "mypy": Form("diagnostics", _strict(diagnostics.mypy), FACTS, FACTS), "ruff": Form("diagnostics", _strict(diagnostics.ruff), FACTS, FACTS), "golangci_lint": Form("diagnostics", _strict(diagnostics.golangci, True), FACTS, FACTS),
    "rubocop": Form("diagnostics", _strict(diagnostics.rubocop), FACTS, FACTS), "lint": Form("diagnostics", _single(diagnostics.lint), FACTS, FACTS), "prettier": Form("diagnostics", _single(diagnostics.prettier), FACTS, FACTS),
    "generic": Form("generic", _out(generic.compact)),
}
