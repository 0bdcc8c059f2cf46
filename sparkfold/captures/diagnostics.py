"""Checkers: diagnostics with their context, by file where they come one after another; None where the shape is unknown."""

from __future__ import annotations

import re

from sparkfold.captures.shape import Blocks, cores, first_few, joined, lines, rx

#: path:line: or path:line:column: (group 3, if any), then the rest.
_PLACE = re.compile(r"^(.+?):(\d+(?::\d+(?=:))?):(.*)$", re.S)
_STRICT_PLACE = re.compile(r"^(.+?):(\d+:\d+):(.*)$", re.S)


def split_location(row: str, column: bool = False) -> tuple[str, str, str] | None:
    m = (_STRICT_PLACE if column else _PLACE).match(row)
    return m.groups() if m else None


def structured(text: str) -> bool:
    """Output for machines, which stays as it is."""
    return bool(re.match(r"[ \t\n\f\r]*(?:[{\[<]|---|%YAML|::(?:error|warning|notice)|##vso\[task\.logissue)", text))


_MYPY = Blocks(opens=rx(r"^mypy: error:", r"^.+?:\d+(?::\d+)?:\s*(?:error|note|warning):"), always=rx(r"^Found .* error", r"^Success: "), within=rx(r"^\s"), strict=True)


def mypy(text: str) -> tuple[str, bool] | None:
    """(diagnostics and totals, whether there are diagnostics)."""
    rows = list(lines(text))
    kept = _MYPY(rows)
    found = any(_MYPY.opens.search(r) for r in kept)
    if len(kept) < sum(bool(r) for r in rows) or not (found or any(r.startswith("Success: ") for r in kept)):
        return None
    return joined(kept), found


_RULE = r"^[A-Z]+\d+\s"
_RUFF_TOTAL = r"^All checks passed|^Found |would be reformatted$|left unchanged$| files would be reformatted| files left unchanged"


def ruff(text: str) -> tuple[str, bool] | None:
    """Rule blocks as they are, or one line per place below its file."""
    rows = list(lines(text))
    if re.search(rf"(?m){_RULE}.*\n(?:(?!{_RULE}|{_RUFF_TOTAL}).*\n)*?\s*--> \S+:\d+:\d+\s*$", "\n".join(rows) + "\n"):
        return joined(Blocks(opens=rx(_RULE), always=rx(_RUFF_TOTAL), closes=rx("(?!)"))(rows)), True
    out, path, found, inside = [], None, False, False
    for row in rows:
        at = split_location(row, True)
        if at and re.match(r"\s*[A-Z]+\d+(?:\s|$)", at[2]):
            out += [at[0]] * (at[0] != path) + [f"  {at[1]} {at[2].lstrip()}"]
            path, found, inside = at[0], True, True
        elif inside and re.match(r"\s", row):
            out.append(row)
        elif re.search(_RUFF_TOTAL, row):
            out.append(row)
            path, inside = None, False
        elif row:
            inside = False
    return (joined(out), found) if found or any(r.startswith("All checks passed") for r in out) else None


_GOLANGCI = Blocks(opens=rx(r"^.+?:\d+(?::\d+)?:.*\([A-Za-z0-9_-]+\)$"), always=rx(r"^\d+ issues:$"), within=rx(r"^\s"), closes=rx(r"^(?=\S)(?!.+:\d+:)"), strict=True)


def golangci(text: str) -> tuple[str, bool] | None:
    rows = _GOLANGCI(r for r in lines(text) if r)
    return (joined(rows), True) if any(_GOLANGCI.opens.search(r) for r in rows) else None


_RUBOCOP = Blocks(opens=rx(r"^.+?:\d+:\d+:\s*[A-Z]: (?=.*/).*: "), always=rx(r" inspected,.*(?: offenses? detected|no offenses detected)"))


def rubocop(text: str) -> tuple[str, bool] | None:
    rows = _RUBOCOP(lines(text))
    found, total = any(_RUBOCOP.opens.search(r) for r in rows), [r for r in rows if _RUBOCOP.always.search(r)]
    return (joined(rows), found) if total and (found or "no offenses detected" in "".join(rows)) else None


_LINT_FILE = re.compile(r"^\S*/\S*$|^\S+\.(?:js|jsx|ts|tsx|vue|svelte)$")
_LINT_ROW = re.compile(r"^(?=.*(?:error|warning|lint/))(?:[^:]*:)?\d+:\d+.")
_LINT_TOTAL = re.compile(r" problems?|^Found |^Checked |^No lint errors")


def lint(stdout: str, stderr: str = "") -> str:
    """Diagnostics below their file, which is said once, and totals."""
    out, file = [], ""
    for row in cores(stdout, stderr):
        if _LINT_FILE.match(row) and " " not in row:
            file = row
        elif _LINT_ROW.match(row):
            out += [file] * bool(file) + [re.sub(" +", " ", row)]
            file = ""
        elif row and _LINT_TOTAL.search(row):
            out.append(row)
    return joined(out) or ("lint ok\n" if stdout or stderr else "")


def prettier(stdout: str, stderr: str = "") -> str:
    """Warnings and errors, and the first of the files that were written."""
    out, written = [], []
    for row in lines(stdout, stderr):
        m = re.match(r"(?!\[(?:warn|error)\])(.+) \d+ms( \(unchanged\))?$", row)
        if m:
            written += [m[1]] * (not m[2])
        elif re.match(r"\[warn\]|\[error\]|All matched files use Prettier", row) or "Code style issues found" in row or "No files matching" in row:
            out.append(row)
    return joined([*out, *[f"formatted {len(written)}: {first_few(written, len(written), 8, ', ... (+{})')}"] * bool(written)])


_PLAN = rx(r"^Plan: ", r"^No changes\.", r"^(?:│ )?(?:Error|Warning): ", r"^(?:Terraform|OpenTofu) will perform", r"^# .* (?:will|must) be ", r"^(?:\+|-|~|-/\+) resource ")


def strict(classify, stdout: str, stderr: str, exit_code: int, empty_is_clean: bool = False) -> tuple[str, str] | None:
    """Both streams through a classifier; None if nothing may change: output for machines, unknown shapes, or a failure without a diagnostic."""
    if structured(stdout) or structured(stderr):
        return None
    said = [classify(s) for s in (stdout, stderr)]
    if exit_code and not any(s and s[1] for s in said):
        return None
    if not any(said):
        return ("", "") if empty_is_clean and not exit_code and not stdout and not stderr else None
    return tuple(s[0] if s else raw for s, raw in zip(said, (stdout, stderr)))
