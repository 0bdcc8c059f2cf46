"""Any long text: clean lines, repeats said once with their number."""

from __future__ import annotations

import re
from collections import Counter

from sparkfold.captures.shape import plain

_NUMBER = r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
_JSON = re.compile(r"[ \t\r\n]*﻿?(?:\{[ \t\r\n]*[\"}]|\[[ \t\r\n]*(?:[\]{\[\"]|(?:true|false|null|" + _NUMBER + r")[ \t\r\n]*[,\]]))")
_CONTROL = re.compile(r"[\x01-\x08\x0b\x0c\x0e-\x1a\x1c-\x1f]")


def fits(text: str, threshold: int = 4096) -> bool:
    """Long enough, no JSON, and text rather than binary by its first 512 characters."""
    if len(text) * 4 <= threshold or (len(text) <= threshold and len(text.encode()) <= threshold) or _JSON.match(text):
        return False
    sample = text[:512]
    return "\0" not in sample and len(_CONTROL.findall(sample)) * 10 <= len(sample)


def clean(line: str) -> str:
    line = plain(line).rstrip(" \t\r")
    body = line.lstrip(" \t")
    return line[: len(line) - len(body)] + re.sub(r"[ \t]+", " ", body)


def folded(text: str) -> list[tuple[int, str, int, bool]]:
    """(line number, line, how often the text has it, whether an empty line goes before). A line seen three times or more stays where it
    first is; one seen twice stays wherever it is not next to itself. Empty lines do not part neighbours."""
    rows = [(k, r) for k, r in enumerate(map(clean, text.split("\n"))) if r]
    count = Counter(r for _, r in rows)
    heads = [k for k, (_, r) in enumerate(rows) if not k or rows[k - 1][1] != r]
    out: list[tuple[int, str, int, bool]] = []
    seen: set[str] = set()
    for at, k in enumerate(heads):
        number, row = rows[k]
        if count[row] >= 3 and row in seen:
            continue
        seen.add(row)
        after = heads[at + 1] if at + 1 < len(heads) else None
        gap = after is not None and rows[after][0] > rows[after - 1][0] + 1  # only empty lines can be missing there
        out.append((number, row, count[row], bool(out) and gap))
    return out


def compact(text: str) -> str | None:
    if not fits(text):
        return None
    return "".join(("\n" if blank else "") + row + (f" ×{n}" if n > 1 else "") + "\n" for _, row, n, blank in folded(text))
