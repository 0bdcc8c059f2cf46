"""Building blocks of the per-capture forms: clean lines, runs, samples, blocks of lines, and what is left out in the middle.

A form takes the streams of one capture as text and returns the shorter text, or None where it does not recognise them. Forms are
pure functions of one row; operators/captured.py runs them batch by batch, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

ESCAPE = re.compile(r"\x1b(?:\[[^@-~]*[@-~]?|\][^\x07\x1b]*(?:\x07|\x1b\\)?|[\s\S])?")
BLANK = " \t\n\f\r"


def plain(text: str) -> str:
    return ESCAPE.sub("", text) if "\x1b" in text else text


def lines(*streams: str) -> Iterator[str]:
    """Lines of the streams one after another, escapes and white space at their ends gone."""
    for s in streams:
        for line in plain(s).split("\n") if s else ():
            yield line.rstrip(BLANK)


def cores(*streams: str) -> Iterator[str]:
    """The same, without indentation."""
    return (line.lstrip(BLANK) for line in lines(*streams))


def joined(rows: Iterable[str]) -> str:
    return "".join(f"{r}\n" for r in rows)


def rx(*alternatives: str) -> re.Pattern:
    return re.compile("|".join(f"(?:{a})" for a in alternatives))


def starts(*words: str) -> str:
    """A pattern for lines that begin with one of the words."""
    return "^(?:" + "|".join(map(re.escape, words)) + ")"


def has(*words: str) -> str:
    return "(?:" + "|".join(map(re.escape, words)) + ")"


def runs(rows: Iterable, key: Callable) -> Iterator[tuple[object, list]]:
    """Neighbours of one key."""
    return ((k, list(g)) for k, g in groupby(rows, key))


def folder(path: str) -> str:
    """Up to the last slash, with it."""
    return path[: path.rfind("/") + 1]


def capped(text: str, most: int) -> str:
    """At most so many bytes, whole characters."""
    return text if len(text) * 4 <= most else text.encode()[:most].decode("utf-8", "ignore")


def first_few(items: list[str], total: int, most: int, more: str = ", ...") -> str:
    """The first items by name, and a mark if there are more in all."""
    return ", ".join(items[:most]) + (more.format(total - min(most, len(items))) if total > min(most, len(items)) else "")


def head_tail(rows: list[str], head: int = 120, tail: int = 80) -> list[str]:
    gone = len(rows) - head - tail
    return rows if gone <= 0 else [*rows[:head], f"(omitted {gone} relevant lines; rerun with --raw)", *rows[-tail:]]


@dataclass(frozen=True)
class Blocks:
    """Which lines of a log stay. The first rule that holds decides: `drop` never stays; `always` stays and ends a block; `opens` stays and
    begins one; `closes` ends one (and stays if `closing_stays`); within a block, lines that match `within` stay, `most` of them at
    the most; another line ends the block if `strict`."""

    opens: re.Pattern
    closes: re.Pattern = field(default_factory=lambda: re.compile(r"^$"))
    within: re.Pattern = field(default_factory=lambda: re.compile(""))
    always: re.Pattern | None = None
    drop: re.Pattern | None = None
    most: int = 1 << 30
    strict: bool = False
    closing_stays: bool = False

    def __call__(self, rows: Iterable[str]) -> list[str]:
        out, left = [], 0
        for row in rows:
            if self.drop and self.drop.search(row):
                continue
            if self.always and self.always.search(row):
                out.append(row)
                left = 0
            elif self.opens.search(row):
                out.append(row)
                left = self.most
            elif self.closes.search(row):
                if left and self.closing_stays:
                    out.append(row)
                left = 0
            elif left and self.within.search(row):
                out.append(row)
                left -= 1
            elif self.strict:
                left = 0
        return out
