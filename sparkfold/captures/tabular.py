"""Drawn and ruled tables as fields between tabs, source files as outlines, and two exact codings of text."""

from __future__ import annotations

import re

from sparkfold.captures.shape import BLANK, joined, plain


#: File endings by language (fixed values); the ending `-` stands for data, which has no outline.
LANGUAGES = {
    "rust": ("rs",), "zig": ("zig",), "go": ("go",), "python": ("py", "pyi"), "script": ("ts", "tsx", "mts", "js", "jsx", "mjs"), "java": ("java", "kt", "kts"), "c": ("c", "h", "cpp", "cc", "hpp", "hh"), "ruby": ("rb",),
    "-": ("json", "yaml", "yml", "toml", "xml", "csv", "sql", "md", "markdown", "html", "css", "txt", "env", "ini", "cfg", "conf", "lock", "sum"),
}
_IMPORT = re.compile(r"import |from |#include|use |require|const .*require\(|export |@|#\[")
_DOC = {"rust": "///|//!", "zig": "///|//!", "go": "//", "python": "\"\"\"|'''", "java": r"/\*\*", "script": r"/\*\*|///", "c": r"/\*\*|///", "ruby": "##"}
_WORDS = "if|else|for|while|switch|catch|do|with|return|case|function|class|interface|enum|namespace|type|new|typeof|await|yield|throw|delete|void|in|of|import|export"
_BODY = {
    "rust": r"(?:pub )?(?:async )?fn ", "zig": r"(?:pub )?fn |test ", "go": r"func ", "java": r"(?:public|private|protected) (?!.*(?:class|interface) ).*\(", "c": r".*\(.*[{)]$",
    "script": rf"(?:async )?function |(?!type )(?:.* = .*=>.*|(?!.*=>)(?:(?!(?:{_WORDS})(?: |\())\*?[\w$]+ ?)+ *\(.*\).*)\{{$",
}
_CODE = re.compile(r"import |#include|def |fn |func |function |class |pub |const ")


def language(path: str) -> str | None:
    name = path.rpartition("/")[2]
    ending = name.rpartition(".")[2] if name.rfind(".") > 0 else ""
    return next((k for k, v in LANGUAGES.items() if ending in v), None)


def outline(text: str, path: str = "") -> str | None:
    """Imports, comments that document, and signatures; bodies are counted. None for data, and for what does not look like code."""
    kind = language(path)
    if kind == "-" or (kind is None and not _CODE.search(text[:2048])):
        return None
    doc, body = re.compile(_DOC.get(kind, r"(?!)")), re.compile(_BODY.get(kind, r"(?!)"))
    out: list[str] = []
    rows = text.split("\n")
    depth = inside = 0
    blank = False
    k = 0
    while k < len(rows):
        row = rows[k]
        core = row.strip(" \t\r")
        k += 1
        if not core:
            out += [""] * (not blank and not depth)
            blank = True
            continue
        blank = False
        opens, closes = core.count("{"), core.count("}")
        if _IMPORT.match(core) or doc.match(core):
            out.append(row)
        elif kind == "python" and re.match(r"(?:async )?def |class ", core):
            out.append(row)
            wide = lambda r: sum(4 if c == "\t" else 1 for c in r[: len(r) - len(r.lstrip(" \t"))])
            end = next((j for j in range(k, len(rows)) if rows[j].strip(" \t\r") and wide(rows[j]) <= wide(row)), len(rows))
            if end < len(rows):
                out += [f"    # ... ({end - k} lines)"] * (end > k) + [rows[end]]
            k = end + 1
        elif depth:
            depth += opens - closes
            inside += 1
            if depth <= 0:
                out += [f"    // ... ({inside} lines)"] * (inside > 1) + [row]
                depth = inside = 0
        else:
            out.append(row)
            if kind not in ("python", "ruby") and body.match(core) and opens > closes:
                depth, inside = opens - closes, 0
    return joined(out)


_SIGIL = "\x01"


def fold_prefixes(text: str) -> str:
    """A line whose first 16 characters are those of the line before has a mark in their place; unfold_prefixes() undoes it."""
    out, was = [], None
    for row in text.split("\n"):
        if row.startswith(_SIGIL):
            out.append(_SIGIL + row)
        elif was is not None and len(row) >= 16 and row[:16] == was and row[16:17] != _SIGIL:
            out.append(_SIGIL + row[16:])
        else:
            out.append(row)
        was = row[:16]
    return "\n".join(out)


def unfold_prefixes(text: str) -> str:
    out, was = [], ""
    for row in text.split("\n"):
        if row.startswith(_SIGIL * 2):
            row = row[1:]
            was = row[:16]
        elif row.startswith(_SIGIL):
            row = was + row[1:]
        else:
            was = row[:16]
        out.append(row)
    return "\n".join(out)


def fold_blanks(text: str) -> str:
    """Runs of 17 blanks and more as a mark and their length, at most 255 at once; a mark itself as a mark and zero."""

    def coded(m: re.Match) -> str:
        n, rest = divmod(len(m[0]), 255)
        return (_SIGIL + chr(255)) * n + (" " * rest if rest < 17 else _SIGIL + chr(rest))

    return re.sub(" {17,}", coded, text.replace(_SIGIL, _SIGIL + "\0"))


def unfold_blanks(text: str) -> str | None:
    """None where a mark has no length, or one of 1 to 16."""
    if re.search(r"\x01(?:$(?![\s\S])|[\x01-\x10]|[^\x00-\xff])", text):
        return None
    return re.sub(r"\x01([\x00\x11-\xff])", lambda m: " " * ord(m[1]) if ord(m[1]) else _SIGIL, text)
