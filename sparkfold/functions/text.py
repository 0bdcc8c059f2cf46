"""Scalar text functions as JVM-side columns. White space is that of ASCII terminals, not Unicode's, throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Colour and cursor sequences, titles, and any other escape with the byte after it.
ANSI = r"\x1b(?:\[[^@-~]*[@-~]?|\][^\x07\x1b]*(?:\x07|\x1b\\)?|[\s\S])?"
ANSI_CSI = r"\x1b\[[^@-~]*[@-~]?"
#: A date, perhaps with a time after a blank, up to the next blank, and the blanks.
TIMESTAMP = r"^\d{4}-\d{2}-\d{2}(?: \d{2}:\d{2}:\d{2})?[^ \t]*[ \t]*"
#: Substrings of a name that mark its value as secret (fixed values).
SECRET_NAMES = ("key", "secret", "password", "token", "credential", "auth", "private", "api_key", "apikey", "access_key", "jwt")


def strip_ansi(x: Column) -> Column:
    return F.regexp_replace(x, ANSI, "")


def strip_ansi_csi(x: Column) -> Column:
    return F.regexp_replace(x, ANSI_CSI, "")


def rtrim_blank(x: Column) -> Column:
    """Without blanks, tabs and carriage returns at the end."""
    return F.regexp_replace(x, r"[ \t\r]+$", "")


def trim_ascii(x: Column) -> Column:
    return F.btrim(x, F.lit(" \t\n\f\r"))


def collapse_blanks(x: Column) -> Column:
    """Runs of blanks and tabs become one blank, but for those that a line begins with."""
    indent = F.regexp_extract(x, r"^([ \t]*)", 1)
    return F.concat(indent, F.regexp_replace(F.substring(x, F.length(indent) + 1, F.length(x)), r"[ \t]+", " "))


def clean_line(x: Column) -> Column:
    return collapse_blanks(rtrim_blank(strip_ansi(x)))


def without_timestamp(x: Column) -> Column:
    return F.regexp_replace(x, TIMESTAMP, "")


def log_line(x: Column, compose: bool) -> Column:
    """A compose line `service | payload` as `service| payload` without the payload's timestamp; any other line as it is."""
    if not compose:
        return x
    service = trim_ascii(F.regexp_extract(x, r"^([^|]*)\|", 1))
    payload = without_timestamp(F.ltrim(F.regexp_replace(x, r"^[^|]*\|", ""), F.lit(" \t\n\f\r")))
    return F.when(service != "", F.concat(service, F.lit("|"), F.when(payload != "", F.concat(F.lit(" "), payload)).otherwise(""))).otherwise(x)


def looks_like_json(x: Column) -> Column:
    """An object or array opens the text; a number or word in an array needs a comma or bracket after it."""
    number = r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
    rule = r"^[ \t\r\n]*\x{FEFF}?(?:\{[ \t\r\n]*[\"}]|\[[ \t\r\n]*(?:[\]{\[\"]|(?:true|false|null|" + number + r")[ \t\r\n]*[,\]]))"
    return F.regexp_like(x, F.lit(rule))


def compactible(x: Column, threshold: int = 4096) -> Column:
    """Long enough, no JSON, and text rather than binary by its first 512 characters."""
    sample = F.substring(x, 1, 512)
    controls = F.length(F.regexp_replace(sample, r"[^\x01-\x08\x0b\x0c\x0e-\x1a\x1c-\x1f]", ""))
    return (F.octet_length(x) > threshold) & ~looks_like_json(x) & ~F.contains(sample, F.lit("\x00")) & (controls * 10 <= F.length(sample))


def parent_slash(path: Column) -> Column:
    """Everything up to the last slash, with it; empty where there is none."""
    return F.regexp_extract(path, r"^(.*/)", 1)


def parent_dir(path: Column) -> Column:
    """The folder without its slash; `.` where there is none, `/` for the root."""
    p = F.regexp_extract(path, r"^(.*)/", 1)
    return F.when(~F.contains(path, F.lit("/")), ".").when(p == "", "/").otherwise(p)


def basename(path: Column) -> Column:
    tail = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.when(tail == "", path).otherwise(tail)


def mask_secret(name: Column, value: Column) -> Column:
    low = F.lower(name)
    secret = F.contains(low, F.lit(SECRET_NAMES[0]))
    for s in SECRET_NAMES[1:]:
        secret = secret | F.contains(low, F.lit(s))
    masked = F.when(F.octet_length(value) <= 4, F.lit("****")).otherwise(F.concat(F.substring(value, 1, 2), F.lit("****"), F.right(value, F.lit(2))))
    return F.when(secret, masked).when(F.octet_length(value) > 100, F.concat(F.substring(value, 1, 50), F.lit("..."))).otherwise(value)


def shell_quote(x: Column) -> Column:
    """As it is if every character is safe in a shell, else in single quotes."""
    return F.when(F.regexp_like(x, F.lit(r"^[A-Za-z0-9_\-./:=,+@%]+$")), x).otherwise(F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("'\\''")), F.lit("'")))


def du_bytes(number: Column, unit: Column) -> Column:
    """Bytes of a size with one decimal; a number without unit is in KiB. Integers only."""
    power = F.when(unit == "M", 2).when(unit == "G", 3).when(unit == "T", 4).when(unit == "P", 5).when(unit == "E", 6).otherwise(1)
    whole = F.regexp_extract(number, r"^(\d*)", 1).cast("long")
    tenth = F.coalesce(F.regexp_extract(number, r"\.(\d)", 1).try_cast("long"), F.lit(0))
    tenths = whole * 10 + tenth
    unit_bytes = F.element_at(F.array(*[F.lit(1024**k) for k in range(1, 7)]), power)
    return tenths * F.expr("1") * F.floor(unit_bytes / 10).cast("long") + F.floor(tenths * (unit_bytes % 10) / 10).cast("long")


def rounded_number(number: Column) -> Column:
    """Two leading digits of a long whole number, then zeros."""
    return F.when(F.contains(number, F.lit(".")) | (F.length(number) <= 2), number).otherwise(F.rpad(F.substring(number, 1, 2), F.length(number), F.lit("0")))


def human_size(b: Column) -> Column:
    def scaled(power: int, letter: str) -> Column:
        tenths = F.floor(b / F.lit(1024**power // 10)).cast("long")
        return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(letter))

    return F.when(b >= 1024**4, scaled(4, "T")).when(b >= 1024**3, scaled(3, "G")).when(b >= 1024**2, scaled(2, "M")).when(b >= 1024, scaled(1, "K")).otherwise(b.cast("string"))


def json_minify(x: Column) -> Column:
    """White space outside strings gone, numbers and order as written; null unless it is one valid container."""
    ok = F.try_parse_json(x).isNotNull() & F.regexp_like(x, F.lit(r"^[ \t\r\n]*[\[{]"))
    return F.when(ok, F.concat(F.regexp_replace(x, r"(\"(?:\\.|[^\"\\])*\")|[ \t\r\n]+", "$1"), F.lit("\n")))


def canonical_unbase64(x: Column) -> Column:
    """Decoded bytes of canonical base64; null otherwise."""
    b = F.try_to_binary(x, F.lit("base64"))
    return F.when(F.base64(b) == x, b)


def first_place(x: Column, needle: str) -> Column:
    """Characters before the first occurrence; null if there is none, 0 for the empty needle."""
    return F.lit(0) if not needle else F.nullif(F.instr(x, needle), F.lit(0)) - 1


def last_place(x: Column, needle: str) -> Column:
    """Characters before the last occurrence; null if there is none, the length for the empty needle."""
    return F.length(x) if not needle else F.length(x) - len(needle) + 1 - F.nullif(F.instr(F.reverse(x), needle[::-1]), F.lit(0))


def after_lines(x: Column, n: int) -> Column:
    """What follows the first n line feeds; empty where there are fewer."""
    return F.regexp_extract(x, rf"(?s)^(?:[^\n]*\n){{{n}}}(.*)$", 1)


def strip_ansi_exact(x: Column) -> Column:
    """Colour sequences and titles out; of any other escape only its first byte."""
    return F.regexp_replace(x, r"\x1b(?:\[[^@-~]*[@-~]?|\][^\x07\x1b]*(?:\x07|\x1b\\)?)?", "")


def location(x: Column) -> Column:
    """path, line and rest of `path:line[:column]:rest`; null for any other text. A drive's colon is no separator."""
    rule = r"(?s)^(.+?):(\d+(?::\d+(?=:))?):(.*)$"
    return F.when(F.regexp_like(x, F.lit(rule)), F.struct(*[F.regexp_extract(x, rule, k + 1).alias(n) for k, n in enumerate(("path", "place", "rest"))]))


def first_number(x: Column) -> Column:
    return F.nullif(F.regexp_extract(x, r"(\d+)", 1), F.lit(""))


def number_before(x: Column, marker: str) -> Column:
    """The digits right before a marker, blanks between them aside."""
    return F.nullif(F.regexp_extract(x, rf"(\d+) *\Q{marker}\E", 1), F.lit(""))


def flag_on(x: Column) -> Column:
    """An environment flag that is on."""
    return F.coalesce(F.startswith(x, F.lit("1")), F.lit(False))


def flag_off(x: Column) -> Column:
    return F.coalesce(F.lower(x).isin("0", "false", "no", "off"), F.lit(False))
