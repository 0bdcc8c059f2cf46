"""Command lines: chains taken apart, and what a version-control add or a container listing says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfold.functions import lines as L
from sparkfold.functions import text as T

#: Quoted text, escapes and redirections are words; then come what ends a command, plain text, and a quote without its end.
_TOKENS = r"""('[^']*'|"(?:\\[\s\S]|[^"\\])*"|\\[\s\S]|[<>]&|&>|&&|\|\||\|&|[;|&\n]|[^'"\;|&\n<>]+|[<>]|['"\\])"""
_ENDS = ("&&", "||", "|&", ";", "|", "&", "\n")
_MARK = "\x00\x01\x00"


def chain(command: Column) -> Column:
    """The commands of a chain, quotes kept; null where a quote or an escape has no end."""
    tokens = F.regexp_extract_all(command, F.lit(_TOKENS), F.lit(1))
    # A mark that no command has stands for each end, so that one join and one split do, whatever the number of tokens.
    marked = F.array_join(F.transform(tokens, lambda t: F.when(t.isin(*_ENDS), _MARK).otherwise(t)), "")
    return F.when(~F.exists(tokens, lambda t: t.isin("'", '"', "\\")), F.split(marked, _MARK))


def git_add(table: DataFrame, key: str = "capture_id") -> DataFrame:
    """key, line_no, line: `! path` for ignored, missing and converted paths; other lines stay."""
    ignored = F.when(F.startswith("line", F.lit("The following paths are ignored")), F.lit(True)).when(F.col("line") == "", F.lit(False))
    t = table.withColumn("inside", F.coalesce(L.carried(ignored, key), F.lit(False)))
    hint = F.col("inside") & F.startswith("line", F.lit("  ("))
    gone = (F.col("line") == "") | F.startswith("line", F.lit("The following paths are ignored")) | hint | F.startswith("line", F.lit("The file will have its original line endings"))
    missing, crlf = F.regexp_extract("line", r"^fatal: pathspec '([^']*)'", 1), F.regexp_extract("line", r"^warning: CRLF will be replaced by LF in (.*?)\.?$", 1)
    out = F.when(F.col("inside") & F.startswith("line", F.lit("\t")), F.concat(F.lit("! "), F.substring("line", 2, 1 << 30))).when(missing != "", F.concat(F.lit("! "), missing)).when(crlf != "", F.concat(F.lit("! "), crlf)).otherwise(F.col("line"))
    return t.where(~gone).select(key, "line_no", out.alias("line"))


def worktrees(table: DataFrame, key: str = "capture_id") -> DataFrame:
    """key, line_no, line: path, hash and branch one blank apart."""
    line = T.trim_ascii(F.col("line"))
    out = F.regexp_replace(line, r"^(.*?)[ \t]+([0-9A-Fa-f]{7,})[ \t]*(\[.*|)$", "$1 $2 $3")
    return table.select(key, "line_no", F.rtrim(out).alias("line")).where("line <> ''")
