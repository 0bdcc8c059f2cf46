"""Printed tables taken apart: images, releases, grids. A capture with a row of another shape gives nothing, so that its raw body is shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfold.functions import lines as L
from sparkfold.functions import text as T

#: States of a release (fixed values).
RELEASE_STATES = ("deployed", "failed", "superseded", "uninstalled", "pending-install", "pending-upgrade", "pending-rollback")


def _fields(table: DataFrame) -> DataFrame:
    return table.withColumn("f", F.filter(F.split("line", r"[ \t\n\f\r]+"), lambda x: x != "")).where(F.size("f") > 0)


def _without(t: DataFrame, bad: Column, key: str) -> DataFrame:
    """`t` without the captures that have a bad row; by a window, as a join would make the fields of all lines twice."""
    return t.withColumn("bad", F.max(F.coalesce(bad, F.lit(False))).over(Window.partitionBy(key))).where("not bad").drop("bad")


def helm_list(table: DataFrame, key: str = "capture_id") -> DataFrame:
    """key, line_no, line: name, namespace, revision, and the last three columns (status, chart, version)."""
    t = _fields(table.where("line_no > 0"))
    return _without(t, F.size("f") < 9, key).select(key, "line_no", F.concat(F.expr("concat(f[0], ' ', f[1], ' r', f[2], ' ')"), F.array_join(F.slice("f", -3, 3), " ")).alias("line"))


def helm_history(table: DataFrame, key: str = "capture_id") -> DataFrame:
    """key, line_no, line: revision, and everything from the state on."""
    t = _fields(table.where("line_no > 0")).withColumn("at", F.get(F.filter(F.transform("f", lambda x, i: F.when(x.isin(*RELEASE_STATES), i)), lambda i: i.isNotNull()), 0))
    return _without(t, F.expr("at is null or at + 2 >= size(f)"), key).select(key, "line_no", F.concat(F.lit("r"), F.get("f", 0), F.lit(" "), F.array_join(F.slice(F.col("f"), F.col("at") + 1, F.size("f") - F.col("at")), " ")).alias("line"))


def helm_status(table: DataFrame, key: str = "capture_id") -> DataFrame:
    """key, line_no, line: name, namespace, state and revision, and the notes."""
    notes = F.coalesce(L.carried(F.when(F.col("line") == "NOTES:", F.lit(True)), key), F.lit(False))
    return table.withColumn("notes", notes).where((F.col("line") != "") & (F.col("notes") | F.regexp_like("line", F.lit("^(?:NAME|NAMESPACE|STATUS|REVISION):")))).select(key, "line_no", "line")


def grid(table: DataFrame, key: str = "capture_id") -> DataFrame:
    """key, line_no, line: the cells of `| a | b |` rows, a tab apart; borders go. A capture with any other line, fewer than two borders or rows, or rows of
    several widths gives nothing."""
    t = table.withColumn("line", T.trim_ascii(F.col("line"))).where("line <> ''")
    t = t.withColumn("border", F.regexp_like("line", F.lit(r"^[-+=|]+$")) & F.contains("line", F.lit("-"))).withColumn("row", ~F.col("border") & F.regexp_like("line", F.lit(r"^\|.*\|$")) & F.regexp_like("line", F.lit(r"[^| \t]")))
    cells = F.transform(F.split(F.expr("substring(line, 2, length(line) - 2)"), r"\|"), T.trim_ascii)
    t = t.withColumn("cells", F.when(F.col("row"), cells))
    wide = F.when(F.size("cells") > 1, F.size("cells"))
    g = t.groupBy(key).agg(F.bool_and(F.col("border") | F.col("row")).alias("ok"), F.count_if("border").alias("b"), F.count_if("row").alias("r"), F.min(wide).alias("lo"), F.max(wide).alias("hi")).where("ok and b >= 2 and r >= 2 and lo = hi")
    return t.where("row").join(g.select(key), key, "left_semi").select(key, "line_no", F.array_join("cells", "\t").alias("line"))


def psql(table: DataFrame, key: str = "capture_id") -> DataFrame:
    """key, line_no, line: header and rows of an aligned result, a tab apart, and its `(n rows)`."""
    t = table.withColumn("line", T.trim_ascii(F.col("line"))).withColumn("rule", F.regexp_like("line", F.lit(r"^(?=.*\+)(?=.*-)[-+]+$"))).withColumn("foot", F.regexp_like("line", F.lit(r"^\(\d+ rows?\)$")))
    w = Window.partitionBy(key)
    t = t.withColumn("at", F.min(F.when(F.col("rule"), F.col("line_no"))).over(w))
    t = t.withColumn("head", F.max(F.when((F.col("line_no") < F.col("at")) & (F.col("line") != ""), F.col("line_no"))).over(w))
    t = t.withColumn("cells", F.transform(F.split("line", r"\|"), T.trim_ascii))
    body = (F.col("line_no") > F.col("at")) & (F.col("line") != "") & ~F.col("foot")
    t = t.withColumn("body", body).withColumn("width", F.max(F.when(F.col("line_no") == F.col("head"), F.size("cells"))).over(w))
    g = t.groupBy(key).agg(F.count_if("body").alias("n"), F.bool_and(~F.col("body") | (F.size("cells") == F.col("width"))).alias("ok"), F.max("width").alias("width")).where("ok and n > 0 and width > 1")
    shown = F.when(F.col("body") | (F.col("line_no") == F.col("head")), F.array_join("cells", "\t")).when(F.col("foot") & (F.col("line_no") > F.col("at")), F.col("line"))
    return t.join(g.select(key), key, "left_semi").select(key, "line_no", shown.alias("line")).where("line is not null")
