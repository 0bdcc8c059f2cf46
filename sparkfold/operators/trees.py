"""Drawn folder trees: depth by indentation, parents and ends of folders by windows over levels, so that a tree of any number of lines needs no stack.

A row of depth d opens level d and closes all levels from d to that of the row before, so levels are opened and closed about as often as there are rows. Within
a level, a row's parent is the last opening before it, and a folder ends where its level is closed next. In a drawn tree each row is at most one deeper than the one
above; a capture for which that does not hold, or with a line that is no entry, gives nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfold.functions import lines as L

#: Files of a folder, or entries of a folder, from which on they become one line; names that this line gives.
MANY, SAMPLES = 4, 3
_DRAWN, _ASCII = r"^[  ─-╿]*", r"^((?:\|   |    )*)(?:\|-- |`-- )(.*\S)\s*$"
_TOTAL = r" director(?:y|ies).* file| file.* director(?:y|ies)"


def _entries(table: DataFrame) -> DataFrame:
    """Rows with text: `depth` and `name`, null where a line is no entry."""
    t = table.withColumn("line", F.regexp_replace("line", r"\r$", "")).where("line <> ''")
    ascii_ = F.regexp_like("line", F.lit(_ASCII))
    lead = F.regexp_extract("line", f"({_DRAWN})", 1)
    depth = F.when(ascii_, F.floor(F.length(F.regexp_extract("line", _ASCII, 1)) / 4) + 1).otherwise(F.floor(F.length(lead) / 4)).cast("int")
    name = F.trim(F.when(ascii_, F.regexp_extract("line", _ASCII, 2)).otherwise(F.regexp_replace("line", _DRAWN, "")))
    return t.withColumn("depth", depth).withColumn("name", F.when(name != "", name))


def levels(rows: DataFrame, key: str) -> DataFrame:
    """`rows` (key, line_no, depth, others) with `parent`, the line number of the row one level up, and `end`, that of the first row that is not below."""
    steps = rows.withColumn("before", F.coalesce(F.lag("depth").over(L.ordered(key)), F.lit(-1)))
    event = lambda level, what: F.struct(level.alias("level"), F.lit(what).alias("what"))
    own, above = F.array(event(F.col("depth"), 2)), F.when(F.col("depth") > 0, F.array(event(F.col("depth") - 1, 1)))
    shut = F.when(F.col("depth") <= F.col("before"), F.transform(F.sequence("depth", "before"), lambda x: event(x, 0)))
    others = F.struct(*[c for c in rows.columns if c not in (key, "line_no")])
    events = steps.select(key, "line_no", others.alias("x"), F.explode(F.concat(own, F.coalesce(above, F.slice(own, 1, 0)), F.coalesce(shut, F.slice(own, 1, 0)))).alias("e"))
    events = events.select(key, "line_no", "e.level", "e.what", F.when(F.col("e.what") == 2, F.col("x")).alias("x"))
    w = Window.partitionBy(key, "level").orderBy("line_no", "what")
    back = Window.partitionBy(key, "level").orderBy(F.desc("line_no"), F.desc("what"))  # frames that only grow, in both directions
    after = F.last(F.when(F.col("what") == 0, F.col("line_no")), ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    events = events.withColumn("parent", F.last(F.when(F.col("what") == 2, F.col("line_no")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("end", after)
    g = events.where("what > 0").groupBy(key, "line_no").agg(F.first("x", ignorenulls=True).alias("x"), F.max(F.when(F.col("what") == 1, F.col("parent"))).alias("parent"), F.max(F.when(F.col("what") == 2, F.col("end"))).alias("end"))
    return g.select(key, "line_no", "x.*", "parent", "end")


def _few(names: Column, n: Column, noun: Column) -> Column:
    left = n - SAMPLES
    return F.concat(F.lit("("), n.cast("string"), F.lit(" "), noun, F.lit(": "), F.array_join(F.slice(names, 1, SAMPLES), ", "), F.when(left > 0, F.concat(F.lit("; "), left.cast("string"), F.lit(" omitted; --raw for all"))).otherwise(""), F.lit(")"))


def tree(table: DataFrame, key: str = "capture_id") -> DataFrame:
    """key, line_no, line: indentation by two blanks instead of drawing. Four files of a folder and more become one line with samples; so does a folder of four entries
    and more that has no folder in it, or that is deep itself. The totals stay."""
    w, group = L.ordered(key), Window.partitionBy(key)
    is_total = F.regexp_like("line", F.lit(_TOTAL))
    t = table.withColumn("line_no", F.col("line_no").cast("long"))
    t = t.withColumn("total", F.max(F.when(is_total, F.struct("line_no", F.regexp_replace("line", r"\r$", "").alias("line")))).over(group))
    t = _entries(t.where(~is_total))
    was = F.lag("depth").over(w)
    fine = F.col("name").isNotNull() & (F.col("depth") <= F.coalesce(was, F.lit(-1)) + 1)
    t = t.withColumn("fine", fine).withColumn("total", F.when(was.isNull(), F.col("total"))).withColumn("all_fine", F.min("fine").over(group)).where("all_fine")
    t = t.withColumn("is_dir", F.endswith("name", F.lit("/")) | (F.col("depth") == 0) | (F.coalesce(F.lead("depth").over(w), F.lit(0)) > F.col("depth")))
    # From here on each step goes on from the rows of the one before, by explosion, windows and grouping: without a join, rows stay where their capture was brought together.
    t = levels(t.select(key, "line_no", "depth", F.regexp_replace("name", "/$", "").alias("name"), "is_dir", "total"), key)
    shown = F.concat("name", F.when(F.col("is_dir") & (F.col("name") != "."), "/").otherwise(""))
    # What each folder holds directly: at most its samples are kept, by place. A row stands at its own folder, and at its parent's as one of those held.
    at = F.explode(F.array(F.struct(F.col("line_no").alias("folder"), F.lit(False).alias("held")), F.struct(F.col("parent").alias("folder"), F.lit(True).alias("held"))))
    m = t.select("*", at.alias("at")).select("*", "at.*").drop("at").where("folder is not null").withColumn("shown", shown).withColumn("file", F.col("held") & ~F.col("is_dir"))
    whole = Window.partitionBy(key, "folder")
    so_far = whole.orderBy("line_no", "held").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    m = m.withColumn("nth", F.count_if("held").over(so_far)).withColumn("nth_file", F.count_if("file").over(so_far))
    sample = lambda keep, name: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("line_no", F.col(name).alias("v")))).over(whole)), lambda x: x["v"])
    m = m.withColumn("kids", F.count_if("held").over(whole)).withColumn("files", F.count_if("file").over(whole)).withColumn("first_file", F.min(F.when(F.col("file"), F.col("line_no"))).over(whole))
    m = m.withColumn("some", sample(F.col("held") & (F.col("nth") <= SAMPLES), "shown")).withColumn("some_files", sample(F.col("file") & (F.col("nth_file") <= SAMPLES), "name"))
    mine = lambda held, *names: F.first(F.when(F.col("held") == held, F.struct(*names)), ignorenulls=True)
    own = mine(False, "depth", "name", "is_dir", "total", "parent", "end", "kids", F.col("files").alias("own_files"), "some")
    g = m.groupBy(key, "line_no").agg(own.alias("own"), mine(True, "files", "some_files", "first_file").alias("above"))
    t = g.select(key, "line_no", "own.*", "above.*")
    plain = F.col("kids") == F.col("own_files")
    t = t.withColumn("shut", F.coalesce(F.col("is_dir") & F.col("parent").isNotNull() & (F.col("kids") >= MANY) & ((F.col("depth") >= 2) | plain), F.lit(False)))
    # Rows below a folder that is shut are hidden: one up where it begins, one down where it ends.
    step = lambda place, d: F.struct(place.alias("place"), F.lit(d).alias("d"))
    marks = F.array(step(F.col("line_no"), 0), F.when(F.col("shut"), step(F.col("line_no") + 1, 1)), F.when(F.col("shut") & F.col("end").isNotNull(), step(F.col("end"), -1)))
    row = F.struct(*[c for c in t.columns if c != key])
    every = t.select(key, row.alias("row"), F.explode(marks).alias("m")).where("m is not null").select(key, "m.place", "m.d", F.when(F.col("m.d") == 0, F.col("row")).alias("row"))
    before = Window.partitionBy(key).orderBy("place").rangeBetween(Window.unboundedPreceding, 0)
    t = every.withColumn("hidden", F.sum("d").over(before) > 0).where("row is not null and not hidden").select(key, "row.*")
    indent = F.repeat(F.lit("  "), F.col("depth"))
    many_files = ~F.col("is_dir") & (F.coalesce("files", F.lit(0)) >= MANY)
    line = F.when(F.col("shut"), F.concat(indent, "name", F.lit("/ "), _few(F.col("some"), F.col("kids"), F.when(plain, "files").otherwise("entries")))).when(many_files, F.concat(indent, _few(F.col("some_files"), F.col("files"), F.lit("files")))).otherwise(F.concat(indent, shown))
    rows = t.where(~many_files | (F.col("line_no") == F.col("first_file"))).select(key, F.explode(F.array("total", F.struct("line_no", line.alias("line")))).alias("x"))
    return rows.where("x is not null").select(key, "x.line_no", "x.line")


def drawn(table: DataFrame, key: str = "capture_id") -> DataFrame:
    """key, line_no, line: indentation instead of drawing; `~` before a name of the same depth as the one above."""
    lead = F.regexp_extract("line", f"({_DRAWN})", 1)
    t = table.withColumn("name", F.substring("line", F.length(lead) + 1, F.length("line"))).withColumn("depth", F.floor(F.length(lead) / 4).cast("int"))
    was = F.last(F.when(F.col("name") != "", F.col("depth")), ignorenulls=True).over(L.ordered(key).rowsBetween(Window.unboundedPreceding, -1))
    same = (F.col("depth") > 0) & (F.coalesce(was, F.lit(0)) == F.col("depth"))
    out = F.when(F.col("name") == "", "").when(same, F.concat(F.lit("~"), "name")).otherwise(F.concat(F.repeat(F.lit("  "), F.col("depth")), "name"))
    return t.select(key, "line_no", out.alias("line"))
