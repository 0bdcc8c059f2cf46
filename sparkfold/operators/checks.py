"""Diagnostics, checks and fixed tables: groups with samples, counts by state, columns said once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfold.functions import lines as L
from sparkfold.functions import text as T
from sparkfold.sources.tables import written


def _diagnostics(table: DataFrame) -> DataFrame:
    """`line` bare, whether it is a `summary`, `place`, `rest`, `code`, `message` and `start` of a diagnostic (null on other lines), and `said`: whether the line is
    shown, alone or in a group. Nothing is filtered here, as a filter would have the steps before it computed again."""
    line = F.col("line")
    t = table.withColumn("line", T.trim_ascii(F.when(F.contains(line, F.lit("\x1b")), T.strip_ansi(line)).otherwise(line)))
    t = t.withColumn("summary", F.startswith("line", F.lit("Found ")) & F.contains("line", F.lit("error"))).withColumn("at", F.instr("line", " - error TS"))
    t = t.withColumn("rest", F.when(~F.col("summary") & (F.col("at") > 0), F.substring("line", F.col("at") + F.lit(9), F.length("line"))))
    t = t.withColumn("rest", F.when(F.contains("rest", F.lit(":")), F.col("rest"))).withColumn("place", F.when(F.col("rest").isNotNull(), F.substring("line", F.lit(1), F.col("at") - 1)))
    t = t.withColumn("code", F.substring_index("rest", ":", 1))
    t = t.withColumn("message", T.trim_ascii(F.substring("rest", F.length("code") + 2, F.length("rest"))))
    t = t.withColumn("start", F.substring(F.encode("message", "UTF-8"), 1, 40))  # bytes, not characters
    return t.withColumn("said", F.coalesce(F.col("rest").isNotNull() | F.col("summary") | F.contains("line", F.lit("error TS")), F.lit(False)))


def _places(n: Column, places: Column) -> Column:
    more = F.when(n > 3, F.concat(F.lit(", ... ("), (n - 3).cast("string"), F.lit(" more)"))).otherwise("")
    return F.concat("code", F.lit(" x"), n.cast("string"), F.lit(": "), F.array_join(places, ", "), more)


def _line(ord: Column, sub: Column | int, line: Column) -> Column:
    return F.struct(ord.cast("long").alias("ord"), (F.lit(sub) if isinstance(sub, int) else sub).cast("long").alias("sub"), line.alias("line"))


def _last() -> Column:
    """Lines of another shape come after all diagnostics, summaries after these."""
    return F.lit(1 << 40) + F.when(F.col("summary"), 1).otherwise(0)


def tsc(table: DataFrame, key: str = "capture_id") -> DataFrame:
    """key, ord, sub, line: three or more diagnostics of one code whose messages begin alike become one line with three places, then the message;
    others stand as they are, by code in order of first sight. Lines of another shape and summaries follow. A capture with none of these has no
    type errors, and says so. Windows hold a whole capture; `tsc_rows` does not."""
    whole, w = Window.partitionBy(key), Window.partitionBy(key, "code")
    by = w.orderBy("line_no")
    t = _diagnostics(table).withColumn("any", F.max("said").over(whole)).withColumn("top", F.row_number().over(whole.orderBy("line_no")) == 1)
    t = t.withColumn("n", F.count("*").over(w)).withColumn("first", F.min("line_no").over(w)).withColumn("alike", F.min("start").over(w) == F.max("start").over(w))
    t = t.withColumn("nth", F.row_number().over(by)).withColumn("p2", F.lead("place", 1).over(by)).withColumn("p3", F.lead("place", 2).over(by))
    diagnostic, grouped = F.col("rest").isNotNull(), (F.col("n") >= 3) & F.col("alike")
    head = diagnostic & grouped & (F.col("nth") == 1)
    out = F.array(
        F.when(head, _line(F.col("first"), 0, _places(F.col("n"), F.array("place", "p2", "p3")))), F.when(head & (F.col("message") != ""), _line(F.col("first"), 1, F.col("message"))),
        F.when(diagnostic & ~grouped, _line(F.col("first"), F.col("line_no"), F.concat("place", F.lit(" "), "rest"))), F.when(~diagnostic & F.col("said"), _line(_last(), F.col("line_no"), F.col("line"))),
        F.when(F.col("top") & ~F.col("any"), _line(F.lit(0), 0, F.lit("no type errors"))),
    )
    return t.select(key, F.explode(out).alias("x")).where("x is not null").select(key, "x.*")


def tsc_rows(table: DataFrame, order: tuple[str, ...], block: Column, key: str = "capture_id") -> DataFrame:
    """What `tsc` makes of captures of any size, from rows (key, order columns, line) that no one has numbered: their order in a capture is that of `order`, and `block`
    only grows with it. Counts by block tell which codes are grouped and how many lines lie before each block, so that lines are numbered block by block and no
    task holds a whole capture."""
    table = table.withColumn("block", F.coalesce(block.cast("long"), F.lit(-(1 << 63))))  # nulls are first, as in an ordering
    lines = _diagnostics(table)
    counts = written(lines.groupBy(key, "block", "code", "start").agg(F.count("*").alias("n"), F.max("said").alias("said")))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sum_before = lambda *by: F.coalesce(F.sum("n").over(earlier.partitionBy(*by)), F.lit(0))
    before = written(counts.groupBy(key, "block").agg(F.sum("n").alias("n")).select(key, "block", sum_before(key).alias("before")))

    def numbered(rows: DataFrame) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy("block", key).orderBy(*order))
        return rows.withColumn("nth", nth).join(before, ["block", key]).withColumn("line_no", F.col("before") + F.col("nth") - 1).drop("nth", "before")

    # A code's first three lines lie in the blocks before which it has fewer than three.
    w = Window.partitionBy(key, "code")
    codes = counts.where("code is not null").groupBy(key, "code", "block").agg(F.sum("n").alias("n"), F.min("start").alias("low"), F.max("start").alias("high"))
    codes = codes.withColumn("earlier", sum_before(key, "code")).withColumn("n", F.sum("n").over(w)).withColumn("alike", F.min("low").over(w) == F.max("high").over(w))
    early = written(codes.where("earlier < 3").select(key, "code", "block", "n", "alike"))
    near = numbered(table.join(early.select(key, "block").distinct(), [key, "block"], "left_semi"))
    near = _diagnostics(near).join(early, [key, "code", "block"]).withColumn("nth", F.row_number().over(w.orderBy("line_no"))).where("nth <= 3")
    top = F.sort_array(F.collect_list(F.struct("line_no", "place", "message")))
    heads = near.groupBy(key, "code", "n", "alike").agg(top.alias("top"))
    heads = written(heads.select(key, "code", "n", (F.col("alike") & (F.col("n") >= 3)).alias("grouped"), F.get("top", 0)["line_no"].alias("first"), F.get("top", 0)["message"].alias("message"), F.transform("top", lambda x: x["place"]).alias("places")))

    x = F.explode(F.array(_line(F.col("first"), 0, _places(F.col("n"), F.col("places"))), _line(F.col("first"), 1, F.col("message")))).alias("x")
    groups = heads.where("grouped").select(key, x).where("x.line <> ''").select(key, "x.*")
    own = F.when(F.col("rest").isNull(), F.when(F.col("said"), F.col("line"))).when(~F.col("grouped"), F.concat("place", F.lit(" "), "rest"))
    rest = lines.join(heads.select(key, "code", "grouped", "first"), [key, "code"], "left")
    rest = numbered(rest.select(key, "block", *order, F.when(F.col("rest").isNull(), _last()).otherwise(F.col("first")).cast("long").alias("ord"), own.alias("line"))).where("line is not null")
    clean = counts.groupBy(key).agg(F.max("said").alias("said")).where("not said").select(key, _line(F.lit(0), 0, F.lit("no type errors")).alias("x")).select(key, "x.*")
    return groups.unionByName(rest.select(key, "ord", F.col("line_no").alias("sub"), "line")).unionByName(clean)


def gh_checks(table: DataFrame, key: str = "capture_id") -> DataFrame:
    """key, ord, line: counts by state in order of first sight, then the rows that did not pass. A capture with any row of another shape
    stays as it is."""
    rule = r"^[^\t]+\t(pass|fail|pending|skipping|cancel)\t[^\t]+\t(?:|https?://[^\t]*)\t?$"
    t = table.where("line <> ''").withColumn("state", F.regexp_extract("line", rule, 1))
    bad = t.where("state = ''").select(key).distinct()
    good = t.join(bad, key, "left_anti")
    s = good.groupBy(key, "state").agg(F.count("*").alias("n"), F.min("line_no").alias("first"))
    s = s.groupBy(key).agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("first", "n", "state"))).alias("s"))
    head = s.select(key, F.lit(-1).cast("long").alias("ord"), F.concat(F.col("n").cast("string"), F.lit(" checks: "), F.array_join(F.transform("s", lambda x: F.concat(x["n"].cast("string"), F.lit(" "), x["state"])), ", ")).alias("line"))
    rows = good.where("state <> 'pass'").unionByName(t.join(bad, key, "left_semi"))
    return head.unionByName(rows.select(key, F.col("line_no").cast("long").alias("ord"), "line"))


def columns(table: DataFrame, key: str = "capture_id") -> DataFrame:
    """key, line_no, line, repeats: fields two blanks apart; one equal to the field above is `~`, a row equal to the one above is
    counted in `repeats`. A line without two blanks ends the comparison."""
    t = table.withColumn("table", F.contains("line", F.lit("  ")))
    t = t.withColumn("fields", F.when(F.col("table"), F.filter(F.split("line", " {2,}"), lambda x: x != "")))
    was = L.before("fields", key)
    t = t.withColumn("was", was).withColumn("same", F.coalesce(F.col("fields") == F.col("was"), F.lit(False)))
    t = L.islands(t, ~F.col("same"), key)
    last = lambda x: F.when(F.regexp_like(x, F.lit("^/.*[^/]$")), F.regexp_extract(x, r"([^/]*)$", 1)).when(F.contains(x, F.lit(" /")) & ~F.startswith(x, F.lit("/")), F.regexp_replace(x, r"^(.*?) /(?:.*/)?([^/]+)$", "$1 $2")).otherwise(x)
    cells = F.transform("fields", lambda x, i: F.when(F.coalesce(F.get("was", i) == x, F.lit(False)), "~").when(i + 1 == F.size("fields"), last(x)).otherwise(x))
    t = t.withColumn("out", F.when(F.col("table"), F.array_join(cells, " ")).otherwise(F.col("line")))
    return t.groupBy(key, "island").agg(F.min(F.struct("line_no", "out")).alias("f"), (F.count("*") - 1).alias("repeats")).select(key, F.col("f.line_no").alias("line_no"), F.col("f.out").alias("line"), F.col("repeats").cast("long").alias("repeats"))


def pip_table(table: DataFrame, key: str = "capture_id") -> DataFrame:
    """key, line_no, line: header and rule gone, columns one blank apart."""
    t = table.withColumn("line", F.btrim("line", F.lit(" \t\n\f\r"))).where("line <> ''")
    t = t.where(~F.regexp_like("line", F.lit(r"^[-][- \t]*$")) & ~F.startswith(F.lower("line"), F.lit("package ")))
    return t.select(key, "line_no", F.regexp_replace("line", r"[ \t]+", " ").alias("line"))
