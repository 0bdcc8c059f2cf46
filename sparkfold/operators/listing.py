"""Listings of files and matches: groups, samples, sizes, and paths said once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkfold.functions import lines as L
from sparkfold.functions import text as T


def _by_hand(ok: DataFrame, raw: DataFrame, key: str) -> DataFrame:
    """The compact rows, and the raw ones of captures that have none."""
    return ok.unionByName(raw.join(ok.select(key).distinct(), key, "left_anti").select(*ok.columns))


def grep(table: DataFrame, key: str = "capture_id") -> DataFrame:
    """key, ord, line: paths in order, the first three matches of each, then how many more. A capture of fewer than 20 lines or two paths, or with a line
    without a path, stays as it is."""
    t = table.where("line <> ''").withColumn("path", F.regexp_extract("line", r"^([^:]*):", 1))
    bad = (~F.contains("line", F.lit(":"))) | (F.col("path") == "") | F.regexp_like("path", F.lit(r"[ \t\n\f\r]"))
    good = t.groupBy(key).agg(F.bool_or(bad).alias("bad"), F.count("*").alias("lines"), F.countDistinct("path").alias("paths")).where("not bad and lines >= 20 and paths >= 2").select(key)
    t = t.join(good, key).withColumn("nth", F.row_number().over(Window.partitionBy(key, "path").orderBy("line_no"))).withColumn("n", F.count("*").over(Window.partitionBy(key, "path")))
    shown = t.where("nth <= 3").select(key, "path", "nth", "line")
    more = t.where("nth = 1 and n > 3").select(key, "path", F.lit(4).alias("nth"), F.concat("path", F.lit(": ... "), (F.col("n") - 3).cast("string"), F.lit(" more matches")).alias("line"))
    out = shown.unionByName(more).withColumn("ord", F.row_number().over(Window.partitionBy(key).orderBy("path", "nth")))
    raw = table.select(key, F.col("line_no").alias("ord"), "line")
    return _by_hand(out.select(key, F.col("ord").cast("long").alias("ord"), "line"), raw.withColumn("ord", F.col("ord").cast("long")), key)


def find(table: DataFrame, noun: str = "entries", key: str = "capture_id") -> DataFrame:
    """key, parent, ord, line: paths by folder; a folder of three or more becomes one line with samples and the last name."""
    t = table.withColumn("path", F.regexp_replace("line", r"\r$", "")).where("path <> ''").withColumn("parent", T.parent_dir(F.col("path")))
    names = F.transform(F.array_sort(F.collect_list("path")), T.basename)
    g = t.groupBy(key, "parent").agg(F.count("*").alias("n"), names.alias("names"))
    label = F.when(F.col("parent") == ".", "./").when(F.endswith("parent", F.lit("/")), F.col("parent")).otherwise(F.concat("parent", F.lit("/")))
    left = F.col("n") - 4
    tail = F.when(F.col("n") > 3, F.concat(F.when(left > 0, F.concat(F.lit("; "), left.cast("string"), F.lit(" omitted"))).otherwise(""), F.lit("; last: "), F.element_at("names", -1), F.when(left > 0, "; --raw for all").otherwise(""))).otherwise("")
    head = g.where("n >= 3").select(key, "parent", F.lit(0).cast("long").alias("ord"), F.concat(label, F.lit(" ("), F.col("n").cast("string"), F.lit(f" {noun}: "), F.array_join(F.slice("names", 1, 3), ", "), tail, F.lit(")")).alias("line"))
    few = t.join(g.where("n < 3").select(key, "parent"), [key, "parent"]).withColumn("ord", F.row_number().over(Window.partitionBy(key, "parent").orderBy("path")).cast("long"))
    return head.unionByName(few.select(key, "parent", "ord", F.col("path").alias("line")))


def rg(table: DataFrame, key: str = "capture_id") -> DataFrame:
    """key, line_no, line: `path:line:text` rows say the path once for each run of it."""
    t = table.withColumn("path", F.regexp_extract("line", r"^([^{ \t].*?):\d+:", 1))
    same = (F.col("path") != "") & (L.before("path", key) == F.col("path"))
    return t.withColumn("same", F.coalesce(same, F.lit(False))).select(key, "line_no", F.when(F.col("same"), F.substring("line", F.length("path") + 1, F.length("line"))).otherwise(F.col("line")).alias("line"))


def rg_files(table: DataFrame, key: str = "capture_id") -> DataFrame:
    """key, line_no, line: a path in the folder of the one before keeps only what follows the folder, after a colon."""
    was = L.before(T.parent_slash(F.col("line")), key)
    t = table.withColumn("was", F.coalesce(was, F.lit("")))
    inside = (F.col("was") != "") & F.startswith("line", F.col("was")) & (F.length("line") > F.length("was")) & (F.substring("line", F.length("was") + 1, F.lit(1)) != ":")
    line = F.when(F.startswith("line", F.lit(":")), F.concat(F.lit(":"), "line")).when(inside, F.concat(F.lit(":"), F.substring("line", F.length("was") + 1, F.length("line")))).otherwise(F.col("line"))
    return t.select(key, "line_no", line.alias("line"))


def file_slice(bodies: DataFrame, key: str = "capture_id", body: str = "body") -> DataFrame:
    """key, line_no, line: the first four and last three lines of a text of more than eight; texts with control characters stay whole. The line feed at the
    end ends the last line. One projection per text."""
    rows = F.split(F.regexp_replace(body, r"\n\z", ""), "\n")
    notice = F.concat(F.lit("... "), (F.size(rows) - 7).cast("string"), F.lit(" lines omitted ..."))
    long = (F.size(rows) > 8) & ~F.regexp_like(body, F.lit(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"))
    shown = F.when(long, F.concat(F.slice(rows, 1, 4), F.array(notice), F.slice(rows, -3, 3))).otherwise(rows)
    return bodies.where(F.col(body) != "").select(key, F.posexplode(shown).alias("line_no", "line"))


def env(table: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    return table.withColumn(value, T.mask_secret(F.col(name), F.col(value)))


def word_counts(table: DataFrame, key: str = "capture_id") -> DataFrame:
    """Counts in single-blank columns."""
    t = table.withColumn("line", F.regexp_replace(T.trim_ascii(F.col("line")), r"[ \t]+", " ")).where("line <> ''")
    return t.select(key, "line_no", "line")
