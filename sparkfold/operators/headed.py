"""Printed tables under a header: containers, images, pods, padded and ruled tables. Columns are where the capture's own header says.

All take and give line tables. The header of a capture is carried to its rows by a window over the capture; what is said of all rows is one group. A capture
with a row of another shape gives nothing, so that its raw body is shown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfold.functions import lines as L
from sparkfold.functions import text as T

_BLANK = " \t\n\f\r"


def _with_head(table: DataFrame, key: str) -> DataFrame:
    """Rows that are not empty, with `head`, the first line of their capture, and `is_head`."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = table.withColumn("head", F.first("line").over(w)).withColumn("is_head", F.col("line_no") == F.min("line_no").over(w))
    return t.where("is_head or line <> ''")


def _at(word: str) -> Column:
    """Where a word stands in the header, from 0; 0 where it does not."""
    return F.greatest(F.instr("head", word) - 1, F.lit(0))


def _from(line: str, at: Column) -> Column:
    return F.substring(line, at + F.lit(1), F.length(line))


def _cells(line: str, lo: Column, hi: Column) -> Column:
    return F.btrim(F.substring(line, lo + F.lit(1), hi - lo), F.lit(_BLANK))


def _one_line(grouped: DataFrame, key: str, line: Column) -> DataFrame:
    return grouped.select(key, F.lit(0).cast("long").alias("line_no"), line.alias("line"))


def _words(line: str) -> Column:
    return F.filter(F.split(line, r"\s+"), lambda x: x != "")


def _in_order(value: Column) -> Column:
    """Values of a capture's rows by line, nulls and empty ones left out."""
    return F.transform(F.array_sort(F.collect_list(F.when(value != "", F.struct("line_no", value.alias("v"))))), lambda x: x["v"])


def _said(names: str) -> Column:
    return F.array_join(F.transform(names, lambda n: F.concat(F.lit(" "), n)), "")


def docker_ps(table: DataFrame, key: str = "capture_id") -> DataFrame:
    """Number, joint state and names."""
    t = _with_head(table, key)
    names = F.when(F.contains("head", F.lit("NAMES")), _at("NAMES")).otherwise(_at("NAME"))
    compose, words = (names == 0) & F.startswith("head", F.lit("NAME")), _words("line")
    plain = F.when((names > 0) & (names < F.length("line")), F.btrim(_from("line", names), F.lit(_BLANK))).otherwise(F.element_at(F.split(F.rtrim("line", F.lit(_BLANK)), " {2}"), -1))
    said = F.when(compose, F.concat(F.coalesce(F.get(words, 0), F.lit("")), F.when(F.size(words) > 1, F.concat(F.lit("("), F.get(words, 1), F.lit(")"))).otherwise(""))).otherwise(plain)
    up = F.startswith(F.ltrim(_from("line", _at("STATUS")), F.lit(_BLANK)), F.lit("Up"))
    row = ~F.col("is_head")
    g = t.groupBy(key).agg(F.count_if(row).alias("n"), F.count_if(row & up).alias("up"), _in_order(F.when(row, said)).alias("names"))
    state = F.when(F.col("up") == 0, "none").when(F.col("up") == F.col("n"), "up").otherwise("m")
    return _one_line(g, key, F.concat(F.lit("d"), F.col("n").cast("string"), state, _said("names")))


def docker_images(table: DataFrame, key: str = "capture_id", most: int = 8) -> DataFrame:
    """Number, the first eight with tag and size, and how many have no name."""
    t = _with_head(table, key)
    tag, ident, size = _at("TAG"), _at("IMAGE ID"), _at("SIZE")
    cells = F.array(_cells("line", F.lit(0), tag), _cells("line", tag, ident), F.btrim(_from("line", size), F.lit(_BLANK)))
    whole = ~F.col("is_head") & (F.length("line") > F.greatest(tag, size)) & (F.length("line") >= ident)
    t = t.withColumn("c", F.when(whole, cells)).withColumn("ok", F.col("c").isNotNull() & ~F.array_contains("c", ""))
    named = F.col("ok") & ~F.array_contains(F.slice("c", 1, 2), "<none>")
    said = F.concat(F.get("c", 0), F.lit(":"), F.get("c", 1), F.lit("("), F.get("c", 2), F.lit(")"))
    g = t.withColumn("named", named).groupBy(key).agg(F.count_if("ok").alias("n"), F.count_if("named").alias("k"), _in_order(F.when(F.col("named"), said)).alias("names"))
    more = F.concat(F.when(F.col("n") > F.col("k"), F.concat(F.lit(" dangling x"), (F.col("n") - F.col("k")).cast("string"))).otherwise(""), F.when(F.col("k") > most, F.concat(F.lit(" (+"), (F.col("k") - most).cast("string"), F.lit(")"))).otherwise(""))
    g = g.withColumn("names", F.slice("names", 1, most))
    return _one_line(g, key, F.concat(F.lit("images "), F.col("n").cast("string"), F.when(F.col("n") > 0, ":").otherwise(""), _said("names"), more))


def _field(line: str, at: Column) -> Column:
    """The word at a column, or the one that began left of it."""
    left = F.when(F.regexp_like(F.substring(line, at + F.lit(1), F.lit(1)), F.lit("[^ \t]")), F.regexp_extract(F.substring(line, F.lit(1), at), r"([^ \t]*)$", 1)).otherwise("")
    return F.when(at < F.length(line), F.regexp_extract(F.concat(left, _from(line, at)), r"^\s*(\S*)", 1)).otherwise("")


def kubectl_pods(table: DataFrame, key: str = "capture_id") -> DataFrame:
    """Number, joint state, names, and what is not well."""
    t = _with_head(table, key).withColumn("ready", _field("line", _at("READY"))).withColumn("status", _field("line", _at("STATUS"))).withColumn("name", F.coalesce(F.get(_words("line"), 0), F.lit("")))
    well = (F.col("status") == "Running") & F.regexp_like("ready", F.lit(r"^([^/]+)/\1$")) & ~F.startswith("ready", F.lit("0/"))
    row = ~F.col("is_head")
    bad = F.concat("name", F.lit("("), "ready", F.when(well, "").otherwise(F.concat(F.lit(","), "status")), F.lit(")"))
    g = t.groupBy(key).agg(F.count_if(row).alias("n"), F.count_if(row & well).alias("up"), _in_order(F.when(row, F.col("name"))).alias("names"), _in_order(F.when(row & (F.col("name") != ""), bad)).alias("bad"))
    state = F.when(F.col("up") == 0, "n").when(F.col("up") == F.col("n"), "r").otherwise("m")
    all_up = (F.col("up") > 0) & (F.col("up") == F.col("n"))
    return _one_line(g, key, F.concat(F.lit("k"), F.col("n").cast("string"), state, F.when(all_up, _said("names")).otherwise(_said("bad"))))


def _tokens(line: str) -> Column:
    return F.regexp_extract_all(line, F.lit(r"(\s{2,}|\s?\S+(?:\s\S+)*)"), F.lit(1))


def _texts_of(line: str) -> Column:
    """The fields of a line without where they stand, which no fold is needed for."""
    return F.filter(F.transform(_tokens(line), lambda t: F.btrim(t, F.lit(_BLANK))), lambda t: t != "")


def _fields_of(line: str) -> Column:
    """(start, text) of each field: text with single blanks, fields two blanks or more apart."""
    tokens = _tokens(line)
    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<at:int,text:string>>").alias("out"))

    def step(s: Column, t: Column) -> Column:
        own = F.array(F.struct((s["pos"] + F.length(t) - F.length(F.ltrim(t))).cast("int").alias("at"), F.btrim(t, F.lit(_BLANK)).alias("text")))
        return F.struct((s["pos"] + F.length(t)).cast("int").alias("pos"), F.when(F.btrim(t, F.lit(_BLANK)) == "", s["out"]).otherwise(F.concat(s["out"], own)).alias("out"))

    return F.aggregate(tokens, start, step, lambda s: s["out"])


def _aligned(fields: Column, heads: Column) -> Column:
    """The fields of a row by column. As many fields as columns stand in order; otherwise each goes, from left to right, to the free column whose header
    begins nearest to it and leaves enough columns for the rest. Surplus fields share the nearest column."""
    n, k = F.size(heads), F.size(fields)
    start = F.struct(F.lit(-1).alias("last"), F.lit(0).alias("i"), F.array().cast("array<struct<col:int,text:string>>").alias("out"))

    def step(s: Column, f: Column) -> Column:
        low = F.when(k <= n, s["last"] + 1).otherwise(F.greatest(s["last"], F.lit(0)))
        high = F.when(k <= n, n - k + s["i"]).otherwise(n - 1)
        nearest = F.array_min(F.transform(F.sequence(low, F.greatest(low, high)), lambda c: F.struct(F.abs(F.get(heads, c) - f["at"]).alias("far"), c.alias("c"))))["c"]
        col = F.when(k == n, s["i"]).otherwise(nearest).cast("int")
        return F.struct(col.alias("last"), (s["i"] + 1).alias("i"), F.concat(s["out"], F.array(F.struct(col.alias("col"), f["text"].alias("text")))).alias("out"))

    placed = F.aggregate(fields, start, step, lambda s: s["out"])
    return F.transform(F.sequence(F.lit(0), n - 1), lambda c: F.array_join(F.transform(F.filter(placed, lambda x: x["col"] == c), lambda x: x["text"]), "  "))


def _ragged(table: DataFrame, key: str) -> DataFrame:
    """Rows that are not blank with `cells`, null in closing remarks; a header of one column gives no row."""
    t = _with_head(table.where(F.btrim("line", F.lit(_BLANK)) != ""), key)
    t = t.withColumn("columns", F.size(_texts_of("head"))).where("columns >= 2").withColumn("texts", _texts_of("line"))
    note = ~F.col("is_head") & F.regexp_like("line", F.lit("^(?:Showing |No )"))
    # Where a row has as many fields as there are columns they stand in order; places are only found for the others.
    odd = ~note & (F.size("texts") != F.col("columns"))
    t = t.withColumn("heads", F.when(odd, F.transform(_fields_of("head"), lambda f: f["at"]))).withColumn("fields", F.when(odd, _fields_of("line")))  # columns of their own, as the alignment speaks of them many times
    return t.withColumn("cells", F.when(note, F.lit(None)).when(odd, _aligned(F.col("fields"), F.col("heads"))).otherwise(F.col("texts")))


def ragged(table: DataFrame, key: str = "capture_id") -> DataFrame:
    """A padded table, whose rows may be wider than its header, as fields between tabs; remarks at the end with single blanks."""
    t = _ragged(table, key)
    return t.select(key, "line_no", F.coalesce(F.array_join("cells", "\t"), F.array_join(_words("line"), " ")).alias("line"))


_RUN_HEAD = "STATUS TITLE WORKFLOW BRANCH EVENT ID ELAPSED AGE"
_RUN_STATES = ("completed", "in_progress", "queued", "failure", "cancelled")


def run_list(table: DataFrame, key: str = "capture_id") -> DataFrame:
    """Runs with eight fields each, one blank apart."""
    t = _ragged(table, key)
    known = F.array_join(_words("head"), " ") == _RUN_HEAD
    good = F.col("cells").isNotNull() & (F.size("cells") == 8) & ~F.array_contains("cells", "") & F.get("cells", 0).isin(*_RUN_STATES) & F.regexp_like(F.get("cells", 5), F.lit(r"^\d+$"))
    w = Window.partitionBy(key)
    t = t.withColumn("ok", F.min(F.when(F.col("is_head"), known).otherwise(F.coalesce(good, F.lit(False)))).over(w)).withColumn("n", F.count("*").over(w)).where("ok and n > 1")
    return t.select(key, "line_no", F.array_join(_words("line"), " ").alias("line"))


def pr_list(table: DataFrame, key: str = "capture_id") -> DataFrame:
    """Lines about requests."""
    t = table.where(F.contains("line", F.lit("pull request")) | F.startswith(F.ltrim("line", F.lit(_BLANK)), F.lit("#")))
    return t.select(key, "line_no", F.rtrim("line", F.lit(_BLANK)).alias("line"))


def single_blanks(table: DataFrame, key: str = "capture_id") -> DataFrame:
    """Fields one blank apart."""
    return table.where("line <> ''").select(key, "line_no", F.array_join(F.filter(F.split("line", "[ \t]"), lambda w: w != ""), " ").alias("line"))


def bars(table: DataFrame, key: str = "capture_id") -> DataFrame:
    """Rows between bars as fields; rules go, other lines stay."""
    t = table.withColumn("line", F.regexp_replace(T.strip_ansi(F.col("line")), r"\r$", ""))
    piped = F.regexp_like("line", F.lit(r"^\|.*\|"))
    rule = F.regexp_like("line", F.lit(r"^\+[+=-]*$")) | (piped & F.regexp_like("line", F.lit(r"^[|-]*$")))
    cells = F.transform(F.split(F.regexp_replace("line", r"^\||\|$", ""), r"\|"), lambda c: F.btrim(c, F.lit(_BLANK)))
    out = F.when(piped, F.regexp_replace(F.array_join(cells, "\t"), r"\t+$", "")).otherwise(F.col("line"))
    return t.where(~rule & (F.col("line") != "")).select(key, "line_no", out.alias("line")).where("line <> ''")


def ruled(table: DataFrame, key: str = "capture_id") -> DataFrame:
    """A table whose second line is dashes, which say where columns begin."""
    t = _with_head(table.where(F.btrim("line", F.lit(_BLANK)) != ""), key).withColumn("no", F.row_number().over(L.ordered(key)))
    w = Window.partitionBy(key)
    t = t.withColumn("rule", F.max(F.when(F.col("no") == 2, F.col("line"))).over(w)).withColumn("n", F.count("*").over(w))
    t = t.where(F.regexp_like("rule", F.lit(r"^[ \t]*-[- \t]*$")) & (F.col("n") > 2) & (F.col("no") != 2))
    runs = F.regexp_extract_all("rule", F.lit("([^-]+|-+)"), F.lit(1))
    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("out"))
    cols = F.aggregate(runs, start, lambda s, r: F.struct((s["pos"] + F.length(r)).cast("int").alias("pos"), F.when(F.startswith(r, F.lit("-")), F.concat(s["out"], F.array(s["pos"]))).otherwise(s["out"]).alias("out")), lambda s: s["out"])
    t = t.withColumn("heads", F.transform(_fields_of("head"), lambda f: f["at"])).withColumn("cols", cols).where((F.size("heads") > 1) & (F.size("cols") > 1))
    t = t.withColumn("at", F.when(F.col("is_head"), F.col("heads")).otherwise(F.col("cols")))
    cells = F.transform("at", lambda a, i: F.btrim(F.substring(F.col("line"), a + 1, F.coalesce(F.get("at", i + 1), F.greatest(F.length("line"), a)) - a), F.lit(_BLANK)))
    return t.select(key, "line_no", F.array_join(cells, "\t").alias("line"))
