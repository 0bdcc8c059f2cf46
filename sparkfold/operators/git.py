"""Version-control output: what repeats from line to line is said once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkfold.functions import lines as L
from sparkfold.functions import text as T


def status_short(table: DataFrame, key: str = "capture_id") -> DataFrame:
    """key, line_no, line: in a run of equal states and folders, the folder is said once. Renames and copies stand alone."""
    t = table.where("line <> ''").withColumn("ok", F.regexp_like("line", F.lit(r"^[ MADRCU?!T][ MADRCU?!T] .")))
    t = t.withColumn("xy", F.substring("line", 1, 2)).withColumn("path", F.substring("line", 4, 1 << 30)).withColumn("rename", F.regexp_like("xy", F.lit("^[RC]")))
    t = t.withColumn("dir", F.when(F.col("ok") & ~F.col("rename"), T.parent_slash(F.col("path"))).otherwise(""))
    same = F.col("ok") & (F.col("dir") != "") & (L.before("dir", key) == F.col("dir")) & (L.before("xy", key) == F.col("xy"))
    t = t.withColumn("same", F.coalesce(same, F.lit(False)))
    short = F.concat("xy", F.lit(" "), F.substring("path", F.length("dir") + 1, F.length("path")))
    return t.select(key, "line_no", F.when(F.col("same"), short).otherwise(F.col("line")).alias("line"))


def reflog(table: DataFrame, key: str = "capture_id") -> DataFrame:
    """key, line_no, line: `sha ref@n what`; a sha like the one before is `~`, HEAD goes unsaid."""
    rule = r"^([0-9A-Fa-f]{7}) ([^ ]+?)@\{(\d+)\}: (.*)$"
    t = table.where("line <> ''").withColumn("sha", F.regexp_extract("line", rule, 1)).withColumn("ref", F.regexp_extract("line", rule, 2))
    t = t.withColumn("same", F.coalesce((F.col("sha") != "") & (L.before("sha", key) == F.col("sha")), F.lit(False)))
    out = F.concat(F.when(F.col("same"), "~").otherwise(F.col("sha")), F.lit(" "), F.when(F.col("ref") == "HEAD", "").otherwise(F.col("ref")), F.lit("@"), F.regexp_extract("line", rule, 3), F.lit(" "), F.regexp_extract("line", rule, 4))
    return t.select(key, "line_no", F.when(F.col("sha") == "", F.col("line")).otherwise(out).alias("line"))


def branches(table: DataFrame, key: str = "capture_id") -> DataFrame:
    """key, line_no, line: local branches, marked ` =o` where the remote has one of the same name; remote ones only where no local one has."""
    t = table.where("line <> ''").select(key, "line_no", F.substring("line", 1, 2).alias("mark"), F.substring("line", 3, 1 << 30).alias("name"))
    prefix = "remotes/origin/"
    local = t.where(~F.startswith("name", F.lit(prefix)))
    remote = t.where(F.startswith("name", F.lit(prefix))).withColumn("name", F.substring("name", len(prefix) + 1, 1 << 30))
    names = remote.select(key, "name", F.lit(True).alias("there")).distinct()
    marked = local.join(names, [key, "name"], "left").select(key, "line_no", F.concat("mark", "name", F.when(F.col("there"), " =o").otherwise("")).alias("line"))
    alone = remote.join(local.select(key, "name"), [key, "name"], "left_anti").select(key, "line_no", F.concat("mark", F.lit(prefix), "name").alias("line"))
    return marked.unionByName(alone)


def trimmed(table: DataFrame, key: str = "capture_id") -> DataFrame:
    """Lines without white space at either end, empty ones gone (settings, tags, remotes)."""
    return table.select(key, "line_no", T.trim_ascii(F.col("line")).alias("line")).where("line <> ''")


def remotes(table: DataFrame, key: str = "capture_id") -> DataFrame:
    """Single-blank fields of verbose remotes; a capture with a line of fewer than three fields stays as it is."""
    t = table.withColumn("fields", F.filter(F.split("line", r"[ \t\n\f\r]+"), lambda x: x != ""))
    t = t.withColumn("bad", F.max(F.size("fields").between(1, 2)).over(Window.partitionBy(key)))  # no order, so that rows stay as they were sorted
    return t.where(F.col("bad") | (F.size("fields") > 0)).select(key, "line_no", F.when(F.col("bad"), F.col("line")).otherwise(F.array_join("fields", " ")).alias("line"))


def shortlog(table: DataFrame, key: str = "capture_id") -> DataFrame:
    return trimmed(table, key).withColumn("line", F.regexp_replace("line", r"^(\d+)[ \t\f\r]+(?=\S)", "$1 "))


def diff(table: DataFrame, key: str = "capture_id") -> DataFrame:
    """key, line_no, line: `d path` (or `d old -> new`) for each file, `@old|new context` for each hunk, `B` for binary files; index, path and rename headers go,
    content lines stay as they are."""
    t = table.withColumn("line", F.rtrim(T.strip_ansi(F.col("line")), F.lit(" \t\n\f\r")))
    old, new = F.regexp_extract("line", r"^diff --git a/(.*) b/(.*)$", 1), F.regexp_extract("line", r"^diff --git a/(.*) b/(.*)$", 2)
    file = F.concat(F.lit("d "), old, F.when(old != new, F.concat(F.lit(" -> "), new)).otherwise(""))
    header = F.regexp_like("line", F.lit(r"^(?:(?:dis)?similarity index |index |--- (?:a/|/dev/null)|\+\+\+ (?:b/|/dev/null)|(?:rename|copy) (?:from|to) )"))
    out = F.when(F.startswith("line", F.lit("diff --git a/")), file).when(F.regexp_like("line", F.lit(r"^@@ -\S+ \+\S+ @@")), F.regexp_replace("line", r"^@@ -(\S+) \+(\S+) @@", "@$1|$2"))
    out = out.when(F.regexp_like("line", F.lit("^Binary files .* differ$")), "B").when(~header, F.col("line"))
    # Exploded, as a condition on the line itself would be asked where lines are made: each pattern twice, in a method too long for the JVM to compile.
    return t.select(key, "line_no", F.explode(F.array(out)).alias("line")).where("line is not null")


#: Sections of a long status, labels of changed paths in them, and the letters they become (fixed values). The empty label is any other.
SECTIONS = {
    "Changes to be committed:": {"modified:   ": "S", "new file:   ": "A", "deleted:    ": "D", "renamed:    ": "R", "": "S"},
    "Changes not staged for commit:": {"new file:   ": "I", "modified:   ": "M", "deleted:    ": "d", "": "M"},
    "Unmerged paths:": {"both modified:   ": "UU", "added by us:    ": "AU", "added by them:  ": "UA", "deleted by us:  ": "DU", "deleted by them:": "UD", "": "UU"},
    "Untracked files:": {"": "?"},
}
_STATE = r"^\s*(?:interactive rebase in progress|All conflicts fixed but you are still merging|You have unmerged paths|You are currently )"
_HINT = r"^  \(.*\)$|^\s*$|^(?:no changes added to commit|nothing to commit|nothing added to commit|All conflicts fixed)"
_ABOUT = r"^(?:On branch |HEAD detached at |Your branch (?:is|and))"
#: Paths of one folder that are said together at most; from how many on a folder is said once, and consecutive numbers are a range.
RUN, FEW, RANGE = 64, 3, 6


def _bytes_of(x: Column, most: Column) -> Column:
    """The beginning of a text that takes at most so many bytes."""
    cut = F.regexp_replace(F.make_valid_utf8(F.substring(F.encode(x, "UTF-8"), F.lit(1), most).cast("string")), "\ufffd+$", "")
    return F.when(F.octet_length(x) <= most, x).otherwise(cut)


def _entry(section: Column, content: Column) -> tuple[Column, Column]:
    """Letter and path of a changed path in its section; the first label that holds decides."""
    code = path = F.when(F.lit(False), F.lit(""))
    for name, labels in SECTIONS.items():
        for label, letter in labels.items():
            here = (section == name) & F.startswith(content, F.lit(label))
            rest = F.substring(content, F.lit(len(label) + 1), F.length(content))
            code, path = code.when(here, letter), path.when(here, F.ltrim(rest, F.lit(" \t\n\f\r")) if label.endswith("them:") else rest)
    return code, path


def _status_head(t: DataFrame, key: str) -> DataFrame:
    """key, line_no (-1), line: branch and distance, from the lines before the first path or state."""
    early = F.col("line_no") < F.col("begun")
    last = lambda pattern, group, when=early: F.max(F.when(when & F.regexp_like("line", F.lit(pattern)), F.struct("line_no", F.regexp_extract("line", pattern, group).alias("v"))))["v"]
    name = F.when(F.startswith("line", F.lit("HEAD")), F.concat(F.lit("HEAD:"), F.regexp_extract("line", r"^HEAD detached at (.*)$", 1))).otherwise(F.regexp_extract("line", r"^On branch (.*)$", 1))
    g = t.groupBy(key).agg(
        F.max(F.when(early & F.regexp_like("line", F.lit(r"^(?:On branch |HEAD detached at )")), F.struct("line_no", _bytes_of(name, F.lit(256)).alias("v"))))["v"].alias("branch"),
        last(r"^Your branch is ahead.*?by (\d+)", 1).alias("ahead"), last(r"^Your branch is behind.*?by (\d+)", 1).alias("behind"), last(r"^Your branch is up to date with '([^']*)'", 1).alias("upstream"),
        last(r"^Your branch and.*and have (\d+).*? and (\d+)", 1).alias("both_ahead"), last(r"^Your branch and.*and have (\d+).*? and (\d+)", 2).alias("both_behind"),
        F.min(F.when(F.col("line_no") == F.col("begun"), F.col("line"))).alias("first"),
    )
    rebase, state = F.startswith("first", F.lit("interactive rebase in progress")), F.regexp_like("first", F.lit(_STATE))
    g = g.withColumn("branch", F.when(rebase, "rebase-in-progress").otherwise(F.coalesce("branch", F.when(state, "operation-in-progress").otherwise(""))))
    g = g.withColumn("ahead", F.coalesce("both_ahead", "ahead", F.lit(""))).withColumn("behind", F.coalesce("both_behind", "behind", F.lit("")))
    part = lambda c, mark: F.when(F.col(c) != "", F.concat(F.lit(mark), c)).otherwise("")
    even = (F.col("ahead") == "") & (F.col("behind") == "") & (F.coalesce("upstream", F.lit("")) != "")
    head = F.concat(F.lit("# "), "branch", part("ahead", " +"), part("behind", " -"), F.when(even, F.concat(F.lit(" ="), "upstream")).otherwise(""))
    return g.where((F.col("branch") != "") | F.col("first").isNotNull()).select(key, F.lit(-1).cast("long").alias("line_no"), head.alias("line"))


def status(table: DataFrame, key: str = "capture_id") -> DataFrame:
    """key, line_no, line: branch with its distance, states, and changed paths by letter. Neighbouring paths of one letter and folder are runs, which are
    islands of at most 64 by place; a run says its folder once, one of consecutive numbers (value less place is the same) is a range. A capture that is no status gives nothing."""
    t = table.withColumn("path_line", F.startswith("line", F.lit("\t"))).withColumn("state", F.regexp_like("line", F.lit(_STATE)))
    t = t.withColumn("section", L.carried(F.when(F.col("line").isin(*SECTIONS), F.col("line")), key))
    t = t.withColumn("begun", F.coalesce(F.min(F.when(F.col("path_line") | F.col("state"), F.col("line_no"))).over(Window.partitionBy(key)), F.lit((1 << 62))))
    head = _status_head(t, key)
    code, path = _entry(F.col("section"), F.substring("line", F.lit(2), F.length("line")))
    late = F.col("line_no") >= F.col("begun")
    quiet = F.col("line").isin(*SECTIONS) | (~F.col("state") & ~F.col("path_line") & (F.regexp_like("line", F.lit(_HINT)) | ~late | (F.col("line_no") < F.col("begun")) & F.regexp_like("line", F.lit(_ABOUT))))
    e = t.where(late & ~quiet).withColumn("code", F.when(F.col("path_line") & ~F.col("state"), code)).withColumn("path", path)
    e = e.withColumn("dir", F.when(F.col("code").isNotNull(), T.parent_slash(F.col("path"))).otherwise(""))
    e = e.withColumn("run", F.when(F.col("dir") != "", F.concat(F.when(F.col("section") == "Unmerged paths:", "U").otherwise(F.col("code")), F.lit(" "), "dir")))
    e = L.islands(e, F.coalesce(L.before("run", key) != F.col("run"), F.lit(True)), key)
    e = e.withColumn("no", F.row_number().over(Window.partitionBy(key, "island").orderBy("line_no")) - 1).withColumn("chunk", F.floor(F.col("no") / RUN)).withColumn("pos", F.col("no") % RUN)
    tail = F.substring("path", F.length("dir") + 1, F.length("path"))
    e = e.withColumn("name", tail).withColumn("number", F.regexp_extract("name", r"^(.*?)(\d+)(\D*)$", 2).try_cast("decimal(38,0)")).withColumn("around", F.regexp_replace("name", r"^(.*?)(\d+)(\D*)$", "$1/$3"))
    w = Window.partitionBy(key, "island", "chunk")
    same = lambda c: F.min(c).over(w) == F.max(c).over(w)
    e = e.withColumn("n", F.count("*").over(w)).withColumn("end", F.max(F.struct("pos", "name")).over(w)["name"])
    ranged = (F.col("n") >= RANGE) & (F.col("dir") != "") & same("code") & same("around") & (F.count("number").over(w) == F.col("n")) & same(F.col("number") - F.col("pos"))
    e = e.withColumn("ranged", F.coalesce(ranged, F.lit(False)))
    short = (F.col("pos") > 0) & (F.col("n") >= FEW) & (F.col("dir") != "") & (F.col("name") != "")
    said = F.concat("code", F.lit(" "), F.when(short, F.col("name")).otherwise(F.col("path")), F.when(F.col("ranged"), F.concat(F.lit(".."), "end")).otherwise(""))
    line = F.when(F.col("state"), F.concat(F.lit("! "), T.trim_ascii(F.col("line")))).when(F.col("code").isNotNull(), said).when(F.col("path_line"), F.substring("line", F.lit(2), F.length("line"))).otherwise(F.col("line"))
    rows = e.where(~F.col("ranged") | (F.col("pos") == 0)).select(key, F.col("line_no").cast("long").alias("line_no"), line.alias("line"))
    return head.unionByName(rows.join(head.select(key), key, "left_semi"))


#: Lines of a message body that stay in a log (fixed values).
FOOTERS = ("Refs:", "Ref:", "Fixes:", "Closes:", "Resolves:", "Related:", "Issue:", "BREAKING CHANGE", "Co-authored-by:", "Signed-off-by:")
#: Bytes of a subject and of all footers.
SUBJECT, FOOT = 512, 768


def log(table: DataFrame, key: str = "capture_id") -> DataFrame:
    """key, line_no, line: `sha7 subject [footers]` of each commit; the subject is its first body line, footers refer to something. What comes before the first commit
    is left out."""
    t = table.withColumn("sha", F.regexp_extract("line", r"^commit ([0-9a-fA-F]{7})[0-9a-fA-F]{33}(?:[ \t]|$)", 1)).withColumn("commit", F.sum((F.col("sha") != "").cast("int")).over(L.ordered(key).rowsBetween(Window.unboundedPreceding, 0)))
    said = T.trim_ascii(F.substring("line", F.lit(5), F.length("line")))
    body = F.startswith("line", F.lit("    ")) & (said != "")
    t = t.where("commit > 0").withColumn("said", F.when(body, said)).withColumn("nth", F.count("said").over(Window.partitionBy(key, "commit").orderBy("line_no")))
    foot = F.when((F.col("nth") > 1) & F.regexp_like("said", F.lit("^(?:" + "|".join(FOOTERS) + ")")), F.struct("line_no", F.col("said").alias("s")))
    first = F.when(F.col("nth") == 1, F.col("said"))
    g = t.groupBy(key, "commit").agg(F.max("sha").alias("sha"), F.min("line_no").alias("line_no"), F.max(first).alias("subject"), F.array_sort(F.collect_list(foot)).alias("feet"))

    def joined(acc: Column, f: Column) -> Column:
        lead = F.when((acc != "") & (F.octet_length(acc) + 2 < FOOT), F.concat(acc, F.lit("; "))).otherwise(acc)
        return F.concat(lead, _bytes_of(f["s"], F.greatest(F.lit(0), F.lit(FOOT) - F.octet_length(lead))))

    g = g.withColumn("foot", F.aggregate("feet", F.lit(""), joined))
    return g.select(key, "line_no", F.concat("sha", F.lit(" "), _bytes_of(F.coalesce("subject", F.lit("")), F.lit(SUBJECT)), F.when(F.col("foot") != "", F.concat(F.lit(" ["), "foot", F.lit("]"))).otherwise("")).alias("line"))


_PROGRESS = (
    r"^(?:remote: (?:(?:Enumerating|Counting|Compressing) objects:|Finding sources:|Getting sizes:|Resolving deltas:|Total )|(?:Counting|Compressing|Receiving|Writing) objects:|Resolving deltas:|Total |Delta compression using )"
)


def _moved(table: DataFrame, sigil: str, skip: str, key: str) -> DataFrame:
    """key, line_no, line: references that moved, are new, deleted or rejected. A capture with a line of another shape gives nothing."""
    core = T.trim_ascii(F.col("line"))
    t = table.withColumn("core", core).where(F.col("core") != "")
    gone = F.startswith("line", F.lit(skip)) | F.regexp_like("core", F.lit(_PROGRESS)) | (F.contains("core", F.lit("-> FETCH_HEAD")) if sigil == "<" else F.lit(False))
    word, rest = F.regexp_extract("line", r"\[(new branch|new tag|deleted|rejected)\]", 1), T.trim_ascii(F.regexp_extract("line", r"\[(?:new branch|new tag|deleted|rejected)\](.*)$", 1))
    mark = F.when(F.startswith(word, F.lit("new")), "+ new ").when(word == "deleted", "- deleted ").otherwise("! rejected ")
    span = r"^([0-9a-fA-F]{4,7})[0-9a-fA-F]{0,75}\.\.([^ ]{0,7})[^ ]* *(.*)$"
    to = F.regexp_replace(F.regexp_extract("core", span, 3), r"^(.*) -> \1$", "$1")
    moved = F.rtrim(F.concat(F.lit(sigil + " "), F.regexp_extract("core", span, 1), F.lit(".."), F.regexp_extract("core", span, 2), F.lit(" "), to))
    t = t.withColumn("gone", gone).withColumn("said", F.when(word != "", F.when(rest != "", F.concat(mark, rest)).otherwise("")).when(F.regexp_like("core", F.lit(span)), moved))
    if sigil == ">":
        t = t.withColumn("said", F.when(F.col("core") == "Everything up-to-date", "= up-to-date").otherwise(F.col("said")))
    w = Window.partitionBy(key)
    t = t.withColumn("ok", F.min(F.col("gone") | F.col("said").isNotNull()).over(w)).where("ok and not gone and said <> ''")
    return t.select(key, "line_no", F.col("said").alias("line"))


def fetched(table: DataFrame, key: str = "capture_id") -> DataFrame:
    return _moved(table, "<", "From ", key)


def pushed(table: DataFrame, key: str = "capture_id") -> DataFrame:
    return _moved(table, ">", "To ", key)


def checkout(table: DataFrame, key: str = "capture_id") -> DataFrame:
    """key, line_no, line: where one is now, and the paths that differ."""
    core = T.trim_ascii(F.col("line"))
    at = r"^HEAD is now at ([^ ]{0,7})[^ ]* *(.*)$"
    out = F.when(F.regexp_like(core, F.lit(r"^Switched to[^']*'[^']*'")), F.concat(F.lit("^ "), F.regexp_extract(core, r"^Switched to[^']*'([^']*)'", 1)))
    out = out.when(F.regexp_like(core, F.lit(at)), F.rtrim(F.concat(F.lit("^ detached "), F.regexp_extract(core, at, 1), F.lit(" "), F.regexp_extract(core, at, 2))))
    out = out.when(F.regexp_like(core, F.lit(r"^Your branch is up to date with '")), F.concat(F.lit("= "), F.regexp_extract(core, r"with '([^']*)'", 1)))
    letter = F.substring("line", 1, 1)
    out = out.when(F.regexp_like("line", F.lit(r"^.\t")), F.concat(F.when(letter == "D", "d").otherwise(letter), F.lit(" "), F.regexp_replace(F.substring("line", F.lit(3), F.length("line")), r"\r$", "")))
    return table.select(key, "line_no", out.alias("line")).where("line is not null")
