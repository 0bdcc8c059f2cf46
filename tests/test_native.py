"""Operators on line tables, held against texts of their shape, of other shapes, and of odd sizes."""

import random

from sparkfold.functions import lines as L
from sparkfold.operators import git, headed, keep, trees


def said(spark, operator, *texts, **more):
    """What an operator makes of each text; None where it gives nothing."""
    bodies = spark.createDataFrame([(k, t.removesuffix("\n")) for k, t in enumerate(texts)], "capture_id long, body string")
    out = {k: [] for k in range(len(texts))}
    for r in operator(L.lines(bodies), **more).collect():
        out[r.capture_id].append((r.line_no, r.line))
    return ["".join(f"{line}\n" for _, line in sorted(out[k])) or None for k in out]


def test_long_status(spark):
    diverged = "On branch main\nYour branch and 'origin/main' have diverged,\nand have 2 and 3 different commits each, respectively.\n\nUnmerged paths:\n\tboth modified:   a/x\n\tdeleted by them: a/y\n\tadded by us:    a/z\n"
    one_line = "On branch m\nYour branch and 'o/m' have diverged, and have 2 and 3 different commits\n"
    detached = "HEAD detached at 1234567\nnothing to commit, working tree clean\n"
    rebase = "interactive rebase in progress; onto 1\nUntracked files:\n\tq\n"
    many = "On branch m\nUntracked files:\n" + "".join(f"\td/f{k}.c\n" for k in range(70))
    gaps = "On branch m\nYour branch is up to date with 'o/m'.\n\nUntracked files:\n" + "".join(f"\td/f{k}\n" for k in (1, 2, 3, 5, 6, 7)) + "\te/a\n\te/b\n"
    staged = "On branch m\nYour branch is behind 'o/m' by 4 commits\n\nChanges to be committed:\n  (use x)\n\tnew file:   n/a\n\trenamed:    a -> b\n\tstrange:    z\nChanges not staged for commit:\n\tdeleted:    n/b\n"
    got = said(spark, git.status, diverged, one_line, detached, rebase, many, gaps, staged, "odd words\nand more\n", "")
    assert got == [
        "# main\nUU a/x\nUD y\nAU z\n", "# m +2 -3\n", "# HEAD:1234567\n", "# rebase-in-progress\n! interactive rebase in progress; onto 1\n? q\n", "# m\n? d/f0.c..f63.c\n? d/f64.c..f69.c\n",
        "# m =o/m\n? d/f1\n? f2\n? f3\n? f5\n? f6\n? f7\n? e/a\n? e/b\n", "# m -4\nA n/a\nR a -> b\nS strange:    z\nd n/b\n", None, None,
    ]


def test_history(spark):
    sha = "a" * 40
    footers = f"commit {sha}\n\n    s\n\n" + "".join(f"    Refs: {'x' * 300}{k}\n" for k in range(4))
    wide = f"commit {sha}\nAuthor: x\n\n    {'é' * 300}\n"
    got = said(spark, git.log, f"commit {sha}\n\n    Subject here\n\n    body\n    Fixes: 1\n    Closes: 2\ncommit {'b' * 40}\n", footers, wide, "abc1234 oneline\n")
    assert got[0] == "aaaaaaa Subject here [Fixes: 1; Closes: 2]\nbbbbbbb \n" and got[3] is None
    assert got[1].startswith("aaaaaaa s [Refs: ") and len(got[1].encode()) <= len("aaaaaaa s []\n") + 768
    assert got[2] == f"aaaaaaa {'é' * 256}\n"


def test_transfers(spark):
    ref = "   1111111222..3333333444  main -> main\n"
    got = said(spark, git.pushed, "To h:x\nweird line\n", "Everything up-to-date\n", "x\nEverything up-to-date\n", f"To h:x\n{ref} ! [rejected]        a -> a (fetch first)\n", "")
    assert got == [None, "= up-to-date\n", None, "> 1111111..3333333 main\n! rejected a -> a (fetch first)\n", None]
    got = said(spark, git.fetched, f"From h:x\n{ref} * [new tag]  v1 -> v1\n * branch  main -> FETCH_HEAD\n", "fatal: no\n")
    assert got == ["< 1111111..3333333 main\n+ new v1 -> v1\n", None]
    assert said(spark, git.checkout, "Switched to a new branch 'x'\n", "M\ta b\nD\tc\r\n", "HEAD is now at 123456789 did it\n", "chatter\n") == ["^ x\n", "M a b\nd c\n", "^ detached 1234567 did it\n", None]


def test_headed_tables(spark):
    assert said(spark, headed.docker_ps, "CONTAINER ID   STATUS   NAMES\n", "CONTAINER ID   STATUS   NAMES\nabc            Up 2 s   web-1\nabd            Exited   db\n") == ["d0none\n", "d2m web-1 db\n"]
    assert said(spark, headed.docker_images, "REPOSITORY TAG IMAGE ID SIZE\n") == ["images 0\n"]
    many = "REPOSITORY  TAG   IMAGE ID  SIZE\n" + "".join(f"r{k}          1.0   abc       {k}MB\n" for k in range(9)) + "<none>      1.0   abc       7MB\n"
    assert said(spark, headed.docker_images, many) == ["images 10: " + " ".join(f"r{k}:1.0({k}MB)" for k in range(8)) + " dangling x1 (+1)\n"]
    assert said(spark, headed.kubectl_pods, "NAME     READY   STATUS\na        1/1     Running\nb       10/12   Pending\n") == ["k2m a(1/1) b(10/12,Pending)\n"]
    padded = "NAME    STATE  AGE\na       open   1d\nlonger than it  shut  2d\nb              3d\nShowing 3  of  9\n"
    assert said(spark, headed.ragged, padded, "one column\n") == ["NAME\tSTATE\tAGE\na\topen\t1d\nlonger than it\tshut\t2d\nb\t\t3d\nShowing 3 of 9\n", None]
    assert said(spark, headed.run_list, "STATUS  TITLE\nx  y\n", "a  b\n") == [None, None]
    assert said(spark, headed.ruled, "id          n\n----------  --\nk1          2\n", "a\n", "a  b\nc  d\ne  f\n") == ["id\tn\nk1\t2\n", None, None]


def test_padded_rows_lose_no_field(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcé1") for _ in range(rng.randint(1, 14)))
    rows = ["NAME      STATE     AGE       ID"] + ["  ".join(word() + " " * rng.randint(0, 8) for _ in range(rng.randint(1, 6))) for _ in range(200)]
    got = said(spark, headed.ragged, "\n".join(rows) + "\n")[0].removesuffix("\n").split("\n")
    assert len(got) == len(rows) and all(a.split() == b.split() and b.count("\t") == 3 for a, b in zip(rows, got))


def _walked(rows):
    """The tree of (depth, name, is_dir) rows by recursion."""
    kids, path = {k: [] for k in range(len(rows))}, []
    for k, (d, _, _) in enumerate(rows):
        del path[d:]
        if path:
            kids[path[-1]].append(k)
        path.append(k)
    few = lambda names, noun: f"({len(names)} {noun}: {', '.join(names[:3])}" + (f"; {len(names) - 3} omitted; --raw for all" if len(names) > 3 else "") + ")"
    shown = lambda k: rows[k][1] + "/" * (rows[k][2] and rows[k][1] != ".")
    out = []

    def walk(k):
        out.append("  " * rows[k][0] + shown(k))
        files = [c for c in kids[k] if not rows[c][2]]
        for c in kids[k]:
            pad = "  " * rows[c][0]
            if not rows[c][2]:
                if len(files) < 4:
                    out.append(pad + rows[c][1])
                elif c == files[0]:
                    out.append(pad + few([rows[f][1] for f in files], "files"))
            elif len(kids[c]) >= 4 and (rows[c][0] >= 2 or not any(rows[g][2] for g in kids[c])):
                out.append(f"{pad}{rows[c][1]}/ " + few([shown(g) for g in kids[c]], "entries" if any(rows[g][2] for g in kids[c]) else "files"))
            else:
                walk(c)

    walk(0)
    return "".join(f"{x}\n" for x in out)


def test_trees_with_both_glyph_sets(spark):
    rng = random.Random(8)
    texts, want = [], []
    for case in range(6):
        depths = [0]
        for _ in range(rng.randint(3, 60)):
            depths.append(rng.randint(1, min(depths[-1] + 1, 6)))
        rows = [(d, f"n{k}" if k else ".", k + 1 < len(depths) and depths[k + 1] > d or k == 0) for k, d in enumerate(depths)]
        box = lambda d: "│   " * (d - 1) + "├── " if d else ""
        plain = lambda d: "|   " * (d - 1) + "|-- " if d else ""
        texts.append("".join((plain if case % 2 else box)(d) + name + "\n" for d, name, _ in rows) + "\n3 directories, 9 files\n")
        want.append(_walked(rows) + "3 directories, 9 files\n")
    assert said(spark, trees.tree, *texts, ".\n│   │   │   jumps\n", "") == [*want, None, None]
    assert said(spark, trees.drawn, ".\n├── a\n│   └── b\n├── c\n├── d\n")[0] == ".\n  a\n    b\n  c\n~d\n"


def test_a_long_tree(spark):
    text = ".\n" + "".join(f"├── d{k}\n" + "".join(f"│   ├── f{j}\n" for j in range(9)) for k in range(10_000))
    got = said(spark, trees.tree, text)[0].split("\n")
    assert len(got) == 10_002 and got[5] == "  d4/ (9 files: f0, f1, f2; 6 omitted; --raw for all)"


def test_line_tables_are_read_once(spark):
    """pre_commit read its lines twice, remotes four times, and each reading sorted them anew in the same task."""
    rows = [(1, 0, "a.....Passed"), (1, 1, "b.....Failed"), (1, 2, "- hook id: b"), (2, 0, "c.....Passed"), (2, 1, "words"), (3, 0, "d.....Failed"), (4, 0, "o  u\t(fetch)"), (5, 0, "o u (fetch)"), (5, 1, "odd"), (5, 2, ""), (6, 0, "")]
    table = spark.createDataFrame(rows, "capture_id long, line_no long, line string")
    hooks, remotes = keep.pre_commit(table.where("capture_id < 4")), git.remotes(table.where("capture_id > 3"))
    for found in (hooks, remotes):
        assert found._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") == 1
    said = lambda df: [(r.capture_id, r.line) for r in df.orderBy("capture_id", "line_no").collect()]
    assert said(hooks) == [(1, "b Failed"), (1, "- hook id: b"), (1, "passed: 1 hook"), (2, "passed: 1 hook"), (3, "d Failed")]
    assert said(remotes) == [(4, "o u (fetch)"), (5, "o u (fetch)"), (5, "odd"), (5, "")]


def test_rows_in_order_need_no_places(spark):
    rows = [(1, 0, "NAME  STATE  AGE"), (1, 1, "a     open   3d"), (1, 2, "b            4d"), (1, 3, "Showing 2  of 2"), (2, 0, "one column"), (2, 1, "x")]
    t = headed._ragged(spark.createDataFrame(rows, "capture_id long, line_no long, line string"), "capture_id").orderBy("line_no").collect()
    assert [r.cells for r in t] == [["NAME", "STATE", "AGE"], ["a", "open", "3d"], ["b", "", "4d"], None]
    assert [r.heads is not None for r in t] == [False, False, True, False]


def test_a_tree_is_brought_together_once(spark):
    """Each step was written and shuffled anew, several times in joins."""
    table = spark.createDataFrame([(1, 0, "."), (1, 1, "├── a"), (1, 2, ""), (1, 3, "1 directory, 1 file")], "capture_id long, line_no long, line string")
    found = trees.tree(table)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert [r.line for r in found.orderBy("line_no").collect()] == [".", "  a", "1 directory, 1 file"]
