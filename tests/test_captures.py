"""Forms of captures on texts of their shape, of other shapes, and on empty ones; the operator that runs them."""

import random

import pytest

from sparkfold.captures import builds, diagnostics, git, listings, packages, runners, services, tabular
from sparkfold.captures.registry import FORMS
from sparkfold.operators import captured
from sparkfold.plans import scripts


def test_every_form_takes_any_text():
    rng = random.Random(4)
    parts = ["", "a", "\t", "  ", "|", "+", "-", "x: y", "# ", "commit " + "a" * 40, "    body", "error: e", "FAIL ", "@@ -1 +1 @@", "\x1b[1m", "1 passed", "[x y1234567] s", "é🙂", "\r", "├── d", "    └── e", "{", "}", "def f():", "> ", "< ", "JOBS", "--", "a.py:1:2: E1 x", "Collecting "]
    for _ in range(150):
        text = "\n".join("".join(rng.choice(parts) for _ in range(rng.randint(0, 3))) for _ in range(rng.randint(0, 12)))
        for name, form in FORMS.items():
            for pair in ((text, ""), ("", text), (text, text), ("", "")):
                got = form.streams(*pair, rng.randint(0, 1))
                assert got is None or all(isinstance(x, str) for x in got), name


def test_transfers_and_merges_of_other_shapes():
    assert git.pull("Already up to date.\n") == "@ up-to-date\n" and git.pull("odd\nAlready up to date.\n") is None
    assert git.merge("Auto-merging a\nCONFLICT (content): Merge conflict in a/b\nAutomatic merge failed; fix\n") == "! conflict a/b\n! failed\n"
    assert git.commit("nothing here\n") is None and git.stash("stash@{0}: WIP on main: abc1234 did\nstash@{1}: On dev: x\n") == "$0 main abc1234 did\n$1 dev x\n"
    assert git.diff("diff --git a/x b/y\nBinary files a/x and b/y differ\n@@ -1 +1 @@ f\n\\ No newline\n") == "d x -> y\nB\n@1|1 f\n\\ No newline\n"


def test_runners_say_when_all_passed():
    assert runners.cargo("running 1 test\ntest a ... ok\n") == runners.jest("PASS a\nTests: 3 passed\n") == runners.pytest("collected 3 items\n=== 3 passed in 1s ===\n") == runners.go("=== RUN T\n--- PASS: T\nok  \tp\t1s\n") == "all tests passed\n"
    assert runners.go("BenchmarkX\t10\t3 ns/op\n") == "BenchmarkX\t10\t3 ns/op\n" and runners.rspec("x\n") is None and runners.playwright("Running 2 tests using 1 worker\n") is None
    long = runners.jest("".join(f"FAIL a{k}\n\n" for k in range(300))).split("\n")
    assert len(long) == 202 and long[120] == "(omitted 100 relevant lines; rerun with --raw)"
    assert runners.jest("Tests: 10 failed\n") == "Tests: 10 failed\n" and runners.jest("Tests: 0 failed, 3 passed\n") == "all tests passed\n"


def test_builds_and_packages():
    assert builds.native("Build Summary: 3/3 steps succeeded\nnoise\n") == "Build Summary: 3/3 steps succeeded\n" and builds.size_bytes("1,024.5", "kB") == 1024 * 1024 + 512 and builds.size_bytes("x", "kB") is None
    assert builds.gradle("> Task :a\n") == "gradle ok\n" and builds.maven("") == "maven ok\n" and builds.frontend("transforming...\n") == "build complete\n"
    assert packages.npm("npm WARN deprecated @a/b@1.0: x\nnpm WARN deprecated c@2: y\nup to date\n") == "deprecated x2: @a/b, c\nup to date\n"
    assert packages.npm("".join(f"npm WARN deprecated p{k}@1: x\n" for k in range(9))) == "deprecated x9: p0, p1, p2, p3, p4, p5, p6, p7, ...\n"
    assert packages.install("chatter\n") == "up to date\n" and packages.pnpm_outdated("x") is None


def test_listings_and_tables():
    assert listings.ls_long("total 0\nodd\n") is None and listings.find_long("x\n") is None and listings.du("x\n") is None
    assert listings.du("1.5M\t/x/a\n120\t/x/b\n7K\t/x/c\n") == "/x/\n1.5M\ta\n120\tb\n7K\tc\n" and listings.du("10K\ta\n") == "10K\ta\n"
    assert listings.difference("1a2\n> x\n\\ No newline at end of file\n") == "@1a2\n+x\n\\ No newline at end of file\n" and listings.difference("1c1\n< a\n> b\n") is None
    assert services.curl("", "> GET /a HTTP/1.1\n< HTTP/1.1 301 Moved\n< location: /b\n") == "> GET /a HTTP/1.1\n< HTTP/1.1 301 Moved\n< location: /b\n"
    assert services.view("x") is None and tabular.outline("{}", "x.json") is None
    assert tabular.outline("import x\nfunc f() {\n  a\n  b\n}\nvar c\n", "m.go") == "import x\nfunc f() {\n    // ... (3 lines)\n}\nvar c\n\n"


def test_codings_come_back():
    rng = random.Random(5)
    for _ in range(500):
        x = "".join(rng.choice(["a", " " * 20, " " * 600, "\x01", "\n", "abcdefghijklmnopq"]) for _ in range(rng.randint(0, 12)))
        assert tabular.unfold_prefixes(tabular.fold_prefixes(x)) == x and tabular.unfold_blanks(tabular.fold_blanks(x)) == x
    assert tabular.unfold_blanks("\x01\x05") is None and tabular.unfold_blanks("a\x01") is None


def test_checkers_leave_what_they_do_not_know():
    assert diagnostics.mypy("a.py:1: error: x\nTraceback\n") is None and diagnostics.mypy("Success: no issues\n") == ("Success: no issues\n", False)
    assert diagnostics.strict(diagnostics.mypy, '{"a": 1}', "", 0) is None and diagnostics.strict(diagnostics.mypy, "Success: x\n", "", 1) is None and diagnostics.strict(diagnostics.golangci, "", "", 0, True) == ("", "")
    assert diagnostics.split_location("C:/a.py:12:3: x") == ("C:/a.py", "12:3", " x") and diagnostics.split_location("a.py:12: x") == ("a.py", "12", " x") and diagnostics.split_location("a.py:12: x", True) is None


def test_operator_guards(spark):
    one, two = "[m 1234567] s\n", "[q 1234567] s\n"
    rows = [(1, one, None, 0, "git_commit"), (2, one, "", 1, "git_commit"), (3, "x\n", "y\n", 0, "git_merge"), (4, None, None, 0, None), (5, one + "z" * (16 << 20), "", 0, "git_commit"), (None, two, "", 0, "git_commit"), (1, one, None, 0, "git_commit")]
    df = spark.createDataFrame(rows, "capture_id long, stdout string, stderr string, exit_code int, evidence string").withColumnRenamed("evidence", "form")
    got = {(r.capture_id, r.out_stdout[:20], r.out_stderr, r.filter_name, r.evidence) for r in captured.compact(df, df["form"]).collect()}
    assert got == {
        (1, "c 1234567 m s\n", "", "git", "FactComplete"), (2, one, "", "passthrough", "ByteExact"), (3, "x\n", "y\n", "passthrough", "ByteExact"), (4, "", "", "passthrough", "ByteExact"),
        (5, one + "z" * 6, "", "passthrough", "ByteExact"), (None, "c 1234567 q s\n", "", "git", "FactComplete"),
    }
    assert captured.compact(df.limit(0), "git_commit").count() == 0
    assert "Exchange" not in captured.compact(df, "git_commit")._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["git_log", "cargo_test", "difference", "helm_list"])
def test_scripts_are_shown_as_they_say(spark, name):
    from sparkfold.plans import queries
    from sparkfold.sources.tables import views

    script = next(s for s in scripts.SCRIPTS if s.name == name)
    got = queries.scripted(script)(spark, "/root/testdata/sf0.001")
    views(spark, "/root/testdata/sf0.001")
    want = spark.sql(scripts.sql(script, True, True))
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 and want.count() > 0
