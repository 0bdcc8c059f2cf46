"""Queries and reports over whole tables and whole texts, against brute force."""

import random
from collections import defaultdict

from sparkfold.plans import queries, usage
from sparkfold.sources.tables import table

DATA = "/root/testdata/sf0.001"


def test_parity_of_gaps_nulls_and_long_bodies(spark):
    long = "é🙂" * 60_000
    old = [(1, "abc"), (2, "abc"), (4, None), (5, None), (6, "abc"), (7, ""), (8, long + "x"), (9, long + "x"), (10, long)]
    new = [(1, "abc"), (3, "abc"), (4, None), (5, "abc"), (6, "ab"), (7, "z"), (8, long + "y"), (9, long), (10, long)]
    rows = usage.parity(*(spark.createDataFrame(x, "case_id long, body string") for x in (old, new))).collect()
    assert {r.case_id: (r.verdict, r.first_difference) for r in rows} == {
        1: ("equal", None), 2: ("only in baseline", None), 3: ("only in candidate", None), 4: ("equal", None), 5: ("differs", 1), 6: ("differs", 3), 7: ("differs", 1),
        8: ("differs", 120_001), 9: ("differs", 120_001), 10: ("equal", None),
    }


def test_parity_finds_every_place(spark):
    rng = random.Random(3)
    pairs = [tuple("".join(rng.choice("aé🙂") for _ in range(rng.randint(0, 9))) for _ in "xy") for _ in range(300)]
    old, new = (spark.createDataFrame([(k, p[c]) for k, p in enumerate(pairs)], "case_id long, body string") for c in (0, 1))
    want = {k: next((i + 1 for i in range(max(map(len, p))) if p[0][i : i + 1] != p[1][i : i + 1]), None) for k, p in enumerate(pairs)}
    assert {r.case_id: r.first_difference for r in usage.parity(old, new).collect()} == want


def test_parity_check_reads_whole_texts_of_all_documents(spark):
    want = {r.doc_id: r.text.find("e") + 1 if r.doc_id % 5 == 0 and "e" in r.text else None for r in table(spark, DATA, "documents").collect()}
    got = queries.parity_check(spark, DATA).collect()
    assert len(got) == len(want)
    assert {r.case_id: r.first_difference for r in got} == want
    assert all((r.verdict == "differs") == (want[r.case_id] is not None) for r in got)
    late = spark.createDataFrame([(5, "x" * 300 + "e"), (11, "a"), (12, "b")], "case_id long, body string")
    assert [r.first_difference for r in usage.parity(late, late.replace("x" * 300 + "e", "x" * 300 + "E")).orderBy("case_id").collect()] == [301, None, None]


def _lineitem(spark, captures):
    """Rows of lineitem by capture, in the order in which they make its lines."""
    out = defaultdict(list)
    for r in table(spark, DATA, "lineitem").collect():
        out[r.l_suppkey % captures].append(r)
    for rows in out.values():
        rows.sort(key=lambda r: (r.l_orderkey, r.l_linenumber, r.l_partkey, r.l_suppkey, r.l_extendedprice))
    return out


def test_tsc_errors_reads_all_of_lineitem(spark):
    want = [(-1, 0, 0, "no type errors")]  # a capture without diagnostics
    for capture, rows in _lineitem(spark, 20).items():
        codes = defaultdict(list)
        for k, r in enumerate(rows):
            if r.l_orderkey % 97 == 0:
                want.append((capture, 1 << 40, k, "error TS18003 no inputs"))
            elif r.l_orderkey % 89:
                message = f"Cannot find name flag {r.l_returnflag if r.l_linenumber == 2 else 'X'} in this scope of the module"
                codes[f"TS{2000 + r.l_suppkey % 7 * 10 + r.l_linenumber}"].append((k, f"src/f{r.l_partkey}.ts:{r.l_linenumber}:1", message))
        for code, d in codes.items():
            first = d[0][0]
            if len(d) >= 3 and len({m[:40] for _, _, m in d}) == 1:
                more = f", ... ({len(d) - 3} more)" if len(d) > 3 else ""
                want += [(capture, first, 0, f"{code} x{len(d)}: {', '.join(p for _, p, _ in d[:3])}{more}"), (capture, first, 1, d[0][2])]
            else:
                want += [(capture, first, k, f"{p} {code}: {m}") for k, p, m in d]
    assert sorted(tuple(r) for r in queries.tsc_errors(spark, DATA).collect()) == sorted(want)


def test_tool_lines_reads_all_of_lineitem(spark):
    say = {0: "Plan: 1 to add", 1: "-- Configuring done", 2: "[ 50%] Building", 3: "x.cs(1,2): error CS0103: gone", 4: "    3 Warning(s)", 5: "Resolved 12 packages", 6: "+ left==1", 7: "Executed 4 tests", 8: "# a.b will be created", 9: "1/2 Test #1: a .... 50%"}
    kept = {"ctest": (3, 9), "cmake": (1, 2, 3, 4), "swift": (7,), "uv": (1, 5, 6), "dotnet": (3, 4), "plan": (0, 8)}
    nothing = {"swift": "ok\n", "plan": "plan ok\n"}
    want = {(c, tool): "".join(say[r.l_partkey % 12] + "\n" for r in rows if r.l_partkey % 12 in k) or nothing.get(tool, "") for c, rows in _lineitem(spark, 25).items() for tool, k in kept.items()}
    got = queries.tool_lines(spark, DATA).collect()
    assert len(got) == len(want) and {(r.capture_id, r.tool): r.body for r in got} == want
