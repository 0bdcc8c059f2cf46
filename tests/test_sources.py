"""Session logs and session databases as sources."""

import json
import sqlite3

from sparkfold.operators import commands
from sparkfold.sources import databases, tables


def _database(path, rows, table="part"):
    with sqlite3.connect(path) as db:
        db.execute(f"CREATE TABLE {table} (id INTEGER PRIMARY KEY, data TEXT)")
        db.executemany(f"INSERT INTO {table} VALUES (?, ?)", rows)


def _call(command, tool="bash", kind="tool"):
    return json.dumps({"type": kind, "tool": tool, "state": {"input": {"command": command}}})


def test_session_databases(spark, tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    _database(tmp_path / "a.db", [(1, _call("ls")), (2, "no json"), (3, None), (7, _call(3)), (90, _call("x", "read")), (91, _call("pwd", kind="text")), (100, _call("é 'q'"))])
    _database(tmp_path / "deep" / "er" / "b.db", [(k, _call(f"c{k}")) for k in range(10)])
    _database(tmp_path / "other.db", [(1, _call("never"))], "elsewhere")
    (tmp_path / "broken.db").write_bytes(b"no database")
    _database(tmp_path / "empty.db", [])
    got = sorted((r.path.rpartition("/")[2], r.row, r.command) for r in databases.shell_commands(databases.records(spark, str(tmp_path))).collect())
    assert got == [("a.db", 1, "ls"), ("a.db", 100, "é 'q'"), *[("b.db", k, f"c{k}") for k in range(10)]]
    assert databases.records(spark, str(tmp_path / "none")).count() == 0


def test_filters_prune_files_and_rows(spark, tmp_path):
    for name in "ab":
        _database(tmp_path / f"{name}.db", [(k, _call(name)) for k in range(100)])
    reader = databases.SessionReader({"path": f"file://{tmp_path}", "rows": "10"})
    assert len(reader.partitions()) == 20
    left = list(reader.pushFilters([databases.GreaterThanOrEqual(("row",), 35), databases.LessThan(("row",), 50), databases.EqualTo(("path",), str(tmp_path / "a.db")), databases.EqualTo(("data",), "x")]))
    assert [type(f).__name__ for f in left] == ["EqualTo"] and [(p.first, p.last) for p in reader.partitions()] == [(35, 44), (45, 49)]
    some = databases.records(spark, str(tmp_path)).where((databases.F.col("row") > 97) & (databases.F.col("path") == str(tmp_path / "b.db")))
    assert [r.row for r in some.collect()] == [98, 99]
    assert some.rdd.getNumPartitions() == 1


def test_written_databases(spark, tmp_path):
    rows = spark.createDataFrame([(_call(f"c{k}"),) for k in range(50)] + [(None,)], "data string").repartition(3)
    assert databases.write(rows, f"file://{tmp_path}/db") == 3
    assert databases.shell_commands(databases.records(spark, f"file://{tmp_path}/db")).select("command").distinct().count() == 50


def test_session_logs_below_a_folder(spark, tmp_path):
    (tmp_path / "x" / "y").mkdir(parents=True)
    record = json.dumps({"n": 1, "a": [{"type": "tool_use", "name": "Bash", "input": {"command": "git status"}}]})
    (tmp_path / "x" / "y" / "s.jsonl").write_text(record + "\nnot json\n\n" + record.replace("1", "2", 1) + "\n")
    (tmp_path / "x" / "t.jsonl").write_text("{}\n")
    (tmp_path / "u.txt").write_text(record)
    found = tables.sessions(spark, str(tmp_path))
    assert found.count() == 3
    assert sorted(r.command for r in commands.tool_calls(found, "path", "record").collect()) == ["git status", "git status"]
