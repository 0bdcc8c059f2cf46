from sparkfold.functions import lines as L
from sparkfold.operators import tables


def _lines(spark, *texts):
    return L.lines(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "capture_id long, body string"))


def _out(df):
    return [r.line for r in df.orderBy("capture_id", *(["line_no"] if "line_no" in df.columns else [])).collect()]


def test_releases(spark):
    assert _out(tables.helm_list(_lines(spark, "NAME\nweb prod 3 2024-01-01 10:00:00 +0000 UTC deployed web-1 2.0\n", "NAME\nshort row\n"))) == ["web prod r3 deployed web-1 2.0"]
    assert _out(tables.helm_history(_lines(spark, "REVISION\n1 Mon Jan superseded web-1 1.0 Install complete\n"))) == ["r1 superseded web-1 1.0 Install complete"]
    assert _out(tables.helm_status(_lines(spark, "NAME: web\nLAST DEPLOYED: now\nSTATUS: deployed\nNOTES:\nhello\n"))) == ["NAME: web", "STATUS: deployed", "NOTES:", "hello"]


def test_grids(spark):
    t = "+-----+-----+\n| a   | b   |\n+-----+-----+\n| 1   | x y |\n+-----+-----+\n"
    assert _out(tables.grid(_lines(spark, t, t + "odd\n"))) == ["a\tb", "1\tx y"]
    assert _out(tables.psql(_lines(spark, " id | name\n----+-----\n  1 | x\n  2 | y\n(2 rows)\n\n", " id | name\n----+-----\n  1\n"))) == ["id\tname", "1\tx", "2\ty", "(2 rows)"]
