"""Run-length compaction of service logs, and transitions of job states."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkfold.functions import lines as L
from sparkfold.functions import text as T


def collapse(table: DataFrame, compose: bool = False, key: str = "capture_id") -> DataFrame:
    """key, line_no, line, n: neighbouring lines that differ only in their timestamp become one, the first, without it. An empty
    line ends a run and goes."""
    t = table.withColumn("line", F.rtrim(T.strip_ansi(F.col("line")), F.lit(" \t\n\f\r")))
    t = t.withColumn("line", T.log_line(F.col("line"), compose)).withColumn("mark", F.col("line") if compose else T.without_timestamp(F.col("line")))
    was, blank = L.before("mark", key), L.before(F.col("line") == "", key)
    t = L.islands(t, was.isNull() | (was != F.col("mark")) | blank, key).where("line <> ''")
    first = F.min(F.struct("line_no", "line")).alias("f")
    out = t.groupBy(key, "island").agg(first, F.count("*").alias("n"))
    return out.select(key, F.col("f.line_no").cast("long").alias("line_no"), T.without_timestamp(F.col("f.line")).alias("line"), F.col("n").cast("long").alias("n"))


def transitions(table: DataFrame, key: str = "capture_id") -> DataFrame:
    """key, line_no, change: one row where a job's status differs from its last one, as `job: old->new`; a job's first status as it is."""
    was = F.lag("status").over(Window.partitionBy(key, "job").orderBy("line_no"))
    t = table.withColumn("was", was).where(F.col("was").isNull() | (F.col("was") != F.col("status")))
    return t.select(key, "line_no", F.concat("job", F.lit(": "), F.when(F.col("was").isNull(), F.col("status")).otherwise(F.concat("was", F.lit("->"), "status"))).alias("change"))
