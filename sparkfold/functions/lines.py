"""Line tables: a body exploded into (key, line_no, line), islands of equal keys, and bodies put together again.

Every operator on lines takes and returns such tables; `key` names the capture (or document) that a line belongs to.
A capture is at most 16 MiB, so windows over one capture are bounded by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines(bodies: DataFrame, key: str = "capture_id", body: str = "body") -> DataFrame:
    """One row per line; a body without a line feed is one line, and one that ends in a line feed ends in an empty line."""
    return bodies.select(F.col(key), F.posexplode(F.split(F.col(body), "\n")).alias("line_no", "line"))


def ordered(key: str = "capture_id", *by: str) -> Window:
    return Window.partitionBy(key).orderBy(*(by or ("line_no",)))


def before(value: Column | str, key: str = "capture_id") -> Column:
    """The value on the line before, in the same capture."""
    return F.lag(value).over(ordered(key))


def carried(value: Column, key: str = "capture_id") -> Column:
    """The last value that is not null, on this line or before."""
    return F.last(value, ignorenulls=True).over(ordered(key).rowsBetween(Window.unboundedPreceding, 0))


def islands(table: DataFrame, new: Column, key: str = "capture_id") -> DataFrame:
    """`island` numbers the runs that begin where `new` holds (null counts as true)."""
    return table.withColumn("island", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(ordered(key).rowsBetween(Window.unboundedPreceding, 0)))


def head_tail(table: DataFrame, head: int, tail: int, notice: Column, key: str = "capture_id") -> DataFrame:
    """The first and last lines of each capture that has more than both together, with `notice` between them (`dropped` in it is
    how many are left out)."""
    w = Window.partitionBy(key)
    t = table.withColumn("_i", F.row_number().over(ordered(key))).withColumn("_n", F.count("*").over(w)).withColumn("dropped", F.col("_n") - (head + tail))
    kept = t.where((F.col("dropped") <= 0) | (F.col("_i") <= head) | (F.col("_i") > F.col("_n") - tail))
    gap = t.where((F.col("dropped") > 0) & (F.col("_i") == head + 1)).withColumn("line", notice)
    return kept.unionByName(gap).select(key, "line_no", "line")


def render(table: DataFrame, key: str = "capture_id", line: str = "line", order: str = "line_no") -> DataFrame:
    """One body per capture: its lines in order, each ended by a line feed."""
    w = F.sort_array(F.collect_list(F.struct(order, line)))
    return table.groupBy(key).agg(w.alias("_l")).select(key, F.concat(F.array_join(F.col("_l")[line], "\n"), F.lit("\n")).alias("body"))
