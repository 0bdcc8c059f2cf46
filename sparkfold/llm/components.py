"""Connected components of a link table, by alternating large and small stars, on written tables throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfold.llm import common


def _canonical(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _mark(pairs: DataFrame) -> tuple:
    r = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return r.n, r.h


def components(links: DataFrame) -> DataFrame:
    """`links` has longs a, b. Returns node, root for every node of a link: root is the least node it is linked with, over any number
    of steps. Each round joins every node to its least neighbour (by a grouped minimum, so a hub's links are first
    reduced where they lie) and is written to the shared folder, until a round changes nothing."""
    now = common.stored(_canonical(links.select("a", "b")))
    mark = _mark(now)
    while True:
        # large star: each neighbour above a node is tied to the node's least neighbour or itself
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # small star: each node and its smaller neighbours are tied to the least of them
        small_least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        joined = large.join(small_least, F.col("a") == F.col("k"))
        small = joined.select("b", "m").unionByName(joined.select(F.col("a").alias("b"), "m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = common.stored(_canonical(small))
        common.discard(now)
        now, before = after, mark
        mark = _mark(now)
        if mark == before:
            break
    roots = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    tops = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct().join(now.select(F.col("a").alias("node")).distinct(), "node", "left_anti")
    return roots.unionByName(tops)
