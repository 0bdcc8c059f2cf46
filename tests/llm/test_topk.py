import math
import random

from pyspark.sql import functions as F

from sparkfold.llm import topk


def _frame(spark, n=260, dims=40):
    rng = random.Random(1)
    rows = [(k, [rng.gauss(0, 0.3) for _ in range(dims)]) for k in range(n)]
    rows += [(n, rows[3][1]), (n + 1, rows[3][1]), (n + 2, None), (n + 3, [1.0, None]), (n + 4, [float("nan")] * dims), (n + 5, []), (None, rows[0][1]), (n + 6, [0.5, 0.25])]
    return rows, spark.createDataFrame([(i, v, 0, 0) for i, v in rows], "vec_id long, embedding array<float>, score int, rank int")


def test_search_against_all_pairs(spark):
    rows, df = _frame(spark)
    f32 = {r.vec_id: r.embedding for r in df.collect() if r.vec_id is not None}
    usable = {i: [math.floor(256 * x) for x in v] for i, v in f32.items() if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    got = {}
    for r in topk.search(df, F.col("vec_id") % 50 == 0, wave=3).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    want = {}
    for q, x in usable.items():
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in usable.items() if i != q and len(x) == len(y))[:5]
            if best:
                want[q] = {k + 1: (i, -s) for k, (s, i) in enumerate(best)}
    assert got == want


def test_search_of_an_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.search(df, F.col("vec_id") % 50 == 0).collect() == []


def test_search_of_huge_components(spark):
    rng = random.Random(2)
    rows = [(k, [rng.choice([1e30, -3e29, 0.5, 7e18, 1e-3]) for _ in range(6)]) for k in range(60)] + [(60, [0.5] * 6), (61, [0.5] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    usable = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.search(df, F.col("vec_id") % 50 == 0).collect()}
    want = {}
    for q, x in usable.items():
        if q % 50 == 0:
            for k, (s, i) in enumerate(sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in usable.items() if i != q)[:5]):
                want[q, k + 1] = (i, min(max(-s, -(1 << 63)), (1 << 63) - 1))
    assert got == want
