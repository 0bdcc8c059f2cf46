"""Exact top-k search by columnar branch-and-bound.

Vectors are laid out by dimension, a block of candidates at a time. Scores grow dimension block by dimension block;
after each, what the rest can still add is at most the product of the two remaining norms (the remaining mass), and
candidates that cannot reach a query's k-th best score are dropped, the survivors compacted. The k-th best score known
so far starts from exact scores of a few candidates and rises block by block.

Queries go out in waves of about `wave` rows, one after another, so what is sent to the tasks is bounded and given back; each wave passes over all
candidates where they lie, only k rows per query and task are exchanged, and its result is written before the next one begins.

Components become floor(256 * x), x as double; scores are integer inner products: in doubles while all partial sums fit 53 bits, else, for that block and
query length, in Python integers. Ranks go by the whole score; one beyond 64 bits is shown as the nearest 64-bit number. Vectors that are null or
hold a null or non-finite component take no part; nor do vectors of another length than the query's, or null ids. A repeated id
counts as one candidate per row, and as one query (its greatest vector). Ties go to the smaller id.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkfold.llm import common

#: Dimensions that a step adds, and candidates that a block holds.
STEP, BLOCK = 16, 4096


def _top(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, by falling score, then id."""
    if score.dtype == object:
        return np.array(sorted(range(len(score)), key=lambda i: (-score[i], ids[i]))[:k], np.int64)
    if len(score) > 4 * k:
        cut = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= cut)
        return some[np.lexsort((ids[some], -score[some]))[:k]]
    return np.lexsort((ids, -score))[:k]


def _whole(x: np.ndarray) -> np.ndarray:
    """The same numbers as Python integers."""
    return np.array([int(v) for v in x.ravel()], object).reshape(x.shape)


def _sortable(x: int) -> str:
    """A text that sorts as the number does, for numbers of up to 999 digits."""
    digits = str(abs(x))
    return f"1{len(digits):03}{digits}" if x >= 0 else f"0{999 - len(digits):03}" + digits.translate(str.maketrans("0123456789", "9876543210"))


class Search:
    """Best candidates so far of each query, over blocks of candidates."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, np.ascontiguousarray(queries, np.float64), k
        self.steps = list(range(0, queries.shape[1], STEP))
        sq = self.q**2
        self.rest = np.stack([np.sqrt(sq[:, s + STEP :].sum(1)) for s in self.steps], 1) if self.steps else np.zeros((len(ids), 0))
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64)) for _ in ids]

    def add_large(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """The same for blocks whose sums do not fit 53 bits: all scores in Python integers, query by query. From then on scores are such integers."""
        v, q = _whole(vectors), _whole(self.q)
        for j, own in enumerate(self.ids):
            known, known_ids = self.best[j]
            other = np.flatnonzero(ids != own)
            score = np.array([sum(map(operator.mul, q[j], row)) for row in v[other]], object)
            score, got = np.concatenate([_whole(known), score]), np.concatenate([known_ids, ids[other]])
            top = _top(score, got, self.k)
            self.best[j] = (score[top], got[top])

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        if np.abs(vectors).max(initial=0) * np.abs(self.q).max(initial=0) * max(1, vectors.shape[1]) >= 2**53 or any(s.dtype == object for s, _ in self.best):
            self.add_large(ids, vectors)
            return
        v = np.ascontiguousarray(vectors.T, np.float64)  # dimension by dimension
        rest = np.stack([np.sqrt((v[s + STEP :] ** 2).sum(0)) for s in self.steps]) if self.steps else None
        first = self.q[:, :STEP] @ v[:STEP]
        for j, own in enumerate(self.ids):
            known, known_ids = self.best[j]
            alive = np.flatnonzero(ids != own)
            score = first[j][alive]
            q = self.q[j]
            floor = known[-1] if len(known) == self.k else -np.inf
            for t, s in enumerate(self.steps):
                if t:
                    score = score + q[s : s + STEP] @ v[s : s + STEP, alive]
                if s + STEP >= len(q):
                    break
                reach = score + self.rest[j, t] * rest[t, alive]
                if floor == -np.inf or t == 0:  # exact scores of the most promising raise the bar
                    some = alive[np.argpartition(-reach, self.k)[: self.k]] if len(alive) > self.k else alive
                    exact = np.concatenate([known, q @ v[:, some]])
                    if len(exact) >= self.k:
                        floor = max(floor, np.partition(exact, len(exact) - self.k)[len(exact) - self.k])
                live = np.flatnonzero(reach * (1 + 1e-12) + 1e-6 >= floor)  # room for the rounding of the norms
                if len(live) < len(alive):
                    alive, score = alive[live], score[live]
            score, got = np.concatenate([known, score]), np.concatenate([known_ids, ids[alive]])
            top = _top(score, got, self.k)
            self.best[j] = (score[top], got[top])


def _matrix(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows, length of each, with the vectors laid flat) of usable vectors."""
    lens = pa.compute.list_value_length(col).fill_null(0).to_numpy(zero_copy_only=False)
    flat = pa.compute.list_flatten(col).cast(pa.float64()).to_numpy(zero_copy_only=False)
    bad = ~np.isfinite(flat)
    row = np.repeat(np.arange(len(lens)), lens)
    ok = np.bincount(row, weights=bad, minlength=len(lens)) == 0
    ok &= ~np.array(col.is_null())
    return ok, lens, np.floor(256 * np.where(bad, 0, flat))


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of the batch's usable rows, by length."""
    ok, lens, flat = _matrix(batch.column(1))
    ok &= ~np.array(batch.column(0).is_null())
    ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.cumsum(lens) - lens
    for d in np.unique(lens[ok]):
        own = np.flatnonzero(ok & (lens == d))
        yield ids[own], flat[common.ranges(at[own], lens[own])].reshape(len(own), d)


def search(vectors: DataFrame, is_query, k: int = 5, wave: int = 4096, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all rows but itself for every row where `is_query` holds."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    asked = vectors.where(is_query).select(F.col(id).cast("long").alias("vec_id"), F.col(vector).alias("v")).where("vec_id is not null and v is not null")
    # Of a repeated id, the greatest usable vector.
    usable = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    asked = common.stored(asked.where(usable).groupBy("vec_id").agg(F.max("v").alias("v")))
    waves = max(1, -(-asked.count() // wave))
    path, schema = common.scratch(spark), "query_id long, rank int, vec_id long, score long"
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc_nulls_last("whole"), "vec_id")  # `whole` tells scores beyond 64 bits apart
    for w in range(waves):
        own = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(waves)) == w).collect()  # about `wave` rows
        sets = {}
        for r in own:
            sets.setdefault(len(r.v), []).append(r)
        packed = {d: (np.array([r.vec_id for r in g], np.int64), np.floor(256 * np.array([r.v for r in g], np.float64)).reshape(len(g), d)) for d, g in sets.items()}
        sent = spark.sparkContext.broadcast(packed)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            finders = {d: Search(i, q, k) for d, (i, q) in sent.value.items()}
            for b in batches:
                for lo in range(0, b.num_rows, BLOCK):
                    for ids, v in _by_length(b.slice(lo, BLOCK)):
                        f = finders.get(v.shape[1])
                        if f is not None:
                            f.add(ids, v)
            for f in finders.values():
                n = [len(s) for s, _ in f.best]
                flat = [x for s, _ in f.best for x in s.tolist()]
                large = [x if isinstance(x, int) and not -(1 << 63) < x < (1 << 63) - 1 else None for x in flat]
                yield pa.record_batch({
                    "query_id": pa.array(np.repeat(f.ids, n)), "vec_id": pa.array(np.concatenate([i for _, i in f.best])), "score": pa.array([min(max(int(x), -(1 << 63)), (1 << 63) - 1) for x in flat], pa.int64()),
                    "whole": pa.array([None if x is None else _sortable(x) for x in large], pa.string()),
                })

        found = rows.mapInArrow(run, "query_id long, vec_id long, score long, whole string")
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        best.write.mode("append").parquet(path)  # one wave at a time, so that one set of queries is in the tasks' memory
        sent.destroy()
    common.discard(asked)
    return spark.read.schema(schema).parquet(path)


def op6_exact_topk(spark, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP6_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
