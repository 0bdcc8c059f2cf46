"""Vector codes: each vector as the numbers of its parts' nearest codebook entries, found by annular norm pruning.

A vector is cut into equal consecutive parts. A part's codebook starts as that part of the first vectors and is improved by a fixed number of rounds: all
parts are assigned to their nearest entries, entries become the floored means of their parts. Distances are exact integers.

The search for a nearest entry sorts the entries by norm. By the triangle inequality an entry nearer than the best distance so far, d, has a norm within
d of the part's own, so a binary search gives the interval of entries that remain. The interval is walked from the inside: the entries nearest
in norm first, then, with the distance that they gave, what is left of the annulus, its ends included, so that ties are seen as well. Parts are taken by norm
too, some at a time, so that a slice of the entries serves all of them in one product.

Work is spread by rows: each round passes over the written table once, with the codebook (`entries` x length numbers, whatever the data) broadcast; tasks
send sums per entry, which Spark adds up before the driver divides.

Defined results: rows take no part whose vector is null, empty, or holds a null component or one that is not finite (1024-fold); nor do vectors of another
length than the commonest (the longest of equally common ones). A length that does not divide by the number of parts leaves the last parts one shorter.
Repeated ids are rows of their own, ordered by vector; null ids come last among the first vectors. Equal entries: the lower number. Components of any size
are exact, beyond 53 bits in Python integers; an error beyond 64 bits is shown as the greatest 64-bit number. An empty table gives no rows. Other columns go
unread.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfold.llm import common

#: Parts that are searched together; entries nearest in norm that are tried first; rows that a step takes; bits of a limb of a sum.
TILE, INNER, ROWS, LIMB = 256, 16, 16384, 40
#: Labels whose sums are broadcast; above, they are joined by label and salt.
FEW_LABELS, SALTS = 50_000, 64
_MOST = (1 << 63) - 1


def cuts(length: int, parts: int) -> list[tuple[int, int]]:
    """Where the parts of a vector lie."""
    edges = [0]
    for k in range(parts):
        edges.append(edges[-1] + length // parts + (k < length % parts))
    return list(zip(edges, edges[1:], strict=False))


class Annulus:
    """Nearest entries of one part's codebook, exactly."""

    def __init__(self, entries: np.ndarray):
        """`entries`: integers, of any size, one row each."""
        self.real = entries.astype(np.float64)
        self.norms = np.sqrt((self.real**2).sum(1))
        self.order = np.argsort(self.norms, kind="stable")
        self.norms, self.real, self.whole = self.norms[self.order], self.real[self.order], entries[self.order]
        self.square = (self.real**2).sum(1)
        self.top = np.abs(self.real).max(initial=0)

    def _distances(self, x: np.ndarray, lo: int, hi: int, exact: bool) -> np.ndarray:
        """Squared distances of these parts to entries lo .. hi - 1 by norm."""
        if exact:
            e = self.real[lo:hi]
            return (x**2).sum(1)[:, None] - 2 * (x @ e.T) + self.square[lo:hi]
        a = np.array([[int(v) for v in row] for row in x], object).reshape(len(x), 1, x.shape[1])
        return ((a - self.whole[None, lo:hi].astype(object)) ** 2).sum(2) if x.shape[1] else np.zeros((len(x), hi - lo), object)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest entry of each row of x (whole numbers in doubles); ties to the lower number."""
        n, k = len(x), len(self.order)
        # All terms of a distance stay under 2**53: doubles are exact.
        exact = bool(4 * max(1, x.shape[1]) * max(np.abs(x).max(initial=0), self.top) ** 2 < 2**53)
        near, best = np.full(n, k, np.int64), np.full(n, np.inf) if exact else np.full(n, float("inf"), object)
        r = np.sqrt((x**2).sum(1))
        by_norm = np.argsort(r, kind="stable")
        for t in range(0, n, TILE if exact else 16):
            rows = by_norm[t : t + (TILE if exact else 16)]
            at = np.searchsorted(self.norms, r[rows])
            # The entries nearest in norm give a first distance, which bounds the annulus.
            lo, hi = max(0, int(at.min()) - INNER // 2), min(k, int(at.max()) + INNER // 2)
            self._improve(x[rows], rows, lo, hi, np.full(len(rows), lo), np.full(len(rows), hi), near, best, exact)
            d = np.sqrt(best[rows].astype(np.float64))
            slack = 1e-9 * (1 + r[rows] + d)  # room for the rounding of norms
            with np.errstate(invalid="ignore"):
                first = np.searchsorted(self.norms, r[rows] - d - slack, "left")
                last = np.searchsorted(self.norms, r[rows] + d + slack, "right")
            odd = ~np.isfinite(r[rows] + d)
            first[odd], last[odd] = 0, k
            # What the first try has not seen: below it and above it.
            for a, b in ((int(first.min()), lo), (hi, int(last.max()))):
                if a < b:
                    self._improve(x[rows], rows, a, b, first, last, near, best, exact)
        return near, best

    def _improve(self, x: np.ndarray, rows: np.ndarray, lo: int, hi: int, first: np.ndarray, last: np.ndarray, near: np.ndarray, best: np.ndarray, exact: bool) -> None:
        """Try entries lo .. hi - 1; of them, each row those in its own annulus first .. last - 1."""
        if lo >= hi:
            return
        found, number = self._distances(x, lo, hi, exact), self.order[lo:hi]
        place = np.arange(lo, hi)
        found = np.where((place >= first[:, None]) & (place < last[:, None]), found, np.inf)
        least = found.min(1)
        own = np.where(found == least[:, None], number, len(self.order)).min(1)
        better = (least < best[rows]) | ((least == best[rows]) & (own < near[rows]))
        near[rows] = np.where(better, own, near[rows])
        best[rows] = np.where(better, least, best[rows])


def usable(vectors: DataFrame, scale: int, id: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """id, label, v: floor(scale * component) of the usable rows, as whole numbers in doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(2)
            lens = pa.compute.list_value_length(col).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = pa.compute.list_flatten(col).cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become nan
            with np.errstate(over="ignore", invalid="ignore"):
                flat = np.floor(scale * flat)
            bad = np.bincount(np.repeat(np.arange(len(lens)), lens), weights=~np.isfinite(flat), minlength=len(lens)) > 0
            kept = np.flatnonzero(~bad & (lens > 0))
            at = np.cumsum(lens) - lens
            values = flat[common.ranges(at[kept], lens[kept])] + 0.0
            offsets = np.concatenate([[0], np.cumsum(lens[kept])])
            yield pa.record_batch({
                "id": b.column(0).take(pa.array(kept)), "label": b.column(1).take(pa.array(kept)), "v": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.float64())),
            })

    kind = dict(vectors.dtypes)
    return vectors.select(F.col(id).alias("id"), F.col(label).alias("label"), F.col(vector).alias("v")).mapInArrow(run, f"id {kind[id]}, label {kind[label]}, v array<double>")


def _matrix(b: pa.RecordBatch, width: int) -> np.ndarray:
    return pa.compute.list_flatten(b.column(b.schema.get_field_index("v"))).to_numpy(zero_copy_only=False).reshape(b.num_rows, width)


def _limbs(total: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Whole numbers (64-bit, or Python's) as digits of 40 bits; the last one has the sign."""
    for k in range(64):
        rest = total >> LIMB
        if bool(((rest == 0) | (rest == -1)).all()) or (total.dtype != object and k == 1):
            yield k, total
            return
        yield k, total & ((1 << LIMB) - 1)
        total = rest


def _sums(rows: DataFrame, books: list[np.ndarray], width: int) -> DataFrame:
    """part, entry, place, limb, total of the parts assigned to each entry; place -1 has their count."""
    parts, sent = cuts(width, len(books)), rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders = [Annulus(e) for e in sent.value]
        sums: list = [np.zeros(e.shape, np.int64) for e in sent.value]
        counts, reach = [np.zeros(len(e), np.int64) for e in sent.value], 0.0
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                x = _matrix(b.slice(at, ROWS), width)
                reach += float(np.abs(x).max(initial=0)) * len(x)
                for p, (lo, hi) in enumerate(parts):
                    own = x[:, lo:hi]
                    near, _ = finders[p].nearest(own)
                    counts[p] += np.bincount(near, minlength=len(counts[p]))
                    if reach < 2**62:
                        np.add.at(sums[p], near, own.astype(np.int64))
                    else:  # Python's integers from here on
                        sums[p] = sums[p].astype(object)
                        np.add.at(sums[p], near, np.array([[int(v) for v in row] for row in own], object).reshape(own.shape))
        for p in range(len(parts)):
            entry, place = (a.ravel() for a in np.indices(sums[p].shape))
            done = [(entry, place, k, limb) for k, limb in _limbs(sums[p].ravel())]
            done.append((np.arange(len(counts[p])), np.full(len(counts[p]), -1), 0, counts[p]))
            for e, j, k, total in done:
                some = total != 0
                if some.any():
                    yield pa.record_batch({
                        "part": pa.array(np.full(some.sum(), p, np.int32)), "entry": pa.array(e[some].astype(np.int32)), "place": pa.array(j[some].astype(np.int32)),
                        "limb": pa.array(np.full(some.sum(), k, np.int32)), "total": pa.array(total[some].tolist(), pa.int64()),
                    })

    return rows.select("v").mapInArrow(run, "part int, entry int, place int, limb int, total long").groupBy("part", "entry", "place", "limb").agg(F.sum("total").alias("total"))


def improved(rows: DataFrame, books: list[np.ndarray], width: int) -> list[np.ndarray]:
    """The codebooks after one round: floored means; an entry without parts stays."""
    got: dict = {}
    for r in _sums(rows, books, width).collect():  # at most entries x width rows, whatever the data
        got[r.part, r.entry, r.place] = got.get((r.part, r.entry, r.place), 0) + (r.total << (LIMB * r.limb))
    out = []
    for p, old in enumerate(books):
        new = [[got.get((p, e, j), 0) // got[p, e, -1] for j in range(old.shape[1])] if (p, e, -1) in got else list(old[e]) for e in range(len(old))]
        out.append(np.array(new, object).reshape(old.shape))
    return out


def encoded(rows: DataFrame, books: list[np.ndarray], width: int) -> DataFrame:
    """id, label, code, error."""
    parts, sent = cuts(width, len(books)), rows.sparkSession.sparkContext.broadcast(books)
    digits = max(2, len(f"{max(len(books[0]) - 1, 0):x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders = [Annulus(e) for e in sent.value]
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                x = _matrix(b, width)
                found = [f.nearest(x[:, lo:hi]) for f, (lo, hi) in zip(finders, parts, strict=True)]
                code = ["".join(f"{k:0{digits}x}" for k in row) for row in zip(*[near.tolist() for near, _ in found], strict=True)]
                error = [min(sum(int(d) for d in row), _MOST) for row in zip(*[d.tolist() for _, d in found], strict=True)]
                yield pa.record_batch({"id": b.column(0), "label": b.column(1), "code": pa.array(code, pa.string()), "error": pa.array(error, pa.int64())})

    kind = dict(rows.dtypes)
    return rows.select("id", "label", "v").mapInArrow(run, f"id {kind['id']}, label {kind['label']}, code string, error long")


def written_codes(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, **names) -> tuple[DataFrame, list[np.ndarray]]:
    """(id, label, code, error of every usable vector, written; the codebooks)."""
    rows = common.stored(usable(vectors, scale, **names))
    common_length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if common_length is None:
        return common.stored(rows.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))), [np.zeros((0, 0), object) for _ in range(parts)]
    width = common_length.n
    rows = rows.where(F.size("v") == width)
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    start = np.array([[int(x) for x in r.v] for r in first], object).reshape(len(first), width)
    books = [start[:, lo:hi] for lo, hi in cuts(width, parts)]
    for _ in range(rounds):
        books = improved(rows, books, width)
    return common.stored(encoded(rows, books, width)), books


def with_label_sums(coded: DataFrame) -> DataFrame:
    """`coded` and label_error, the sum of errors of rows with an equal label; a label may hold most rows."""
    most = F.lit(_MOST).cast("decimal(38,0)")
    sums = common.stored(coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), most).cast("long").alias("label_error")).withColumnRenamed("label", "of_label"))
    if sums.count() <= FEW_LABELS:
        return coded.join(F.broadcast(sums), coded.label.eqNullSafe(sums.of_label)).drop("of_label")
    salted = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = coded.withColumn("own_salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int"))
    return rows.join(salted, rows.label.eqNullSafe(salted.of_label) & (rows.own_salt == salted.salt)).drop("of_label", "salt", "own_salt")


def books_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def op12_vector_codes(spark, sf_dir: str) -> DataFrame:
    coded, books = written_codes(common.table(spark, sf_dir, "embeddings"))
    return with_label_sums(coded).select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _sql(rounds: int = 4) -> str:
    parts = ["""
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, k, v[k * (len(v) // 4) + 1 : (k + 1) * (len(v) // 4)] AS x, row_number() OVER (PARTITION BY k ORDER BY vec_id NULLS LAST, v) - 1 AS place FROM e, range(4) t(k)),
c0 AS MATERIALIZED (SELECT k, place AS entry, x AS c FROM p WHERE place < 256)"""]
    near = "SELECT k, place, arg_min(entry, d * 256 + entry) AS entry, min(d) AS d FROM (SELECT p.k, p.place, c.entry, CAST(list_sum(list_transform(list_zip(p.x, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM p JOIN c{r} c ON p.k = c.k) GROUP BY k, place"
    for r in range(rounds):
        parts.append(f"a{r} AS MATERIALIZED ({near.format(r=r)})")
        parts.append(f"""m{r} AS (SELECT k, entry, list(m ORDER BY j) AS c FROM (SELECT a.k, a.entry, j, CAST(sum(p.x[j]) AS BIGINT) AS s, count(*) AS n, (s - ((s % n) + n) % n) // n AS m
  FROM a{r} a JOIN p ON a.k = p.k AND a.place = p.place, unnest(range(1, len(p.x) + 1)) u(j) GROUP BY a.k, a.entry, j) GROUP BY k, entry)""")
        parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c.k, c.entry, coalesce(m.c, c.c) AS c FROM c{r} c LEFT JOIN m{r} m ON c.k = m.k AND c.entry = m.entry)")
    parts.append(f"last AS MATERIALIZED ({near.format(r=rounds)})")
    parts.append("""coded AS (SELECT p.vec_id, p.label, p.place, string_agg(printf('%02x', CAST(l.entry AS INTEGER)), '' ORDER BY p.k) AS code, CAST(sum(l.d) AS BIGINT) AS error
  FROM last l JOIN p ON l.k = p.k AND l.place = p.place GROUP BY ALL)""")
    parts.append(f"books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY k, entry)) AS h FROM c{rounds})")
    return ",\n".join(parts) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT h FROM books) AS codebooks_sha256 FROM coded"


OP12_SQL = _sql()
