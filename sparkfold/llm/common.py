"""Shared helpers: scratch tables, Arrow batches in bounded slices, vectorised words and hashes.

Everything here treats text as UTF-8 bytes; a null text is an empty one.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import shutil
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a vectorised step takes at once; a single longer text is its own slice.
SLICE_BYTES = 1_000_000

_U = np.uint64
#: Odd multiplier of the rolling hash and of the mixers.
_BASE = _U(0x9E3779B97F4A7C15)
_M1, _M2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """Where a public vocabulary file is: in `folder`, else where its package says."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def scratch(spark: SparkSession) -> str:
    """A fresh folder path under spark.checkpoint.dir. Where that is unset, a temporary folder in local mode; on a cluster an error, as executors would
    write to disks of their own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="sparkfold-")
        atexit.register(shutil.rmtree, base, True)
        spark.conf.set("spark.checkpoint.dir", f"file://{base}")
        base = f"file://{base}"
    return f"{base.rstrip('/')}/sparkfold-{uuid.uuid4().hex}"


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """`df` written to the shared folder and read again: lineage is cut, and a lost executor costs nothing."""
    path = scratch(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._sparkfold_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table that stored() wrote; nothing may read it any more."""
    path = getattr(df, "_sparkfold_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str, text: str = "text") -> DataFrame:
    """doc_id and text alone (and `more`), whatever else the table has; null text becomes empty.

    Arrow batches hold fewer rows than by default, as rows of text are long; a session that has set a bound keeps its own."""
    conf = docs.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) == 10000:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    return docs.select("doc_id", F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), *more)


#: Text bytes of a training sample that go to the driver.
SAMPLE_BYTES = 24_000_000


def sample_texts(docs: DataFrame, ids: list, most_bytes: int = SAMPLE_BYTES, text: str = "text") -> list:
    """doc_id and whole text of the rows with these ids, as many as `most_bytes` take, by a checksum of the id; of rows that share an id, the one with the
    least text. `ids` are few (a bounded sample), and their lengths are read first, so no more than the bound is sent."""
    if not ids:
        return []
    spark, kind = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    few = lambda some: F.broadcast(spark.createDataFrame([(i,) for i in some], f"doc_id {kind}"))
    rows = texts(docs, text=text)
    size = {r.doc_id: r.n for r in rows.join(few(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.max(F.octet_length("text")).alias("n")).collect()}
    order = sorted(size, key=lambda i: (zlib.crc32(str(i).encode()), str(i)))
    total = np.cumsum([size[i] for i in order])
    kept = order[: int(np.searchsorted(total, most_bytes, "right"))]
    if not kept:
        return []
    return sorted(rows.join(few(kept), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")).collect(), key=lambda r: r.doc_id)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that `df` does not have."""
    taken = {c.lower() for c in df.columns}
    return [next(c for c in (f"{n}{k or ''}" for k in range(len(taken) + 1)) if c.lower() not in taken) for n in names]


def slices(batches: Iterator[pa.RecordBatch], col: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with about `most` bytes of text each, one row at least."""
    for b in batches:
        if not b.num_rows:
            continue
        k = b.schema.get_field_index(col)
        ends = offsets_of(b.column(k))
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + most, "right")) - 1)
            yield b.slice(lo, hi - lo)
            lo = hi
    release()


def release() -> None:
    """Give freed memory back: workers outlive their tasks, and what an idle one holds is missing elsewhere."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def _buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return o, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def offsets_of(col: pa.Array) -> np.ndarray:
    return _buffers(col)[0]


def bytes_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all text bytes, offsets of the rows in them) without a copy per row; nulls are empty."""
    o, data = _buffers(col)
    if col.null_count:
        col = pa.compute.fill_null(col, "" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
        o, data = _buffers(col)
    return data[o[0] : o[-1]], o - o[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, vectorised."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _M1
    x ^= x >> _U(27)
    x *= _M2
    x ^= x >> _U(31)
    return x


_LUT = mix(np.arange(1, 257, dtype=_U) * _BASE)
_POW: dict[str, np.ndarray] = {"up": np.ones(1, _U), "down": np.ones(1, _U)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64."""
    if len(_POW["up"]) < n:
        m = 1 << (n - 1).bit_length()
        for key, b in (("up", int(_BASE)), ("down", pow(int(_BASE), -1, 1 << 64))):
            a = np.full(m, b, _U)
            a[0] = 1
            _POW[key] = np.cumprod(a, dtype=_U)
    return _POW["up"][:n], _POW["down"][:n]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(data: np.ndarray, offs: np.ndarray, lower: bool = False, space: np.ndarray = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ (or without the bytes of `space`) of rows of text: start and end of each in `data`, its row, its 64-bit hash."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, _U)
    inside = np.zeros(n + 1, bool)
    inside[:n] = ~(_SPACE if space is None else space)[data]
    first = inside[:n].copy()
    first[1:] &= ~inside[: n - 1]
    begins = offs[:-1][offs[:-1] < offs[1:]]
    first[begins] = inside[begins]
    starts = np.flatnonzero(first)
    stop = inside.copy()
    stop[:n] &= ~inside[1:]
    last = begins[1:] - 1
    stop[last] = inside[last]
    ends = np.flatnonzero(stop) + 1
    if lower:
        data = _LOWER[data]
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, _U)
    np.cumsum(_LUT[data] * up[:n], out=sums[1:], dtype=_U)
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U) * _M2)
    return starts, ends, np.searchsorted(offs, starts, "right") - 1, hashes


def counts_of(rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, minlength=n).astype(np.int64)


def ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Concatenated aranges: starts[i] .. starts[i] + lens[i] - 1."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lens) - lens
    return np.repeat(starts - before, lens) + np.arange(total)


def covered(n: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Which of n places lie in any interval [lo, hi)."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, lo, 1)
    np.add.at(d, hi, -1)
    return np.cumsum(d[:n]) > 0
