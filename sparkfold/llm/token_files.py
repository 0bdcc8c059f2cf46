"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

An id is replaced by its rank by corpus frequency, so frequent ids take one byte. Four ids share a control byte that
holds two bits each (bytes used, less one); the data bytes lie in a stream of their own. Decoding looks the lengths of
four ids up in a 256-row table at once and gathers bytes with numpy.

A file is a Parquet part with one row per block of documents: `shard`, `block` and `first` (ids of the shard before
the block) as integers; `docs`, `sizes` (little-endian 64- and 32-bit), `control` and `data` as bytes. Each document
begins at a control byte. Spark's committer writes the parts, so lost executors and retries leave no half files; shards
and blocks are in ascending order of document id. `ranks` beside it maps ranks back to ids.

Ids are counted and checked where they are made, and ranked and coded after the exchange, a slice of documents at once, so
Python sees each id once on the way in and once on the way out.

Null text is empty (its ids are the end id alone). A null doc_id sorts first. Repeated rows are kept, tied ids ordered
by checksum; an empty table gives empty files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfold.llm import common
from sparkfold.llm.wordpieces import encoder

#: Data bytes after which a block ends.
BLOCK_BYTES = 1 << 20

#: Bytes that each of a control byte's four ids takes, and their sum.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
TOTAL = LENGTHS.sum(1)


def pack_all(ranks: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(control, data, control bytes of each document, data bytes of each) of documents of `sizes` ids laid one after another; the
    spare slots of a document's last control byte are zero."""
    r = ranks.astype(np.uint32, copy=False)
    size = np.ones(len(r), np.uint8)
    for k in (8, 16, 24):
        size += r >> np.uint32(k) != 0
    groups = -(-sizes // 4)
    code = np.zeros(4 * int(groups.sum()), np.uint8)
    code[common.ranges(4 * (np.cumsum(groups) - groups), sizes)] = size - 1
    control = code[0::4] | code[1::4] << 2 | code[2::4] << 4 | code[3::4] << 6
    ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    at = ends[:-1]
    data = np.empty(int(ends[-1]), np.uint8)
    data[at] = r  # the lowest byte
    for k in (1, 2, 3):
        longer = np.flatnonzero(size > k)
        data[at[longer] + k] = r[longer] >> np.uint32(8 * k)
    return control, data, groups, np.diff(ends[np.concatenate([[0], np.cumsum(sizes)])])


def pack_ids(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of one document's ranks."""
    control, data, _, _ = pack_all(ranks, np.array([len(ranks)]))
    return control.tobytes(), data.tobytes()


def unpack_ids(control: bytes, data: bytes, sizes: np.ndarray) -> np.ndarray:
    """Ranks of the documents whose numbers of ids are `sizes`, laid one after another in the two streams."""
    c = np.frombuffer(control, np.uint8)
    d = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)])
    groups = -(-sizes // 4)
    used = np.arange(4) < np.minimum(4, np.repeat(sizes, groups) - 4 * common.ranges(np.zeros(len(sizes), np.int64), groups))[:, None]
    lens = LENGTHS[c][used]
    at = np.cumsum(lens) - lens
    out = d[at].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(lens > k)
        out[longer] |= d[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Rows of bytes that end at `ends` of `data`, without a copy per row."""
    offs = np.concatenate([[0], ends])
    wide = offs[-1] >= 1 << 31
    made = (pa.LargeBinaryArray if wide else pa.BinaryArray).from_buffers(pa.large_binary() if wide else pa.binary(), len(ends), [None, pa.py_buffer(offs.astype(np.int64 if wide else np.int32)), pa.py_buffer(data)])
    return made


def encode_ids(docs: DataFrame, vocabulary: str, end_id: int | None = 1, text: str = "text", counted: bool = False, wide: bool = False) -> DataFrame:
    """doc_id, n, crc (of the ids as little-endian 32-bit integers) and `ids` (little-endian 32-bit, or 16-bit where `width` is 2, never so if
    `wide`) of every whole text, the end id appended. If `counted`, each task adds a last row, which alone has `counts`: how often it met each id."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        width = 2 if not wide and enc.library.get_vocab_size() <= 1 << 16 and (end_id or 0) < 1 << 16 else 4
        tail = int(end_id is not None)
        total = np.zeros(max(enc.library.get_vocab_size(), (end_id or 0) + 1), np.int64)
        schema = None
        for b in common.slices(batches):
            own, n = enc.encode(*common.bytes_of(b.column(1)))
            n = n + tail
            ends = np.cumsum(n)
            ids = np.full(int(n.sum()), end_id or 0, "<u4")
            ids[common.ranges(ends - n, n - tail)] = own
            raw = memoryview(ids.tobytes())
            sums = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist())]
            row = {"doc_id": b.column(0), "width": pa.array(np.full(len(n), width, np.int32)), "n": pa.array(n), "crc": pa.array(sums, pa.int64()), "ids": _binary(ids.astype(f"<u{width}").view(np.uint8), ends * width)}
            if counted:
                total += np.bincount(ids, minlength=len(total))
                row["counts"] = pa.nulls(len(n), pa.binary())
            out = pa.record_batch(row)
            schema = out.schema
            yield out
        if counted and schema is not None:
            yield pa.record_batch([pa.nulls(1, f.type) for f in schema][:-1] + [pa.array([total.astype("<i8").tobytes()], pa.binary())], schema=schema)

    return common.texts(docs, text=text).mapInArrow(run, f"doc_id {kind}, width int, n long, crc long, ids binary" + ", counts binary" * counted)


def rank_table(encoded: DataFrame) -> np.ndarray:
    """Ids by falling frequency over the whole corpus, ties to the smaller id, from the counts of encode_ids(). As many entries as ids
    occur: at most the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            for x in b.column(0):
                n = np.frombuffer(x.as_buffer(), "<i8")
                total = n.copy() if not len(total) else total + n
        some = np.flatnonzero(total)
        yield pa.record_batch({"id": pa.array(some, pa.int64()), "n": pa.array(total[some], pa.int64())})

    got = encoded.where("counts is not null").select("counts").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return np.array([r.id for r in sorted(got, key=lambda r: (-r.n, r.id))], np.uint32)


def write(docs: DataFrame, vocabulary: str, path: str, end_id: int | None = 1, text: str = "text", partitions: int | None = None) -> DataFrame:
    """Write the token files of `docs` under `path`; returns the block table as read back from there (with the ranks as `path`/ranks)."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    encoded = common.stored(encode_ids(docs, vocabulary, end_id, text, counted=True))
    ids = rank_table(encoded)
    spark.createDataFrame([(int(k), int(i)) for k, i in enumerate(ids)], "rank long, id long").coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(int(ids.max(initial=0)) + 1, np.uint32)
    rank_of[ids] = np.arange(len(ids), dtype=np.uint32)

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, first = TaskContext.get().partitionId(), 0, 0
        docs, sizes, control, data, size = [], [], [], [], 0

        def flush():
            row = {"shard": [shard], "block": [number], "first": [first], "n_ids": [int(sum(s.sum() for s in sizes))], "docs": [pa.concat_arrays(docs)], "sizes": [np.concatenate(sizes).astype("<u4").tobytes()], "control": [b"".join(control)], "data": [b"".join(data)]}
            return pa.record_batch([pa.array(row[f.name], f.type) if f.name != "docs" else pa.ListArray.from_arrays(pa.array([0, len(row["docs"][0])], pa.int32()), row["docs"][0]) for f in schema], schema=schema)

        for b in common.slices(batches, "ids"):
            schema = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("first", pa.int64()), ("n_ids", pa.int64()), ("docs", pa.list_(b.column(0).type)), ("sizes", pa.binary()), ("control", pa.binary()), ("data", pa.binary())])
            n = b.column(2).to_numpy()
            raw, _ = common.bytes_of(b.column(3))
            c, d, groups, lens = pack_all(rank_of[raw.view(f"<u{b.column(1)[0].as_py()}")], n)
            cuts, c_ends, d_ends = (np.concatenate([[0], np.cumsum(x)]) for x in (groups + lens + 12, groups, lens))
            lo = 0
            while lo < len(n):  # up to the document that fills the block
                hi = min(len(n), int(np.searchsorted(cuts, cuts[lo] + BLOCK_BYTES - size)))
                docs.append(b.column(0).slice(lo, hi - lo))
                sizes.append(n[lo:hi])
                control.append(c[c_ends[lo] : c_ends[hi]].tobytes())
                data.append(d[d_ends[lo] : d_ends[hi]].tobytes())
                size += int(cuts[hi] - cuts[lo])
                if size >= BLOCK_BYTES:
                    yield flush()
                    number, first, size = number + 1, first + int(sum(s.sum() for s in sizes)), 0
                    docs, sizes, control, data = [], [], [], []
                lo = hi
        if docs:
            yield flush()

    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = encoded.where("counts is null").select("doc_id", "width", "n", "ids", "crc")
    ordered = rows.repartitionByRange(parts, "doc_id", "crc").sortWithinPartitions("doc_id", "crc", "n").drop("crc")
    ordered.mapInArrow(block, f"shard long, block long, first long, n_ids long, docs array<{kind}>, sizes binary, control binary, data binary").write.option("compression", "none").parquet(f"{path}/blocks")
    common.discard(encoded)
    return spark.read.parquet(f"{path}/blocks")


def read(spark, path: str, with_ids: bool = True) -> DataFrame:
    """One row per document of the files under `path`: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and its ids."""
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["docs"].dataType.elementType.simpleString()
    ids = np.zeros(spark.read.parquet(f"{path}/ranks").count(), np.uint32)
    for r in spark.read.parquet(f"{path}/ranks").collect():
        ids[r.rank] = r.id
    base, before = {}, 0
    for r in blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect():  # a row per written part
        base[r.shard], before = before, before + r.n

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                shard, first, docs, sizes, control, data = (b.column(j)[k] for j in range(6))
                n = np.frombuffer(sizes.as_buffer(), "<u4").astype(np.int64)
                own = ids[unpack_ids(control.as_buffer(), data.as_buffer(), n)].astype("<u4")
                ends = np.cumsum(n)
                raw = memoryview(own.tobytes())
                parts = [raw[4 * (e - s) : 4 * e] for e, s in zip(ends.tolist(), n.tolist())]
                row = {"doc_id": docs.values, "start": pa.array(ends - n + base[shard.as_py()] + first.as_py()), "n_tokens": pa.array(n), "ids_crc32": pa.array([zlib.crc32(p) for p in parts], pa.int64())}
                if with_ids:
                    row["ids"] = pa.array([np.frombuffer(p, "<u4") for p in parts], pa.list_(pa.int64()))
                yield pa.record_batch(row)

    schema = f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return blocks.select("shard", "first", "docs", "sizes", "control", "data").mapInArrow(decode, schema)


def op1_token_files(spark, sf_dir: str) -> DataFrame:
    path = common.scratch(spark)
    write(common.table(spark, sf_dir, "documents"), common.tokenizer_path("word_bpe_49k.json"), path)
    return read(spark, path, with_ids=False)
