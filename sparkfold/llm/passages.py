"""What the two passage-removing operators share: copies set apart, texts written once by document, anchors of windows.

A window (so many bytes, or words) takes as its anchor the least hash of the shorter grams within it. Equal windows have
equal anchors, so only windows whose anchor occurs twice in the corpus can repeat, and these few are compared by content.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfold.llm import common


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """out[i] = min(a[i : i + w]) for every whole window, by doubling."""
    if len(a) < w:
        return a[:0]
    out, k = a, 1
    while k * 2 <= w:
        out = np.minimum(out[:-k], out[k:])
        k *= 2
    r = w - k
    return np.minimum(out[:-r], out[r:]) if r else out


@dataclass
class Corpus:
    """rows: every input row (doc_id, h1, `first`: the least doc_id with the same text, and the columns of `about`);
    texts: doc_id, h1, text of one row of each text, the one with the least doc_id, in buckets by doc_id."""

    rows: DataFrame
    texts: DataFrame
    _table: str

    def drop(self) -> None:
        self.texts.sparkSession.sql(f"DROP TABLE IF EXISTS {self._table}")


def corpus(docs: DataFrame, about: dict[str, Column], text: str = "text") -> Corpus:
    """Copies are found by two 64-bit hashes of the text, grouped with partial sums, so a text that a third of all rows share
    meets nowhere; only one row of each text goes on. `about`: expressions over doc_id and text to keep of every row."""
    spark = docs.sparkSession
    own = common.texts(docs, text=text).withColumn("h1", F.xxhash64("text")).withColumn("h2", F.xxhash64(F.lit(1), "text"))
    rows = common.stored(own.select("doc_id", "h1", "h2", *[c.alias(k) for k, c in about.items()]))
    firsts = rows.where("doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("first"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"sparkfold_{uuid.uuid4().hex}"
    kept = own.join(firsts.select(F.col("first").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id", "h1"])
    kept.select("doc_id", "h1", "text").write.option("compression", "zstd").bucketBy(n, "doc_id").saveAsTable(name)
    return Corpus(rows.join(firsts, ["h1", "h2"], "left").drop("h2"), spark.table(name), name)


def repeated(c: Corpus, keys: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """c.texts with `keys`: those of the text's window keys that the corpus holds twice; texts without any are left out.
    keys(data, offs) -> (keys of all texts, number of each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            k, n = keys(*common.bytes_of(b.column(1)))
            yield pa.record_batch({"doc_id": b.column(0), "key": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(k.view(np.int64)))})

    kind = dict(c.texts.dtypes)["doc_id"]
    found = c.texts.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, key array<long>").select("doc_id", F.explode("key").alias("key"))
    often = found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    hits = found.join(often, "key").groupBy("doc_id").agg(F.collect_set("key").alias("keys"))
    return c.texts.join(hits, "doc_id")
