"""Compaction of any long text output, and the report on what it saves. A text is a row: one Arrow pass, no shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfold.captures import generic as G


def _texts(bodies: DataFrame, key: str, body: str) -> tuple[DataFrame, str]:
    rows = bodies.select(F.col(key).alias("key"), F.coalesce(F.col(body).cast("string"), F.lit("")).alias("text"))
    return rows, dict(rows.dtypes)["key"]


def compact(bodies: DataFrame, key: str = "capture_id", body: str = "body", threshold: int = 4096) -> DataFrame:
    """key, line_no, line, n, blank_before: cleaned lines without repeats. A line seen three times or more in the body stays where it first
    is, with its count; one seen twice stays at each place it is not next to itself. `blank_before` says that an empty line goes before it.
    Bodies that are short, JSON or binary give nothing."""
    rows, kind = _texts(bodies, key, body)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(k, G.folded(t)) for k, t in enumerate(b.column(1).to_pylist()) if G.fits(t, threshold)]
            flat = [x for _, f in found for x in f]
            owner = pa.array([k for k, f in found for _ in f], pa.int32())
            cols = [pa.array([x[c] for x in flat], t) for c, t in enumerate((pa.int32(), pa.string(), pa.int64(), pa.bool_()))]
            yield pa.record_batch([b.column(0).take(owner), *cols], names=["key", "line_no", "line", "n", "blank_before"])

    return rows.mapInArrow(run, f"key {kind}, line_no int, line string, n long, blank_before boolean").withColumnRenamed("key", key)


def report(bodies: DataFrame, key: str = "capture_id", body: str = "body", threshold: int = 4096) -> DataFrame:
    """key, raw_bytes, displayed_bytes, omitted_bytes, saved_percent of every body; those without a compact form are shown whole."""
    rows, kind = _texts(bodies, key, body)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            raw = [len(t.encode()) for t in texts]
            shown = [n if (c := G.compact(t) if G.fits(t, threshold) else None) is None else len(c.encode()) for t, n in zip(texts, raw)]
            yield pa.record_batch([b.column(0), pa.array(raw, pa.int64()), pa.array(shown, pa.int64())], names=["key", "raw_bytes", "displayed_bytes"])

    sizes = rows.mapInArrow(run, f"key {kind}, raw_bytes long, displayed_bytes long").withColumnRenamed("key", key)
    omitted = F.greatest(F.lit(0), F.col("raw_bytes") - F.col("displayed_bytes")).cast("long")
    saved = F.when(F.col("raw_bytes") == 0, 0).otherwise(F.expr("omitted_bytes * 100 div raw_bytes")).cast("long")
    return sizes.withColumn("omitted_bytes", omitted).withColumn("saved_percent", saved)


def rendered(compacted: DataFrame, key: str = "capture_id") -> DataFrame:
    """One body per capture out of the lines of compact()."""
    from sparkfold.functions import lines as L

    out = F.concat(F.when(F.col("blank_before"), "\n").otherwise(""), "line", F.when(F.col("n") > 1, F.concat(F.lit(" ×"), F.col("n").cast("string"))).otherwise(""))
    return L.render(compacted.withColumn("line", out), key)
