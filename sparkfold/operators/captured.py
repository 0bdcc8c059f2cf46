"""Forms over tables of captures. A capture is a row, so this is one Arrow pass where the row lies: no shuffle, no window.

Columns: `key`, stdout, stderr, exit_code, and the form's name, or null for none. Null streams are empty. A row whose form does not know its
text, whose command failed and whose form is not for failures, or whose streams reach 16 MiB, stays as it is (`evidence` ByteExact).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfold.captures.registry import FORMS

#: Bytes of a stream from which on it is not looked into.
MOST_BYTES = 16 << 20


def compact(captures: DataFrame, form: Column | str, key: str = "capture_id") -> DataFrame:
    """key, out_stdout, out_stderr, filter_name, evidence. `form`: a column with the form's name, or one name for all."""
    name = F.lit(form) if isinstance(form, str) else form
    has = set(captures.columns)
    stream = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in has else F.lit("")
    code = F.coalesce(F.col("exit_code").cast("int"), F.lit(0)) if "exit_code" in has else F.lit(0)
    rows = captures.select(F.col(key).alias("key"), stream("stdout").alias("stdout"), stream("stderr").alias("stderr"), code.alias("exit_code"), name.alias("form"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for stdout, stderr, code, name in zip(*(b.column(k).to_pylist() for k in range(1, 5))):
                f = FORMS.get(name)
                evidence = f and (f.evidence if code == 0 else f.failed)
                small = max(len(stdout), len(stderr)) * 4 < MOST_BYTES or max(len(stdout.encode()), len(stderr.encode())) < MOST_BYTES
                got = f.streams(stdout, stderr, code) if evidence and small else None
                for column, value in zip(out, (*got, f.family, evidence) if got else (stdout, stderr, "passthrough", "ByteExact")):
                    column.append(value)
            yield pa.record_batch([b.column(0), *(pa.array(c, pa.string()) for c in out)], names=["key", "out_stdout", "out_stderr", "filter_name", "evidence"])

    kind = dict(rows.dtypes)["key"]
    done = rows.mapInArrow(run, f"key {kind}, out_stdout string, out_stderr string, filter_name string, evidence string")
    return done.withColumnRenamed("key", key)


def shown(compacted: DataFrame, key: str = "capture_id") -> DataFrame:
    """key, line_no, line of both streams, one after the other; a line feed at the end ends the last line."""
    text = F.concat("out_stdout", "out_stderr")
    rows = F.when(text != "", F.split(F.regexp_replace(text, r"\n\z", ""), "\n"))
    return compacted.select(key, F.posexplode(rows).alias("line_no", "line")).select(key, F.col("line_no").cast("long").alias("line_no"), "line")
