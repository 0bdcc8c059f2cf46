"""Readers: the tables of a folder, session logs, and whole files as captures."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same table as a stream of its files; a table that is a single file is found by its name."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    folder = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = spark.readStream.schema(table(spark, sf_dir, name).schema)
    return reader.parquet(f"{sf_dir}/{name}.parquet") if folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def views(spark: SparkSession, sf_dir: str) -> None:
    """The tables that captures are built from, as views of their names."""
    for name in ("region", "nation", "supplier", "part", "orders", "lineitem", "events", "documents"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def files(spark: SparkSession, path: str) -> DataFrame:
    """capture_id (the path) and body of each file, bytes kept as they are."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("capture_id"), F.col("content").cast("string").alias("body"))


def sessions(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """path and `record` (a variant) of each valid line of the session logs anywhere below `path`; lines that are no JSON are dropped."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    return lines.select("path", F.try_parse_json("value").alias("record")).where("record is not null")


def scratch(spark: SparkSession) -> str:
    """A fresh folder path under spark.checkpoint.dir. Where that is unset, a temporary folder in local mode; on a cluster an error, as executors would
    write to disks of their own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="sparkfold-")
        atexit.register(shutil.rmtree, base, True)
        base = f"file://{base}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/sparkfold-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read again: it is computed once, and a lost executor costs nothing."""
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
