"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters of ``[\x20\x09-\x0D]``.
ASCII_SPACE = " \t\n\x0b\f\r"

#: Rows and UTF-8 bytes of text that a Python task looks at together.
BLOCK_ROWS, BLOCK_BYTES = 512, 2 << 20


def shared_folder(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a local session names none, as in tests, a local folder is made once
    and noted in the session; on a cluster the setting is required.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.conf.get("postmill.shared.dir", None)
    if not named:
        if not spark.conf.get("spark.master", "local").split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="postmill-")
        spark.conf.set("postmill.shared.dir", named)
    return named.rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts lineage
    in a form that outlives any executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.shared_path = path
    return found


def discard(df: DataFrame) -> None:
    """Remove the files of a materialised table that nothing reads any more."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df.shared_path)
    path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bounded_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """``df``; its session hands Python at most ``rows`` rows at a time, so
    that a run of very long texts does not fill a worker's memory."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    return df


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", rows: int = BLOCK_ROWS, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each piece holds a bounded amount of text
    (one row at least, however long)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start = size = 0
        for i, n in enumerate(lengths):
            if i > start and (size + n > most or i - start >= rows):
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += int(n)
        yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [t or "" for t in batch.column(name).to_pylist()]
