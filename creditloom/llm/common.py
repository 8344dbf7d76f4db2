"""What the operators of this package share."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.session import clear_scratch, discard, scratch_dir, stored

__all__ = [
    "clear_scratch", "crc_of_id", "discard", "prepare", "ranked_blocks", "scratch_dir", "slices", "sorted_join", "stored",
    "table",
]

#: Rows handed to Python at a time; with very long texts the default of 10,000 would need gigabytes.
ROWS_PER_BATCH = 2000
ROOT = Path(__file__).resolve().parents[2]

_shipped: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Lets Python workers import this package and bounds the rows that they are handed at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    app = spark.sparkContext.applicationId
    on_path = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if app in _shipped or str(ROOT) in on_path:
        return
    _shipped.add(app)
    archive = os.path.join(tempfile.mkdtemp(), "creditloom.zip")  # only the driver reads it: Spark sends it on
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted((ROOT / "creditloom").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(archive)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sorted_join(rows: DataFrame) -> DataFrame:
    """The table, whose next join sorts both sides and sends neither whole to the driver and to every task.

    For tables that grow with the input: Spark does not count the rows that an explode adds, and takes a file's size for
    that of its rows, so it would broadcast them up to a size that the driver cannot hold.
    """
    return rows.hint("merge")


def crc_of_id(column: str = "doc_id") -> Column:
    """CRC-32 of the id written as decimal text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of few rows, to bound what Python holds at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def raw(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """Text column as UTF-8 bytes, null as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def ranked_blocks(rows: int, target: int) -> int:
    """Number of blocks that hold about ``target`` rows each."""
    return max(1, -(-rows // target))
