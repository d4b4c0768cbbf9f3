"""Helpers shared by the operators: working tables on shared storage and byte-level word tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a Python task handles at once.
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`.

    Unset, a local master gets a temporary folder (tests); a cluster gets an error, since a machine's own
    folder can't be read by other machines.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lodestone-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Workspace:
    """Working tables of one operator call: written once as Parquet, so that a lost executor costs a reread only."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def table(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._lodestone_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a working table that nothing reads any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._lodestone_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def byte_table(keep: str) -> bytes:
    """A `bytes.translate` table: A-Z become a-z; ASCII bytes for which `keep` is false become spaces.

    keep: "alnum" keeps ASCII letters, digits and every byte from 0x80.
    """
    assert keep == "alnum"
    low = [b + 32 if 65 <= b <= 90 else b for b in range(256)]
    return bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in low)


#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of text with A-Z in lower case are `text.translate(ALNUM).split()`.
ALNUM = byte_table("alnum")


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `most` bytes of `column`, one row at least."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)


def raw(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    col = batch.column(column)
    return col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()
