"""A streaming face of the batch model (an extension: batches are the model; Spark's streams deliver them).

Batches of signals in a folder are merged as they come; each merge is idempotent, so a repeated delivery changes
nothing. Counts over event time use watermarks, so their state is bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.merge import insert_signals
from lodestone.operators.rounds import stored

SIGNALS = "company_id string, type string, label string, date string, source string"


def signal_stream(spark: SparkSession, folder: str, per_trigger: int = 50) -> DataFrame:
    """New JSON files of signals in a folder."""
    return spark.readStream.schema(SIGNALS).option("maxFilesPerTrigger", per_trigger).json(folder)


def commits(spark: SparkSession, target: str) -> list[int]:
    """The numbers of the batches that are whole, in order."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/commits")
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    return sorted(int(f.getPath().getName()[2:]) for f in files.listStatus(root) if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS")))


def versions(spark: SparkSession, target: str, before: int | None = None) -> dict[int, int]:
    """By part the batch that wrote it last, as the newest commit says (or the newest before a batch)."""
    known = [n for n in commits(spark, target) if before is None or n < before]
    return {r.part: r.batch for r in spark.read.parquet(f"{target}/commits/b={known[-1]}").collect()} if known else {}


def read_parts(spark: SparkSession, target: str, parts: dict[int, int]) -> DataFrame:
    paths = [f"{target}/parts/p={p}/b={b}" for p, b in sorted(parts.items())]
    return spark.read.schema(SIGNALS).parquet(*paths) if paths else spark.createDataFrame([], SIGNALS)


def current(spark: SparkSession, target: str) -> DataFrame:
    """The table that merge_stream keeps, as the newest commit has it."""
    return read_parts(spark, target, versions(spark, target))


def merge_stream(stream: DataFrame, known: DataFrame, target: str, checkpoint: str, n_parts: int = 64) -> StreamingQuery:
    """Insert-or-ignore every batch into a table in parts by a hash of the company (K-02, U-02, U-13).

    A batch reads and writes the parts that it touches only, as parts/p=<part>/b=<batch>; then a commit says which batch
    wrote each part last, and readers follow the newest commit. A batch that is delivered again starts from the commit
    before it and writes the same; versions that two commits no longer name are removed.
    """
    spark = stream.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        part = F.pmod(F.xxhash64("company_id"), F.lit(n_parts)).cast("int")
        before = versions(spark, target, number)
        rows = stored(batch.select(*[f.name for f in batch.schema.fields]))
        touched = [r.part for r in rows.select(part.alias("part")).distinct().collect()]  # n_parts at most
        after = dict(before)
        for p in sorted(touched):
            old = read_parts(spark, target, {p: before[p]} if p in before else {})
            insert_signals(old, rows.where(part == p), known).write.mode("overwrite").parquet(f"{target}/parts/p={p}/b={number}")
            after[p] = number
        spark.createDataFrame(sorted(after.items()), "part int, batch int").coalesce(1).write.mode("overwrite").parquet(f"{target}/commits/b={number}")
        earlier = [n for n in commits(spark, target) if n < number]
        if len(earlier) > 1:
            path = spark._jvm.org.apache.hadoop.fs.Path
            files = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
            oldest = {r.part: r.batch for r in spark.read.parquet(f"{target}/commits/b={earlier[0]}").collect()}
            for p, b in oldest.items():
                if before.get(p) != b:
                    files.delete(path(f"{target}/parts/p={p}/b={b}"), True)
            files.delete(path(f"{target}/commits/b={earlier[0]}"), True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """(window_start, event_type, n, total) over tumbling or sliding windows; rows later than the watermark are dropped in a stream."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    out = events.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, session_start, n) of events with less than a gap between them."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    out = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("session_start"), "n")
