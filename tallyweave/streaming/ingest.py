"""Incremental ingest: each new file once, rows deduplicated by key, pending rows kept as state.

Queries run with trigger(availableNow): they take what has landed since the last run and end. The checkpoint holds the
position, so there is no watermark table, and a run that fails halfway is repeated from there.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyweave.operators.store import shared_path

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def _rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that start in here keep their state in RocksDB, which has timers and holds more than memory does."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


def each_source(
    spark: SparkSession, sources: dict[str, Callable[[], DataFrame]], checkpoints: str | None = None,
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """((source, outcome) of every source, the new rows of those whose stream ended well).

    Each source is a streaming query of its own with a checkpoint of its own (below `checkpoints`), and all run side by
    side. One that can't be opened, or fails while it runs, is named as 'error:' and the kind of error; the others commit
    what they have read, once: 'ok:' and the number of rows.
    """
    root = checkpoints or shared_path(spark, "sources")
    started: dict[str, tuple[StreamingQuery, str, DataFrame]] = {}
    outcomes, rows = [], {}
    failed = lambda name, error: outcomes.append((name, f"error:{type(error).__name__}"))

    def into(out: str) -> Callable[[DataFrame, int], None]:
        """A batch that is sent again writes its own folder anew."""
        return lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    for name, read in sources.items():
        try:
            stream, out = read(), shared_path(spark, "source")
            writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{root}/{name}").foreachBatch(into(out))
            started[name] = writer.start(), out, stream
        except Exception as error:  # whatever a source does, it doesn't stop the others
            failed(name, error)
    for name, (query, out, stream) in started.items():
        try:
            query.awaitTermination()
            path = spark._jvm.org.apache.hadoop.fs.Path(out)
            none = not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)  # nothing was new
            rows[name] = spark.createDataFrame([], stream.schema) if none else spark.read.schema(stream.schema).parquet(f"{out}/batch=*")
            outcomes.append((name, f"ok:{rows[name].count()}"))
        except Exception as error:
            failed(name, error)
    return spark.createDataFrame(outcomes, "source string, outcome string"), rows


def landed(rows: DataFrame, files: int, inbox: str | None = None) -> str:
    """The folder to which rows are written as some files, as a feed would land them; a new one, or one more time `inbox`."""
    inbox = inbox or shared_path(rows.sparkSession, "inbox")
    rows.repartition(files).write.mode("append").parquet(inbox)
    return inbox


def folder_stream(spark: SparkSession, inbox: str, schema: str | None = None, files: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, so many files a batch."""
    source = spark.readStream.schema(schema or spark.read.parquet(inbox).schema).option("maxFilesPerTrigger", files)
    return source.parquet(inbox)


def table_stream(spark: SparkSession, sf_dir: str, table: str, files: int = 4) -> DataFrame:
    """A table's Parquet file or folder as a stream, a few files a batch."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    return source.option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{table}.parquet*")


def drain(
    stream: DataFrame, mode: str = "append", batch: Callable[[DataFrame, int], None] | None = None, checkpoint: str | None = None,
    out: str | None = None,
) -> DataFrame | None:
    """Run a stream over what is there, into a Parquet table or through a function of each batch; the table's rows."""
    spark = stream.sparkSession
    at = checkpoint or shared_path(spark, "stream-checkpoint")
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", at)
    with _rocksdb(spark):
        if batch is not None:
            writer.foreachBatch(batch).start().awaitTermination()
            return None
        out = out or shared_path(spark, "stream")
        writer.format("parquet").start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def deduplicated(stream: DataFrame, key: str, time: str, late: str = "60 days") -> DataFrame:
    """The first row of each key; keys are forgotten after the lateness, as sources are read again for no longer."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Rows by window and key; a window is written once the watermark has passed it."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n")).select(
        F.col("window.start").alias("start"), key, "n",
    )
