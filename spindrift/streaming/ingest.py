"""Incremental ingestion: a landing folder is drained into tables, resumable from its checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.sources.files import upload_code
from spindrift.storage import own_folder


def drain(stream: DataFrame, process: Callable[[DataFrame, int], None], checkpoint: str) -> int:
    """Runs process(batch, number) on everything that is there, exactly once per input; returns batches run.

    A later call with the same checkpoint goes on where this one stopped.
    """
    run = stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    if run.exception() is not None:
        raise run.exception()
    return len([p for p in run.recentProgress if p["numInputRows"]])


def ingest_uploads(spark: SparkSession, landing: str, out: str, checkpoint: str, recognise: Callable[[DataFrame], DataFrame] | None = None) -> int:
    """Uploads of a landing folder: those that aren't taken go to ``out``/refused, the others through
    ``recognise`` to ``out``/pages.  Each batch overwrites its own folder, so a batch that is run again
    leaves no rows twice."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(landing)

    def process(batch: DataFrame, number: int) -> None:
        seen = batch.withColumn("code", upload_code("path", F.col("length")))
        seen.where("code is not null").select("path", "length", "code").write.mode("overwrite").parquet(f"{out}/refused/batch={number}")
        taken = seen.where("code is null").drop("code")
        (recognise(taken) if recognise else taken.select("path", "length")).write.mode("overwrite").parquet(f"{out}/pages/batch={number}")

    return drain(stream, process, checkpoint)


def pending(pages: DataFrame, done: DataFrame, key: str = "page_id") -> DataFrame:
    """Pages that still have to be processed."""
    return pages.join(done.select(key).distinct(), key, "left_anti")


def daily_counts(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """stream(ts, event_type) counted by day and type, with a watermark; complete once a day is over."""
    timed = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "event_type", "n")


def drain_events(spark: SparkSession, path: str) -> DataFrame:
    """Counts per event type of a Parquet folder or file, ingested as a stream and written batch by batch."""
    folder = own_folder(spark, "stream")
    schema = spark.read.parquet(path).schema
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        # a stream reads folders: the file's folder, and of it this file
        stream = reader.option("pathGlobFilter", at.getName()).parquet(str(at.getParent().toString()))
    else:
        stream = reader.parquet(path)

    def process(batch: DataFrame, number: int) -> None:
        batch.groupBy("event_type").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    drain(stream, process, f"{folder}/checkpoint")
    return spark.read.schema("event_type string, n long, batch int").parquet(f"{folder}/out").groupBy("event_type").agg(F.sum("n").alias("n"))
