"""Where tables that are written on the way live: the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir.  Where it's unset a local session, as in tests, gets a folder of its own; a cluster has none to share, which is an error."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = _made.get(sc.applicationId)
        if found is None:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
            found = _made[sc.applicationId] = tempfile.mkdtemp(prefix="checkpoints-")
            atexit.register(shutil.rmtree, found, True)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(found)
    return found


def own_folder(spark: SparkSession, kind: str) -> str:
    """A new place in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/{kind}/{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: lineage ends here and partitions stay as they are."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def keep(df: DataFrame, compression: str | None = None) -> DataFrame:
    """The rows as a Parquet table in the shared folder; compact, for what is large or read more than once."""
    path = own_folder(df.sparkSession, "tables")
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep_together(df: DataFrame, key: str) -> tuple[DataFrame, str]:
    """(the rows as a Parquet table in the shared folder, its path).  Rows of a key stand in one file and Spark knows: joins and groups by it leave them where they are."""
    spark = df.sparkSession
    path, name, n = own_folder(spark, "tables"), f"kept_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, key).write.bucketBy(n, key).option("path", path).option("compression", "zstd").saveAsTable(name)
    kept = spark.table(name)
    spark.sql(f"drop table {name}")  # the name only; the files stay
    spark.sparkContext._jvm.System.gc()  # what was shuffled for it goes now, not when the driver happens to collect its garbage
    return kept, path


def discard(spark: SparkSession, path: str) -> None:
    """Removes a kept table that nothing will read again."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs meanwhile sends at most so many rows at once to Python workers, for rows as large as images."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    most = int(before)
    spark.conf.set(name, str(rows if most <= 0 else min(rows, most)))
    try:
        yield
    finally:
        spark.conf.set(name, before)
