"""Files in and out: uploads, images, Parquet shards, state files, label lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.text import extension
from spindrift.schema import EXTENSIONS, MAX_UPLOAD_BYTES


def binary_files(spark: SparkSession, path: str, extensions: tuple[str, ...] = ()) -> DataFrame:
    """(path, modificationTime, length, content) of the files of a folder, those with the extensions where given."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if extensions:
        reader = reader.option("pathGlobFilter", "*.{" + ",".join([*extensions, *(e.upper() for e in extensions)]) + "}")
    return reader.load(path)


def parquet_files(spark: SparkSession, path: str) -> list[str]:
    """The Parquet files of a file or folder in order of path; none is an error.  Only names reach the driver."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select("path").orderBy("path").collect()
    if not found:
        raise FileNotFoundError(f"no Parquet file in {path}")
    return [r.path for r in found]


def write_files(rows: DataFrame, put: Callable[[str, bytes], None]) -> None:
    """Hands rows(path, content) to put, one after another, where the rows are: page images, thumbnails and crops go wherever put stores them.

    A task that is run again puts its files again, so put has to overwrite.
    """

    def each(part: Iterator) -> None:
        for row in part:
            if row.content is not None:
                put(row.path, bytes(row.content))

    rows.select("path", "content").foreachPartition(each)


def upload_code(name, size, pdf: bool = False) -> Column:
    """Why an upload is refused: 415 for its kind, 400 when it's empty, 413 when it's too large, in that order; else null.

    PDF files are a known kind that isn't taken yet, unless ``pdf``.
    """
    kinds = [e for e in EXTENSIONS if pdf or e != "pdf"]
    s = F.col(size) if isinstance(size, str) else size
    return F.when(~F.coalesce(extension(name).isin(*kinds), F.lit(False)), 415).when(s == 0, 400).when(s > MAX_UPLOAD_BYTES, 413).cast("int")


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """Files of a landing folder with the reason why each isn't taken; Spark's readers skip empty files."""
    return binary_files(spark, path).withColumn("code", upload_code("path", F.col("length")))


def verified_files(files: DataFrame, expected: DataFrame) -> DataFrame:
    """files(path, content) against expected(name, sha256): plus name and intact."""
    named = files.withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("sha256", F.sha2("content", 256))
    return named.join(expected.select("name", F.col("sha256").alias("wanted")), "name", "left").withColumn("intact", F.coalesce(F.lower("sha256") == F.lower("wanted"), F.lit(False))).drop("wanted")


def parquet_samples(spark: SparkSession, path: str, columns: tuple[str, ...] = ("image", "text")) -> DataFrame:
    """Samples of a Parquet file or a folder of them, only the columns asked for, with file and row index."""
    return spark.read.parquet(path).select(*columns, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def labels(spark: SparkSession, path: str, column: str = "text") -> DataFrame:
    return spark.read.parquet(path).select(column)


def shard_listing(listing: DataFrame, column: str = "value") -> DataFrame:
    """(name, size, sha256, shard) of the shards that a listing in JSON names; other entries are dropped."""
    entry = "array<struct<path: string, size: bigint, lfs: struct<oid: string>>>"
    rows = listing.select(F.explode(F.from_json(column, entry)).alias("e")).select(F.element_at(F.split("e.path", "/"), -1).alias("name"), F.col("e.size").alias("size"), F.col("e.lfs.oid").alias("sha256"))
    return rows.withColumn("shard", F.regexp_extract("name", "^train_shard_(\\d{3})", 1).try_cast("int")).where("shard is not null")


def json_state(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """A JSON document in each file, or, as write_report writes them, one in each line."""
    return spark.read.schema(schema).option("multiLine", str(not lines).lower()).json(path)


def write_label_list(rows: DataFrame, path: str) -> None:
    """rows(line_id, value) as text in order of line; sorted by range, so any number of files is in order."""
    rows.repartitionByRange("line_id").sortWithinPartitions("line_id").select("value").write.mode("overwrite").text(path)


def write_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def as_json(df: DataFrame, *columns: str) -> DataFrame:
    """One JSON text per row, of the columns that a view shows."""
    return df.select(F.to_json(F.struct(*(columns or df.columns)), {"ignoreNullFields": "false"}).alias("value"))
