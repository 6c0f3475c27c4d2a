"""Token counts of flat token files: a separator scan.

A flat file holds nothing but ids, 16 or 32 bits each, with an end-of-document id after each document;
no index says where documents lie.  Each file is searched in blocks, with one vectorised comparison a
block; a block reports where its separators are.  A prefix scan over the blocks of a file (a running
sum of separators, a running maximum of the place after the last one) then tells every block how many
documents came before it and where the one began that it starts in the middle of.

A file of up to MOST_BYTES is one value, searched in blocks.  A larger one is read in byte ranges, each a
task's: Spark's text reader finds the separator's bytes, and since those may also straddle two ids, a
prefix scan over the ranges' byte counts tells which of them lie on a whole id; the others are put
together again.

Defined results: two separators in a row are an empty document (0 tokens); ids after the last
separator are one more document with ``ended`` false; an empty file has no documents; files are told
apart by their path, so equal files count each; a file whose size isn't a whole number of ids fails.
For ``write_token_files``: a null text is the empty text, a document of 0 tokens; repeated rows are
written each; other columns are ignored; an empty table writes no documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.llm.tokens import tokenizer, tokenizer_path
from spindrift.llm.wordscan import slices, texts_of
from spindrift.storage import keep, own_folder

END = 49407
WIDTH = 2
#: Ids in a block.
BLOCK = 1 << 16
#: Bytes of a record that is written, unless a document alone is larger, and records in a file.
RECORD_BYTES = 1 << 22
RECORDS = 32
#: Larger files are read in ranges.
MOST_BYTES = 1 << 28


def write_token_files(docs: DataFrame, out: str, path: str | None = None, end: int = END, width: int = WIDTH) -> None:
    """Writes the ids of documents(text) to flat files in the folder ``out``."""
    path = path or tokenizer_path()
    kind = np.dtype(f"<u{width}")

    def record(held: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([end.to_bytes(width, "little").join(held)], pa.binary())], names=["raw"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, held, size = tokenizer(path, plain=True), [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                ids, per = t.encode(texts_of(part.column("text")))
                raw, ends = ids.astype(kind).tobytes(), (np.cumsum(per) * width).tolist()
                for a, b in zip([0, *ends], ends, strict=False):
                    if held and size + b - a > RECORD_BYTES:
                        yield record(held)
                        held, size = [], 0
                    held.append(raw[a:b])
                    size += b - a + width
        if held:
            yield record(held)

    # documents are joined by the separator's bytes; the text writer puts them after each value, too, and hands the value's bytes through
    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(encode, "raw binary").select(F.col("raw").cast("string").alias("value"))
    separator = end.to_bytes(width, "little").decode("latin-1")
    rows.write.option("lineSep", separator).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", RECORDS).text(out)


def separator_scan(spark: SparkSession, files: str, end: int = END, width: int = WIDTH, block: int = BLOCK, most: int = MOST_BYTES) -> DataFrame:
    """(path, ordinal, start, n_tokens, ended) of every document in the flat files of a folder or pattern."""
    found = block_scan(spark, files, end, width, block, most)
    large = spark.read.format("binaryFile").load(files).where(F.col("length") > most).select("length").limit(1).count()  # no content is read
    return found.unionByName(range_scan(spark, files, end, width, most)) if large else found


def range_scan(spark: SparkSession, files: str, end: int = END, width: int = WIDTH, least: int = 0) -> DataFrame:
    """As separator_scan, for files of more than ``least`` bytes, read in byte ranges."""
    separator = end.to_bytes(width, "little")
    if any(separator[i:] == separator[: width - i] for i in range(1, width)):
        raise ValueError(f"the bytes of {end} may overlap themselves, so ranges can't be searched for them")
    meta = [F.col(f"_metadata.{c}").alias(c) for c in ("file_path", "file_size", "file_block_start")]
    read = spark.read.option("lineSep", separator.decode("latin-1")).option("encoding", "ISO-8859-1").text(files).select("value", *meta).where(F.col("file_size") > least)
    whole = F.when(F.col("file_size") % width == 0, F.octet_length("value").cast("long")).otherwise(F.raise_error(F.concat("file_path", F.lit(f" is not a whole number of {width}-byte ids")).cast("string")).cast("long"))
    pieces = read.select(F.col("file_path").alias("path"), "file_size", F.col("file_block_start").alias("range"), F.monotonically_increasing_id().alias("at"), whole.alias("size"))

    def ahead(rows: DataFrame, value: str) -> DataFrame:
        """rows plus ``before``: the sum of value over all pieces before, from one total per range."""
        totals = rows.groupBy("path", "range").agg(F.sum(value).alias("total"))
        totals = totals.withColumn("earlier", F.sum("total").over(Window.partitionBy("path").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")).drop("total")
        inside = Window.partitionBy("path", "range").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn("inside", F.sum(value).over(inside) - F.col(value)).join(totals, ["path", "range"]).withColumn("before", F.col("inside") + F.col("earlier")).drop("inside", "earlier")

    placed = ahead(keep(pieces).withColumn("bytes", F.col("size") + width), "bytes").withColumnRenamed("before", "start")
    # a separator counts if it lies on a whole id and inside the file
    cuts = placed.withColumn("cut", ((F.col("start") + F.col("size")) % width == 0).cast("long") * (F.col("start") + F.col("size") < F.col("file_size")).cast("long"))
    documents = ahead(keep(cuts), "cut").groupBy("path", F.col("before").alias("ordinal")).agg(F.min("start").alias("first"), F.max(F.col("start") + F.col("size")).alias("stop"), (F.max("cut") == 1).alias("ended"))
    return documents.select("path", "ordinal", F.expr(f"first div {width}").alias("start"), F.expr(f"(stop - first) div {width}").alias("n_tokens"), "ended")


def block_scan(spark: SparkSession, files: str, end: int = END, width: int = WIDTH, block: int = BLOCK, most: int = MOST_BYTES) -> DataFrame:
    """As separator_scan, for files of at most ``most`` bytes."""
    kind = np.dtype(f"<u{width}")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                raw = content.as_buffer()
                if len(raw) % width:
                    raise ValueError(f"{name}: {len(raw)} bytes are not a whole number of {width}-byte ids")
                ids = np.frombuffer(raw, dtype=kind)
                for k in range(0, len(ids), block):
                    part = ids[k : k + block]
                    ends = np.flatnonzero(part == end) + k
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k // block], pa.int64()), pa.array([k + len(part)], pa.int64()), pa.array([ends.tolist()], pa.list_(pa.int64()))], names=["path", "block", "upto", "ends"])

    blocks = spark.read.format("binaryFile").load(files).where(F.col("length") <= most).select("path", "content").mapInArrow(search, "path string, block long, upto long, ends array<long>")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("path").orderBy("block").rowsBetween(1, 1)
    known = (
        blocks.withColumn("ahead", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).cast("long"))
        .withColumn("since", F.coalesce(F.max(F.try_element_at("ends", F.lit(-1)) + 1).over(before), F.lit(0)).cast("long"))
        .withColumn("last", F.max("block").over(later).isNull())
    )
    # the place after the last separator so far, for what is left at a file's end
    rest = F.greatest("since", F.coalesce(F.try_element_at("ends", F.lit(-1)) + 1, F.lit(0)))
    known = known.withColumn("rest", rest).withColumn("stops", F.when(F.col("last") & (F.col("upto") > F.col("rest")), F.concat("ends", F.array("upto"))).otherwise(F.col("ends")))
    at = F.posexplode("stops").alias("i", "stop")
    return known.select("path", "ahead", "since", "ends", at).select(
        "path", (F.col("ahead") + F.col("i")).alias("ordinal"), F.expr("if(i = 0, since, ends[i - 1] + 1)").alias("start"),
        F.expr("stop - if(i = 0, since, ends[i - 1] + 1)").alias("n_tokens"), F.expr("i < size(ends)").alias("ended"),
    )


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the documents to flat files in the shared folder and scans those."""
    spark = docs.sparkSession
    out = own_folder(spark, "tokens")
    write_token_files(docs, out, path)
    return separator_scan(spark, out)


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    found = count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.concat_ws("-", F.regexp_extract("path", r"part-(\d+)", 1), F.regexp_extract("path", r"-c(\d+)[^/]*$", 1)).alias("file"), "ordinal", "start", "n_tokens", "ended")
