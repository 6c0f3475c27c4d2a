"""Contiguous shards of nearly equal bytes.

Rows are range-partitioned and sorted once; each partition reports its bytes and rows, one number
pair per partition; with the running totals of those every partition knows the global byte offset
of its first row and numbers its rows on its own.  Shard k holds the rows that start in the k-th of
n equal stretches of the byte line, so shards are contiguous in the order and differ from the
target by less than one row's size at either end.

Defined results: a null text has 0 bytes (size 1, crc 0); rows with equal keys are kept, in an
order fixed by size and checksum, and equal rows may change places without changing the result;
null doc_ids come first; an empty table gives no rows; with fewer rows than shards some shards are
empty; extra columns are ignored by ``shard_plan``.  Texts that are equal may land in different
shards: law ``bytes`` binds sizes only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from spindrift.storage import cut


N_SHARDS = 8


def prefix_shards(rows: DataFrame, n_shards: int, order: list[str], size: str = "size") -> DataFrame:
    """rows plus shard int and slot long, for a positive long column of sizes, cut in the given order."""
    laid = cut(cut(rows).repartitionByRange(*order).sortWithinPartitions(*order))

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = b = 0
        for batch in batches:
            n += batch.num_rows
            b += int(batch.column(size).to_numpy().sum())
        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "n": [n], "b": [b]}, schema=pa.schema([("part", pa.int32()), ("n", pa.int64()), ("b", pa.int64())]))

    # one row per partition, not per document
    sums = {r.part: (r.n, r.b) for r in laid.mapInArrow(totals, "part int, n long, b long").collect()}
    first, total_n, total_b = {}, 0, 0
    for part in sorted(sums):
        first[part] = (total_n, total_b)
        total_n, total_b = total_n + sums[part][0], total_b + sums[part][1]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in laid.schema.fields) + ", shard int, place long"
    stretch = max(1, -(-total_b // n_shards))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, b = first.get(TaskContext.get().partitionId(), (0, 0))
        for batch in batches:
            sizes = batch.column(size).to_numpy()
            starts = b + np.cumsum(sizes) - sizes
            # equal stretches of whole bytes
            whole = starts // stretch
            shard = np.minimum(whole, n_shards - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard), pa.array(n + np.arange(len(sizes), dtype=np.int64))], names=[*batch.schema.names, "shard", "place"])
            n, b = n + len(sizes), b + int(sizes.sum())

    placed = cut(laid.mapInArrow(number, schema))
    begin = placed.groupBy("shard").agg(F.min("place").alias("begin"))  # a row per shard
    return placed.join(F.broadcast(begin), "shard").withColumn("slot", F.col("place") - F.col("begin")).drop("place", "begin")


def shard_plan(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for documents(doc_id, text), in doc_id order."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return prefix_shards(rows, n_shards, ["doc_id", "size", "text_crc32"])


def op6_byte_sharding(spark, sf_dir: str) -> DataFrame:
    plan = shard_plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return plan.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The checksum is folded over half bytes, the low one first; its table of 16 follows from the polynomial.
OP6_SQL = """
with t as (
  select list_transform(range(16), lambda i: list_reduce(range(4), lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i::bigint)) as t
), d as (
  select doc_id, octet_length(encode(coalesce(text, ''))) + 1 as size, string_split(hex(encode(coalesce(text, ''))), '') as h from documents
), halves as (
  select doc_id, size, list_transform(range(1, 2 * size - 1), lambda i: (strpos('0123456789ABCDEF', case when i % 2 = 1 then h[i + 1] else h[i - 1] end) - 1)::bigint) as h from d
), crc as (
  select doc_id, size, xor(list_reduce(h, lambda c, n: xor(t.t[(xor(c, n) & 15) + 1], c >> 4), 4294967295::bigint), 4294967295) as text_crc32 from halves, t
), laid as (
  select *, sum(size) over (order by doc_id, size, text_crc32)::bigint - size as pos, greatest(1, (sum(size) over () + 7)::bigint // 8) as stretch from crc
), cut as (
  select doc_id, size, text_crc32, pos, least(pos // stretch, 7)::int as shard from laid
)
select doc_id, size::bigint as size, text_crc32, 'bytes' as law, shard, row_number() over (partition by shard order by pos) - 1 as slot, null::int as grown_shard from cut
"""
