"""Bounded-space online best-fit packing of token sequences.

Each partition reads its documents once, in order, turns them into ids, cuts only documents longer
than a sequence, and places piece after piece, as they come, into the open bin that it fills best.  A
fixed number of bins is open; they hang in lists by free space, and a bitset over free space finds the
tightest that fits in one step.  When too many are open the fullest closes.  What a partition holds
is bounded by that number, not by its input.

Bins that end up far from full, in whatever partition, are taken apart, and their pieces come again, long
ones first, to the same best-fit: a second round over the few pieces that the first left badly placed.
Only places and lengths move there, never texts.

Defined results: a null text is the empty text, one id (the end) long; repeated rows are packed each;
equal lengths go first come, first served, in the order of the input partition; an empty table gives
no rows; input columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.tokens import tokenizer, tokenizer_path, with_end
from spindrift.llm.wordscan import slices, texts_of
from spindrift.storage import keep

LENGTH = 2048
END = 0
OPEN_BINS = 8192
#: Bins filled less than this are taken apart.
FULL = 0.985
#: Pieces of the second round in one of its tasks, about.
ITEMS_A_TASK = 200_000


class BestFit:
    """Open bins by free space: ``place`` returns (bin, offset) of an item of at most ``capacity``."""

    def __init__(self, capacity: int, open_bins: int = OPEN_BINS):
        self.capacity, self.most = capacity, open_bins
        self.free = [[] for _ in range(capacity)]
        self.set = self.open = self.bins = 0

    def place(self, size: int) -> tuple[int, int]:
        fits = self.set >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            stack = self.free[room]
            bin_ = stack.pop()
            self.open -= 1
            if not stack:
                self.set ^= 1 << room
        else:
            room, bin_ = self.capacity, self.bins
            self.bins += 1
        left = room - size
        if left:  # a bin without room is closed
            if not self.free[left]:
                self.set |= 1 << left
            self.free[left].append(bin_)
            self.open += 1
            if self.open > self.most:
                least = (self.set & -self.set).bit_length() - 1
                self.free[least].pop()
                self.open -= 1
                if not self.free[least]:
                    self.set ^= 1 << least
        return bin_, self.capacity - room


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long"


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, open_bins: int = OPEN_BINS) -> DataFrame:
    """PIECES of every document, each placed in a bin of its partition."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray | pa.Array]]:
        for batch in batches:
            for part in slices(batch, "text"):
                ids, per = with_end(*tokenizer(path).encode(texts_of(part.column("text"))), end)
                n = -(-per // length)
                which = np.repeat(np.arange(len(per)), n)
                number = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                start = number * length
                size = np.minimum(per[which] - start, length)
                begin = (np.cumsum(per) - per)[which] + start
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * b : 4 * (b + s)]) for b, s in zip(begin.tolist(), size.tolist(), strict=True)]
                yield [part.column("doc_id").take(pa.array(which)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(size), pa.array(crc, pa.int64())]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, own = BestFit(length, open_bins), TaskContext.get().partitionId() << 40
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]

        for columns in cut_up(batches):
            placed = np.array([fit.place(n) for n in columns[3].to_pylist()], dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(placed[:, 0] + own), pa.array(placed[:, 1].copy())], names=[*names, "bin", "offset"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(pack, PIECES)


def place_again(placed: DataFrame, length: int = LENGTH, open_bins: int = OPEN_BINS, items: int = ITEMS_A_TASK) -> DataFrame:
    """(bin, offset, sequence_id, place): new places of the pieces of placed(bin, offset, length) whose bins are far from full."""
    poor = placed.groupBy("bin").agg(F.sum("length").alias("fill")).where(F.col("fill") < FULL * length).select("bin")
    again = keep(placed.select("bin", "offset", "length").join(poor, "bin"))
    tasks = max(1, -(-again.count() // items))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # numbers of bins beyond any of the first round
        fit, own = BestFit(length, open_bins), (1 << 62) + (TaskContext.get().partitionId() << 40)
        for batch in batches:
            got = np.array([fit.place(n) for n in batch.column("length").to_pylist()], dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column("bin"), batch.column("offset"), pa.array(got[:, 0] + own), pa.array(got[:, 1].copy())], names=["bin", "offset", "sequence_id", "place"])

    return again.repartition(tasks, "bin", "offset").sortWithinPartitions(F.col("length").desc(), "bin", "offset").mapInArrow(pack, "bin long, offset long, sequence_id long, place long")


def pack_documents(docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END, open_bins: int = OPEN_BINS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of documents(doc_id, text)."""
    placed = keep(pieces(docs, path or tokenizer_path(), length, end, open_bins))
    again = place_again(placed, length, open_bins)
    return placed.join(again, ["bin", "offset"], "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("sequence_id", "bin").alias("sequence_id"), F.coalesce("place", "offset").alias("offset")
    )


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
