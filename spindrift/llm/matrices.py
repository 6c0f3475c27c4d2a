"""Packed token-id matrices: best-fit-decreasing with a segment tree over free capacities.

Each task packs its own documents in chunks of bounded size, so no token is shuffled.  Documents
longer than a row are split into pieces that put together give the document again.  In a chunk the
pieces go in from the longest to the shortest, each into the row with the least room that fits; a
segment tree over capacities finds it in log(capacity) steps.  Rows that stay far from full hand
their pieces on to the next chunk.

A row is one sequence: ``ids`` (little-endian, 16 bits where the vocabulary allows, else 32, padded to the row length),
``n_tokens`` without padding, ``cu_seqlens`` (0 and the end of each segment), ``resets`` (places where
position ids begin at 0 again: the start of each segment), and for each segment ``doc_ids`` and
``doc_starts`` (its place in its document).

Defined results: a null text is the empty text and takes one id, the end; repeated rows are packed
each; equal lengths keep their order; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.tokens import tokenizer, tokenizer_path, with_end
from spindrift.llm.wordscan import slices, texts_of

LENGTH = 2048
END = 49407
PAD = 0
#: Tokens that a task holds before it packs them.
CHUNK = 1 << 21
#: Rows filled less than this wait for the next chunk.
FULL = 0.97

SCHEMA = "sequence_id long, ids binary, n_tokens int, cu_seqlens array<int>, resets array<int>, doc_ids array<long>, doc_starts array<long>"


class CapacityTree:
    """Which free capacities have a row: leaves count rows, inner nodes sum up."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, by: int) -> None:
        i = room + self.size
        while i:
            self.count[i] += by
            i >>= 1

    def at_least(self, need: int) -> int:
        """The least capacity >= need that some row has, or -1."""
        i = need + self.size
        if self.count[i]:
            return need
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Rows of indices of sizes, each summing up to at most capacity."""
    tree, held, rows = CapacityTree(capacity), [[] for _ in range(capacity + 1)], []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        room = tree.at_least(sizes[i])
        if room < 0:
            row, room = len(rows), capacity
            rows.append([])
        else:
            row = held[room].pop()
            tree.add(room, -1)
        rows[row].append(i)
        left = room - sizes[i]
        if left:
            held[left].append(row)
            tree.add(left, 1)
    return rows


def pack_matrices(docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END, pad: int = PAD, chunk: int = CHUNK) -> DataFrame:
    """SCHEMA rows for documents(doc_id, text)."""
    path = path or tokenizer_path()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path, plain=True)
        kind = np.uint16 if max(t.vocabulary, end + 1, pad + 1) <= 1 << 16 else np.uint32
        number = TaskContext.get().partitionId() << 40
        held: list[tuple[int | None, int, np.ndarray]] = []
        tokens = 0

        def rows(groups: list[list[tuple[int | None, int, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
            nonlocal number
            for at in range(0, len(groups), 1024):
                part = groups[at : at + 1024]
                matrix = np.full((len(part), length), pad, dtype=kind)
                cu = []
                for r, row in enumerate(part):
                    ends = [0]
                    for _, _, ids in row:
                        matrix[r, ends[-1] : ends[-1] + len(ids)] = ids
                        ends.append(ends[-1] + len(ids))
                    cu.append(ends)
                raw = matrix.astype(np.dtype(kind).newbyteorder("<")).tobytes()
                width = length * np.dtype(kind).itemsize
                yield pa.RecordBatch.from_arrays([
                    pa.array(range(number, number + len(part)), pa.int64()), pa.array([raw[i * width : (i + 1) * width] for i in range(len(part))], pa.binary()), pa.array([c[-1] for c in cu], pa.int32()),
                    pa.array(cu, pa.list_(pa.int32())), pa.array([c[:-1] for c in cu], pa.list_(pa.int32())), pa.array([[p[0] for p in row] for row in part], pa.list_(pa.int64())), pa.array([[p[1] for p in row] for row in part], pa.list_(pa.int64())),
                ], names=["sequence_id", "ids", "n_tokens", "cu_seqlens", "resets", "doc_ids", "doc_starts"])
                number += len(part)

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, tokens
            groups = [[held[i] for i in row] for row in best_fit_decreasing([len(p[2]) for p in held], length)]
            full = [g for g in groups if last or sum(len(p[2]) for p in g) >= FULL * length]
            if 2 * len(full) < len(groups):  # else the same pieces might wait for ever
                full = groups
            done = {id(g) for g in full}
            held = [p for g in groups if id(g) not in done for p in g]
            tokens = sum(len(p[2]) for p in held)
            yield from rows(full)

        for batch in batches:
            for part in slices(batch, "text"):
                ids, per = with_end(*t.encode(texts_of(part.column("text"))), end)
                ids = ids.astype(kind)
                begin = np.cumsum(per) - per
                whole = []
                for d, b, n in zip(part.column("doc_id").to_pylist(), begin.tolist(), per.tolist(), strict=True):
                    for k in range(0, n, length):
                        piece = (d, k, ids[b + k : b + min(n, k + length)])
                        if len(piece[2]) == length:
                            whole.append([piece])
                        else:
                            held.append((d, k, piece[2].copy()))
                            tokens += len(piece[2])
                yield from rows(whole)
                if tokens >= chunk:
                    yield from flush(False)
        yield from flush(True)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(pack, SCHEMA)


def write_matrices(packed: DataFrame, path: str) -> None:
    packed.write.mode("error").parquet(path)


def position_ids(cu_seqlens: list[int]) -> list[int]:
    """0, 1, 2 ... in each segment."""
    return [i for a, b in zip(cu_seqlens, cu_seqlens[1:], strict=False) for i in range(b - a)]


def op10_packed_matrices(spark, sf_dir: str) -> DataFrame:
    return pack_matrices(spark.read.parquet(f"{sf_dir}/documents.parquet"))
