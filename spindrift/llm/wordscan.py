"""Vectorised scanning of whole UTF-8 texts, shared by the operators of this subpackage.

A batch of texts is one byte array plus offsets.  Words are maximal runs of bytes other than
space and 0x09-0x0D, found with numpy over the whole batch at once.  A span (word, line) is read in
lanes of eight bytes; its 64-bit hash is a sum over lanes of a non-linear function of the lane and its
place, so no Python loop runs per word or per document, and no pattern of bytes cancels out: two
different spans share a hash with a probability of 2**-64.
Batches are cut to a byte budget, so memory doesn't depend on how Arrow grouped the rows; a single
text longer than the budget is a batch of its own and is still read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are scanned at once.
BATCH_BYTES = 1 << 18

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_GRAM = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)
#: What is left of a lane of which only so many bytes belong to the span.
_KEEP = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], dtype=np.uint64)

IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: spreads a 64-bit value over all bits."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


class Texts:
    """Some texts as one byte array: ``data`` and ``offsets`` (one more than texts)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1
        self._lanes: np.ndarray | None = None
        self.starts = self.ends = self.doc = np.zeros(0, dtype=np.int64)

    def lowered(self) -> Texts:
        """A-Z in lower case; other characters stay."""
        return Texts(LOWER[self.data], self.offsets)

    def words(self, kind: np.ndarray = IS_WORD) -> Texts:
        """Fills starts, ends (byte positions) and doc (index of the text) of every run of bytes of the kind."""
        word = kind[self.data]
        inner = self.offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(word))]
        edge = np.zeros(len(word) + 1, dtype=bool)
        if len(word):
            edge[0], edge[-1] = word[0], word[-1]
            edge[1:-1] = word[1:] != word[:-1]
        begins = edge[:-1] & word
        stops = np.zeros(len(word) + 1, dtype=bool)
        stops[1:] = edge[1:] & word
        begins[inner] = word[inner]
        stops[inner] |= word[inner - 1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops)
        self.doc = np.searchsorted(self.offsets, self.starts, side="right") - 1
        return self

    def lane(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The first ``size`` bytes, eight at most, from each place on as one number; 0 where there are none."""
        if self._lanes is None:
            padded = np.zeros(len(self.data) + 8, dtype=np.uint8)
            padded[: len(self.data)] = self.data
            self._lanes = np.ndarray((len(self.data) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
        return self._lanes[np.minimum(at, len(self.data))] & _KEEP[np.clip(size, 0, 8)]

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hash of each span of bytes; equal bytes have equal hashes."""
        size = ends - starts
        out = mix(self.lane(starts, size) ^ _U(0x6A09E667F3BCC909))
        more = np.flatnonzero(size > 8)
        if len(more):
            # the other lanes of all longer spans side by side, each under a key of its place
            lanes = (size[more] - 1) >> 3
            first = np.cumsum(lanes) - lanes
            place = np.arange(int(lanes.sum())) - np.repeat(first, lanes) + 1
            at = np.repeat(starts[more], lanes) + 8 * place
            value = self.lane(at, np.repeat(ends[more], lanes) - at)
            keyed = mix(mix(value ^ mix(place.astype(np.uint64) * _U(0x9E3779B97F4A7C15))) + place.astype(np.uint64))
            out[more] += np.add.reduceat(keyed, first)
        return mix(out + size.astype(np.uint64) * _U(0xBB67AE8584CAA73B))

    def word_hashes(self) -> np.ndarray:
        return self.hashes(self.starts, self.ends)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """starts, ends and text index of the lines between line feeds."""
        cuts = np.flatnonzero(self.data == 0x0A)
        starts = np.concatenate([self.offsets[:-1], cuts + 1])
        ends = np.concatenate([self.offsets[1:], cuts])
        doc = np.concatenate([np.arange(self.n), np.searchsorted(self.offsets, cuts, side="right") - 1])
        # starts and ends pair up once both are put in order of text and place
        a, b = np.lexsort((starts, doc)), np.lexsort((ends, doc))
        return starts[a], ends[b], doc[a]

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text have the flag."""
        sums = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]


def grams(hashes: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of k words inside one text, and the place of their first word."""
    m = len(hashes) - k + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(doc[:m] == doc[k - 1 :])
    out = np.zeros(len(at), dtype=np.uint64)
    for i in range(k):
        out += hashes[at + i] * _GRAM[i % len(_GRAM)] + _U(i)
    return mix(out), at


def texts_of(column: pa.Array) -> Texts:
    """The texts of an Arrow column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if column.buffers()[2] is None or not len(column):
        return Texts(np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64))
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return Texts(data, offsets - offsets[0])


def slices(batch: pa.RecordBatch, column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts together hold at most ``limit`` bytes, or one row."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
