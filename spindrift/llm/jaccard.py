"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact intersection.

1. A first scan counts the word k-grams of all texts in a table of fixed size, which tells grams that
   very many texts share.
2. A second turns each whole text into its set of k-grams (sorted 64-bit hashes).  Sizes are cut into
   bands; two sets of similarity t stand in one band or in neighbours, and differ in at most
   (1 - t) / (1 + t) of their summed sizes.  Each band deals the grams out, by hash, to more cells than
   a pair of it can have differences, so a pair has cells with the same grams in both.  A tile is all
   sets of one band with the same cell.  Cells that are empty or hold only very common grams are weak
   and left out, unless a set has so many that a pair might share no other.  Sets too small for cells,
   and bands where a cell would hold few grams (as at 0.8), take their first n - ceil(t n) + 1 grams, rarest first: one of them is shared by every pair.
3. Documents with equal sets are one class, and only a class's first row goes on.  Tiles of two or more
   come from a count of the keys.
4. Inside a tile every set is compared with the tile's first: the sizes and the bit counts of folded
   parity signatures bound the overlap from above (a bit that differs is a gram that isn't shared), and
   for pairs that pass sorted-array intersection decides.  These links are exact before they are closed.
5. Tiles whose members aren't all connected by then are compared whole, signatures block pair by block
   pair, leaving out what is known to be connected.  What passes makes small groups, which get their
   texts, and sorted-array intersection decides again.

So a group of many near copies costs a comparison each, not one for each pair; a tile or a leader of many
is cut into blocks, one task for each (pair), and keys that hold many rows are joined by a broadcast of
bounded size.  No pair is emitted but (member, leader); other links leave a task as a forest.

Rows are told apart by a number of their own, sets by 128-bit names, grams by 64-bit hashes.  Two of n
different sets share a name with a probability of about n * n / 2**129; two of a pair's grams are mixed
up with one of about 2**-64 for each two.

Defined results: a null text is the empty text; a text without words has the empty set and is linked
with nothing; with fewer than k words the whole sequence is the one gram; rows that share a doc_id
are each a document; a null doc_id is no class's smallest id unless there is no other; an empty
table gives no rows; input columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from spindrift.llm.common import Forest, blocked, components, grouped, hot_keys, maybe_in, spread, without
from spindrift.llm.wordscan import grams, mix, slices, texts_of
from spindrift.storage import cut, keep

#: Sets that a task of the scan remembers in order not to describe a copy again.
CHUNK_DOCS = 1 << 16
#: Rows that are compared with one leader in a task.
STAR_BLOCK = 128
#: Sets in a block of a tile, when signatures are compared.
SIGNED_BLOCK = 256
#: Sets in a block of a group: as few as GROUP_LEAST, if the tasks that there are can share its pairs of blocks, as many as GROUP_BLOCK at most; and bytes of sets.
GROUP_LEAST, GROUP_BLOCK = 32, 256
GROUP_BYTES = 16 << 20
#: Bits of the widest signature; a set of n grams has the power of two from n, at least 64.
MOST_BITS = 16384
#: Counters of grams, a power of two.  They tell what is common; collisions cost time, not results.
COUNTERS = 1 << 20
CHUNKS = 64
#: Bands whose smallest sets have fewer grams than this, in all or in a cell, use the first grams instead.
LEAST_DEALT = 32
LEAST_A_CELL = 3

_U = np.uint64


@lru_cache(maxsize=8)
def bands(num: int, den: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first sizes of bands, one more than bands; cells of each, 0 for none and -1 for first grams; differences of each).

    Covers sizes up to ``most``.  A band ends a few powers of 1 / t after it begins, so that a partner is
    in the same band or the next.  There are more cells than differences, and so many more that a set
    hardly ever has as many empty ones as a pair must have equal.
    """
    steps = 4 if 20 * num >= 17 * den else 2
    first, cells, differ = [1], [], []
    while first[-1] <= most:
        e = first[-1]
        for _ in range(steps):
            e = e * den // num + 1
        k = 2 * (e - 1) * (den - num) // (den + num)
        least = -(-num * first[-1] // den)
        m = k + 1 if k else 0
        while k:
            empty = m * math.exp(-least / m)
            want = k + 2 + math.ceil(empty + 4 * math.sqrt(empty))
            if want <= m:
                break
            m = want
            if m * LEAST_A_CELL > least or least < LEAST_DEALT:
                m = -1
                break
        first.append(e)
        cells.append(m)
        differ.append(k)
    return np.array(first), np.array([*cells, 0]), np.array([*differ, 0])


def cells_of(g: np.ndarray, n: np.ndarray, num: int, den: int, counters: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(index of the set, key) of all cells of sets g of sizes n, each sorted; counters of all grams where known."""
    seen = np.zeros(len(g), dtype=np.uint32) if counters is None else counters[(g & _U(COUNTERS - 1)).astype(np.int64)]
    usual = 0.0 if counters is None else float(counters.mean())
    rare = seen <= usual + 3 * math.sqrt(usual) + 3
    first, cells, differ = bands(num, den, 1 << max(10, int(n.max(initial=1)).bit_length() + 1))
    ends = np.cumsum(n)
    doc = np.repeat(np.arange(len(n)), n)
    # place in order of the counters, then of the hashes: one order for all sets
    place = np.empty(len(g), dtype=np.int64)
    place[np.lexsort((seen, doc))] = np.arange(len(g)) - np.repeat(ends - n, n)
    own = np.searchsorted(first, n, side="right") - 1
    who, keys = [], []
    for up in (0, 1):
        band = np.maximum(own + up, 0)
        # the next band's pairs, if a partner can be there
        goes = (n > 0) & ((up == 0) | (n * den >= num * first[np.minimum(band, len(first) - 1)]))
        m = np.where(goes, cells[np.minimum(band, len(cells) - 1)], 0)
        few = np.flatnonzero((m[doc] == -1) & (place < (n - -(-num * n // den) + 1)[doc]))
        who.append(doc[few])
        keys.append(mix(g[few] ^ mix(band[doc[few]].astype(np.uint64) + _U(1 << 40))))
        dealt = np.flatnonzero(m > 0)
        if not len(dealt):
            continue
        base = np.zeros(len(n), dtype=np.int64)
        base[dealt] = np.cumsum(m[dealt]) - m[dealt]
        at = np.flatnonzero((m > 0)[doc])
        d = doc[at]
        h = mix(g[at] + _U(0x5851F42D4C957F2D))
        cell = base[d] + (h % m[d].astype(np.uint64)).astype(np.int64)
        total = int(m[dealt].sum())
        # exact sums of 64-bit hashes, as sums of halves that stay below 2**53
        low = np.bincount(cell, weights=(h & _U(0xFFFFFFFF)).astype(np.float64), minlength=total).astype(np.uint64)
        high = np.bincount(cell, weights=(h >> _U(32)).astype(np.float64), minlength=total).astype(np.uint64)
        held = np.bincount(cell[rare[at]], minlength=total)
        owner = np.repeat(dealt, m[dealt])
        number = np.arange(total) - base[owner]
        # a set with that many weak cells might share nothing but weak ones: it shows them too
        bare = np.bincount(owner[held == 0], minlength=len(n)) >= m - differ[np.minimum(band, len(differ) - 1)]
        show = (held > 0) | bare[owner]
        name = mix((band[owner].astype(np.uint64) << _U(32)) + number.astype(np.uint64))
        who.append(owner[show])
        keys.append(mix((low + (high << _U(32))) ^ name)[show])
    return np.concatenate(who), np.concatenate(keys)


def sets_of(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the k-gram sets one after another, each sorted; number in each)."""
    t = texts_of(column).lowered().words()
    h = t.word_hashes()
    g, at = grams(h, t.doc, k)
    doc = t.doc[at]
    count = np.bincount(t.doc, minlength=t.n)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        first = np.cumsum(count) - count
        whole = np.array([mix(np.array([int(sum(int(h[first[d] + i]) * (2 * i + 3) ** 5 for i in range(count[d])) % (1 << 64))], dtype=np.uint64) + _U(count[d]))[0] for d in short], dtype=np.uint64)
        g, doc = np.concatenate([g, whole]), np.concatenate([doc, short])
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    new = np.ones(len(g), dtype=bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    return g[new], np.bincount(doc[new], minlength=t.n).astype(np.int64)


def parity(grams_: np.ndarray) -> bytes:
    """Signature: bit i is the parity of the number of grams that hash to i.  Folding halves with xor gives the narrower one."""
    bits = max(64, min(MOST_BITS, 1 << max(0, int(len(grams_) - 1).bit_length())))
    odd = np.bincount((mix(grams_) & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _fold(sig: np.ndarray, words: int) -> np.ndarray:
    while sig.shape[-1] > words:
        half = sig.shape[-1] // 2
        sig = sig[..., :half] ^ sig[..., half:]
    return sig


def _classes(g: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit name for each set, in halves; order doesn't matter in a set, so sums of mixed grams give it."""
    ends = np.cumsum(n)
    out = []
    for key in (0x243F6A8885A308D3, 0x13198A2E03707344):
        sums = np.zeros(len(g) + 1, dtype=np.uint64)
        np.cumsum(mix(g ^ _U(key)), out=sums[1:])
        out.append(mix((sums[ends] - sums[ends - n]) ^ (n.astype(np.uint64) * _U(0x9E3779B97F4A7C15))).view(np.int64))
    return out[0], out[1]


def count_grams(docs: DataFrame, k: int) -> np.ndarray:
    """How many sets hold the grams of each counter, copies inside a chunk counted once."""
    step = COUNTERS // CHUNKS

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(COUNTERS, dtype=np.uint32)
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                g, n = sets_of(part.column("text"), k)
                name = list(zip(*(h.tolist() for h in _classes(g, n)), strict=True))
                if len(seen) > CHUNK_DOCS:
                    seen.clear()
                fresh = np.zeros(len(n), dtype=bool)
                for i, c in enumerate(name):
                    if c not in seen:
                        seen.add(c)
                        fresh[i] = True
                at, times = np.unique((g[np.repeat(fresh, n)] & _U(COUNTERS - 1)).astype(np.int64), return_counts=True)
                counters[at] += times.astype(np.uint32)
        if seen:
            blobs = [pa.compress(counters[i * step : (i + 1) * step].tobytes(), codec="zstd", asbytes=True) for i in range(CHUNKS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array(blobs, pa.binary())], names=["chunk", "counts"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = np.zeros(step, dtype=np.uint64)
        for blob in table.column("counts"):
            total += np.frombuffer(pa.decompress(blob.as_py(), decompressed_size=4 * step, codec="zstd", asbytes=True), dtype=np.uint32)
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()], pa.binary())})

    # CHUNKS rows of fixed size reach the driver, whatever the input
    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(scan, "chunk int, counts binary").groupBy("chunk").applyInArrow(add, "chunk int, counts binary").collect()
    counters = np.zeros(COUNTERS, dtype=np.uint32)
    for r in parts:
        counters[r.chunk * step : (r.chunk + 1) * step] = np.frombuffer(r.counts, dtype=np.uint32)
    return counters


def scan(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Table (row, n, h1, h2, tie, sig, cells, doc) of all rows of docs.

    row numbers them, n is the size of the set, (h1, h2) its name, tie a hash of the row, doc the row itself.
    sig (signature) and cells (keys of tiles) are there where the task hasn't just seen the same set.
    """
    counted = docs.sparkSession.sparkContext.broadcast(count_grams(docs, k))  # COUNTERS numbers
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")).select(F.xxhash64("doc").alias("tie"), "doc")
    longs = [StructField(c, LongType()) for c in ("row", "n", "h1", "h2", "tie")]
    schema = StructType([*longs, StructField("sig", BinaryType()), StructField("cells", ArrayType(LongType())), whole.schema["doc"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            text = batch.column("doc").field("text").cast(pa.large_string())
            for part in slices(pa.RecordBatch.from_arrays([batch.column("tie"), batch.column("doc"), text], names=["tie", "doc", "text"]), "text"):
                g, n = sets_of(part.column("text"), k)
                h1, h2 = _classes(g, n)
                if len(seen) > CHUNK_DOCS:
                    seen.clear()
                fresh = np.zeros(len(n), dtype=bool)
                for i, name in enumerate(zip(h1.tolist(), h2.tolist(), strict=True)):
                    if n[i] and name not in seen:
                        seen.add(name)
                        fresh[i] = True
                signed = [parity(x) if f else None for x, f in zip(np.split(g, np.cumsum(n)[:-1]), fresh.tolist(), strict=True)]
                who, keys = cells_of(g[np.repeat(fresh, n)], n[fresh], num, den, counted.value)
                held = np.zeros(len(n), dtype=np.int64)
                held[fresh] = np.bincount(who, minlength=int(fresh.sum()))
                offsets = pa.array(np.concatenate([[0], np.cumsum(held)]).astype(np.int32), mask=np.append(~fresh, False))
                cells = pa.ListArray.from_arrays(offsets, pa.array(keys[np.argsort(who, kind="stable")].view(np.int64)))
                columns = [pa.array(row + np.arange(len(n))), pa.array(n), pa.array(h1), pa.array(h2), part.column("tie"), pa.array(signed, pa.binary()), cells, part.column("doc")]
                row += len(n)
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return keep(whole.mapInArrow(run, schema))


def _pair(na: int, sa: bytes, nb: int, sb: bytes, num: int, den: int) -> bool:
    """Whether the bounds let two sets pass."""
    if na > nb:
        na, sa, nb, sb = nb, sb, na, sa
    if den * na < num * nb:
        return False
    y = int.from_bytes(sb, "little")
    while len(sb) > len(sa):
        half = len(sb) // 2
        y = (y >> (8 * half)) ^ (y & ((1 << (8 * half)) - 1))
        sb = sb[:half]
    differ = (int.from_bytes(sa, "little") ^ y).bit_count()
    return (na + nb - differ) // 2 >= -(-num * (na + nb) // (num + den))


def _link(ids: np.ndarray, n: np.ndarray, sigs: list[bytes], comp: np.ndarray, num: int, den: int, forest: Forest, exact=None) -> None:
    """Joins in the forest what passes the bounds (and the exact test, where given).

    Pairs of one comp are known to be connected and left out, as are pairs that the forest connects already.
    """
    if len(ids) <= 6:
        every = ids.tolist()
        for i in range(len(every)):
            for x in range(i):
                if comp[i] != comp[x] and _pair(int(n[i]), sigs[i], int(n[x]), sigs[x], num, den) and forest.find(every[i]) != forest.find(every[x]) and (exact is None or exact(i, x)):
                    forest.join(every[i], every[x])
        return
    order = np.lexsort((ids, n))
    n, comp, every = n[order], comp[order], ids[order].tolist()
    root = np.array([forest.find(i) for i in every], dtype=np.int64)
    widths = np.array([len(sigs[i]) // 8 for i in order])
    levels = {w: np.stack([_fold(np.frombuffer(sigs[i], dtype=np.uint64), w) if len(sigs[i]) // 8 > w else np.frombuffer(sigs[i].ljust(8 * w, b"\0"), dtype=np.uint64)[:w] for i in order]) for w in np.unique(widths).tolist()}
    for i in range(len(every) - 1):
        # sizes are sorted: partners are those up to n / t
        stop = int(np.searchsorted(n, n[i] * den // num, side="right"))
        j = np.arange(i + 1, stop)
        j = j[(root[j] != root[i]) & (comp[j] != comp[i])]
        if not len(j):
            continue
        w = int(widths[i])  # the narrower one: sizes are sorted
        differ = np.bitwise_count(levels[w][j] ^ levels[w][i]).sum(axis=1, dtype=np.int64)
        most = (n[j] + n[i] - differ) // 2
        need = -(-num * (n[j] + n[i]) // (num + den))
        for x in j[most >= need].tolist():
            if root[x] != root[i] and (exact is None or exact(order[i], order[x])):
                forest.join(every[i], every[x])
                low, high = sorted((root[i], root[x]))
                root[root == high] = low


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0


def starred(pairs: DataFrame, load: DataFrame, judge: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """What judge makes of pairs(id, leader) and load(row, n, load): batches (leader, block, id, n, load), a leader
    before its rows.  A leader of many is put before each block of them, so no task holds all."""
    pairs = keep(pairs)
    held = pairs.groupBy("leader").agg(F.count("*").alias("held"))
    hot = F.broadcast(hot_keys(held).select("leader", F.ceil(F.col("held") / STAR_BLOCK).cast("int").alias("blocks")))
    blocks = F.coalesce("blocks", F.lit(1))
    members = pairs.join(hot, "leader", "left").select("leader", "id", F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"))
    heads = held.join(hot, "leader", "left").select("leader", F.col("leader").alias("id"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    wanted = pairs.select(F.explode(F.array("id", "leader")).alias("row")).distinct()
    loaded = maybe_in(load, wanted, "row").withColumnRenamed("row", "id")
    rows = members.unionByName(heads).join(loaded, "id").withColumn("head", (F.col("id") == F.col("leader")).cast("int"))
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "leader", "block").sortWithinPartitions("leader", "block", F.col("head").desc(), "id")
    return dealt.select("leader", "id", "n", "load").mapInArrow(judge, "id long, leader long")


def _answer(found: list[tuple[int, int]], names: tuple[str, str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], names=list(names))


def linked(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scan's table, classes(h1, h2, held, rep, best), (node, component) of the reps that are linked with another).

    best is the class's first row by (doc_id, null last; name; tie; row).
    """
    scanned = scan(docs, k, num, den)
    best = F.struct(F.col("doc.doc_id").isNull().alias("none"), F.col("doc.doc_id").cast("long").alias("doc_id"), "h1", "h2", "tie", "row")
    classes = keep(scanned.where("n > 0").groupBy("h1", "h2").agg(F.count("*").alias("held"), F.min("row").alias("rep"), F.min(best).alias("best")))
    again = cut(scanned.where("sig is not null").select("row").join(classes.select(F.col("rep").alias("row")), "row", "left_anti"))
    first = without(scanned.where("cells is not null").select("row", "cells"), again, "row")
    entries = first.select(F.col("row").alias("id"), F.explode("cells").alias("key"))
    tiles = keep(entries.groupBy("key").agg(F.count("*").alias("held"), F.min("id").alias("low"), F.max("id").alias("high")).where("low < high"))
    big = tiles.where("held > 2").select("key", "held", "low")
    members = keep(spread(keep(maybe_in(entries, big, "key", hashed=True)), big, "key", kept=True))

    # every member of a tile against the tile's first
    pairs = tiles.where("held = 2").select(F.col("high").alias("id"), F.col("low").alias("leader")).unionByName(members.where("id <> low").select("id", F.col("low").alias("leader"))).distinct()
    sigs = scanned.where("sig is not null").select("row", "n", F.col("sig").alias("load"))
    texts = scanned.where("sig is not null").select("row", "n", F.coalesce(F.col("doc.text").cast("string"), F.lit("")).alias("load"))

    def by_signature(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = (0, b"")
        for batch in batches:
            found = []
            for leader, id_, n, sig in zip(*(batch.column(c).to_pylist() for c in ("leader", "id", "n", "load")), strict=True):
                if id_ == leader:
                    head = (n, sig)
                elif _pair(*head, n, sig, num, den):
                    found.append((id_, leader))
            yield _answer(found, ("id", "leader"))

    def by_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.zeros(0, dtype=np.uint64)
        for batch in batches:
            found = []
            for part in slices(batch, "load"):
                g, n = sets_of(part.column("load"), k)
                for leader, id_, x in zip(part.column("leader").to_pylist(), part.column("id").to_pylist(), np.split(g, np.cumsum(n)[:-1]), strict=True):
                    if id_ == leader:
                        head = x
                        continue
                    same = _overlap(head, x)
                    if den * same >= num * (len(x) + len(head) - same):
                        found.append((id_, leader))
            yield _answer(found, ("id", "leader"))

    stars = keep(starred(starred(pairs, sigs, by_signature), texts, by_sets).select(F.col("id").alias("a"), F.col("leader").alias("b")))
    known = components(stars)

    # what is left: tiles with members that no link connects so far
    placed = keep(members.select("key", "id").join(known.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp")))
    open_ = keep(placed.groupBy("key").agg(F.count("*").alias("held"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key", "held"))
    if open_.isEmpty():
        return scanned, classes, known
    return scanned, classes, components(stars.unionByName(rest(placed, open_, known, sigs, texts, k, num, den)))


def rest(placed: DataFrame, open_: DataFrame, known: DataFrame, sigs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links (a, b) that connect all similar pairs of placed(key, id, comp) of different comp that share one of the open tiles.

    Signatures are compared inside each tile, block pair by block pair; what their bounds let pass
    makes small groups, inside which sorted sets decide.
    """
    parts = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = spread(placed, open_.withColumn("tile", F.col("held")), "key", kept=True)
    rows = blocked(rows, F.ceil(F.col("tile") / SIGNED_BLOCK), "id").join(sigs.withColumnRenamed("row", "id"), "id")

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for t, starts in grouped(batches, ["key", "a", "b"]):
            ids, n, comp, sig = t.column("id").to_numpy(), t.column("n").to_numpy(), t.column("comp").to_numpy(), t.column("load").to_pylist()
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)], strict=True):
                if e - s > 1:
                    _link(ids[s:e], n[s:e], sig[s:e], comp[s:e], num, den, forest)
        yield forest.batch()

    dealt = rows.select("key", "a", "b", "id", "comp", "n", "load").repartition(parts, "key", "a", "b").sortWithinPartitions("key", "a", "b")
    groups = components(dealt.mapInArrow(narrow, "a long, b long")).select(F.col("node").alias("id"), F.col("component").alias("grp"))
    comps = known.select(F.col("node").alias("id"), F.col("component").alias("comp"))
    named = keep(groups.join(sigs.select(F.col("row").alias("id"), "n"), "id").join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id")))
    shared = F.least(F.ceil(F.count("*") / GROUP_LEAST), F.lit(math.ceil(math.sqrt(2 * parts))))
    sizes = named.groupBy("grp").agg(F.count("*").alias("held"), F.greatest(F.ceil(F.count("*") / GROUP_BLOCK), F.ceil(F.sum("n") * 8 / GROUP_BYTES), shared).alias("blocks"))
    several = blocked(spread(named, sizes, "grp").drop("held"), F.col("blocks"), "id")
    loaded = maybe_in(texts.drop("n"), named.select(F.col("id").alias("row")), "row").withColumnRenamed("row", "id")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Forest()
        for t, starts in grouped(batches, ["grp", "a", "b"]):
            ids, comp, n, held = t.column("id").to_numpy(), t.column("comp").to_numpy(), [], []
            for whole in t.select(["load"]).to_batches():
                for part in slices(whole, "load"):
                    g, size = sets_of(part.column("load"), k)
                    n.append(size)
                    held.extend(np.split(g, np.cumsum(size)[:-1]))
            n = np.concatenate(n)
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)], strict=True):
                if e - s > 1:
                    sets = held[s:e]

                    def exact(i: int, j: int) -> bool:
                        same = _overlap(sets[i], sets[j])  # noqa: B023
                        return den * same >= num * (len(sets[i]) + len(sets[j]) - same)  # noqa: B023

                    local = Forest()
                    _link(ids[s:e], n[s:e], [parity(x) for x in sets], comp[s:e], num, den, local, exact)
                    for x in list(local.up):
                        out.join(x, local.find(x))
        yield out.batch()

    dealt = several.join(loaded, "id").select("grp", "a", "b", "id", "comp", "load").repartition(parts, "grp", "a", "b").sortWithinPartitions("grp", "a", "b")
    return keep(dealt.mapInArrow(check, "a long, b long").where("a <> b"))


def placed_rows(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(scan's table, (row, doc_id, n, best) of its rows with words): best is the first row of the whole group."""
    scanned, classes, found = linked(docs, k, num, den)
    joined = keep(classes.join(found.select(F.col("node").alias("rep"), "component"), "rep").select("rep", "component", "best"))
    firsts = joined.groupBy("component").agg(F.count("*").alias("held"), F.min("best").alias("first"))
    grouped_ = spread(joined.select("rep", "component"), firsts, "component").select("rep", "first")
    of_class = classes.join(grouped_, "rep", "left").select("h1", "h2", "held", F.coalesce("first", "best").alias("best"))
    rows = scanned.where("n > 0").select("row", F.col("doc.doc_id").cast("long").alias("doc_id"), "n", "h1", "h2")
    return scanned, spread(rows, of_class, "h1", "h2").select("row", "doc_id", "n", "best")


def jaccard_join(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents whose k-gram sets have overlap / union >= num / den are linked."""
    scanned, rows = placed_rows(docs.select("doc_id", "text"), k, num, den)
    full = rows.select("doc_id", F.col("n").alias("n_shingles"), F.col("best.doc_id").alias("component_id"))
    none = scanned.where("n = 0").select(F.col("doc.doc_id").cast("long").alias("doc_id"))
    return full.unionByName(none.select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_first(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One document of each group of similar ones, with all columns: the one with the smallest doc_id.

    Rows are told apart by their place, so rows that share a doc_id, or have none, go or stay each for its
    own text.  A null doc_id comes last; of rows that share the smallest one the first by name of the set and
    by hash of the row stays.  Documents without words stay; of those that share doc_id and text one does.
    """
    scanned, rows = placed_rows(docs, k, num, den)
    gone = rows.where("row <> best.row").select("row")
    bare = scanned.where("n = 0").select("row", "tie", F.md5(F.to_json(F.struct(F.col("doc.doc_id").alias("d"), F.col("doc.text").alias("t")))).alias("own"))
    same = bare.groupBy("own").agg(F.count("*").alias("held"), F.min(F.struct("tie", "row")).alias("first")).where("held > 1")
    gone = cut(gone.unionByName(spread(bare, same, "own").where("row <> first.row").select("row")))
    return without(scanned.select("row", "doc"), gone, "row").select("doc.*")


def op8_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, num=9, den=10)


#: All pairs of documents that share a shingle.
OP8_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), grams as (
  select distinct doc_id, unnest(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from w
), sizes as (
  select doc_id, count(*) as n from grams group by doc_id
), sized as (
  select grams.doc_id, g, n from grams join sizes using (doc_id)
), shared as (
  select p.doc_id as a, q.doc_id as b, p.n as na, q.n as nb, count(*) as same from sized p join sized q on p.g = q.g and p.doc_id < q.doc_id and 10 * p.n >= 9 * q.n and 10 * q.n >= 9 * p.n group by all
), pairs as (
  select a, b from shared where 100 * same >= 90 * (na + nb - same)
), links as (select a, b from pairs union all select b, a from pairs), reach as (
  select distinct a as x, a as y from links union select reach.x, links.b from reach join links on links.a = reach.y
), low as (
  select x, min(y) as component_id from reach group by x
)
select d.doc_id, coalesce(n, 0) as n_shingles, coalesce(component_id, d.doc_id) as component_id from documents d left join sizes using (doc_id) left join low on x = d.doc_id
"""
