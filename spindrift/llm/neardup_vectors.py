"""Embedding near-dedup: iterative quantisation, multi-index Hamming tables, exact rerank.

1. On a bounded sample rotations of the principal components are learned so that the signs give balanced
   binary codes that lose little.  Codes are cut into disjoint substrings, as wide as the logarithm of the
   number of vectors that may meet asks for, and there are as many as simulated pairs at the threshold
   need to be found nearly always: with one bit flipped at most in some substring.
2. A table for each substring: a vector stands under its own key and probes the keys one flipped bit
   away (upwards only: of two keys that differ in a bit one has it unset).  Tables carry codes and ids.
3. Where vectors of one label meet, their whole codes have to lie within the Hamming radius.  A pair that
   meets in several tables counts in the first, which both codes tell.
4. Only what passes gets its original vector, and cosine >= threshold in double precision makes a link.

What the index misses is missed: recall is measured against all pairs in the tests.  Equal vectors are
one class with a count from the start.  A key of many vectors is cut into blocks, one task for each pair of
blocks, so none has to fit a task; links leave a task as counts and a forest, never as pairs.

Defined results: vectors that are null, of zero length or zero, or that hold a null or a non-finite
component, and those with a null label, link with nothing; vectors of different lengths don't link;
repeated rows are separate vectors that link with each other; a null vec_id counts as a vector but
is no smallest id unless there is no other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import Forest, blocked, components, grouped, hot_keys, maybe_in, spread
from spindrift.llm.wordscan import mix
from spindrift.storage import cut, keep

THRESHOLD = 0.93
#: Vectors that the rotations are fitted on, the first by a hash: the only bound here.
SAMPLE = 20_000
WORD = 64
#: Vectors that a key of a table has on average, about, and the narrowest and widest substring.
A_KEY = 8
NARROW, WIDE = 8, 28
MOST_TABLES = 48
#: Part of the simulated pairs at the threshold that the tables have to bring together, and that the radius lets pass.
FOUND = 0.999
SIMULATED = 4000
ROUNDS = 40
#: Vectors in a block of a hot key: as few as LEAST, if the tasks that there are can share its pairs of blocks, as many as BLOCK at most.
BLOCK, LEAST = 512, 32
#: Pairs that are compared at once.
PAIRS = 1 << 20
SEED = 3

_U = np.uint64


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that tiny and huge components survive squaring."""
    rows = rows / np.maximum(np.abs(rows).max(axis=1, keepdims=True), 1e-300)
    return rows / np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), 1e-300)


class Codes:
    """Projections that give codes of some 64-bit words, and how codes are cut into ``tables`` substrings of ``width`` bits."""

    def __init__(self, sample: np.ndarray, threshold: float, rows: int, rounds: int = ROUNDS, seed: int = SEED):
        self._rng = np.random.Generator(np.random.PCG64(seed))
        d = sample.shape[1] if sample.ndim == 2 and len(sample) else 1
        self._x = unit(sample.astype(np.float64)) if len(sample) else np.zeros((0, d))
        self.dim, self._rounds = d, rounds
        self.mean = self._x.mean(axis=0) if len(self._x) else np.zeros(d)
        _, self._vectors = np.linalg.eigh((self._x - self.mean).T @ (self._x - self.mean) + 1e-12 * np.eye(d))
        self.width = min(WIDE, max(NARROW, math.ceil(math.log2(max(1, rows) / A_KEY))))
        self.project = np.zeros((d, 0))
        pairs = self._simulated(threshold)
        self.tables, found = 0, 0.0
        while found < FOUND and self.tables < MOST_TABLES:
            self.tables += 1
            while self.project.shape[1] < self.tables * self.width:
                self.project = np.concatenate([self.project, self._rotated()], axis=1)
            if not pairs:
                break
            flips = [self.bits(x) != self.bits(y) for x, y in pairs]
            found = min(float((self._cut(f).sum(axis=2) <= 1).any(axis=1).mean()) for f in flips)
        self.radius = max([0, *(int(np.quantile(f.sum(axis=1), FOUND)) + 1 for f in flips)]) if pairs else WORD
        del self._x, self._vectors, self._rng

    def _rotated(self) -> np.ndarray:
        """Projection to one word: nearest corners, then the rotation that brings the vectors closest to them, again and again."""
        base = self._vectors[:, ::-1][:, :WORD]
        if base.shape[1] < WORD:  # fewer dimensions than bits: spread over all of them
            base = base @ self._rng.standard_normal((base.shape[1], WORD))
        turn = np.linalg.qr(self._rng.standard_normal((WORD, WORD)))[0]
        v = (self._x - self.mean) @ base
        for _ in range(self._rounds if len(v) else 0):
            u, _, w = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
            turn = (u @ w).T
        return base @ turn

    def _simulated(self, threshold: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """Pairs of exactly that cosine: sampled vectors turned in any direction, and towards another of them."""
        if len(self._x) < 2 or self.dim < 2:
            return []
        x = self._x[self._rng.integers(0, len(self._x), SIMULATED)]
        out = []
        for to in (self._rng.standard_normal(x.shape), self._x[self._rng.integers(0, len(self._x), SIMULATED)]):
            off = to - (to * x).sum(axis=1, keepdims=True) * x
            good = np.sqrt((off * off).sum(axis=1)) > 1e-6
            if good.any():
                out.append((x[good], threshold * x[good] + math.sqrt(max(0.0, 1 - threshold * threshold)) * unit(off[good])))
        return out

    def _cut(self, bits: np.ndarray) -> np.ndarray:
        return bits[:, : self.tables * self.width].reshape(len(bits), self.tables, self.width)

    def bits(self, vectors: np.ndarray) -> np.ndarray:
        """Codes of unit vectors, a bit a column; those of another length are folded or padded to the sample's."""
        n, d = vectors.shape
        if d != self.dim:
            padded = np.zeros((n, -(-d // self.dim) * self.dim))
            padded[:, :d] = vectors
            vectors = padded.reshape(n, -1, self.dim).sum(axis=1)
        return (vectors - self.mean) @ self.project >= 0

    def words(self, bits: np.ndarray) -> np.ndarray:
        return np.packbits(bits, axis=1, bitorder="little").copy().view(np.uint64)

    def keys(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, table, key, probe) of all keys that rows stand under or probe."""
        cut_ = self._cut(bits)
        own = (cut_ * (1 << np.arange(self.width))).sum(axis=2)
        row, table = (a.ravel() for a in np.indices(own.shape))
        prow, ptable, bit = np.nonzero(~cut_)
        return np.concatenate([row, prow]), np.concatenate([table, ptable]), np.concatenate([own.ravel(), own[prow, ptable] | (1 << bit)]), np.concatenate([np.zeros(own.size, bool), np.ones(len(prow), bool)])

    def near(self, x: np.ndarray, y: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Whether codes of words lie within the radius and come together in that table first."""
        differ = x ^ y
        good = np.bitwise_count(differ).sum(axis=1, dtype=np.int64) <= self.radius
        at = np.flatnonzero(good)
        flips = self._cut(np.unpackbits(differ[at].view(np.uint8).reshape(len(at), 8 * differ.shape[1]), axis=1, bitorder="little")).sum(axis=2) <= 1
        good[at] = flips.any(axis=1) & (flips.argmax(axis=1) == table[at])
        return good


def _vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, unit vectors) for each length that vectors of an Arrow column have."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    begin = np.cumsum(size) - size
    for d in np.unique(size).tolist():
        at = np.flatnonzero(size == d)
        yield at, unit(flat[begin[at][:, None] + np.arange(d)])


def _met(starts: np.ndarray, end: int, probe: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places (i, j), i no probe, inside each run of rows with one key; a run has its probes last.  Some at a time."""
    stops = np.append(starts[1:], end)
    last = np.repeat(stops, stops - starts)
    i = np.flatnonzero(~probe)
    partners = last[i] - i - 1
    ends = np.cumsum(partners)
    lo = 0
    while lo < len(i):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, side="right")))
        n = partners[lo:hi]
        a = np.repeat(i[lo:hi], n)
        yield a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        lo = hi


def near_vectors(table: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of table(vec_id, embedding, label)."""
    spark = table.sparkSession
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0)).alias("emb"))  # no -0.0
    kind = dict(table.dtypes)["embedding"]
    narrow = kind if kind == "array<float>" else "array<double>"  # what is stored and sent
    ok = "label is not null and emb is not null and size(emb) > 0 and forall(emb, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(emb, x -> x <> 0)"
    # two hashes of different seeds name a class; its number is its own
    names = [F.xxhash64("label", "emb").alias("h1"), F.xxhash64(F.lit(SEED), "emb", "label").alias("h2")]
    distinct = rows.where(F.expr(ok)).groupBy("label", "emb").agg(F.count("*").alias("copies"), F.min("vec_id").alias("low"))
    classes = keep(distinct.select(F.monotonically_increasing_id().alias("id"), *names, "label", F.col("emb").cast(narrow).alias("emb"), "copies", "low"))
    # bounded by the parameter
    fitted = classes.orderBy("h1", "h2").limit(sample).select("emb").toPandas()["emb"]
    dims = fitted.map(len)
    dim = int(dims.mode().iloc[0]) if len(dims) else 1
    most = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    codes = Codes(np.stack(fitted[dims == dim].to_list()) if len(dims) else np.zeros((0, 1)), threshold, most)

    def coded(column: pa.Array) -> np.ndarray:
        bits = np.zeros((len(column), codes.project.shape[1]), dtype=bool)
        for at, x in _vectors(column):
            bits[at] = codes.bits(x)
        return bits

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                batch = whole.slice(a, 1024)
                bits = coded(batch.column("emb"))
                row, table_, key, probe = codes.keys(bits)
                label = batch.column("lab").to_numpy().view(np.uint64)
                # the table in the last bits, a hash of label and key in the others
                bucket = (mix(label[row] ^ mix(key.astype(np.uint64) + (table_.astype(np.uint64) << _U(40)))) & ~_U(63)) | table_.astype(np.uint64)
                raw = codes.words(bits).view(np.uint8).reshape(len(bits), -1)
                code = pa.FixedSizeBinaryArray.from_buffers(pa.binary(raw.shape[1]), len(row), [None, pa.py_buffer(raw[row].tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), pa.array(batch.column("id").to_numpy()[row]), pa.array(probe), code], names=["bucket", "id", "probe", "code"])

    entries = classes.select(F.xxhash64("label").alias("lab"), "id", "emb").mapInArrow(index, "bucket long, id long, probe boolean, code binary")
    sizes = cut(entries.groupBy("bucket").agg(F.count("*").alias("held")).where("held > 1"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = F.least(F.ceil(F.col("held") / LEAST), F.lit(math.ceil(math.sqrt(2 * parts))))
    hot = F.broadcast(hot_keys(sizes).select("bucket", F.greatest(F.ceil(F.col("held") / BLOCK), shared).alias("blocks")))
    spread_out = blocked(entries.join(hot, "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))), F.col("blocks"), "id")
    keys = ["bucket", "a", "b"]

    def pairs_of(t: pa.Table, starts: np.ndarray, code: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows of t that the codes let pass."""
        bucket, a, b, own, id_ = (t.column(c).to_numpy() for c in ("bucket", "a", "b", "own", "id"))
        for i, j in _met(starts, t.num_rows, t.column("probe").to_numpy(zero_copy_only=False).astype(bool)):
            # pairs inside one block belong to that block's own task
            mine = ((own[i] != own[j]) | (a[i] == b[i])) & (id_[i] != id_[j])
            i, j = i[mine], j[mine]
            near = codes.near(code[i], code[j], bucket[i] & 63)
            yield i[near], j[near]

    def hamming(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in grouped(batches, keys):
            code = np.frombuffer(b"".join(t.column("code").to_pylist()), dtype=np.uint64).reshape(t.num_rows, -1)
            passed = np.zeros(t.num_rows, dtype=bool)
            for i, j in pairs_of(t, starts, code):
                passed[i] = passed[j] = True
            if passed.any():
                yield from t.drop_columns(["code"]).filter(pa.array(passed)).combine_chunks().to_batches()

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, links = Forest(), {}
        for t, starts in grouped(batches, keys):
            emb = t.column("emb").combine_chunks()
            emb = emb.chunk(0) if isinstance(emb, pa.ChunkedArray) else emb
            id_, copies, label = (t.column(c).to_numpy() for c in ("id", "copies", "label"))
            size, place, unit_ = np.zeros(t.num_rows, np.int64), np.zeros(t.num_rows, np.int64), {}
            for at, x in _vectors(emb):
                size[at], place[at], unit_[x.shape[1]] = x.shape[1], np.arange(len(at)), x
            for i, j in pairs_of(t, starts, codes.words(coded(emb))):
                same = (size[i] == size[j]) & (label[i] == label[j])
                i, j = i[same], j[same]
                for d in np.unique(size[i]).tolist():
                    p, q = i[size[i] == d], j[size[i] == d]
                    for lo in range(0, len(p), 1 << 16):
                        u, v = p[lo : lo + (1 << 16)], q[lo : lo + (1 << 16)]
                        good = np.einsum("ij,ij->i", unit_[d][place[u]], unit_[d][place[v]]) >= threshold
                        for x, y in zip(u[good].tolist(), v[good].tolist(), strict=True):
                            links[id_[x]] = links.get(id_[x], 0) + int(copies[y])
                            links[id_[y]] = links.get(id_[y], 0) + int(copies[x])
                            forest.join(int(id_[x]), int(id_[y]))
        found = list(links)
        yield pa.RecordBatch.from_arrays([pa.array([int(k) for k in found], pa.int64()), pa.array([forest.find(int(k)) for k in found], pa.int64()), pa.array([links[k] for k in found], pa.int64())], names=["id", "root", "found"])

    dealt = spread_out.select(*keys, "own", "probe", "id", "code").repartition(parts, *keys).sortWithinPartitions(*keys, "probe", "id")
    passed = keep(dealt.mapInArrow(hamming, "bucket long, a int, b int, own int, probe boolean, id long"))
    wanted = cut(passed.select("id").distinct())
    full = passed.join(maybe_in(classes.select("id", "label", "emb", "copies"), wanted, "id"), "id")
    found = keep(full.repartition(parts, *keys).sortWithinPartitions(*keys, "probe", "id").mapInArrow(rerank, "id long, root long, found long"))

    joined = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("id").agg(F.sum("found").alias("found"))
    linked = keep(classes.select("id", "low").join(joined.withColumnRenamed("node", "id"), "id"))
    lows = linked.groupBy("component").agg(F.count("*").alias("held"), F.min("low").alias("component_id"))
    placed = spread(linked.select("id", "component"), lows, "component").join(counts, "id", "left").select("id", "component_id", "found")
    result = classes.select("id", "h1", "h2", "copies", "low").join(placed, "id", "left").select(
        "h1", "h2", F.col("copies").alias("held"), F.coalesce("component_id", "low").alias("component_id"), (F.col("copies") - 1 + F.coalesce("found", F.lit(0))).alias("n_links")
    )
    usable = rows.where(F.expr(ok)).select("vec_id", *names)
    real = spread(usable, result, "h1", "h2").select("vec_id", "n_links", "component_id")
    none = rows.where(~F.coalesce(F.expr(ok), F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return real.unionByName(none).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op2_vector_neardup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: All pairs of one label.
OP2_SQL = """
with recursive v as (
  select vec_id, label, e, sqrt(list_dot_product(e, e)) as norm from (select vec_id, label, embedding::double[] as e from embeddings) where e is not null and label is not null
), pairs as (
  select p.vec_id as a, q.vec_id as b from v p join v q on p.label = q.label and p.vec_id < q.vec_id where list_dot_product(p.e, q.e) / (p.norm * q.norm) >= 0.93
), links as (select a, b from pairs union all select b, a from pairs), reach as (
  select distinct a as x, a as y from links union select reach.x, links.b from reach join links on links.a = reach.y
), low as (
  select x, min(y) as component_id from reach group by x
), n as (
  select a, count(*) as n_links from links group by a
)
select vec_id, coalesce(n_links, 0) as n_links, coalesce(component_id, vec_id) as component_id, coalesce(component_id, vec_id) = vec_id as kept
from embeddings left join n on a = vec_id left join low on x = vec_id
"""
