"""Joins that stand hot keys, blocks of large groups, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.bloom import blocks_for, passes, words_of
from spindrift.storage import cut, keep

#: Keys of more than one in so many rows are answered from a broadcast: there can't be more than that many.
HOT_PARTS = 1000


def hot_keys(found: DataFrame, held: str = "held") -> DataFrame:
    """Those of found(.., held: rows with the key) that hold more than a HOT_PARTS-th of all rows: fewer than HOT_PARTS, whatever the input."""
    least = found.agg(F.floor(F.coalesce(F.sum(held), F.lit(0)) / HOT_PARTS).alias("least")).scalar()
    return found.where(F.col(held) > least)


def spread(rows: DataFrame, found: DataFrame, *key: str, held: str = "held", kept: bool = False) -> DataFrame:
    """rows joined with found, which has one row for each key and in ``held`` how many of rows have it.

    Hot keys are answered from a broadcast of bounded size, so their rows stay where they are; of the
    others none has enough rows to weigh on a task.  ``kept`` says that found comes from a table already.
    """
    found = found if kept else cut(found)
    hot = hot_keys(found, held)
    cold = rows.join(F.broadcast(hot.select(*key)), [*key], "left_anti").join(found.join(F.broadcast(hot.select(*key)), [*key], "left_anti"), [*key])
    return rows.join(F.broadcast(hot), [*key]).unionByName(cold)


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """rows whose key, never null, isn't in gone(key).  Most stay where they are: only those that a Bloom filter takes for gone are joined."""
    n_blocks = blocks_for(gone.count())
    marked = rows.withColumn("_words", words_of(gone, key, n_blocks))
    maybe = F.expr(passes(key, "_words", n_blocks))
    return marked.where(~maybe).drop("_words").unionByName(marked.where(maybe).drop("_words").join(gone.select(key), key, "left_anti").select(*rows.columns))


def maybe_in(rows: DataFrame, wanted: DataFrame, key: str, hashed: bool = False) -> DataFrame:
    """rows whose key may be in wanted(key), by a Bloom filter: what a join with wanted has to look at."""
    n_blocks = blocks_for(wanted.count())
    return rows.withColumn("_words", words_of(wanted, key, n_blocks, hashed)).where(F.expr(passes(key, "_words", n_blocks, hashed))).drop("_words")


def blocked(rows: DataFrame, blocks, id_: str) -> DataFrame:
    """Rows once for each pair of blocks that theirs is in: columns a <= b, and own, the row's block."""
    wide = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64(id_, F.lit(5)), F.col("blocks")).cast("int"))
    return (
        wide.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
        .withColumn("a", F.least("own", "other")).withColumn("b", F.greatest("own", "other")).drop("blocks", "other")
    )


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of rows with equal keys, and where groups begin, from batches sorted by the keys."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < 4096 and batch.nbytes < 1 << 20:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        starts = _starts(table, keys)
        if len(starts) > 1:
            last = int(starts[-1])
            yield table.slice(0, last), starts[:-1]
            table = table.slice(last)
        held, size = table.to_batches(), 0
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        if table.num_rows:
            yield table, _starts(table, keys)


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.zeros(table.num_rows, dtype=bool)
    change[:1] = True
    for k in keys:
        c = table.column(k).to_numpy()
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


#: Links that one task connects at the end; above that the graph is first made smaller, round by round.
LAST_LINKS = 1 << 20


class Forest:
    """Union-find over 64-bit ids, smallest id as root."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while up.get(root, root) != root:
            root = up[root]
        while up.get(x, x) != root:
            up[x], x = root, up[x]
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def batch(self) -> pa.RecordBatch:
        """(a, b) of every node that isn't a root, and its root."""
        pairs = [(x, self.find(x)) for x in list(self.up)]
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest, roots = Forest(), set()
    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            forest.join(a, b)
    found = forest.batch()
    yield found
    roots = sorted(set(found.column("b").to_pylist()))
    yield pa.RecordBatch.from_arrays([pa.array(roots, pa.int64()), pa.array(roots, pa.int64())], names=["a", "b"])


def components(links: DataFrame, last: int | None = None) -> DataFrame:
    """Connected components of links(a long, b long): one row (node, component) for every node that
    has a link; component is the smallest node reachable.  Null ends are ignored.

    A round hangs each node below its smallest neighbour, shortens those paths and puts the roots in
    place of the nodes, which at least halves the nodes that still have links.  A hub's links are folded
    by partial aggregates, its joins are plain ones that Spark can split.  When at most ``last`` links
    are left, one task connects them; only counts reach the driver.
    """
    # in the rounds tables, not checkpoints: a checkpoint carries its plan's constraints along, and they multiply
    last = LAST_LINKS if last is None else last
    edges = cut(links.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rounds: list[DataFrame] = []
    while edges.count() > last:
        both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("l")).select("l.a", "l.b")
        up = keep(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("up")).select(F.col("a").alias("node"), "up"))
        moved = True
        while moved:  # each step halves the way to the root
            step = keep(up.join(up.select(F.col("node").alias("up"), F.col("up").alias("next")), "up").select("node", F.col("next").alias("up"), (F.col("next") < F.col("up")).alias("moved")))
            up, moved = step.select("node", "up"), step.where("moved").limit(1).count() > 0
        rounds.append(up)
        for end in ("a", "b"):
            edges = edges.join(up.select(F.col("node").alias(end), F.col("up").alias("to")), end).select(F.col("to").alias(end), "b" if end == "a" else "a")
        edges = keep(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found = cut(edges.repartition(1).mapInArrow(_connect, "a long, b long").select(F.col("a").alias("node"), F.col("b").alias("component")))
    for up in reversed(rounds):
        top = found.select(F.col("node").alias("up"), "component")
        found = keep(up.join(top, "up", "left").select("node", F.coalesce("component", "up").alias("component")))
    return found
