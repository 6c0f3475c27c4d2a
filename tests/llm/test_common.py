import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spindrift.llm import bloom
from spindrift.llm import common as C


def test_spread_is_an_inner_join(spark):
    rng = random.Random(1)
    rows = [(rng.choice([7, 7, 7, rng.randint(0, 3000)]), rng.choice("xy"), i) for i in range(6000)]
    held = Counter((a, b) for a, b, _ in rows)
    left = spark.createDataFrame(rows, "a int, b string, i int").repartition(3)
    found = spark.createDataFrame([(a, b, n, f"{a}{b}") for (a, b), n in held.items() if a % 5], "a int, b string, held long, v string")
    got = C.spread(left, found, "a", "b").select("a", "b", "i", "v").collect()
    assert Counter(map(tuple, got)) == Counter((a, b, i, f"{a}{b}") for a, b, i in rows if a % 5)
    hot = C.hot_keys(found).collect()
    assert {r.a for r in hot} == {7} and len(hot) == 2
    assert C.hot_keys(found.limit(0)).count() == 0 and C.spread(left, found.limit(0), "a", "b").count() == 0


@pytest.mark.parametrize("gone", [[], [1, 2, 3], list(range(0, 4000, 3))])
def test_without_and_maybe_in(spark, gone):
    rows = spark.range(4000).selectExpr("id as k", "struct(id as k, 'x' as _words) as doc")
    g = spark.createDataFrame([(x,) for x in gone], "k long")
    assert {r.k for r in C.without(rows, g, "k").collect()} == set(range(4000)) - set(gone)
    for hashed in (False, True):
        keys = rows.select(F.xxhash64("k").alias("h")) if hashed else rows.select(F.col("k").alias("h"))
        wanted = g.select((F.xxhash64("k") if hashed else F.col("k")).alias("h"))
        kept, must = {r.h for r in C.maybe_in(keys, wanted, "h", hashed).collect()}, {r.h for r in wanted.collect()}
        assert must <= kept and len(kept) <= len(must) + 80


def test_filters_grow_with_their_keys():
    assert [bloom.blocks_for(n) for n in (0, 1, 4, 5, 1000, 10**9)] == [1, 1, 1, 1, 256, bloom.MAX_BLOCKS]


def test_blocks_bring_every_pair_together_once(spark):
    rows = spark.range(40).select(F.lit(1).alias("g"), F.col("id"), F.lit(4).alias("n"))
    seen = Counter()
    for (a, b), part in __import__("itertools").groupby(sorted((r.a, r.b, r.id, r.own) for r in C.blocked(rows, F.col("n"), "id").collect()), key=lambda r: r[:2]):
        held = list(part)
        for i, x in enumerate(held):
            for y in held[:i]:
                if x[3] != y[3] or a == b:
                    seen[min(x[2], y[2]), max(x[2], y[2])] += 1
    assert seen == Counter({(i, j): 1 for j in range(40) for i in range(j)})
