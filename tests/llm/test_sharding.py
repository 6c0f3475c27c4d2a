import zlib
from collections import Counter

import pytest

from spindrift.llm import sharding as S
from tests.llm.fixtures import AWKWARD, SCHEMA


def model(rows, n):
    """Contiguous shards cut where equal stretches of all bytes end."""
    sized = sorted(((r[0] is not None, r[0] or 0), len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    total = sum(x[1] for x in sized)
    stretch, at, out, slots = max(1, -(-total // n)), 0, Counter(), Counter()
    for (there, d), size, crc in sized:
        shard = min(at // stretch, n - 1)
        out[(d if there else None, size, crc, shard, slots[shard])] += 1
        slots[shard] += 1
        at += size
    return out


@pytest.mark.parametrize("n", [1, 3, 8, 40])
def test_awkward_rows(spark, n):
    docs = spark.createDataFrame(AWKWARD, SCHEMA).selectExpr("*", "1 as size", "2 as shard", "3 as place")
    got = S.shard_plan(docs.repartition(5), n)
    assert Counter(tuple(r) for r in got.select("doc_id", "size", "text_crc32", "shard", "slot").collect()) == model(AWKWARD, n)
    assert S.shard_plan(docs.limit(0), n).count() == 0


def test_real_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = S.op6_byte_sharding(spark, sf).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in got) == model(rows, 8)
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    size = Counter()
    for r in got:
        size[r.shard] += r["size"]
    most = max(r["size"] for r in got)
    assert set(size) == set(range(8)) and max(size.values()) - min(size.values()) <= 2 * most
