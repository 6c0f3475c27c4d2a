import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

from spindrift.llm import packing as P
from spindrift.llm.tokens import tokenizer_path
from tests.llm.fixtures import AWKWARD, SCHEMA


def want(rows, length=2048):
    t = Tokenizer.from_file(tokenizer_path())
    out = Counter()
    for r in rows:
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), length):
            part = ids[k : k + length]
            out[(r[0], k // length, k, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes()))] += 1
    return out


def check(rows, got, most_waste):
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want(rows)
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    total = sum(r.length for r in got)
    assert len(seqs) <= max(-(-total // 2048) + 2, most_waste * total / 2048)


def test_awkward_rows(spark):
    docs = spark.createDataFrame(AWKWARD, SCHEMA).selectExpr("*", "1 as bin", "2 as piece")
    check(AWKWARD, P.pack_documents(docs.repartition(3)).collect(), 1.5)
    assert P.pack_documents(docs.limit(0)).count() == 0


def test_real_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check(rows, P.pack_documents(docs.repartition(5)).collect(), 1.02)


def test_bounded_best_fit():
    rng = random.Random(5)
    fit, fill = P.BestFit(100, 7), Counter()
    for _ in range(3000):
        n = rng.randint(1, 100)
        b, o = fit.place(n)
        assert fill[b] == o
        fill[b] += n
        assert fill[b] <= 100 and fit.open <= 7 and fit.open == sum(map(len, fit.free))
        assert {i for i, s in enumerate(fit.free) if s} == {i for i in range(100) if fit.set >> i & 1}
    a = P.BestFit(10)
    assert [a.place(n) for n in (6, 7, 3, 4, 10, 1)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0), (3, 0)]
