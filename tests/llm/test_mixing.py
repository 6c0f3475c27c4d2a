from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from spindrift.llm import mixing as M
from tests.llm.fixtures import AWKWARD, SCHEMA, words


def water(sizes, weights, most):
    """Targets by resharing what is above, again and again."""
    total, capped = sum(sizes), set()
    while True:
        left = total - sum(most * sizes[i] for i in capped)
        w = sum(weights[i] for i in range(len(sizes)) if i not in capped)
        t = [most * s if i in capped else left * weights[i] / w if w else 0 for i, s in enumerate(sizes)]
        over = {i for i, x in enumerate(t) if x > most * sizes[i]}
        if not over - capped:
            return t
        capped |= over


def seats(targets, n):
    won = [0] * len(targets)
    for _ in range(n):
        i = max(range(len(targets)), key=lambda i: (targets[i] / (2 * won[i] + 1), -i))
        won[i] += 1
    return won


@pytest.mark.parametrize("sizes", [[100, 5, 7, 300, 0, 20], [1], [10, 10, 10, 10], [0, 0], [1000, 1, 1, 1, 1, 1, 1]])
def test_targets_and_quotas(spark, sizes):
    sized = spark.createDataFrame([(f"s{i}", s) for i, s in enumerate(sizes)], "source string, size long")
    targets = M.source_targets(sized)
    got = {r.sid: r for r in targets.collect()}
    want = water(sizes, [1 + i % 3 for i in range(len(sizes))], 3)
    for i, t in enumerate(want):
        assert got[i + 1].target == pytest.approx(t)
    for n in (16, 37, 1 << 20):
        q = {r.sid: r for r in M.block_quotas(targets, n).collect()}
        house = sum(sizes) // q[1].block
        assert [q[i + 1].quota for i in range(len(sizes))] == (seats([got[i + 1].target for i in range(len(sizes))], house) if sum(sizes) else [0] * len(sizes))
        shards = M.shard_quotas(M.block_quotas(targets, n), 4).collect()
        per = defaultdict(int)
        for r in shards:
            per[r.shard] += r.blocks
        assert sum(per.values()) == sum(r.quota for r in q.values()) and max(per.values()) - min(per.values()) <= 1


def test_mix_of_awkward_rows(spark):
    docs = spark.createDataFrame(AWKWARD, SCHEMA).withColumn("size", F.lit("x")).withColumn("taken", F.lit(1))
    got = M.mix_plan(docs).collect()
    assert sorted((r.doc_id or -1, r["size"]) for r in got) == sorted((r[0] or -1, len(words(r[1]))) for r in AWKWARD)
    per = defaultdict(lambda: [0, 0, 0])
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"]
        per[r.source][0] += r["size"]
        per[r.source][1] += r.taken
        per[r.source][2] = r.target
        assert r.source_size == sum(len(words(x[1])) for x in AWKWARD if x[3] == r.source)
    for size, taken, target in per.values():
        assert taken <= 3 * size and abs(taken - target) <= 1.5
    assert sorted(map(str, M.mix_plan(docs.repartition(3)).collect())) == sorted(map(str, got))
    assert M.mix_plan(docs.limit(0)).count() == 0


def plain(rows, n_blocks, n_shards, seed=11):
    """(doc_id, size) -> words in each shard, block copy by block copy."""
    import hashlib
    import math

    digest = lambda t: hashlib.md5(t.encode()).hexdigest()
    per = defaultdict(list)
    for d, text, source in rows:
        per[source].append((digest(f"{seed}:" + ("null" if d is None else str(d))), d is not None, d or 0, len(words(text))))
    names = sorted((s for s in per if s is not None)) + [None] * (None in per)
    sizes = [sum(x[3] for x in per[s]) for s in names]
    total = sum(sizes)
    block = max(1, math.ceil(total / n_blocks))
    targets = water(sizes, [1 + i % 3 for i in range(len(names))], 3)
    quota = seats(targets, total // block) if total else [0] * len(names)
    out, before = {}, 0
    for s, size, q in zip(names, sizes, quota, strict=True):
        n = max(1, math.ceil(size / block))
        q = min(q, 3 * n)
        shares = [sum((before + u) % n_shards == g for u in range(q)) for g in range(n_shards)]
        before += q
        order = [g for g, x in enumerate(shares) for _ in range(x)]  # the shard of each copy
        phase = int(digest(f"{seed}:" + ("\x00null" if s is None else s))[:12], 16) % n
        picked = [i for i in range(n) if (i * (q % n) + phase) % n < q % n]
        copies = {i: [p * n + i for p in range(q // n)] for i in range(n)}
        for k, i in enumerate(picked):
            copies[i].append(q // n * n + k)
        at = 0
        for _, _, d, m in sorted(per[s]):
            got = [0] * n_shards
            for w in range(at, at + m):
                for u in copies[w // block]:
                    got[order[u]] += 1
            out[d, m, s] = got
            at += m
    return out


@pytest.mark.parametrize(("n_blocks", "n_shards"), [(40, 3), (1 << 20, 8), (7, 2)])
def test_blocks_and_shards_against_a_plain_model(spark, n_blocks, n_shards):
    rows = [(i, " ".join(["w"] * (1 + 7 * i % 23)), ["a", "b", "c", None, "d"][i % 5 if i % 11 else 0]) for i in range(1, 90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = M.mix_plan(docs, n_blocks=n_blocks, n_shards=n_shards).collect()
    assert {(r.doc_id, r["size"], r.source): r.shard_words for r in got} == plain(rows, n_blocks, n_shards)
    assert all(r.taken == sum(r.shard_words) for r in got)


def test_mixing_hands_columns_of_any_name_through(spark):
    names = ["mixed_times", "mixed_doc_id", "mixed_source", "times", "tag", "doc", "d", "s", "t", "col"]
    docs = spark.createDataFrame([(*r, *(f"{n}{i}" for n in names)) for i, r in enumerate(AWKWARD)], SCHEMA + ", " + ", ".join(f"`{n}` string" for n in names))
    out = M.mix_documents(docs)
    rows = out.collect()
    assert out.columns == docs.columns and rows and {tuple(r) for r in rows} <= {tuple(r) for r in docs.collect()}


def test_rows_without_ids_are_mixed_by_their_own_texts(spark):
    rows = [(None, f"t{i} " * (i + 1), "a") for i in range(40)] + [(i, "x " * 400, "b") for i in range(5)]
    out = M.mix_documents(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    n = defaultdict(int)
    for r in out.collect():
        n[r.text] += 1
    assert all(n[t] <= 3 for _, t, s in rows if s == "a") and sum(n.values()) < 200


def test_mixed_documents(spark):
    docs = spark.createDataFrame(AWKWARD, SCHEMA).withColumn("size", F.lit("x"))
    out = M.mix_documents(docs)
    assert out.columns == docs.columns
    texts = {r.text for r in out.collect()}
    assert texts and all(words(t) for t in texts) and texts <= {r[1] for r in AWKWARD}
    assert M.mix_documents(docs.limit(0)).count() == 0
