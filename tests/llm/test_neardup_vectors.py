import numpy as np
import pytest

from spindrift.llm import neardup_vectors as V
from tests.llm.fixtures import components


def model(rows, threshold=0.93):
    """n_links and component of each row over all pairs of one label."""
    links, good = [], []
    for i, (_, emb, label) in enumerate(rows):
        x = np.array([np.nan if v is None else v for v in emb], dtype=np.float64) if emb is not None else np.zeros(0)
        if label is not None and len(x) and np.isfinite(x).all() and x.any():
            good.append((i, label, V.unit(x[None])[0]))
    for k, (i, a, x) in enumerate(good):
        for j, b, y in good[:k]:
            if a == b and len(x) == len(y) and float(x @ y) >= threshold:
                links.append((i, j))
    roots = components(range(len(rows)), links)
    n, low = [0] * len(rows), {}
    for i, j in links:
        n[i] += 1
        n[j] += 1
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[roots[i]] = min(low.get(roots[i], r[0]), r[0])
    return n, [low.get(roots[i]) for i in range(len(rows))]


SCHEMA = "vec_id long, embedding array<float>, label int"


def run(spark, rows, schema=SCHEMA):
    got = V.near_vectors(spark.createDataFrame(rows, schema).selectExpr("*", "1 as copies", "2 as `class`")).collect()
    assert len(got) == len(rows)
    return got


def test_awkward_rows(spark):
    e = [1.0, 2.0, 3.0]
    rows = [
        (1, None, 0), (2, [], 0), (3, [0.0, 0.0, 0.0], 0), (4, [1.0, None, 3.0], 0), (5, [1.0, float("nan"), 3.0], 0), (6, [1.0, float("inf"), 0.0], 0),
        (10, e, 0), (11, e, 0), (12, [2.0, 4.0, 6.0], 0), (13, e, 1), (14, e, None), (15, [1.0, 2.0, 3.0, 0.0], 0), (16, [-1.0, -2.0, -3.0], 0), (16, e, 0), (None, e, 0), (17, [3.0, -1.0, 0.5], 0),
    ]
    n, low = model(rows)
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in run(spark, rows))
    assert got == sorted((str(r[0]), n[i], low[i], r[0] is not None and r[0] == low[i]) for i, r in enumerate(rows))
    assert V.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("d", [8, 64, 200])
def test_recall_against_all_pairs(spark, d, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 40)
    rng = np.random.default_rng(d)
    rows, base = [], rng.standard_normal((60, d))
    for i in range(900):
        x = base[rng.integers(60) if rng.random() < 0.7 else 0] + rng.standard_normal(d) * rng.choice([0.0, 0.1, 0.2, 0.3, 1.0])
        rows.append((i, [float(v) for v in x], int(i % 2)))
    n, low = model([(i, np.array(x, dtype=np.float32), y) for i, x, y in rows])
    got = {r.vec_id: r for r in run(spark, rows)}
    found = sum(r.n_links for r in got.values())
    assert all(got[i].n_links <= n[i] for i in got)
    assert found >= 0.95 * sum(n), (found, sum(n))
    assert sum(got[i].component_id == low[i] for i in got) >= 0.95 * len(rows)


def test_real_rows(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in table.collect()]
    n, low = model(rows)
    got = {r.vec_id: r for r in V.near_vectors(table).collect()}
    assert sum(r.n_links for r in got.values()) >= 0.99 * sum(n) and all(got[r[0]].n_links <= n[i] for i, r in enumerate(rows))
    assert sum(got[r[0]].component_id == low[i] for i, r in enumerate(rows)) >= 0.995 * len(rows)


def test_balanced_codes():
    rng = np.random.default_rng(1)
    x = V.unit(rng.standard_normal((4000, 64)) @ np.diag(np.linspace(2, 0.2, 64)))
    bits = V.Codes(x[:2000], 0.93, 5000).bits(x)
    assert abs(bits.mean(axis=0) - 0.5).max() < 0.1


@pytest.mark.parametrize("rows", [50, 5000, 10**6])
def test_tables_bring_pairs_together(rows):
    rng = np.random.default_rng(rows)
    x = V.unit(rng.standard_normal((3000, 64)))
    y = V.unit(x + 0.3 * V.unit(rng.standard_normal(x.shape)))
    codes = V.Codes(x, 0.93, rows)
    a, b = codes.bits(x), codes.bits(y)
    ka, kb = ({}, {})
    for bits, out in ((a, ka), (b, kb)):
        for r, t, k, p in zip(*codes.keys(bits), strict=True):
            out.setdefault(int(r), []).append((int(t), int(k), bool(p)))
    met, near = 0, 0
    for r in range(len(x)):
        own = {(t, k) for t, k, p in ka[r] if not p}, {(t, k) for t, k, p in kb[r] if not p}
        probes = {(t, k) for t, k, p in ka[r] if p}, {(t, k) for t, k, p in kb[r] if p}
        at = sorted([t for t, _ in own[0] & own[1]] + [t for t, _ in own[0] & probes[1]] + [t for t, _ in own[1] & probes[0]])
        # a pair meets in a table exactly once if its substrings differ in one bit at most, else never
        flips = (codes._cut(a[r : r + 1]) != codes._cut(b[r : r + 1]))[0].sum(axis=1)
        assert at == np.flatnonzero(flips <= 1).tolist()
        met += bool(at)
        near += sum(bool(codes.near(codes.words(a[r : r + 1]), codes.words(b[r : r + 1]), np.array([t]))[0]) for t in set(at))
    assert met >= 0.995 * len(x) and met * 0.99 <= near <= met
