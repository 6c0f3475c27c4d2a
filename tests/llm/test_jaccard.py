import random
from collections import Counter

import pyarrow as pa
import pytest

from spindrift.llm import jaccard as J
from spindrift.llm.common import components as connect
from tests.llm.fixtures import AWKWARD, SCHEMA, components, shingles


def model(rows, k, num, den):
    """(doc_id, size of its set, smallest doc_id reachable), over all pairs of different sets."""
    sets = [frozenset(shingles(t, k)) for _, t in rows]
    classes = list(set(sets) - {frozenset()})
    links = []
    for i, a in enumerate(classes):
        for b in classes[:i]:
            same = len(a & b)
            if den * same >= num * (len(a) + len(b) - same):
                links.append((classes.index(a), classes.index(b)))
    roots = components(range(len(classes)), links)
    ids = {}
    for (d, _), s in zip(rows, sets, strict=True):
        if s and d is not None:
            r = roots[classes.index(s)]
            ids[r] = min(ids.get(r, d), d)
    return Counter((d, len(s), ids.get(roots[classes.index(s)]) if s else d) for (d, _), s in zip(rows, sets, strict=True))


def variants(seed, groups=25):
    rng = random.Random(seed)
    rows, n = [], 0
    phrase = [f"common{i}" for i in range(60)]
    for _ in range(groups):
        words = [rng.choice("abcdefgh") + str(rng.randint(0, 400)) for _ in range(rng.choice([2, 4, 30, 80, 200]))]
        if rng.random() < 0.5:
            words[len(words) // 2 : len(words) // 2] = phrase
        for _ in range(rng.randint(1, 9)):
            w = list(words)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = f"z{rng.randint(0, 10**6)}"
            rows.append((n, rng.choice([" ", "\n", "  "]).join(x.upper() if rng.random() < 0.1 else x for x in w)))
            n += rng.randint(1, 3)
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("k", "num", "den"), [(3, 9, 10), (5, 4, 5), (1, 1, 2)])
def test_against_all_pairs(spark, k, num, den, monkeypatch):
    monkeypatch.setattr(J, "GROUP_BLOCK", 2)
    monkeypatch.setattr(J, "SIGNED_BLOCK", 3)
    monkeypatch.setattr(J, "STAR_BLOCK", 2)
    rows = variants(k)
    got = J.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), k, num, den).collect()
    assert Counter(tuple(r) for r in got) == model(rows, k, num, den)


def test_awkward_rows(spark):
    docs = spark.createDataFrame(AWKWARD, SCHEMA).selectExpr("*", "1 as n", "2 as class", "3 as component_id")
    got = J.jaccard_join(docs, 3, 9, 10)
    assert Counter(tuple(r) for r in got.collect()) == model([r[:2] for r in AWKWARD], 3, 9, 10)
    assert J.jaccard_join(docs.limit(0), 3, 9, 10).count() == 0
    left = J.keep_first(docs, 3, 9, 10)
    assert left.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in left.collect()) == [-1, 1, 2, 3, 4, 5, 6, 7, 9, 10, 13, 14, 15, 16]


def test_keep_first_tells_rows_with_null_or_shared_ids_apart(spark):
    def text(name, n=60):
        return " ".join(f"{name}{i}" for i in range(n))

    rows = [
        # a near copy without an id goes, rows without an id and of their own stay, as do near copies among them, once
        (1, text("a")), (None, text("a", 61)), (None, text("b")), (None, text("c")), (None, text("d")), (None, text("d", 61)), (None, text("d", 62)),
        # shared ids: the near copy of 2 goes, the other text of 3 stays; near copies that share 4 leave one, equal texts of 5 too
        (2, text("e")), (3, text("e", 61)), (3, text("f")), (4, text("g")), (4, text("g", 61)), (4, text("h")), (5, text("i")), (5, text("i")), (5, text("i").upper()),
        # a near copy of a row that goes, and texts without words
        (6, text("j")), (7, text("j", 61)), (7, text("k")), (None, text("k", 61)), (8, ""), (8, ""), (8, " "), (None, ""), (None, None), (None, ""), (9, text("l")),
    ]
    docs = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, one int").repartition(3)
    left = J.keep_first(docs, 5, 4, 5)
    assert left.columns == docs.columns
    got = Counter((r.doc_id, (r.text or "").split("0")[0].lower().strip()) for r in left.collect())
    assert got == Counter([(1, "a"), (None, "b"), (None, "c"), (None, "d"), (2, "e"), (3, "f"), (4, "g"), (4, "h"), (5, "i"), (6, "j"), (7, "k"), (8, ""), (8, ""), (None, ""), (None, ""), (9, "l")])
    assert all(rows[r.one] == (r.doc_id, r.text) for r in left.collect())


def test_near_copies_of_which_the_first_is_no_centre(spark, monkeypatch):
    # copies differ from one text in a few words each, so most pairs of copies are not similar, and links go through the centre
    monkeypatch.setattr(J, "STAR_BLOCK", 16)
    monkeypatch.setattr(J, "SIGNED_BLOCK", 50)
    monkeypatch.setattr(J, "GROUP_BLOCK", 40)
    rng = random.Random(12)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.choice([6, 7, 8])):
            w[rng.randrange(len(w))] = f"n{rng.randint(0, 10**9)}"
        rows.append((i, " ".join(w)))
    rows.insert(120, (500, " ".join(base)))
    got = J.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 3, 9, 10).collect()
    assert Counter(tuple(r) for r in got) == model(rows, 3, 9, 10)


def test_rows_without_ids_cost_no_more(spark):
    import time

    rows = [(i, f"t{i // 2} " + " ".join(f"w{i // 2}x{j}" for j in range(30))) for i in range(4000)]
    seconds = []
    for ids in ("doc_id", "cast(null as long) as doc_id", "cast(7 as long) as doc_id"):
        docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(ids, "text")
        began = time.time()
        assert J.jaccard_join(docs, 3, 9, 10).groupBy().sum("n_shingles").first()[0] == 4000 * 29
        seconds.append(time.time() - began)
    assert max(seconds[1:]) < 3 * seconds[0], seconds


def test_real_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert Counter(tuple(r) for r in J.jaccard_join(docs, 3, 9, 10).collect()) == model(rows, 3, 9, 10)


def test_components_of_long_paths(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 300)] + [(rng.randint(400, 900), rng.randint(400, 900)) for _ in range(400)] + [(1000, 1001 + i) for i in range(200)] + [(None, 3), (5, 5)]
    want = components({x for p in links for x in p if x is not None}, [p for p in links if None not in p])
    for last in (1 << 20, 50, 0):
        got = {r.node: r.component for r in connect(spark.createDataFrame(links, "a long, b long"), last).collect()}
        assert got == {n: want[n] for n in got} and set(got) == {x for a, b in links if a is not None and a != b for x in (a, b)}
    assert connect(spark.createDataFrame([], "a long, b long")).count() == 0


def test_signatures_bound_from_above():
    rng = random.Random(9)
    import numpy as np

    for _ in range(300):
        a = {rng.randrange(1 << 63) for _ in range(rng.randint(1, 3000))}
        b = set(rng.sample(sorted(a), int(len(a) * rng.random()))) | {rng.randrange(1 << 63) for _ in range(rng.randint(1, 200))}
        x, y = (np.array(sorted(s), dtype=np.uint64) for s in (a, b))
        if 10 * len(a & b) >= 8 * len(a | b):
            assert J._pair(len(a), J.parity(x), len(b), J.parity(y), 8, 10)


def test_grams_of_short_texts():
    g, n = J.sets_of(pa.array(["a b", "a b", "b a", "A  b", "", None, "a", "a b c", "a b c d"]), 3)
    assert n.tolist() == [1, 1, 1, 1, 0, 0, 1, 1, 2]
    assert g[0] == g[1] == g[3] and len(set(g.tolist())) == 5


@pytest.mark.parametrize(("num", "den"), [(9, 10), (4, 5), (1, 2), (19, 20)])
def test_similar_sets_share_a_cell(num, den):
    import numpy as np

    rng = np.random.default_rng(num)
    for size in [1, 2, 5, 9, 10, 31, 40, 100, 333, 700, 5000]:
        for _ in range(25):
            a = rng.integers(0, 1 << 63, size, dtype=np.uint64)
            drop = rng.integers(0, max(1, round(size * (den - num) / den)) + 1)
            b = np.concatenate([a[drop:], rng.integers(0, 1 << 63, rng.integers(0, max(1, size // 8) + 1), dtype=np.uint64)])
            a, b = np.unique(a), np.unique(b)
            same = len(np.intersect1d(a, b))
            if len(b) and den * same >= num * (len(a) + len(b) - same) and not np.array_equal(a, b):
                who, key = J.cells_of(np.concatenate([a, b]), np.array([len(a), len(b)]), num, den)
                assert set(key[who == 0].tolist()) & set(key[who == 1].tolist()), (size, len(a), len(b), same)


def test_bands_keep_partners_near():
    for num, den in ((9, 10), (4, 5), (1, 2), (99, 100)):
        first, cells, differ = J.bands(num, den, 100_000)
        for n in range(1, 4000):
            i = int(np_search(first, n))
            far = n * den // num
            assert far < first[i + 2] and 2 * (first[i + 1] - 1) * (den - num) // (den + num) == differ[i]
            assert cells[i] == -1 or cells[i] > differ[i] or differ[i] == 0


def np_search(first, n):
    import numpy as np

    return np.searchsorted(first, n, side="right") - 1
