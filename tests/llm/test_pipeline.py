from collections import Counter, defaultdict

import corpus_pipeline as C
from spindrift.llm import mixing as M
from spindrift.llm import quality as Q
from tests.llm.fixtures import AWKWARD, SCHEMA, words
from tests.llm.test_jaccard import model as similar
from tests.llm.test_packing import check


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def hold(spark, docs, sf):
    """Runs the stages one by one, each against a plain model of what it must do to its own input."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = {(r.doc_id, r.n_words) for r in Q.judge(docs, labels).collect() if r.kept}
    a = C.quality_rules(spark, docs, sf)
    assert a.columns == docs.columns
    assert rows_of(a) == Counter({r: n for r, n in rows_of(docs).items() if (r[0], len(words(r[1]))) in kept})
    b = C.ngram_jaccard(spark, a, sf)
    first = rows_of(a)
    low = {d for d, _, c in similar([(r[0], r[1]) for r in first], 5, 4, 5) if d == c}
    assert rows_of(b) == Counter({r: 1 for r in first if r[0] in low})
    c = C.mix_sources(spark, b, sf)
    plan = {r.doc_id: int(r.taken / r["size"] + 0.5) for r in M.mix_plan(b).collect() if r["size"]}
    assert rows_of(c) == Counter({r: plan[r[0]] for r in rows_of(b) if plan.get(r[0])})
    d = C.best_fit_packing(spark, c, sf).collect()
    check([tuple(r) for r in c.collect()], d, 1.05)
    return a, b, c, d


def test_stages_on_real_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a, b, c, d = hold(spark, docs, sf)
    whole = C.run(spark, sf).collect()
    assert Counter(r[:5] for r in whole) == Counter(r[:5] for r in d)
    taken, size = defaultdict(int), defaultdict(int)
    for r in c.collect():
        taken[r.source] += len(words(r.text))
    for r in b.collect():
        size[r.source] += len(words(r.text))
    longest = max(len(words(r.text)) for r in b.collect())
    for r in M.mix_plan(b).select("source", "target").distinct().collect():
        assert abs(taken[r.source] - r.target) <= longest


def test_stages_on_awkward_rows(spark, sf):
    docs = spark.createDataFrame(AWKWARD, SCHEMA)
    a, b, c, d = hold(spark, docs, sf)
    assert {r.doc_id for r in a.collect()} == {10, 11, 12} and {r.doc_id for r in b.collect()} == {10}
    for stage in (C.quality_rules, C.ngram_jaccard, C.mix_sources, C.best_fit_packing):
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_stages_with_nulls_repeats_and_clashing_names(spark, sf):
    names = ["row", "n", "h1", "h2", "tie", "sig", "cells", "gone_id", "_maybe_key", "_words", "mixed_times", "mixed_doc_id", "taken", "bin", "piece", "stat_n_words", "kept", "doc", "page", "best"]
    text = lambda name, n=80: " ".join(f"{name}{i}" for i in range(n))
    rows = [
        (1, text("a"), "en", "s", 1), (1, text("a"), "en", "s", 1), (None, text("a", 81), "en", None, None), (None, text("b"), None, None, None), (None, text("b"), None, None, None),
        (2, text("c"), "en", "t", 3), (2, text("d"), "en", "t", 3), (3, None, None, "t", None), (4, "", "en", "t", 0), (5, text("e", 6000), "en", "u", 1),
    ]
    docs = spark.createDataFrame([(*r, *(f"{n}{i}" for n in names)) for i, r in enumerate(rows)], SCHEMA + ", " + ", ".join(f"`{n}` string" for n in names))
    a = C.quality_rules(spark, docs, sf)
    assert a.columns == docs.columns and rows_of(a) == Counter({r: n for r, n in rows_of(docs).items() if r[1]})
    b = C.ngram_jaccard(spark, a, sf)
    left = b.collect()
    assert b.columns == docs.columns and Counter((r.doc_id, r.text.split("0")[0]) for r in left) == Counter([(1, "a"), (None, "b"), (2, "c"), (2, "d"), (5, "e")])
    assert {tuple(r) for r in left} <= {tuple(r) for r in docs.collect()}
    again = C.ngram_jaccard(spark, docs, sf).collect()
    assert Counter((r.doc_id, (r.text or "").split("0")[0]) for r in again) == Counter([(1, "a"), (None, "b"), (2, "c"), (2, "d"), (3, ""), (4, ""), (5, "e")])
    c = C.mix_sources(spark, b, sf)
    mixed = rows_of(c)
    assert c.columns == docs.columns and set(mixed) <= {tuple(r) for r in left} and max(mixed.values()) <= 3
    check(list(mixed.elements()), C.best_fit_packing(spark, c, sf).collect(), 1.5)


def test_names():
    assert [n for n, _ in C.STAGES] == ["quality_rules", "ngram_jaccard", "mix_sources", "best_fit_packing"]
    assert set(C.queries()) == {"pipeline"} and C.oracle_sql() == {}
