from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import quality as Q
from tests.llm.fixtures import AWKWARD, SCHEMA, words


def model(text):
    w, lines = words(text), (text or "").split("\n")
    real = [x for x in lines if words(x)]
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(3)}
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum((text or "").count(c) for c in "#*$%&|<>"),
        "n_dup_lines": len(real) - len(set(real)), "n_repeat_words": len(covered), "n_lines": len(real), "n_distinct_words": len(set(w)),
    }


def check(rows, got):
    want = Counter((r[0], *model(r[1]).values()) for r in rows)
    assert Counter((g.doc_id, *(g[k] for k in model(""))) for g in got) == want


def test_stats_of_awkward_rows(spark):
    got = Q.text_stats(spark.createDataFrame(AWKWARD, SCHEMA)).collect()
    check(AWKWARD, got)


def test_stats_of_real_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check([(r.doc_id, r.text) for r in docs.collect()], Q.text_stats(docs).collect())


def test_list_finds_planted_rule_and_spares_the_rest():
    rng = np.random.default_rng(3)
    x = rng.random((3000, 3))
    bad = (x[:, 0] > 0.7) & (x[:, 1] <= 0.4)
    rules = Q.learn_list(x, bad, ["a", "b", "c"])
    hit, open_ = np.zeros(3000, dtype=bool), np.ones(3000, dtype=bool)
    for rule, stays, _ in rules:  # the first rule that a row meets decides
        met = open_ & np.all([x[:, "abc".index(n)] <= v if op == "<=" else x[:, "abc".index(n)] > v for n, op, v in rule], axis=0)
        hit |= met & (not stays)
        open_ &= ~met
    assert (hit & bad).sum() > 0.85 * bad.sum() and (hit & ~bad).sum() < 0.05 * bad.sum()
    assert Q.learn_list(x, rng.random(3000) < 0.1, ["a", "b", "c"]) == []
    assert Q.learn_list(x[:0], bad[:0], ["a", "b", "c"]) == []


def test_exceptions_come_before_the_rules_they_except(spark):
    rng = np.random.default_rng(7)
    x = rng.random((6000, 2))
    bad = (x[:, 0] > 0.5) & ~(x[:, 1] > 0.6)
    rules = Q.learn_list(x, bad, ["upper", "digits"])
    open_, said = np.ones(len(x), dtype=bool), np.ones(len(x), dtype=bool)
    for rule, stays, _ in rules:
        met = open_ & np.all([x[:, ["upper", "digits"].index(n)] <= v if op == "<=" else x[:, ["upper", "digits"].index(n)] > v for n, op, v in rule], axis=0)
        said[met], open_ = stays, open_ & ~met
    assert (said == ~bad).mean() > 0.97 and not (rules and rules[-1][1])
    # the same verdicts by the one expression, over statistics that give these features
    rows = spark.createDataFrame([(i, int(a * 1_000_000), int(b * 1_000_000)) for i, (a, b) in enumerate(x[:500].tolist())], "i int, n_upper long, n_digits long").withColumn("word_chars", F.lit(1_000_000).cast("long"))
    got = {r.i: r.k for r in rows.select("i", Q.verdict(rules).alias("k")).collect()}
    assert sum(got[i] == bool(said[i]) for i in got) >= 499


@pytest.mark.parametrize("labels", [[], [(1, None, 0), (None, 0, 0), (4, 0, 0), (4, 1, 0)]])
def test_without_usable_labels_only_base_rules_hold(spark, labels):
    docs = spark.createDataFrame(AWKWARD, SCHEMA)
    got = Q.judge(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(AWKWARD)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed)


def test_filter_hands_all_columns_through(spark):
    docs = spark.createDataFrame(AWKWARD, SCHEMA).selectExpr("*", "1 as n_words", "'x' as stat_n_words", "2 as kept")
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = Q.quality_filter(docs, none)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == {10, 11, 12}
    assert Q.quality_filter(docs.limit(0), none).count() == 0


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rules = Q.fit(docs, labels.where("doc_id % 2 = 0"))
    rest = Q.text_stats(docs).where(~Q.base_failed()).withColumn("kept", Q.verdict(rules)).join(labels.where("doc_id % 2 = 1"), "doc_id")
    n = {(r.quality, r.kept): r["count"] for r in rest.groupBy("quality", "kept").count().collect()}
    bad_out, good_out = n.get((0, False), 0), n.get((1, False), 0)
    print(rules, n)
    assert bad_out > 0.8 * (bad_out + n.get((0, True), 0))
    assert good_out < 0.01 * (good_out + n.get((1, True), 0))
