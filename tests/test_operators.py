"""Operators on small tables against literal expectations and plain-Python models."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from spindrift import schema
from spindrift.functions import numeric
from spindrift.operators import evaluation, layout, metrics, recognition, review, similarity, store
from spindrift.plans.recognize import recognize
from spindrift.sources import files, sqlite
from spindrift.streaming import ingest


def test_schema_conforms_and_checks(spark):
    df = spark.createDataFrame([("DOC-1", "a.png", "o/a.png", "image", None)], "id string, filename string, original_path string, file_type string, language string")
    got = schema.conform(df, "documents").first()
    assert (got.language, got.status, got.source_manual, got.page_count, got.error) == ("ta", "uploaded", 0, 0, None)
    assert len(schema.TABLES) == 10
    with pytest.raises(Exception, match="unknown status: lost"):
        spark.createDataFrame([("lost",)], "status string").select(schema.in_domain("status", schema.DOCUMENT_STATUS)).collect()
    assert [r.k for r in schema.duplicates(spark.createDataFrame([(1,), (2,), (1,)], "k int"), "k").collect()] == [1]


DOCS = "doc_id long, id string, status string, source_type string, created_at string"
PAGES = "page_id long, doc_id long, page_number int, status string, review_status string, processed_at timestamp_ntz"
LINES = "line_id long, page_id long, doc_id long, line_order int, ocr_text string, verified_text string, confidence double, engine string, review_status string, tesseract_checked int"


def empty(spark):
    return tuple(spark.createDataFrame([], s) for s in (DOCS, PAGES, LINES))


def test_dashboard_of_nothing(spark):
    d = metrics.dashboard(*empty(spark)).first()
    assert (d.documents, d.pages, d.lines, d.auto_accepted_percent, d.reviewed_percent, d.reread_percent) == (0, 0, 0, 0.0, 0.0, 0.0)
    assert d.average_confidence is None and d.pages_per_minute is None and d.status_breakdown == [] and d.bucket_breakdown == []
    s = metrics.stats(*empty(spark)).first()
    assert (s.documents, s.lines_to_review, s.average_confidence) == (0, 0, None)


def test_dashboard_of_something(spark):
    import datetime as dt

    at = dt.datetime(2026, 1, 1)
    docs = spark.createDataFrame([(1, "a", "review", None, "1"), (2, "b", "failed", "palm_leaf", "2"), (3, "c", "review", "palm_leaf", "3")], DOCS)
    pages = spark.createDataFrame([(1, 1, 1, "ready", "verified", at), (2, 1, 2, "ready", "unreviewed", at + dt.timedelta(seconds=90)), (3, 2, 1, "pending", "unreviewed", None)], PAGES)
    lines = spark.createDataFrame([
        (1, 1, 1, 0, "x", None, 0.5, "paddle", "needs_review", 1), (2, 1, 1, 1, "x", None, 0.95, None, "accepted", 0), (3, 2, 1, 0, "x", "y", 0.9, "text_layer", "verified", 1), (4, 2, 1, 1, "x", "y", None, "paddle", "corrected", 0),
    ], LINES)
    d = metrics.dashboard(docs, pages, lines).first()
    assert (d.auto_accepted_percent, d.reviewed_percent, d.reread_percent, d.average_confidence, d.pages_per_minute) == (25.0, 50.0, 50.0, 78.3, 1.33)
    assert [tuple(x) for x in d.status_breakdown] == [("failed", 1), ("review", 2)]
    assert [tuple(x) for x in d.source_type_breakdown] == [("palm_leaf", 2), ("unknown", 1)]
    assert [tuple(x) for x in d.bucket_breakdown] == [("50-79%", 1), ("80-94%", 1), ("95-100%", 1)]
    assert metrics.stats(docs, pages, lines).first().average_confidence == 0.5
    assert metrics.throughput(pages.limit(0)).first().pages_per_minute is None
    bars = {r.count_: r.width for r in metrics.bar_widths(spark.createDataFrame([(1,), (200,), (0,)], "count long")).withColumnRenamed("count", "count_").collect()}
    assert bars == {1: 3.0, 200: 100.0, 0: 3.0}


def test_vote(spark):
    rows = [(1, 1, 0, "handwritten", 0.75), (1, 2, 0, "inscription", 0.5), (1, 2, 1, "handwritten", 0.25), (1, 3, 0, "inscription", 0.625), (2, 1, 0, "a", 0.5), (2, 1, 1, "b", 0.5), (3, 1, 0, "a", 0.0), (4, 1, 0, "z", 0.4), (4, 2, 0, "a", 0.4)]
    got = {r.doc_id: r for r in recognition.source_vote(spark.createDataFrame(rows, "doc_id int, page_number int, pos int, source_type string, confidence double")).collect()}
    assert got[1].source_type == "inscription" and got[1].confidence == 0.6 and got[1].votes["handwritten"] == 0.75
    assert got[2].source_type == "a" and (got[3].source_type, got[3].confidence) == ("a", 0.0) and got[4].source_type == "z"


def test_votes_add_up_exactly(spark):
    """0.1 + 0.7 and 0.6 + 0.2 aren't the same double; the class voted for first wins whatever the order of rows."""
    rows = [(1, 1, 0, "a", 0.1), (1, 2, 0, "b", 0.2), (1, 3, 0, "b", 0.6), (1, 4, 0, "a", 0.7), (2, 1, 0, "a", 0.7), (2, 2, 0, "b", 0.1), (2, 3, 0, "b", 0.2), (2, 4, 0, "b", 0.4), (3, 1, 0, "a", float("nan")), (3, 2, 0, "b", 0.5)]
    for some in (rows, rows[::-1]):
        got = {r.doc_id: r for r in recognition.source_vote(spark.createDataFrame(some, "doc_id int, page_number int, pos int, source_type string, confidence double").coalesce(1)).collect()}
        assert [(got[d].source_type, got[d].confidence) for d in (1, 2, 3)] == [("a", 0.5), ("a", 0.5), ("b", 1.0)]
        assert got[1].votes == {"a": 0.8, "b": 0.8}


def test_rounding_of_scaled_values(spark):
    df = spark.createDataFrame([(333 / 640,), (367 / 640,), (-333 / 640,), (0.5,), (None,)], "x double")
    assert [r.y for r in df.select(numeric.scaled_round("x", 6).alias("y")).collect()] == [0.520312, 0.573438, -0.520312, 0.5, None]


def test_routes(spark):
    rows = [("modern_print", "palm_leaf"), ("palm_leaf", "palm_leaf"), ("modern_print", "handwritten"), ("odd", None), (None, "inscription")]
    got = [(r.redo, r.route) for r in recognition.routes(spark.createDataFrame(rows, "requested string, source_type string")).collect()]
    assert got == [(True, "palm_leaf"), (False, "palm_leaf"), (False, "modern_print"), (False, "modern_print"), (True, "inscription")]


def test_gate_and_readings(spark):
    df = spark.range(20000).withColumn("c", F.when(F.col("id") < 10, 0.5).otherwise(0.99))
    got = df.where(recognition.needs_reread("c", F.col("id").cast("string"))).agg(F.count_if(F.expr("id < 10")), F.count("*")).first()
    assert got[0] == 10 and 250 < got[1] < 560
    words = spark.createDataFrame([([("a", 90.0), (" ", 50.0), ("b\u200c", 70.0), ("c", -1.0), ("\u200b", 9.0)],), ([],)], "w array<struct<word: string, conf: double>>")
    r = [x.r for x in words.select(recognition.word_reading(F.col("w")).alias("r")).collect()]
    assert (r[0].text, r[0].confidence, r[1].text, r[1].confidence) == ("a b", 0.8, "", 0.0)
    c = spark.createDataFrame([(["x", "y", "z"], [0.2, 0.60004, 0.60001])], "l array<string>, p array<double>").select(recognition.classification(F.col("l"), F.col("p")).alias("c")).first().c
    assert [tuple(x) for x in c] == [("y", 0.6, 60.0), ("z", 0.6, 60.0), ("x", 0.2, 20.0)]


def laid_out(lines):
    """The same rules over one page of (pos, x0, y0, x1, y1), line by line."""
    order = sorted(lines, key=lambda x: (x[2], x[1]))
    gap = 2.5 * sorted(max(1.0, x[4] - x[2]) for x in lines)[len(lines) // 2]
    regions = []
    for x in order:
        r = next((r for r in regions if abs(x[1] - r["x"]) <= gap), None)
        if r is None:
            r = {"x": x[1], "y": x[2], "lines": []}
            regions.append(r)
        r["x"], r["y"] = min(r["x"], x[1]), min(r["y"], x[2])
        r["lines"].append(x)
    regions.sort(key=lambda r: (r["x"], r["y"]))
    flat = [(i, x) for i, r in enumerate(regions, 1) for x in sorted(r["lines"], key=lambda x: (x[2], x[1]))]
    return {x[0]: (i, k) for k, (i, x) in enumerate(flat)}


def test_layout(spark):
    three = [(1, c + 3 * r, 40.0 + 150 * c, 15.0 + 22 * r, 130.0 + 150 * c, 27.0 + 22 * r) for r in range(2) for c in range(3)]
    rng = random.Random(8)
    rows = list(three)
    for p in range(2, 120):
        for i in range(rng.randint(1, 25)):
            x, y = rng.choice([20, 60, 200, 230, 400]) + rng.randint(0, 9), rng.randint(0, 12) * 10
            rows.append((p, i, float(x), float(y), float(x + 50), float(y + rng.randint(0, 14))))
    got = layout.reading_order(spark.createDataFrame(rows, "page_id int, pos int, x0 double, y0 double, x1 double, y1 double")).collect()
    assert [r.pos for r in sorted((r for r in got if r.page_id == 1), key=lambda r: r.line_order)] == [0, 3, 1, 4, 2, 5]
    for p in {r[0] for r in rows}:
        want = laid_out([r[1:] for r in rows if r[0] == p])
        assert {r.pos: (r.region_order, r.line_order) for r in got if r.page_id == p} == want


def test_review(spark):
    docs = spark.createDataFrame([(1, "a", "review", None, "2"), (2, "b", "review", None, "2"), (3, "c", "review", None, "1")], DOCS).withColumn("language", F.lit("ta"))
    pages = spark.createDataFrame([(1, 1, 1, "ready", "verified", None), (2, 1, 2, "ready", "unreviewed", None)], PAGES).withColumn("width", F.lit(None).cast("int")).withColumn("height", F.lit(0)).withColumn("image_path", F.lit("p.png"))
    lines = spark.createDataFrame([(11, 1, 1, 1, "கடல்", "", 0.4, "paddle", "needs_review", 1), (10, 1, 1, 0, "x", "வானம்", 0.9, "paddle", "verified", 0)], LINES)
    got = review.listing(docs, pages, 2).collect()
    assert [(r.id, r.verified_pages) for r in got] == [("a", 1), ("b", 0)]
    for bad in (0, 1001):
        with pytest.raises(ValueError):
            review.listing(docs, pages, bad)
    tree = {r.id: r.pages for r in review.review_tree(docs, pages, lines).collect()}
    assert [len(p.lines) for p in tree["a"]] == [2, 0] and tree["b"] == []
    assert [(x.text, x.romanized) for x in tree["a"][0].lines] == [("வானம்", "vaanam"), ("கடல்", "katal")]
    flat = review.review_lines(docs, pages, lines).collect()
    assert {(r.page_width, r.page_height) for r in flat} == {(1, 1)}
    events = spark.createDataFrame([(1, 11, "edit", " Kim\t", "new"), (2, 11, "reject", "Bea", "newer")], "seq long, line_key long, action string, reviewer string, new_text string")
    after = review.apply_verifications(lines, events)
    row = after.where("line_id = 11").first()
    assert (row.review_status, row.verified_text) == ("verified", "newer")
    assert {r.page_id: r.rolled_up for r in review.page_rollup(lines).collect()} == {1: "unreviewed"}
    assert {r.page_id: r.rolled_up for r in review.page_rollup(after).collect()} == {1: "verified"}
    assert [(r.previous_text, r.reviewer) for r in review.history(events).orderBy("seq").collect()] == [(None, "Kim"), ("new", "Bea")]
    odd = spark.createDataFrame([("choose", "x"), ("edit", " \t\n"), ("edit", None), ("accept", "y")], "action string, reviewer string")
    assert [r.problem for r in review.checked(odd).collect()] == ["unknown action", "no reviewer", "no reviewer", None]
    boxes = {c: F.lit(0.0) for c in ("x0", "y0", "x1", "y1")}
    pairs = review.training_pairs(review.training_context(docs, pages, after.withColumns(boxes)))
    paths = spark.createDataFrame([("crops/1/page-0001-line-0001.png",)], "path string")
    assert review.export_lines(pairs).count() == 2
    assert [r.value for r in review.export_lines(pairs, paths).collect()] == ["crops/1/page-0001-line-0001.png\tnewer"]


def test_store(spark):
    old = spark.createDataFrame([(1, 1, "a", "x"), (1, 2, "b", "y")], "d int, p int, s string, t string")
    new = spark.createDataFrame([(1, 1, None, "n", ["s"]), (2, 1, "c", "m", ["s", "t", "d"])], "d int, p int, s string, t string, supplied array<string>")
    assert sorted(map(tuple, store.upsert(old, new, ["d", "p"]).collect()), key=str) == [(1, 1, None, "x"), (1, 2, "b", "y"), (2, 1, "c", "m")]
    assert sorted(map(tuple, store.upsert(old, new.drop("supplied"), ["d", "p"], ["t"]).collect()), key=str) == [(1, 1, "a", "n"), (1, 2, "b", "y"), (2, 1, None, "m")]
    e = spark.createDataFrame([(1, "o", 9), (2, "o", 1)], "page_id int, model string, seq int")
    n = spark.createDataFrame([(1, "n", 1), (1, "m", 2), (3, "n", 1)], "page_id int, model string, seq int")
    assert sorted(map(tuple, store.last_wins(e, n, ["page_id"], "seq").collect())) == [(1, "m", 2), (2, "o", 1), (3, "n", 1)]
    kids, fresh = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "page_id int, t string"), spark.createDataFrame([(1, "z")], "page_id int, t string")
    assert sorted(map(tuple, store.replace_children(kids, fresh, "page_id").collect())) == [(1, "z"), (2, "c")]
    tables = {
        "documents": spark.createDataFrame([("a",), ("b",)], "id string"), "pages": spark.createDataFrame([(1, "a"), (2, "b")], "id long, document_id string"), "regions": spark.createDataFrame([(5, 1), (6, 2)], "id long, page_id long"),
        "lines": spark.createDataFrame([(10, 1, 5), (20, 2, 6), (21, 2, 5), (22, 2, None)], "id long, page_id long, region_id long"), "verifications": spark.createDataFrame([(1, 10), (2, 20)], "id long, line_id long"),
    }
    left = store.cascade(tables, spark.createDataFrame([("a",)], "id string"))
    assert {k: sorted(map(tuple, v.collect()), key=str) for k, v in left.items()} == {"documents": [("b",)], "pages": [(2, "b")], "regions": [(6, 2)], "lines": [(20, 2, 6), (21, 2, None), (22, 2, None)], "verifications": [(2, 20)]}
    assert [r.id for r in store.orphans(tables["verifications"], "line_id", left["lines"], "id").collect()] == [1]
    docs = spark.createDataFrame([("a", "uploaded", None, None), ("b", "review", None, None)], "id string, status string, error string, updated_at string")
    bad = spark.createDataFrame([("a", "failed", "e" * 2000)], "id string, status string, error string")
    got = {r.id: r for r in store.set_status(docs, bad, F.lit("now")).collect()}
    assert (got["a"].status, len(got["a"].error), got["a"].updated_at, got["b"].status, got["b"].updated_at) == ("failed", 1000, "now", "review", None)
    with pytest.raises(Exception, match="unknown status"):
        store.set_status(docs, bad.withColumn("status", F.lit("lost")), F.lit("now")).collect()


def test_evaluation(spark):
    pairs = spark.createDataFrame([("abc", "abd"), ("xy", "xy"), ("é", "e")], "target string, prediction string")
    r = evaluation.ocr_quality(pairs).first()
    assert (r.samples, r.edits, r.characters, r.exact) == (3, 2, 6, 1) and r.cer_percent == pytest.approx(33.333333) and r.exact_percent == pytest.approx(33.333333)
    none = evaluation.ocr_quality(pairs.limit(0)).first()
    assert none.cer_percent is None and none.exact_percent is None
    assert [x.character for x in evaluation.charset(spark.createDataFrame([("ba",), ("bc",), (None,)], "text string")).collect()] == ["a", "b", "c"]
    texts = spark.createDataFrame([("ab",), ("bc",)], "text string")
    assert [r.character for r in evaluation.missing_characters(evaluation.charset(texts.limit(1)), texts).collect()] == ["c"]
    losses = spark.createDataFrame([(1, 0.5), (1, 0.25001), (2, 1.0)], "epoch int, loss double")
    assert {r.epoch: r.loss for r in evaluation.epoch_loss(losses).collect()} == {1: 0.375, 2: 1.0}
    rows = spark.range(103).withColumn("k", (F.col("id") * 37) % 103).repartition(7)
    got = sorted((r.k, r.row_index, r.validation) for r in evaluation.split(rows, "k").collect())
    assert got == [(i, i, i % 10 == 0) for i in range(103)]
    b = evaluation.batches(rows.withColumnRenamed("k", "row_index"), 10)
    assert sorted(r["count"] for r in b.groupBy("batch").count().collect()) == [3] + [10] * 10


@pytest.mark.parametrize(("target", "patience"), [(80.0, 8), (30.0, 8), (99.0, 2), (99.0, 50)])
def test_early_stop(spark, target, patience):
    rng = random.Random(int(target) + patience)
    runs = []
    for r in range(8):
        for e in range(1, 30):
            runs.append((r, e, float(rng.randint(10, 14)), float(rng.randint(0, 90))))
    got = {(x.run, x.epoch): x for x in evaluation.early_stop(spark.createDataFrame(runs, "run int, epoch int, cer double, exact double"), target, patience, "run").collect()}
    for r in range(8):
        best, stale, stopped = (float("inf"), -1.0), 0, False
        for run, e, cer, exact in runs:
            if run != r:
                continue
            better = cer < best[0] or cer == best[0] and exact > best[1]
            best, stale = ((cer, exact), 0) if better else (best, stale + 1)
            stop = not stopped and (exact >= target or stale >= patience)
            stopped |= stop
            x = got[r, e]
            assert (x.improved, x.stale, x.stop) == (better, stale, stop)


def test_search(spark):
    index = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [1.0, 1.0]), (3, "b", [0.0, 2.0]), (4, None, [1.0, 0.1]), (5, "b", None), (6, "c", [0.0, 0.0])], "page_id int, document_id string, embedding array<double>")
    q = spark.createDataFrame([(1, [2.0, 0.0], "a"), (2, [2.0, 0.0], None), (3, [0.0, 0.0], "")], "query_id int, embedding array<double>, exclude string")
    got = {}
    for r in similarity.similar(index, q, k=3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.page_id, r.similarity_score))
    assert got == {1: [(4, 0.995), (3, 0.0), (6, 0.0)], 2: [(1, 1.0), (4, 0.995), (2, 0.7071)], 3: [(1, 0.0), (2, 0.0), (3, 0.0)]}


def test_search_in_blocks_gives_the_same(spark, monkeypatch):
    rng = random.Random(3)
    index = spark.createDataFrame([(i, "abc"[i % 3], [rng.uniform(-1, 1) for _ in range(5)]) for i in range(60)], "page_id int, document_id string, embedding array<double>")
    q = spark.createDataFrame([(i, [rng.uniform(-1, 1) for _ in range(5)], [None, "a", ""][i % 3]) for i in range(25)], "query_id int, embedding array<double>, exclude string")
    rows = lambda: sorted(map(str, similarity.similar(index, q).collect()))
    want = rows()
    assert len(want) == 100
    monkeypatch.setattr(similarity, "QUERY_BLOCK", 7)
    assert rows() == want


def test_search_gives_what_every_pair_gives(spark, monkeypatch):
    """Against all pairs in plain Python: copies, small tiles, zero vectors, other sizes, nulls and NaN; equal scores by id."""
    rng = random.Random(5)
    pool = [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(20)]
    odd = [[0.0] * 6, [0.5] * 4, [None, *[1.0] * 5], [float("nan"), *[1.0] * 5], [], [1e-200] * 6, [1e200] * 6]
    vector = lambda: rng.choice(pool) if rng.random() < 0.5 else rng.choice(odd) if rng.random() < 0.2 else [rng.uniform(-1, 1) for _ in range(6)]
    rows = [(f"p{i:04}", rng.choice([None, "a", "b", "c"]), None if i % 50 == 0 else vector()) for i in range(600)]
    asked = [(i, None if i == 7 else vector(), [None, "a", "b", "", "z"][i % 5]) for i in range(60)]

    def unit(v):
        if v is None or None in v:
            return v
        n = 0.0
        for x in v:
            n += x * x
        n = n**0.5
        return [x / n if n > 0 or n != n else x for x in v]

    def place(v, q):
        """(0, 0) for a score that is no number, (1, -score), (2, 0) for none."""
        if len(v) != len(q) or None in v or None in q:
            return (2, 0.0)
        s = 0.0
        for x, y in zip(v, q, strict=True):
            s += x * y
        return (0, 0.0) if s != s else (1, -s)

    units = [(i, doc, unit(v)) for i, doc, v in rows if v is not None]
    want = {(q, r + 1): i for q, v, x in asked if v is not None for r, (_, i) in enumerate(sorted((place(u, unit(v)), i) for i, doc, u in units if not x or doc != x)[:4])}
    index = spark.createDataFrame(rows, "page_id string, document_id string, embedding array<double>")
    queries = spark.createDataFrame(asked, "query_id int, embedding array<double>, exclude string")
    for block, numbers, tile in ((1 << 17, 1 << 23, 1024), (25, 1 << 23, 16), (1 << 17, 200, 1)):
        for name, value in {"QUERY_BLOCK": block, "QUERY_NUMBERS": numbers, "TILE": tile, "FIRST_ROWS": tile, "ROWS": 4 * tile}.items():
            monkeypatch.setattr(similarity, name, value)
        assert {(r.query_id, r.rank): r.page_id for r in similarity.similar(index, queries).collect()} == want


def test_search_never_makes_all_pairs(spark):
    """Queries and rows meet inside a task, so no join makes a row of each pair."""
    index = spark.range(300).selectExpr("id as page_id", "cast(id % 7 as string) as document_id", "array(sin(id), cos(id)) as embedding")
    found = similarity.similar(index, index.selectExpr("page_id as query_id", "embedding", "document_id as exclude"))
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 1200


def test_page_images_crops_and_sinks(spark, tmp_path):
    from spindrift.functions import images
    from spindrift.functions.numeric import crop_box

    turned, small, thumb = (images.transformer(f) for f in (_upright, _small, _thumbnail))
    df = spark.createDataFrame([(1, b"abcdefgh"), (2, None)], "i int, file binary").select("i", images.prepared(F.col("file"), turned, small, thumb).alias("p"))
    got = {r.i: r.p for r in df.collect()}
    assert (bytes(got[1].image), bytes(got[1].thumbnail)) == (b"hgfedcba-s", b"hgfedcba-t") and got[2].image is None
    box = crop_box(F.lit(5.4), F.lit(0.0), F.lit(6.0), F.lit(1.0), F.lit(8), F.lit(9))
    crops = df.select(F.format_string("crop-%d.png", "i").alias("path"), images.cropper(_cut)(F.col("p.image"), box).alias("content"))
    assert {r.path: r.content and bytes(r.content) for r in crops.collect()} == {"crop-1.png": b"1,0,8,5", "crop-2.png": None}
    folder = str(tmp_path)

    def put(path, content):
        with open(f"{folder}/{path}", "wb") as f:
            f.write(content)

    files.write_files(crops, put)
    assert [p.name for p in tmp_path.iterdir()] == ["crop-1.png"] and (tmp_path / "crop-1.png").read_bytes() == b"1,0,8,5"
    with pytest.raises(FileNotFoundError):
        files.parquet_files(spark, folder)
    spark.range(2).write.parquet(f"{folder}/t")
    assert [p.endswith(".parquet") for p in files.parquet_files(spark, folder)] == [True] * len(files.parquet_files(spark, folder))


def _upright():
    return lambda f: f[::-1]


def _small():
    return lambda f: f + b"-s"


def _thumbnail():
    return lambda f: f + b"-t"


def _cut():
    return lambda f, a, b, c, d: f"{a},{b},{c},{d}".encode()


def test_recognition_with_fake_engines(spark):
    pages = spark.createDataFrame([(d, p, bytes([d, p]), "ta", "modern_print") for d in (1, 2) for p in (1, 2, 3)], "doc_id int, page_number int, image binary, language string, requested string")

    def classify(image):
        return F.array(F.struct(F.when(F.substring(F.hex(image), 1, 2) == "01", "palm_leaf").otherwise("modern_print").alias("source_type"), F.lit(0.9).alias("confidence")))

    def page_engine():
        return lambda image, language, route: [
            {"text": f" {route} low ", "confidence": 0.5, "bbox": [0.0, 10.0 + len(image), 9.0, 20.0], "engine": "paddle"}, {"text": "\u200b", "confidence": 0.9, "bbox": [0.0, 0.0, 1.0, 1.0], "engine": "paddle"},
            {"text": "first", "confidence": 0.99, "bbox": [0.0, 0.0, 9.0, 9.0], "engine": "paddle"},
        ]

    def line_engine():
        return lambda image, bbox, language: {"text": f"{language}{len(image)}", "confidence": 0.7, "engine": "tesseract"}

    enhance = lambda image: F.concat(image, F.lit(b"!!"))
    docs, lines = recognize(pages, classify, recognition.page_reader(page_engine), recognition.line_reader(line_engine), enhance)
    assert {(r.status, r.error) for r in docs.collect()} == {("review", None)}
    assert {r.doc_id: (r.source_type, r.redo, r.route) for r in docs.collect()} == {1: ("palm_leaf", True, "palm_leaf"), 2: ("modern_print", False, "modern_print")}
    got = {}
    for r in lines.orderBy("doc_id", "page_number", "line_order").collect():
        got.setdefault((r.doc_id, r.page_number), []).append((r.text, r.review_status, r.y0, r.second and r.second.text))
    assert len(got) == 6
    for (d, _), page in got.items():
        assert page[0][:2] == ("first", "accepted")
        assert page[1] == (("palm_leaf low", "needs_review", 14.0, "ta4") if d == 1 else ("modern_print low", "needs_review", 12.0, "ta2"))


def test_lines_placed_in_the_row_are_those_of_reading_order(spark):
    rng = random.Random(11)
    sides = [None, float("nan"), 0.0, 5.0, 30.0, 31.0, 90.0, 300.0]
    line = lambda odd: (rng.choice([" a  b", "\u200b", "c", "", None]), rng.choice([None, 0.5]), [rng.choice(sides if odd else sides[2:]) for _ in range(4)] if rng.random() < 0.95 else None, "paddle")
    pages = [[line(p % 2) for _ in range(rng.randrange(16))] for p in range(300)]
    df = spark.createDataFrame(list(enumerate(pages)), f"page_id int, lines {recognition.LINE}").coalesce(1)
    names = ("pos", "region_order", "line_order", "region_x0", "region_y0", "region_x1", "region_y1")
    got = df.select("page_id", F.inline(layout.placed_lines(F.col("lines")))).select("page_id", "text", "confidence", "engine", "bbox", *names)
    clean = df.select("page_id", F.posexplode(recognition.clean_lines(F.col("lines"))).alias("pos", "l")).select("page_id", "pos", "l.*")
    flat = clean.select("*", *(F.col("bbox")[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))))
    want = layout.reading_order(flat).select("page_id", "text", "confidence", "engine", "bbox", *names)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 500
    assert df.select(layout.placed_lines(F.lit(None).cast(recognition.LINE)).alias("p")).first().p is None


def test_recognition_moves_images_once(spark):
    """Lines come from what was written with their places, without a shuffle; the pages as they came are gone by then."""
    from pathlib import Path

    from spindrift.storage import shared_dir

    tables = Path(shared_dir(spark).removeprefix("file:")) / "tables"
    before = set(tables.glob("*"))
    pages = spark.createDataFrame([(d, p, bytes([d, p]), "ta", None) for d in range(1, 9) for p in range(1, d + 1)], "doc_id int, page_number int, image binary, language string, requested string")
    classify = lambda image: F.array(F.struct(F.when(F.hex(image) == "0601", "inscription").otherwise("handwritten").alias("source_type"), F.lit(0.9).alias("confidence")))

    def page_engine():
        return lambda image, language, route: [{"text": f"{route} {i}", "confidence": 0.5 if i == image[1] else 0.99, "bbox": [0.0, 20.0 * i, 9.0, 20.0 * i + 9], "engine": "paddle"} for i in range(3)]

    line = recognition.line_reader(lambda: lambda image, bbox, language: {"text": f"{image[0]}.{image[1]}", "confidence": 0.7, "engine": "tesseract"})
    docs, lines = recognize(pages, classify, recognition.page_reader(page_engine), line)
    assert "Exchange" not in lines._jdf.queryExecution().executedPlan().toString()
    # the documents and the pages as they were read
    assert len(set(tables.glob("*")) - before) == 2
    got = lines.collect()
    assert len(got) == 3 * 36 and all(r.second.text == f"{r.doc_id}.{r.page_number}" for r in got if r.confidence == 0.5) and {r.line_order for r in got} == {0, 1, 2}
    assert {r.doc_id: r.source_type for r in docs.collect()} == dict.fromkeys(range(1, 9), "handwritten")


def test_a_page_that_cannot_be_read_fails_its_document_only(spark):
    pages = spark.createDataFrame([(d, p, bytes([d, p]), "ta", "modern_print") for d in (1, 2, 3) for p in (1, 2)], "doc_id int, page_number int, image binary, language string, requested string")

    def page_engine():
        def read(image, language, route):
            if image == bytes([2, 2]):
                raise RuntimeError("torn page " + "x" * 2000)
            return [{"text": "t", "confidence": 0.99, "bbox": [0.0, 0.0, 9.0, 9.0], "engine": "paddle"}]

        return read

    def probabilities():
        return lambda image: [0.1, 0.2, 0.6, 0.05, 0.05]

    line = recognition.line_reader(lambda: lambda image, bbox, language: {"text": "again", "confidence": 0.7, "engine": "tesseract"})
    docs, lines = recognize(pages, recognition.classifier(probabilities), recognition.page_reader(page_engine), line)
    got = {r.doc_id: r for r in docs.collect()}
    assert {d: r.status for d, r in got.items()} == {1: "review", 2: "failed", 3: "review"} and {r.source_type for r in got.values()} == {"handwritten"}
    assert got[2].error.startswith("torn page") and len(got[2].error) == 1000 and got[1].error is None
    assert sorted((r.doc_id, r.page_number) for r in lines.collect()) == [(1, 1), (1, 2), (2, 1), (3, 1), (3, 2)]


def test_engines_are_made_once_and_skip_null_images(spark):
    def vectors():
        return lambda image: [float(len(image)), 1.0]

    df = spark.createDataFrame([(1, b"ab"), (2, None)], "i int, image binary")
    embed = recognition.embedder(vectors)
    assert [tuple(r) for r in df.select("i", embed("image").alias("v")).orderBy("i").collect()] == [(1, [2.0, 1.0]), (2, None)]
    from spindrift.functions.images import per_worker

    one, two = (lambda *key: [1, key]), (lambda *key: [2, key])
    assert per_worker(one, "ta", "a") is per_worker(one, "ta", "a") is not per_worker(one, "ta", "b")
    assert per_worker(one, "ta", "a") == [1, ("ta", "a")] and per_worker(two, "ta", "a") == [2, ("ta", "a")]


def test_replacing_a_reading(spark):
    lines = schema.conform(spark.createDataFrame([(1, 1, "old"), (2, 2, "other"), (3, 3, "gone")], "id long, page_id long, ocr_text string"), "lines")
    regions = schema.conform(spark.createDataFrame([(7, 1, 1), (8, 2, 1)], "id long, page_id long, reading_order int"), "regions")
    read = spark.createDataFrame([(1,), (3,)], "page_id long")
    box = [0.0, 1.0, 2.0, 3.0] * 2
    rows = [(1, 0, 1, "a", 0.9, None, None, *box), (1, 1, 1, None, None, "consensus", "x", *box), (1, 2, 2, "c", 0.79, "paddle", None, *box)]
    reading = spark.createDataFrame(rows, "page_id long, line_order int, region_order int, text string, confidence double, engine string, second string, x0 double, y0 double, x1 double, y1 double, region_x0 double, region_y0 double, region_x1 double, region_y1 double")
    new_lines, new_regions = store.replace_reading(lines, regions, read, reading)
    got = {(r.page_id, r.line_order): r for r in new_lines.collect()}
    assert set(got) == {(1, 0), (1, 1), (1, 2), (2, None)}
    assert [(got[1, i].ocr_text, got[1, i].engine, got[1, i].tesseract_checked, got[1, i].review_status) for i in range(3)] == [("a", "paddle", 0, "accepted"), ("", "consensus", 1, "needs_review"), ("c", "paddle", 0, "needs_review")]
    assert sorted((r.page_id, r.reading_order, r.x1) for r in new_regions.collect() if r.page_id == 1) == [(1, 1, 2.0), (1, 2, 2.0)] and new_regions.count() == 3
    assert {r.region_id for r in new_lines.collect() if r.page_id == 1} == {r.id for r in new_regions.collect() if r.page_id == 1}


def test_views_and_reports(spark, tmp_path):
    docs = spark.createDataFrame([("a", "f.png", 3)], "id string, filename string, page_count int")
    assert review.by_id(docs, "a").columns == list(review.SUMMARY) and review.by_id(docs, "a").first().verified_pages == 0 and review.by_id(docs, "z").count() == 0
    files.write_report(docs, str(tmp_path / "r"))
    assert tuple(files.json_state(spark, str(tmp_path / "r"), "id string, page_count int").first()) == ("a", 3)
    assert [r.id for r in review.statuses(docs.withColumns({"status": F.lit("review"), "error": F.lit(None)}), ["a", "b"]).collect()] == ["a"]
    assert tuple(recognition.mean_confidence(spark.createDataFrame([("a", 80.0), (" \t", 1.0), ("b", 90.0)], "word string, conf double")).first()) == (2, 85.0)


def test_files(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    for name, data in (("a.PNG", b"123"), ("b.txt", b"1"), ("c.jpg", b""), ("d.pdf", b"1")):
        (land / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: r.code for r in files.uploads(spark, str(land)).collect()}
    assert got == {"a.PNG": None, "b.txt": 415, "d.pdf": 415}
    sizes = spark.createDataFrame([("c.jpg", 0), ("c.txt", 0), ("c.jpg", 600 * 1024 * 1024), ("c.jpg", None)], "path string, length long")
    assert [r.c for r in sizes.select(files.upload_code("path", "length").alias("c")).collect()] == [400, 415, 413, None]
    import hashlib

    expected = spark.createDataFrame([("a.PNG", hashlib.sha256(b"123").hexdigest().upper()), ("b.txt", "0")], "name string, sha256 string")
    assert {r.name: r.intact for r in files.verified_files(files.binary_files(spark, str(land)), expected).collect()} == {"a.PNG": True, "b.txt": False, "d.pdf": False}
    listing = spark.createDataFrame([('[{"path": "data/train_shard_003.parquet", "size": 5, "lfs": {"oid": "ab"}}, {"path": "README", "size": 1}]',)], "value string")
    assert [tuple(r) for r in files.shard_listing(listing).collect()] == [("train_shard_003.parquet", 5, "ab", 3)]
    spark.range(5).selectExpr("struct(cast('x' as binary) as bytes) as image", "cast(id as string) as text", "id as other").write.parquet(str(tmp_path / "p"))
    s = files.parquet_samples(spark, str(tmp_path / "p"), ("image.bytes", "text"))
    assert set(s.columns) == {"bytes", "text", "file", "row"} and s.count() == 5
    assert files.labels(spark, str(tmp_path / "p")).count() == 5
    files.write_label_list(spark.createDataFrame([(2, "b"), (1, "a")], "line_id int, value string"), str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["a", "b"]
    assert files.as_json(spark.createDataFrame([(1, None)], "a int, b string")).first().value == '{"a":1,"b":null}'


def test_sqlite_source(spark, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as db:
        db.execute("create table lines(id integer primary key, t text, c real)")
        db.executemany("insert into lines values (?, ?, ?)", [(i, f"t{i}" if i % 3 else None, i / 4) for i in range(1, 500)])
        db.execute("create table none(id integer)")
    sqlite.register(spark)
    df = spark.read.format("sqlite_file").option("path", path).option("table", "lines").load()
    assert df.dtypes == [("id", "bigint"), ("t", "string"), ("c", "double")]
    assert df.agg(F.sum("id"), F.count("t"), F.sum("c")).first()[:] == (124750, 333, 31187.5)
    assert spark.read.format("sqlite_file").option("path", path).option("table", "none").load().count() == 0
    assert sqlite.tables(path) == ["lines", "none"]


def test_streams(spark, tmp_path):
    land, out, cp = (str(tmp_path / x) for x in ("land", "out", "cp"))
    (tmp_path / "land").mkdir()
    (tmp_path / "land" / "a.png").write_bytes(b"12")
    (tmp_path / "land" / "b.txt").write_bytes(b"12")
    assert ingest.ingest_uploads(spark, land, out, cp) == 1
    assert ingest.ingest_uploads(spark, land, out, cp) == 0  # nothing new
    (tmp_path / "land" / "c.jpg").write_bytes(b"123")
    assert ingest.ingest_uploads(spark, land, out, cp) == 1
    assert sorted(r.length for r in spark.read.parquet(f"{out}/pages").collect()) == [2, 3]
    assert [r.code for r in spark.read.parquet(f"{out}/refused").collect()] == [415]
    done = spark.createDataFrame([(1,)], "page_id int")
    assert [r.page_id for r in ingest.pending(spark.createDataFrame([(1,), (2,)], "page_id int"), done).collect()] == [2]


def test_daily_counts_of_a_stream(spark, sf, tmp_path):
    stream = spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    run = ingest.daily_counts(stream).writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.table("daily").agg(F.sum("n")).first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()


def test_download_progress(spark):
    sizes = spark.createDataFrame([("a", 10, 3, 2.0), ("b", 5, 5, 1.0), ("c", 0, 0, 0.0)], "name string, size long, prefix long, seconds double")
    done = spark.createDataFrame([("a", 7)], "name string, start long")
    got = {r.name: (r.bytes_done, r.percent, r.rate, r.seconds_left) for r in evaluation.download_progress(sizes, done, 4).collect()}
    assert got == {"a": (6, 60.0, 1.5, pytest.approx(4 / 1.5)), "b": (5, 100.0, 0.0, 0.0), "c": (0, 0.0, 0.0, 0.0)}
    assert tuple(evaluation.all_passed(spark.createDataFrame([(True,), (False,)], "ok boolean")).first()) == (False, 1)
