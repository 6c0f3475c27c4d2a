"""Every query by name, and the SQL another engine answers it with."""

from __future__ import annotations

import sqlite3
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.functions import numeric as N
from spindrift.functions import text as X
from spindrift.functions import vectors as V
from spindrift.operators import evaluation, layout, metrics, recognition, review, similarity, store
from spindrift.plans import fixtures as fx
from spindrift.plans.recognize import recognize
from spindrift.sources import files, sqlite
from spindrift.storage import own_folder
from spindrift.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, fixtures: bool = True):
    """Registers a function under its name; sql may use the fixtures' tables."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = "with recursive" + fx.SQL + sql.strip() if fixtures else sql.strip()
        return f

    return put


def _three(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return fx.documents(spark, d), fx.pages(spark, d), fx.lines(spark, d)


_WS = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_NORM = "trim(regexp_replace(translate(nfc_normalize($x), chr(8203) || chr(8204) || chr(8205) || chr(65279), ''), '" + _WS + "', ' ', 'g'))"
_CONS, _SIGNS = "".join(X.CONSONANTS), "".join(X.VOWEL_SIGNS)


# --- metrics


@query("""
select (select count(*) from fx_documents) as documents, (select count(*) from fx_pages) as pages, lines,
  coalesce(accepted * 100.0::double / nullif(lines, 0), 0) as auto_accepted_percent, coalesce(reviewed * 100.0::double / nullif(lines, 0), 0) as reviewed_percent,
  round(mean * 100, 6) as average_confidence, round((select case when n >= 2 and m > 0 then n / m end from (select count(*) as n, date_diff('second', min(processed_at), max(processed_at)) / 60.0::double as m
    from fx_pages where status = 'ready' and processed_at is not null)), 6) as pages_per_minute, coalesce(reread * 100.0::double / nullif(lines, 0), 0) as reread_percent
from (select count(*) as lines, count(*) filter (review_status = 'accepted') as accepted, count(*) filter (review_status in ('verified', 'corrected')) as reviewed,
  count(*) filter (tesseract_checked = 1) as reread, avg(confidence) as mean from fx_lines)
""")
def dashboard_totals(spark, d):
    t = metrics.totals(*_three(spark, d))
    return t.withColumn("average_confidence", F.round("average_confidence", 6)).withColumn("pages_per_minute", F.round("pages_per_minute", 6))


@query("""
, t as (select (select count(*) from fx_documents) as documents, (select count(*) from fx_pages) as pages, count(*) as lines, count(*) filter (review_status = 'accepted') as accepted,
  count(*) filter (review_status in ('verified', 'corrected')) as reviewed, count(*) filter (tesseract_checked = 1) as reread, avg(confidence) as mean from fx_lines),
p as (select count(*) as n, date_diff('second', min(processed_at), max(processed_at)) / 60.0::double as m from fx_pages where status = 'ready' and processed_at is not null),
st as (select status, count(*) as count from fx_documents group by 1), so as (select coalesce(source_type, 'unknown') as source_type, count(*) as count from fx_documents group by 1),
bu as (select case when confidence < 0.5 then '0-49%' when confidence < 0.8 then '50-79%' when confidence < 0.95 then '80-94%' else '95-100%' end as bucket, count(*) as count from fx_lines where confidence is not null group by 1)
select documents, pages, lines, coalesce(printf('%.1f', accepted * 100.0::double / nullif(lines, 0))::double, 0) as auto_accepted_percent, coalesce(printf('%.1f', reviewed * 100.0::double / nullif(lines, 0))::double, 0) as reviewed_percent,
  coalesce(printf('%.1f', reread * 100.0::double / nullif(lines, 0))::double, 0) as reread_percent, printf('%.1f', mean * 100)::double as average_confidence,
  (select case when n >= 2 and m > 0 then printf('%.2f', n / m)::double end from p) as pages_per_minute,
  (select string_agg(status || '=' || count, ';' order by status) from st) as status_breakdown, (select string_agg(source_type || '=' || count, ';' order by count desc, source_type) from so) as source_type_breakdown,
  (select string_agg(bucket || '=' || count, ';' order by bucket) from bu) as bucket_breakdown
from t
""")
def dashboard(spark, d):
    out = metrics.dashboard(*_three(spark, d))
    shown = lambda key: F.array_join(F.transform(f"{key}_breakdown", lambda x: F.concat_ws("=", x[key], x["count"].cast("string"))), ";")
    return out.withColumns({f"{key}_breakdown": shown(key) for key in ("status", "source_type", "bucket")})


@query("""
select (select count(*) from fx_documents) as documents, (select count(*) from fx_pages) as pages, (select count(*) from fx_pages where review_status = 'verified') as verified_pages,
  (select count(*) from fx_lines) as lines, (select count(*) from fx_lines where review_status = 'needs_review') as lines_to_review, round((select avg(confidence) from fx_lines where engine <> 'text_layer'), 6) as average_confidence
""")
def stats_totals(spark, d):
    return metrics.stats(*_three(spark, d)).withColumn("average_confidence", F.round("average_confidence", 6))


@query("select status, count(*) as count from fx_documents group by status")
def status_breakdown(spark, d):
    return metrics.breakdown(fx.documents(spark, d), "status")


@query("select coalesce(source_type, 'unknown') as source_type, count(*) as count from fx_documents group by 1")
def source_breakdown(spark, d):
    return metrics.breakdown(fx.documents(spark, d), "source_type", "unknown", by_count=True)


_BUCKETS = "select case when confidence < 0.5 then '0-49%' when confidence < 0.8 then '50-79%' when confidence < 0.95 then '80-94%' else '95-100%' end as bucket, count(*) as count from fx_lines where confidence is not null group by 1"


@query(_BUCKETS)
def confidence_buckets(spark, d):
    return metrics.confidence_buckets(fx.lines(spark, d))


@query(f", b as ({_BUCKETS}) select bucket, count, greatest(3, count / greatest((select max(count) from b), 1)::double * 100)::double as width from b")
def bar_widths(spark, d):
    return metrics.bar_widths(metrics.confidence_buckets(fx.lines(spark, d)))


@query("""
select n as ready_pages, m as minutes, round(case when n >= 2 and m > 0 then n / m end, 6) as pages_per_minute
from (select count(*) as n, date_diff('second', min(processed_at), max(processed_at)) / 60.0::double as m from fx_pages where status = 'ready' and processed_at is not null)
""")
def throughput(spark, d):
    return metrics.throughput(fx.pages(spark, d)).withColumn("pages_per_minute", F.round("pages_per_minute", 6))


_STAGES = ("preprocess", "read", "layout", "reread")


@query("""
, st as (select page_id as page, stage, (('0x' || substr(md5(stage || page_id), 1, 8))::bigint % 1000) as ms from fx_pages, (values ('preprocess'), ('read'), ('layout'), ('reread')) s(stage))
select stage, sum(ms)::bigint as stage_ms, round(avg(ms / 1000.0::double), 6) as stage_seconds_per_page, (select count(*) from fx_pages) as pages,
  round((select sum(ms) / 1000.0::double / count(distinct page) from st), 6) as seconds_per_page, round((select count(distinct page) / (sum(ms) / 1000.0::double / 60) from st), 6) as pages_per_minute,
  (select count(*) filter (coalesce(confidence, 0) < 0.95) / count(*)::double from fx_lines) as reread_share
from st group by stage
""")
def bench_summary(spark, d):
    ms = N.hash32(F.concat("stage", F.col("page").cast("string"))) % 1000
    stages = fx.pages(spark, d).select(F.col("page_id").alias("page"), F.explode(F.array(*map(F.lit, _STAGES))).alias("stage")).withColumn("seconds", ms / F.lit(1000.0))
    out = metrics.bench_summary(stages, fx.lines(spark, d))
    rounded = (F.round(c, 6).alias(c) for c in ("stage_seconds_per_page", "seconds_per_page", "pages_per_minute"))
    return out.select("stage", F.round(F.col("stage_seconds") * 1000).cast("long").alias("stage_ms"), "pages", *rounded, "reread_share")


@query("""
, e as (select coalesce(engine, 'clip') as name, min(h) % 3 <> 0 as ok from fx_lines group by 1)
select bool_and(ok) as all_available, coalesce(string_agg(name, ',' order by name) filter (not ok), '') as missing from e
""")
def engine_health(spark, d):
    engines = fx.lines(spark, d).groupBy(F.coalesce("engine", F.lit("clip")).alias("name")).agg((F.min("h") % 3 != 0).alias("available"))
    return metrics.health(engines).select("all_available", F.array_join("missing", ",").alias("missing"))


# --- review


@query("""
select d.id, d.status, d.created_at::varchar as created_at, (select count(*) from fx_pages p where p.doc_id = d.doc_id and p.review_status = 'verified') as verified_pages
from (select * from fx_documents order by created_at desc, id limit 100) d
""")
def documents_with_verified_pages(spark, d):
    out = review.listing(fx.documents(spark, d), fx.pages(spark, d), 100)
    return out.select("id", "status", F.col("created_at").cast("string").alias("created_at"), "verified_pages")


@query("""
, l as (select *, coalesce(nullif(verified_text, ''), ocr_text) as text from fx_lines)
select l.line_id, d.id, l.page_number, l.line_order, coalesce(nullif(p.width, 0), 1) as page_width, coalesce(nullif(p.height, 0), 1) as page_height, l.text, @norm as romanized
from l join fx_pages p on p.page_id = l.page_id join fx_documents d on d.doc_id = l.doc_id
""".replace("@norm", _NORM.replace("$x", "l.text")))
def review_lines(spark, d):
    return review.review_lines(*_three(spark, d)).select("line_id", "id", "page_number", "line_order", "page_width", "page_height", "text", "romanized")


@query("""
, l as (select page_id, line_order, line_id, ocr_text, coalesce(nullif(verified_text, ''), ocr_text) as text, confidence, review_status, row_number() over (partition by page_id order by line_order) - 1 as line_pos from fx_lines),
p as (select page_id, doc_id, page_number, status as page_status, row_number() over (partition by doc_id order by page_number) - 1 as page_pos from fx_pages)
select d.id, d.status, page_pos::int as page_pos, page_number, p.page_id, page_status, line_pos::int as line_pos, line_id, l.text, @norm as romanized, confidence, l.review_status
from fx_documents d left join p on p.doc_id = d.doc_id left join l on l.page_id = p.page_id
""".replace("@norm", _NORM.replace("$x", "l.text")))
def review_tree(spark, d):
    tree = review.review_tree(*_three(spark, d)).select("id", "status", F.posexplode_outer("pages").alias("page_pos", "p"))
    flat = tree.select("id", "status", "page_pos", "p.page_number", "p.page_id", F.col("p.status").alias("page_status"), F.posexplode_outer("p.lines").alias("line_pos", "l"))
    return flat.select("id", "status", "page_pos", "page_number", "page_id", "page_status", "line_pos", "l.line_id", "l.text", "l.romanized", "l.confidence", "l.review_status")


@query("select e.page_id, e.document_id, p.page_number, len(e.embedding)::int as dimensions from fx_embeddings e join fx_pages p on p.page_id = 1001 + e.page_id * 1000")
def page_embedding_join(spark, d):
    # a document's vector belongs to its first page
    vectors = fx.embeddings(spark, d).select((F.col("page_id") * 1000 + 1001).alias("page_id"), F.col("page_id").alias("vector_id"), "document_id", "embedding")
    stored = vectors.select("page_id", V.to_json("embedding").alias("embedding_json"))
    joined = similarity.embedded_pages(stored, fx.pages(spark, d).select("page_id", "page_number")).join(vectors.drop("embedding"), "page_id")
    return joined.select(F.col("vector_id").alias("page_id"), "document_id", "page_number", F.size("embedding").alias("dimensions"))


_CONTEXT = "select l.line_id, l.page_id, l.doc_id, l.line_order, l.page_number, l.x0, l.y0, l.x1, l.y1, l.verified_text, p.image_path, d.source_type, d.language from fx_lines l join fx_pages p on p.page_id = l.page_id join fx_documents d on d.doc_id = l.doc_id"


@query(f"select line_id, page_id, x0, y0, x1, y1, image_path, source_type, language from ({_CONTEXT})")
def line_training_context(spark, d):
    return review.training_context(*_three(spark, d)).select("line_id", "page_id", "x0", "y0", "x1", "y1", "image_path", "source_type", "language")


@query(f"""
select line_id, printf('crops/%d/page-%04d-line-%04d.png', doc_id, page_number, line_order) || chr(9) || regexp_replace(regexp_replace(replace(verified_text, chr(9), ' '), '^{_WS}', ''), '{_WS}$', '') as value
from ({_CONTEXT}) where image_path is not null and not regexp_full_match(coalesce(verified_text, ''), '({_WS})?') and doc_id % 5 <> 0
""")
def training_export(spark, d):
    pairs = review.training_pairs(review.training_context(*_three(spark, d)))
    crops = pairs.where("split(crop_path, '/')[1] % 5 <> 0").select(F.col("crop_path").alias("path"))  # of the others the crop isn't there
    return review.export_lines(pairs, crops)


@query("select line_key, max_by(action, seq) as action, max_by(reviewer, seq) as reviewer, max_by(new_text, seq) as new_text, max(seq) as seq from fx_verifications group by line_key")
def latest_verification(spark, d):
    return review.latest(fx.verifications(spark, d)).select("line_key", "action", "reviewer", "new_text", "seq")


@query("select seq, line_key, action, reviewer, lag(new_text) over (partition by line_key order by seq) as previous_text, new_text from fx_verifications")
def verification_history(spark, d):
    return review.history(fx.verifications(spark, d)).select("seq", "line_key", "action", "reviewer", "previous_text", "new_text")


@query("""
, last as (select line_key, max_by(new_text, seq) as new_text from fx_verifications group by line_key)
select line_id, case when line_key is not null then new_text else verified_text end as verified_text, case when line_key is not null then 'verified' else review_status end as review_status
from fx_lines left join last on line_key = line_id
""")
def verified_lines(spark, d):
    return review.apply_verifications(fx.lines(spark, d), fx.verifications(spark, d)).select("line_id", "verified_text", "review_status")


@query("""
select case when action in ('accept', 'edit') and trim(coalesce(reviewer, '')) <> '' then null when action in ('accept', 'edit') then 'no reviewer' else 'unknown action' end as problem, count(*) as n
from (select case when action = 'reject' then 'choose' else action end as action, case when seq % 7 = 0 then '  ' else reviewer end as reviewer from fx_verifications) group by 1
""")
def verification_problems(spark, d):
    events = fx.verifications(spark, d).select(F.when(F.col("action") == "reject", "choose").otherwise(F.col("action")).alias("action"), F.when(F.col("seq") % 7 == 0, "  ").otherwise(F.col("reviewer")).alias("reviewer"))
    return review.checked(events).groupBy("problem").agg(F.count("*").alias("n"))


@query("""
select page_id, count(*) filter (review_status = 'needs_review') as open_lines, count(*) filter (review_status = 'verified') as verified_lines,
  case when count(*) filter (review_status = 'needs_review') = 0 and count(*) filter (review_status = 'verified') > 0 then 'verified' else 'unreviewed' end as rolled_up
from fx_lines group by page_id
""")
def page_rollup(spark, d):
    return review.page_rollup(fx.lines(spark, d))


@query("select d.id, case when d.page_count > 0 then count(p.page_id) || ' / ' || d.page_count else '–' end as verified from fx_documents d left join fx_pages p on p.doc_id = d.doc_id and p.review_status = 'verified' group by d.id, d.page_count")
def verified_ratio(spark, d):
    docs = fx.documents(spark, d)
    n = fx.pages(spark, d).where("review_status = 'verified'").groupBy("doc_id").count()
    return docs.join(n, "doc_id", "left").select("id", metrics.verified_ratio(F.coalesce("count", F.lit(0)), F.col("page_count")).alias("verified"))


# --- store


def _old_new(spark, d):
    p = fx.pages(spark, d).select("page_id", "doc_id", "page_number", "status", "review_status", "image_path", "g")
    old = p.where("g % 3 <> 0").drop("g")
    new = p.where("g % 2 = 0").select("page_id", "doc_id", "page_number", F.lit("ready").alias("status"), F.lit(None).cast("string").alias("image_path"), F.when(F.col("g") % 5 == 0, F.array(F.lit("status"))).otherwise(F.array(F.lit("status"), F.lit("image_path"))).alias("supplied"))
    return old, new


@query("""
, o as (select * from fx_pages where g % 3 <> 0), n as (select * from fx_pages where g % 2 = 0)
select coalesce(n.doc_id, o.doc_id) as doc_id, coalesce(n.page_number, o.page_number) as page_number, o.page_id, case when n.page_id is not null then 'ready' else o.status end as status,
  o.review_status, case when n.page_id is not null and n.g % 5 <> 0 then null else o.image_path end as image_path
from o full join n on o.doc_id = n.doc_id and o.page_number = n.page_number
""")
def upsert_pages(spark, d):
    old, new = _old_new(spark, d)
    return store.upsert(old, new, ["doc_id", "page_number"], allowed=["status", "image_path", "review_status"])


@query("select page_id, case when page_id % 3 = 0 then 'm2' else 'm1' end as model, (case when page_id % 3 = 0 then page_id + 7 else page_id end)::bigint as seq from fx_embeddings")
def upsert_embeddings(spark, d):
    old = fx.embeddings(spark, d).select("page_id", F.lit("m1").alias("model"), F.col("page_id").alias("seq"))
    new = old.where("page_id % 3 = 0").select("page_id", F.lit("m2").alias("model"), (F.col("page_id") + 7).alias("seq"))
    return store.last_wins(old, new, ["page_id"], "seq")


@query("""
select page_id, line_id, ocr_text from fx_lines where page_id not in (select page_id from fx_pages where g % 4 = 1)
union all select page_id, -line_id, 'again ' || ocr_text from fx_lines where page_id in (select page_id from fx_pages where g % 4 = 1) and line_order < 3
""")
def replace_page_lines(spark, d):
    old = fx.lines(spark, d).select("page_id", "line_id", "ocr_text")
    again = fx.pages(spark, d).where("g % 4 = 1").select("page_id")
    new = fx.lines(spark, d).where("line_order < 3").join(again, "page_id", "left_semi").select("page_id", (-F.col("line_id")).alias("line_id"), F.concat(F.lit("again "), "ocr_text").alias("ocr_text"))
    return store.replace_children(old, new, "page_id", again)


def _tables(spark, d):
    docs, pages, lines = _three(spark, d)
    ids = docs.select("doc_id", "id")
    return {
        "documents": docs, "pages": pages.join(ids.withColumnRenamed("id", "document_id"), "doc_id").withColumnRenamed("page_id", "id"),
        "lines": lines.select(F.col("line_id").alias("id"), "page_id"), "verifications": fx.verifications(spark, d).select(F.col("seq").alias("id"), F.col("line_key").alias("line_id")),
    }


@query("""
, gone as (select doc_id, id from fx_documents where status = 'failed'), pg as (select page_id from fx_pages where doc_id not in (select doc_id from gone)), ln as (select line_id from fx_lines where page_id in (select page_id from pg))
select 'documents' as name, count(*) as n, sum(doc_id)::bigint as s from fx_documents where id not in (select id from gone)
union all select 'pages', count(*), sum(page_id)::bigint from pg union all select 'lines', count(*), sum(line_id)::bigint from ln
union all select 'verifications', count(*), sum(seq)::bigint from fx_verifications where line_key in (select line_id from ln)
""")
def cascade_delete(spark, d):
    left = store.cascade(_tables(spark, d), fx.documents(spark, d).where("status = 'failed'").select("id"))
    out = None
    for name, key in (("documents", "doc_id"), ("pages", "id"), ("lines", "id"), ("verifications", "id")):
        part = left[name].agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.sum(key).alias("s"))
        out = part if out is None else out.unionByName(part)
    return out


@query("select seq, line_key from fx_verifications where line_key not in (select line_id from fx_lines)")
def orphan_check(spark, d):
    return store.orphans(fx.verifications(spark, d).select("seq", "line_key"), "line_key", fx.lines(spark, d), "line_id")


@query("select id, case when status = 'processing' then case when page_count % 2 = 0 then 'review' else 'failed' end else status end as status, case when status = 'processing' then left(repeat('e', 1500), 1000) end as error from fx_documents")
def status_update(spark, d):
    docs = fx.documents(spark, d).withColumn("error", F.lit(None).cast("string"))
    changes = docs.where("status = 'processing'").select("id", F.when(F.col("page_count") % 2 == 0, "review").otherwise("failed").alias("status"), F.repeat(F.lit("e"), F.lit(1500)).alias("error"))
    return store.set_status(docs, changes, F.lit(None)).select("id", "status", "error")


@query("select id, case when source_type is null then 'handwritten' else source_type end as source_type, case when source_type is null then 1.0::double end as source_confidence, (source_type is null)::int as source_manual from fx_documents")
def source_update(spark, d):
    docs = fx.documents(spark, d).withColumn("source_confidence", F.lit(None).cast("double")).withColumn("source_manual", F.lit(0))
    changes = docs.where("source_type is null").select("id", F.lit("handwritten").alias("source_type"), F.lit(0.3).alias("confidence"), F.lit(True).alias("manual"))
    return store.set_source(docs, changes).select("id", "source_type", "source_confidence", "source_manual")


@query("select page_id, page_number from fx_pages where status <> 'ready'")
def pending_pages(spark, d):
    pages = fx.pages(spark, d).select("page_id", "page_number", "status")
    return ingest.pending(pages, pages.where("status = 'ready'")).select("page_id", "page_number")


@query("select doc_id, string_agg(page_number, ',' order by page_number) as ready from fx_pages where status = 'ready' group by doc_id")
def ready_pages(spark, d):
    return review.ready_pages(fx.pages(spark, d)).select("doc_id", F.array_join("ready", ",").alias("ready"))


# --- recognition


@query("select line_id, case when coalesce(confidence, 0) < 0.8 then 'needs_review' else 'accepted' end as review_status from fx_lines")
def review_status_from_confidence(spark, d):
    return fx.lines(spark, d).select("line_id", recognition.review_status("confidence").alias("review_status"))


@query("select line_id, (coalesce(confidence, 0) < 0.95 or ('0x' || substr(md5('audit' || line_id), 1, 8))::bigint % 10000 < 200) as reread from fx_lines")
def reread_gate(spark, d):
    return fx.lines(spark, d).select("line_id", recognition.needs_reread("confidence", F.concat(F.lit("audit"), F.col("line_id").cast("string"))).alias("reread"))


_VOTE = """
, top as (select doc_id, page_number, source_type, confidence from (select *, row_number() over (partition by doc_id, page_number order by confidence desc, pos) as rn from fx_classifications) where rn = 1),
sums as (select doc_id, source_type, sum((confidence * 10000)::bigint) as score, min(page_number) as first from top group by doc_id, source_type),
vote as (select doc_id, source_type, score / sum(score) over (partition by doc_id)::double as confidence, row_number() over (partition by doc_id order by score desc, first) as rn from sums)
"""


@query(_VOTE + "select doc_id, source_type, round(confidence, 6) as confidence from vote where rn = 1")
def source_vote(spark, d):
    return recognition.source_vote(fx.classifications(spark, d)).select("doc_id", "source_type", N.scaled_round("confidence", 6).alias("confidence"))


@query(_VOTE + """
select v.doc_id, d.source_type as requested, v.source_type as detected, (v.source_type in ('palm_leaf', 'inscription') and v.source_type is distinct from d.source_type) as redo,
  case when v.source_type in ('palm_leaf', 'inscription') and v.source_type is distinct from d.source_type then v.source_type else coalesce(d.source_type, 'modern_print') end as route
from vote v join fx_documents d on d.doc_id = v.doc_id where rn = 1
""")
def route_selection(spark, d):
    votes = recognition.source_vote(fx.classifications(spark, d)).join(fx.documents(spark, d).select("doc_id", F.col("source_type").alias("requested")), "doc_id")
    return recognition.routes(votes).select("doc_id", "requested", F.col("source_type").alias("detected"), "redo", "route")


@query("""
select doc_id, case when n <= 0 then '' when n <= 5 then (select string_agg(i, ',' order by i) from unnest(range(n)) t(i))
  else (select string_agg(p, ',' order by p) from (select distinct round_even(i * (n - 1) / 4.0::double, 0)::int as p from range(5) t(i))) end as sample
from (select doc_id, page_count as n from fx_documents)
""")
def sample_pages(spark, d):
    return recognition.sampled_pages(fx.documents(spark, d)).select("doc_id", F.array_join("sample", ",").alias("sample"))


@query("select page_id, page_number from fx_pages where page_number <= 2")
def first_pages(spark, d):
    return recognition.first_pages(fx.pages(spark, d)).select("page_id", "page_number")


@query("""
, l as (select page_id, list({'y0': y0, 'x0': x0, 'p': pos, 'x1': x1, 'y1': y1} order by y0, x0, pos) as l, list_sort(list(greatest(1, y1 - y0)))[count(*) // 2 + 1] * 2.5 as gap from fx_lines group by page_id),
step as (
  select page_id, l, gap, 0::bigint as i, []::double[] as edge, []::bigint[] as region from l
  union all
  select page_id, l, gap, i + 1, case when near > 0 then list_transform(edge, lambda e, k: case when k = near then least(e, x0) else e end) else list_append(edge, x0) end, list_append(region, case when near > 0 then near else len(edge) + 1 end)
  from (select *, coalesce(list_position(list_transform(edge, lambda e: abs(x0 - e) <= gap), true), 0)::bigint as near from (select *, l[i + 1].x0 as x0 from step where i < len(l)))
), flat as (select page_id, unnest(l, recursive := false) as z, unnest(region) as made from step where i = len(l)),
reg as (select page_id, made, row_number() over (partition by page_id order by min(z.x0), min(z.y0), made) as region_order, min(z.x0) as region_x0, max(z.x1) as region_x1 from flat group by page_id, made)
select f.page_id, f.z.p as pos, r.region_order::int as region_order, (row_number() over (partition by f.page_id order by r.region_order, f.z.y0, f.z.x0, f.z.p) - 1)::int as line_order, r.region_x0, r.region_x1
from flat f join reg r on f.page_id = r.page_id and f.made = r.made
""")
def reading_order(spark, d):
    lines = fx.lines(spark, d).select("page_id", "pos", "x0", "y0", "x1", "y1")
    return layout.reading_order(lines).select("page_id", F.col("pos").cast("long").alias("pos"), "region_order", "line_order", "region_x0", "region_x1")


@query("""
select line_id, greatest(0, round_even(x0, 0)::int - 4) as "left", greatest(0, round_even(y0, 0)::int - 4) as top, least(p.width, round_even(x1, 0)::int + 4) as "right", least(p.height, round_even(y1, 0)::int + 4) as bottom
from fx_lines l join fx_pages p on p.page_id = l.page_id
""")
def crop_boxes(spark, d):
    rows = fx.lines(spark, d).join(fx.pages(spark, d).select("page_id", "width", "height"), "page_id")
    return rows.select("line_id", N.crop_box("x0", "y0", "x1", "y1", "width", "height").alias("b")).select("line_id", "b.*")


@query("""
select line_id, greatest(0, x0 / w * 100) as "left", greatest(0, y0 / hh * 100) as top, greatest(0.5, (x1 - x0) / w * 100) as width, greatest(0.5, (y1 - y0) / hh * 100) as height
from (select l.*, coalesce(nullif(p.width, 0), 1)::double as w, coalesce(nullif(p.height, 0), 1)::double as hh from fx_lines l join fx_pages p on p.page_id = l.page_id)
""")
def overlay_percent(spark, d):
    rows = fx.lines(spark, d).join(fx.pages(spark, d).select("page_id", "width", "height"), "page_id")
    return rows.select("line_id", N.overlay("x0", "y0", "x1", "y1", "width", "height").alias("b")).select("line_id", "b.*")


@query("""
select line_id, greatest(0, least(y1, n1) - greatest(y0, n0)) / least(greatest(1, y1 - y0), greatest(1, n1 - n0)) as overlap
from (select *, lead(y0) over w as n0, lead(y1) over w as n1 from fx_lines window w as (partition by page_id order by pos)) where n0 is not null
""")
def overlap_ratio(spark, d):
    w = Window.partitionBy("page_id").orderBy("pos")
    rows = fx.lines(spark, d).withColumn("n0", F.lead("y0").over(w)).withColumn("n1", F.lead("y1").over(w)).where("n0 is not null")
    return rows.select("line_id", N.overlap_ratio("y0", "y1", "n0", "n1").alias("overlap"))


# --- text

@query("select doc_id, " + _NORM.replace("$x", "text") + " as text from fx_script")
def normalize_text(spark, d):
    return fx.script_texts(spark, d).select("doc_id", X.normalize_text("text").alias("text"))


@query("select doc_id, " + _NORM.replace("$x", "text") + " as text from documents", fixtures=False)
def normalize_text_full(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", X.normalize_text("text").alias("text"))


def _sql_map(table: dict[str, str]) -> str:
    return "map {" + ", ".join(f"'{k}': '{v}'" for k, v in table.items()) + "}"


@query(f"""
select doc_id, list_aggregate(list_transform(regexp_extract_all({_NORM.replace("$x", "text")}, '([{_CONS}][{_SIGNS}{X.PULLI}]?|[\\s\\S])'),
  lambda u: case when u = '{X.PULLI}' then '' when {_sql_map(X.VOWELS)}[u] is not null then {_sql_map(X.VOWELS)}[u] when {_sql_map(X.CONSONANTS)}[left(u, 1)] is not null then {_sql_map(X.CONSONANTS)}[left(u, 1)] ||
    case when length(u) = 1 then 'a' when substr(u, 2, 1) = '{X.PULLI}' then '' else {_sql_map(X.VOWEL_SIGNS)}[substr(u, 2, 1)] end else u end), 'string_agg', '') as romanized
from fx_script
""")
def transliterate(spark, d):
    return fx.script_texts(spark, d).select("doc_id", X.transliterate("text").alias("romanized"))


_WORDS = "list_filter(list_transform(regexp_split_to_array(text, '" + _WS + "'), lambda w: " + _NORM.replace("$x", "trim(w, '" + X.PUNCTUATION.replace("'", "''") + "')") + "), lambda w: w <> '')"
_MINE = "list_filter(w, lambda w: regexp_matches(w, '[\\x{0B80}-\\x{0BFF}]'))"
_VALID = f"lambda w: regexp_matches(w, '^[\\x{{0B80}}-\\x{{0BFF}}]+$') and not regexp_matches(w, '(^|[^{_CONS}])[{_SIGNS}{X.PULLI}]') and not regexp_matches(w, '(^|[^{_CONS}{X.E_SIGN}]){X.AU_MARK}')"


@query(f"""
, w as (select doc_id, {_WORDS} as w from fx_script), m as (select doc_id, {_MINE} as m from w)
select doc_id, len(m)::int as script_words, len(list_filter(m, {_VALID}))::int as valid_words from m
""")
def valid_words(spark, d):
    return fx.script_texts(spark, d).select("doc_id", X.text_layer("text").alias("t")).select("doc_id", "t.script_words", "t.valid_words")


@query(f"""
, w as (select doc_id, {_WORDS} as w from fx_script), m as (select doc_id, {_MINE} as m from w)
select doc_id, case when len(m) = 0 then 0 else len(list_filter(m, {_VALID})) / len(m)::double end as score, len(m) > 0 and len(list_filter(m, {_VALID})) / len(m)::double >= 0.95 as trusted from m
""")
def text_layer_score(spark, d):
    return fx.script_texts(spark, d).select("doc_id", X.text_layer("text").alias("t")).select("doc_id", "t.score", "t.trusted")


@query("select distinct unnest(string_split(text, '')) as character from documents where text <> ''", fixtures=False)
def charset(spark, d):
    return evaluation.charset(fx.table(spark, d, "documents"))


@query("""
select doc_id, count(*) as samples, sum(levenshtein(prediction, target))::bigint as edits, sum(length(target))::bigint as characters, count(*) filter (prediction = target) as exact,
  sum(levenshtein(prediction, target)) * 100 / greatest(sum(length(target)), 1)::double as cer_percent, count(*) filter (prediction = target) * 100.0::double / count(*) as exact_percent
from fx_ocr_pairs group by doc_id
""")
def ocr_eval(spark, d):
    return evaluation.ocr_quality(fx.ocr_pairs(spark, d), "doc_id")


@query("""
select user_id, coalesce((select string_agg(['க', 'ங', 'ச'][tokens[i]], '' order by i) from unnest(range(1, len(tokens) + 1)) t(i) where tokens[i] <> 0 and (i = 1 or tokens[i] <> tokens[i - 1])), '') as text from fx_ctc
""")
def ctc_decode(spark, d):
    return fx.ctc_tokens(spark, d).select("user_id", X.ctc_decode("tokens", "கஙச").alias("text"))


@query("select user_id, string_agg((case tokens[i] when 0 then 1 else tokens[i] end)::varchar, ',' order by i) as ids from (select user_id, tokens, unnest(range(1, len(tokens) + 1)) as i from fx_ctc) group by user_id")
def encode_text(spark, d):
    letters = F.array_join(F.transform("tokens", lambda t: F.get(F.array(*map(F.lit, "ககஙச")), t)), "")
    return fx.ctc_tokens(spark, d).select("user_id", F.array_join(X.encode_text(letters, "கஙச"), ",").alias("ids"))


@query("select line_id, replace(replace(replace(replace(replace(ocr_text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') as html from fx_lines")
def html_escape(spark, d):
    return fx.lines(spark, d).select("line_id", X.html_escape("ocr_text").alias("html"))


_KINDS = "('pdf', 'jpg', 'jpeg', 'png', 'tif', 'tiff', 'webp', 'heic')"


@query(f"""
select page_id, ext, case when ext is null or ext not in {_KINDS} then 415 when size = 0 then 400 when size > 500 * 1024 * 1024 then 413 end as code
from (select page_id, lower(regexp_extract(name, '[.]([^./\\\\]+)$', 1)) as ext, size from (select page_id, case when page_id % 3 = 0 then url else url || '.JPG' end as name,
  octet_length(encode(html)) * case when page_id % 50 = 1 then 1000000 when page_id % 50 = 2 then 0 else 1 end as size from pages))
""", fixtures=False)
def upload_checks(spark, d):
    pages = fx.table(spark, d, "pages")
    size = F.octet_length("html").cast("long") * F.when(F.col("page_id") % 50 == 1, 1_000_000).when(F.col("page_id") % 50 == 2, 0).otherwise(1)
    named = pages.select("page_id", F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(F.concat("url", F.lit(".JPG"))).alias("name"), size.alias("size"))
    return named.select("page_id", X.extension("name").alias("ext"), files.upload_code("name", "size", pdf=True).alias("code"))


# --- training

@query("""
select run, min(cer) as best_cer, max(exact) as best_exact, max(epoch) filter (cer = least_cer) as best_epoch from (select *, min(cer) over (partition by run) as least_cer from fx_epochs) group by run
""")
def epoch_best(spark, d):
    return evaluation.best_epoch(fx.epochs(spark, d), "run")


@query("""
, i as (select *, not exists (select 1 from fx_epochs b where b.run = e.run and b.epoch < e.epoch and (b.cer < e.cer or b.cer = e.cer and b.exact >= e.exact)) as improved from fx_epochs e),
n as (select *, row_number() over (partition by run order by epoch) as k from i),
s as (select *, k - max(case when improved then k end) over (partition by run order by k) as stale from n)
select run, epoch, improved, stale::int as stale, coalesce(epoch = min(case when exact >= 80 or stale >= 3 then epoch end) over (partition by run), false) as stop from s
""")
def early_stop(spark, d):
    return evaluation.early_stop(fx.epochs(spark, d), patience=3, run="run").select("run", "epoch", "improved", F.col("stale").cast("int").alias("stale"), "stop")


@query("select run, epoch, printf('%.4f', avg(v)::double)::double as loss from (select user_id as run, day(ts)::int as epoch, (event_id % 1000) / 8.0::double as v from events) group by run, epoch", fixtures=False)
def epoch_loss(spark, d):
    losses = fx.table(spark, d, "events").select(F.col("user_id").alias("run"), F.dayofmonth("ts").alias("epoch"), ((F.col("event_id") % 1000) / 8.0).alias("loss"))
    return evaluation.epoch_loss(losses, "run")


@query("select doc_id, row_number() over (order by doc_id) - 1 as row_index, (row_number() over (order by doc_id) - 1) % 10 = 0 as validation from documents", fixtures=False)
def train_val_split(spark, d):
    return evaluation.split(fx.table(spark, d, "documents").select("doc_id"), "doc_id")


@query("select doc_id as row_index, (row_number() over (order by md5('7:' || doc_id), doc_id) - 1) // 16 as batch from documents", fixtures=False)
def shuffled_batches(spark, d):
    return evaluation.batches(fx.table(spark, d, "documents").select(F.col("doc_id").alias("row_index")), 16)


@query("select bool_and(ok) as all_ok, count(*) filter (not ok) as failed from (select o_orderstatus <> 'P' as ok from orders)", fixtures=False)
def all_passed(spark, d):
    return evaluation.all_passed(fx.table(spark, d, "orders").select((F.col("o_orderstatus") != "P").alias("ok")))


@query("""
select name, bytes_done, coalesce(bytes_done * 1.0::double / nullif(size, 0), 0) * 100 as percent, (bytes_done - prefix) / 2.0::double as rate,
  case when bytes_done > prefix then (size - bytes_done) / ((bytes_done - prefix) / 2.0::double) else 0.0::double end as seconds_left
from (select 's' || o_orderkey as name, size, prefix, size - (select coalesce(sum(least(1000, size - i)), 0) from range(prefix, size, 1000) t(i) where (i // 1000) % 3 <> 0)::bigint as bytes_done
  from (select o_orderkey, (o_orderkey % 17) * 777 as size, least((o_orderkey % 3) * 1000, (o_orderkey % 17) * 777) as prefix from orders))
""", fixtures=False)
def download_progress(spark, d):
    o = fx.table(spark, d, "orders").select(F.concat(F.lit("s"), F.col("o_orderkey").cast("string")).alias("name"), ((F.col("o_orderkey") % 17) * 777).alias("size"), (F.col("o_orderkey") % 3 * 1000).alias("p"))
    sizes = o.select("name", "size", F.least("p", "size").alias("prefix"), F.lit(2.0).alias("seconds"))
    done = sizes.where("prefix < size").select("name", F.explode(F.expr("sequence(prefix, size - 1, 1000L)")).alias("start")).where("start div 1000 % 3 = 0")
    return evaluation.download_progress(sizes, done, 1000)


# --- vectors


@query("""
, v as (select page_id, document_id, list_transform(embedding::double[], lambda x: x / sqrt(list_dot_product(embedding::double[], embedding::double[]))) as v from fx_embeddings where embedding is not null),
s as (select q.page_id as query_id, i.page_id, i.document_id, list_dot_product(i.v, q.v) as score from v q, v i where q.page_id % 50 = 0 and i.document_id <> q.document_id)
select query_id, page_id, document_id, rank::int as rank, round(score, 6) as score from (select *, row_number() over (partition by query_id order by score desc, page_id) as rank from s) where rank <= 4
""")
def similar_pages(spark, d):
    index = fx.embeddings(spark, d).where("document_id is not null")
    queries = index.where("page_id % 50 = 0").select(F.col("page_id").alias("query_id"), "embedding", F.col("document_id").alias("exclude"))
    return similarity.similar(index, queries).select("query_id", "page_id", "document_id", "rank", F.round("score", 6).alias("score"))


@query("""
, x as (select page_id, embedding::double[] as x from fx_embeddings where embedding is not null), e as (select page_id, list_transform(x, lambda v: exp(v - list_max(x))) as e from x)
select page_id, (list_position(e, list_max(e)) - 1)::int as best, round(list_max(e) / list_sum(e), 6) as confidence from e
""")
def softmax_scores(spark, d):
    p = fx.embeddings(spark, d).withColumn("x", F.col("embedding").cast("array<double>")).where("x is not null").withColumn("p", N.softmax("x"))
    return p.select("page_id", V.argmax("p").alias("best"), F.round(F.array_max("p"), 6).alias("confidence"))


@query("select page_id, w as width, h as height, case when s < 1 then greatest(1, trunc(w * s)::int) else w end as ocr_width, case when s < 1 then greatest(1, trunc(h * s)::int) else h end as ocr_height from (select page_id, w, h, least(1.0::double, 1600::double / greatest(w, h)) as s from (select page_id, (g % 5000 + 1)::int as w, (g % 3001 + 1)::int as h from fx_pages))")
def ocr_sizes(spark, d):
    p = fx.pages(spark, d).select("page_id", (F.col("g") % 5000 + 1).cast("int").alias("width"), (F.col("g") % 3001 + 1).cast("int").alias("height"))
    w, h = N.scaled_size("width", "height")
    return p.select("page_id", "width", "height", w.alias("ocr_width"), h.alias("ocr_height"))


@query("select event_type, count(*) as n from events group by event_type", fixtures=False)
def ingest_stream(spark, d):
    return ingest.drain_events(spark, f"{d}/events.parquet")


# --- small functions and sources over whole tables


@query("select l_orderkey, l_linenumber, l_partkey, printf('%.1f', l_extendedprice / 7)::double as one, printf('%.2f', -l_extendedprice / 8)::double as two, floor(l_extendedprice / 4 + 0.5)::bigint as js from lineitem", fixtures=False)
def rounding(spark, d):
    v = F.col("l_extendedprice")
    return fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", N.py_round(v / 7, 1).alias("one"), N.py_round(-v / 8, 2).alias("two"), N.js_round(v / 4).alias("js"))


@query("select id, 'DOC-' || strftime(created_at, '%Y%m%d') || '-' || upper(left(md5(id), 6)) as made from fx_documents")
def document_ids(spark, d):
    return fx.documents(spark, d).select("id", X.document_id("created_at", "id").alias("made"))


@query("select 'train_shard_' || lpad((p_partkey % 1000)::varchar, 3, '0') || '.parquet' as name, p_size::bigint as size, md5(p_name) as sha256, (p_partkey % 1000)::int as shard from part where p_partkey % 7 <> 0", fixtures=False)
def shard_listing(spark, d):
    path = F.when(F.col("p_partkey") % 7 == 0, "README.md").otherwise(F.concat(F.lit("data/train_shard_"), F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0"), F.lit(".parquet")))
    entry = F.struct(path.alias("path"), F.col("p_size").cast("long").alias("size"), F.struct(F.md5("p_name").alias("oid")).alias("lfs"))
    return files.shard_listing(fx.table(spark, d, "part").select(F.to_json(F.array(entry)).alias("value")))


@query("select lang, count(*) as samples, count(distinct doc_id) as ids from documents group by lang", fixtures=False)
def parquet_samples(spark, d):
    rows = files.parquet_samples(spark, f"{d}/documents.parquet", ("doc_id", "lang"))
    return rows.groupBy("lang").agg(F.count_distinct("file", "row").alias("samples"), F.count_distinct("doc_id").alias("ids"))


@query("select page_id, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from fx_lines group by page_id")
def polygon_boxes(spark, d):
    corners = F.array(F.array("x0", "y0"), F.array("x1", "y0"), F.array("x1", "y1"), F.array("x0", "y1"))
    pages = fx.lines(spark, d).select("page_id", corners.alias("c")).groupBy("page_id").agg(F.flatten(F.collect_list("c")).alias("c"))
    return pages.select("page_id", N.polygon_box("c").alias("b")).select("page_id", *(F.col("b")[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))))


@query(f"""
, l as (select page_id, pos, {_NORM.replace("$x", "t")} as t from (select page_id, pos, case when pos % 4 = 0 then ' ' || chr(8203) else ocr_text || chr(9) || chr(8205) || ' x' end as t from fx_lines))
select page_id, count(*) filter (t <> '')::int as kept, coalesce(string_agg(t, chr(10) order by pos) filter (t <> ''), '') as text from l group by page_id
""")
def clean_lines(spark, d):
    odd = F.when(F.col("pos") % 4 == 0, " \u200b").otherwise(F.concat("ocr_text", F.lit("\t\u200d x")))
    lines = fx.lines(spark, d).groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", odd.alias("text")))), lambda x: F.struct(x["text"].alias("text"))).alias("l"))
    kept = lines.select("page_id", recognition.clean_lines(F.col("l")).alias("l"))
    return kept.select("page_id", F.size("l").alias("kept"), F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("text"))


@query("""
, w as (select user_id, event_id, case when event_id % 5 = 0 then '  ' else event_type || ' ' end as word, ((event_id % 6 - 1) * 25)::double as conf from events), k as (select *, trim(word) as t from w where trim(word) <> '' and conf >= 0)
select user_id, coalesce((select string_agg(t, ' ' order by event_id) from k where k.user_id = u.user_id), '') as text, coalesce((select printf('%.4f', sum(conf / 100) / count(*))::double from k where k.user_id = u.user_id), 0) as confidence
from (select distinct user_id from events) u
""")
def word_readings(spark, d):
    e = fx.table(spark, d, "events")
    word = F.struct("event_id", F.when(F.col("event_id") % 5 == 0, "  ").otherwise(F.concat("event_type", F.lit(" "))).alias("word"), ((F.col("event_id") % 6 - 1) * 25).cast("double").alias("conf"))
    words = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(word)), lambda x: F.struct(x["word"].alias("word"), x["conf"].alias("conf"))).alias("w"))
    return words.select("user_id", recognition.word_reading(F.col("w")).alias("r")).select("user_id", "r.text", "r.confidence")


@query("select count(*) as words, avg(value) as confidence from events where event_type <> 'error'", fixtures=False)
def mean_confidence(spark, d):
    words = fx.table(spark, d, "events").select(F.when(F.col("event_type") == "error", "\t ").otherwise(F.col("event_type")).alias("word"), F.col("value").alias("conf"))
    return recognition.mean_confidence(words)


@query("""
, c as (select page_id, source_type, pos, printf('%.4f', confidence / 3)::double as p, printf('%.2f', confidence / 3 * 100)::double as percent from fx_classifications)
select page_id, string_agg(source_type, ',' order by p desc, pos) as ranked, max(p) as best, max(percent) as percentage from c group by page_id
""")
def classifications(spark, d):
    held = fx.classifications(spark, d).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", "source_type", (F.col("confidence") / 3).alias("p")))).alias("c"))
    ranked = held.select("page_id", recognition.classification(F.transform("c", lambda x: x["source_type"]), F.transform("c", lambda x: x["p"])).alias("c"))
    return ranked.select("page_id", F.array_join(F.transform("c", lambda x: x["source_type"]), ",").alias("ranked"), F.col("c")[0]["confidence"].alias("best"), F.col("c")[0]["percentage"].alias("percentage"))


_PLAIN = "list_filter(list_transform(list_filter(list_transform(regexp_split_to_array(text, '" + _WS + "'), lambda w: trim(w, '.,;:!?\"''()[]')), lambda w: w <> ''), lambda w: translate(w, chr(8204) || chr(8205), '')), lambda w: regexp_matches(w, '[\\x{0B80}-\\x{0BFF}]'))"


@query(f"""
, m as (select doc_id, {_PLAIN} as m from fx_script)
select doc_id, len(m)::int as script_words, len(list_filter(m, {_VALID}))::int as valid_words from m
""")
def text_layer_plain(spark, d):
    return fx.script_texts(spark, d).select("doc_id", X.text_layer_plain("text").alias("t")).select("doc_id", "t.script_words", "t.valid_words")


@query("select id, case when doc_id % 3 = 0 then (doc_id % 7)::int else page_count end as page_count, case when doc_id % 3 = 0 then 'now' end as updated_at from fx_documents")
def page_count_update(spark, d):
    docs = fx.documents(spark, d).withColumn("updated_at", F.lit(None).cast("string"))
    return store.set_page_count(docs, docs.where("doc_id % 3 = 0").select("id", (F.col("doc_id") % 7).cast("int").alias("page_count")), F.lit("now")).select("id", "page_count", "updated_at")


@query("""
select id, filename, 'ta' as language, 'uploaded' as status, 0 as page_count from (select 'DOC-20260102-' || upper(left(md5('u/' || page_id), 6)) as id, 'f' || page_id as filename from pages)
union all select id, 'old', language, status, page_count from fx_documents
""")
def insert_documents(spark, d):
    old = fx.documents(spark, d).select("id", F.lit("old").alias("filename"), F.lit("o").alias("original_path"), F.lit("image").alias("file_type"), "language", "status", "page_count")
    new = fx.table(spark, d, "pages").select(F.concat(F.lit("f"), F.col("page_id").cast("string")).alias("filename"), F.concat(F.lit("u/"), F.col("page_id").cast("string")).alias("original_path"), F.lit("image").alias("file_type"))
    out = store.insert_documents(old, new, F.to_date(F.lit("2026-01-02")), F.to_timestamp_ntz(F.lit("2026-01-02 00:00:00")))
    return out.select("id", "filename", "language", "status", "page_count")


@query("""
select id, case when bad > 0 then 'failed' when ready = n then 'done' when ready > 0 then 'running' else 'queued' end as status, coalesce(ready, 0)::int as done_pages, coalesce(n, 0)::int as total_pages
from fx_documents left join (select doc_id, count(*) as n, count(*) filter (status = 'ready' and g % 23 <> 0) as ready, count(*) filter (g % 23 = 0) as bad from fx_pages group by doc_id) using (doc_id)
""")
def job_progress(spark, d):
    docs = fx.documents(spark, d)
    jobs = docs.select(F.col("id"), F.col("id").alias("document_id"), F.lit("queued").alias("status"), F.lit(0).alias("total_pages"), F.lit(0).alias("done_pages"), F.lit("").alias("updated_at"))
    pages = fx.pages(spark, d).join(docs.select("doc_id", F.col("id").alias("document_id")), "doc_id").select("document_id", F.when(F.col("g") % 23 == 0, "failed").otherwise(F.col("status")).alias("status"))
    return store.job_progress(jobs, pages, F.lit("now")).select("id", "status", "done_pages", "total_pages")


@query("""
, again as (select page_id from fx_pages where g % 4 = 1), r as (select *, (1 + h % 2)::int as region_order from fx_lines where page_id in (select page_id from again) and pos % 3 <> 0),
b as (select page_id, region_order, min_by(x0 - 1, line_order) as rx0, count(*) as n from r group by page_id, region_order)
select page_id, count(*) as lines, count(*) filter (review_status = 'needs_review') as to_review, sum(checked)::bigint as checked, count(distinct region) as regions, coalesce(sum(rx0), 0)::double as region_x0 from (
  select page_id, review_status, tesseract_checked as checked, null as region, null as rx0 from fx_lines where page_id not in (select page_id from again)
  union all select r.page_id, case when coalesce(confidence, 0) < 0.8 then 'needs_review' else 'accepted' end, (h % 2)::int, region_order, rx0 from r join b using (page_id, region_order))
group by page_id
""")
def replace_reading(spark, d):
    lines, pages = fx.lines(spark, d), fx.pages(spark, d)
    old = lines.withColumn("id", F.col("line_id"))
    regions = pages.select((F.col("page_id") * 10).alias("id"), "page_id", F.lit(5.0).alias("x0"), F.lit(99).alias("reading_order"))
    again = pages.where("g % 4 = 1").select("page_id")
    seen = lines.where("pos % 3 <> 0").join(again, "page_id", "left_semi")
    reading = seen.select(
        "page_id", "line_order", (F.col("h") % 2 + 1).cast("int").alias("region_order"), F.col("ocr_text").alias("text"), "confidence", "engine", F.when(F.col("h") % 2 == 1, "second").alias("second"), "x0", "y0", "x1", "y1",
        (F.col("x0") - 1).alias("region_x0"), F.col("y0").alias("region_y0"), F.col("x1").alias("region_x1"), F.col("y1").alias("region_y1"),
    )
    new_lines, new_regions = store.replace_reading(old, regions, again, reading)
    boxes = new_regions.where("reading_order <> 99").select(F.col("id").alias("region_id"), F.col("x0").alias("rx0"))
    out = new_lines.join(boxes, "region_id", "left").groupBy("page_id")
    return out.agg(F.count("*").alias("lines"), F.count_if(F.col("review_status") == "needs_review").alias("to_review"), F.sum("tesseract_checked").alias("checked"), F.count_distinct("region_id").alias("regions"), F.coalesce(F.sum("rx0"), F.lit(0.0)).alias("region_x0"))


@query("""
select id, 'f' as filename, language, source_type, source_manual, status, page_count, (select count(*) from fx_pages p where p.doc_id = d.doc_id and p.review_status = 'verified') as verified_pages, error
from (select *, 0 as source_manual, null::varchar as error from fx_documents order by created_at desc, id limit 1000) d
""")
def document_summaries(spark, d):
    docs = fx.documents(spark, d).withColumn("filename", F.lit("f")).withColumn("source_manual", F.lit(0))
    out = review.summaries(review.listing(docs, fx.pages(spark, d), 1000))
    return out.select("id", "filename", "language", "source_type", "source_manual", "status", "page_count", "verified_pages", F.col("error").cast("string").alias("error"))


# --- sources and sinks, there and back


@query("select id, status, page_count from fx_documents")
def json_report(spark, d):
    folder = own_folder(spark, "reports")
    files.write_report(fx.documents(spark, d).select("id", "status", "page_count"), folder)
    return files.json_state(spark, folder, "id string, status string, page_count int", lines=True)


@query("""select to_json({'id': id, 'language': language, 'source_type': source_type, 'page_count': page_count, 'error': null})::varchar as value from fx_documents""")
def json_view(spark, d):
    docs = fx.documents(spark, d).withColumn("error", F.lit(None).cast("string"))
    return files.as_json(docs, "id", "language", "source_type", "page_count", "error")


@query(f"""
select printf('crops/%d/page-%04d-line-%04d.png', doc_id, page_number, line_order) || chr(9) || regexp_replace(regexp_replace(replace(verified_text, chr(9), ' '), '^{_WS}', ''), '{_WS}$', '') as value
from ({_CONTEXT}) where image_path is not null and not regexp_full_match(coalesce(verified_text, ''), '({_WS})?')
""")
def label_list(spark, d):
    folder = own_folder(spark, "labels")
    files.write_label_list(review.export_lines(review.training_pairs(review.training_context(*_three(spark, d)))), folder)
    return spark.read.text(folder)


@query("select n_nationkey::bigint as n_nationkey, n_name, n_regionkey::bigint as n_regionkey, n_name not like 'A%' as other, 'nation' as tables from nation", fixtures=False)
def sqlite_scan(spark, d):
    """A table of 25 rows as a SQLite file, its tables listed, its columns found and its rows read."""
    folder = Path(own_folder(spark, "sqlite").removeprefix("file:"))
    folder.mkdir(parents=True)
    at = str(folder / "nation.db")
    with sqlite3.connect(at) as db:
        db.execute("create table nation (n_nationkey integer primary key, n_name text, n_regionkey integer)")
        db.executemany("insert into nation values (?, ?, ?)", [tuple(r) for r in fx.table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").collect()])
    sqlite.register(spark)
    rows = spark.read.format("sqlite_file").option("path", at).option("table", "nation").load()
    return rows.withColumn("other", ~F.col("n_name").like("A%")).withColumn("tables", F.lit(",".join(sqlite.tables(at))))


# --- recognition from page images, end to end, by engines that read what the image's bytes say


def _page_engine():
    def read(image, language, route):
        return [{"text": f" {t} ", "confidence": len(t) % 100 / 100, "bbox": [20.0, 30.0 * i, 90.0, 30.0 * i + 20], "engine": "paddle"} for i, t in enumerate(image.decode().split("\n"))]

    return read


def _line_engine():
    return lambda image, bbox, language: {"text": f"{language}:{int(bbox[1])}", "confidence": 0.7, "engine": "tesseract"}


def _recognized(spark, d):
    # by document, as recognize holds them, so that texts are shuffled once
    lines = fx.lines(spark, d).select("doc_id", "page_number", "pos", "ocr_text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    held = lines.groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("pos", "ocr_text"))).alias("l"))
    pages = held.select(
        "doc_id", "page_number", F.array_join(F.transform("l", lambda x: x["ocr_text"]), "\n").cast("binary").alias("image"), F.lit("ta").alias("language"),
        F.when(F.col("doc_id") % 2 == 1, "palm_leaf").otherwise(F.lit(None)).alias("requested"),
    )

    def classify(image):
        c = (N.hash32(image) % 1001) / 1000.0
        return F.array(F.struct(F.lit("palm_leaf").alias("source_type"), c.alias("confidence")), F.struct(F.lit("modern_print").alias("source_type"), (1 - c).alias("confidence")))

    return recognize(pages, classify, recognition.page_reader(_page_engine), recognition.line_reader(_line_engine))


_IMAGES = """
, im as (select doc_id, page_number, string_agg(ocr_text, chr(10) order by pos) as image from fx_lines group by doc_id, page_number),
c as (select doc_id, page_number, ('0x' || substr(md5(image), 1, 8))::bigint % 1001 / 1000.0::double as c from im), n as (select doc_id, count(*)::int as n from im group by doc_id),
sampled as (select doc_id, unnest(case when n <= 5 then range(n) else list_distinct(list_transform(range(5), lambda i: round_even(i * (n - 1) / 4.0::double, 0)::bigint)) end) + 1 as page_number from n),
tops as (select doc_id, page_number, case when c >= 1 - c then 'palm_leaf' else 'modern_print' end as source_type, greatest(c, 1 - c) as confidence from c join sampled using (doc_id, page_number)),
totals as (select doc_id, source_type, sum((confidence * 1000)::bigint) as score, min(page_number) as first from tops group by doc_id, source_type),
votes as (select *, score / sum(score) over (partition by doc_id)::double as confidence, row_number() over (partition by doc_id order by score desc, first) as rn from totals)
"""


@query(_IMAGES + """
select doc_id, requested, source_type, round(confidence, 6) as confidence, redo, case when redo then source_type when requested in ('palm_leaf', 'modern_print') then requested else 'modern_print' end as route, 'review' as status
from (select *, source_type = 'palm_leaf' and requested <> 'palm_leaf' as redo from (select *, case when doc_id % 2 = 1 then 'palm_leaf' else 'modern_print' end as requested from votes where rn = 1))
""")
def recognized_documents(spark, d):
    documents, _ = _recognized(spark, d)
    return documents.select("doc_id", "requested", "source_type", N.scaled_round("confidence", 6).alias("confidence"), "redo", "route", "status")


@query(f"""
, l as (select *, row_number() over (partition by doc_id, page_number order by pos) - 1 as i, {_NORM.replace("$x", "ocr_text")} as t, length(ocr_text) % 100 / 100.0::double as c from fx_lines)
select doc_id, page_number, t as text, (row_number() over (partition by doc_id, page_number order by i) - 1)::int as line_order, c as confidence, 30.0::double * i as y0,
  case when c < 0.8 then 'needs_review' else 'accepted' end as review_status, case when c < 0.95 then 'ta:' || (30 * i)::bigint end as second
from l where t <> ''
""")
def recognized_lines(spark, d):
    _, lines = _recognized(spark, d)
    # which of the confident lines are read again hangs on a hash of their page
    second = F.when(F.col("confidence") < 0.95, F.col("second.text"))
    return lines.select("doc_id", "page_number", "text", "line_order", "confidence", "y0", "review_status", second.alias("second"))
