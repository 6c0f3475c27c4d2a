"""Inputs of the catalogue: the data model's tables, derived from whatever texts, events and vectors are at hand.

Everything follows from md5 of the keys, so another engine can derive the same rows; ``SQL`` holds the
same tables as common table expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from spindrift.functions.numeric import hash32
from spindrift.schema import GATE, REVIEW_BELOW, SOURCE_TYPES

LINES_A_PAGE = 20
#: Latin letters and the script's letters that stand in for them.
LATIN = "abcdefghijklmnopqrstuvwxyz"
SCRIPT = "ாபசதெபகஹிஜகலமநொபகரஸடுவவஷயழ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _s(c: str) -> Column:
    return F.col(c).cast("string")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OCR lines: one for each line of a document's text that isn't blank."""
    raw = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "ocr_text")).where(F.trim("ocr_text") != "")
    h = F.col("h")
    out = raw.withColumn("h", hash32(F.concat(_s("doc_id"), F.lit("-"), _s("pos"))))
    page = F.floor(F.col("pos") / LINES_A_PAGE).cast("int") + 1
    out = out.withColumns({
        "page_number": page, "line_order": (F.col("pos") % LINES_A_PAGE).cast("int"), "page_id": F.col("doc_id") * 1000 + page, "line_id": F.col("doc_id") * 100000 + F.col("pos"),
        "confidence": F.when(h % 50 != 0, (h % 10001) / F.lit(10000)),
        "engine": F.when(h % 41 == 0, F.lit(None)).when(h % 4 == 0, "text_layer").when(h % 4 == 1, "tesseract").when(h % 4 == 2, "consensus").otherwise("paddle"),
        "x0": (20 + 300 * (h % 2) + h % 7).cast("double"), "y0": (30 * (F.col("pos") % LINES_A_PAGE)).cast("double"),
    })
    return out.withColumns({
        "x1": F.col("x0") + 120, "y1": F.col("y0") + 18 + h % 5,
        "tesseract_checked": ((F.coalesce("confidence", F.lit(0.0)) < GATE) | (h % 10000 < 200)).cast("int"),
        "review_status": F.when(h % 9 == 0, "verified").when(F.coalesce("confidence", F.lit(0.0)) < REVIEW_BELOW, "needs_review").otherwise("accepted"),
        "verified_text": F.when(h % 9 != 0, F.lit(None)).when(h % 27 == 0, "").otherwise(F.concat(F.lit("v:"), "ocr_text")),
    })


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.col("g")
    out = lines(spark, sf_dir).groupBy("page_id", "doc_id", "page_number").agg(F.count("*").alias("n_lines")).withColumn("g", hash32(F.concat(F.lit("p"), _s("page_id"))))
    return out.withColumns({
        "status": F.when(g % 10 == 0, "pending").otherwise("ready"), "review_status": F.when(g % 4 == 0, "verified").otherwise("unreviewed"),
        "width": F.when(g % 13 == 0, F.lit(None)).otherwise(600).cast("int"), "height": F.when(g % 17 == 0, 0).otherwise(800).cast("int"),
        "image_path": F.when(g % 11 == 0, F.lit(None)).otherwise(F.concat(F.lit("pages/"), _s("page_id"), F.lit(".png"))),
        "processed_at": F.when(g % 10 != 0, F.expr("timestamp_ntz'2026-01-01 00:00:00' + make_dt_interval(0, 0, 0, page_id % 86400)")),
    })


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    kind, state = hash32(F.concat(F.lit("d"), _s("doc_id"))) % 7, hash32(F.concat(F.lit("t"), _s("doc_id"))) % 5
    return d.select(
        "doc_id", F.concat(F.lit("DOC-"), F.lpad(_s("doc_id"), 8, "0")).alias("id"), F.col("lang").alias("language"),
        F.get(F.array(*map(F.lit, SOURCE_TYPES)), kind.cast("int")).alias("source_type"),
        F.get(F.array(*map(F.lit, ("uploaded", "processing", "review", "verified", "failed"))), state.cast("int")).alias("status"),
        F.expr("timestamp_ntz'2026-01-01 00:00:00' + make_dt_interval(0, 0, 0, doc_id div 3)").alias("created_at"), (F.col("n_chars") % 12).cast("int").alias("page_count"),
    )


def verifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.when(F.col("event_type").isin("click", "purchase"), "accept").when(F.col("event_type") == "error", "reject").otherwise("edit")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("line_key"), action.alias("action"), F.concat(F.lit("u"), _s("user_id")).alias("reviewer"), F.col("props").alias("new_text"), F.col("ts").alias("created_at"),
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("page_id"), F.col("label").cast("string").alias("document_id"), "embedding")


def classifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = F.posexplode(F.array(*map(F.lit, SOURCE_TYPES))).alias("pos", "source_type")
    scored = pages(spark, sf_dir).select("doc_id", "page_number", "page_id", types)
    return scored.withColumn("confidence", (hash32(F.concat(F.lit("c"), _s("page_id"), "source_type")) % 10001) / F.lit(10000))


@F.pandas_udf(StringType())
def _in_script(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    letters = str.maketrans(LATIN, SCRIPT)
    for p in parts:
        yield pd.Series([t if t is None else t.translate(letters) for t in p], dtype=object)


def script_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", _in_script(F.lower("text")).alias("text"))


def ctc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = (hash32(F.concat(F.lit("k"), _s("event_id"))) % 4).cast("int").alias("token")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", token)
    return rows.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "token"))).alias("s")).select("user_id", F.col("s.token").alias("tokens"))


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A training history for each user: a day of events is an epoch."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.dayofmonth("ts").alias("epoch"), F.floor(F.col("value") * 100).cast("long").alias("v"))
    return e.groupBy("run", "epoch").agg((F.expr("sum(v) div count(*) div 100")).cast("double").alias("cer"), (F.count("*") * 9.0).alias("exact"))


def ocr_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line, whole."""
    target = lines(spark, sf_dir).select("doc_id", "line_id", F.col("ocr_text").alias("target"))
    return target.withColumn("prediction", F.translate("target", "aei", "xyz"))


SQL = rf"""
raw_lines as (
  select doc_id, unnest(string_split(text, chr(10))) as ocr_text, unnest(range(len(string_split(text, chr(10))))) as pos from documents
), hashed_lines as (
  select *, ('0x' || substr(md5(doc_id || '-' || pos), 1, 8))::bigint as h from raw_lines where trim(ocr_text) <> ''
), fx_lines as (
  select *, doc_id * 1000 + page_number as page_id, doc_id * 100000 + pos as line_id, x0 + 120 as x1, y0 + 18 + h % 5 as y1,
    (coalesce(confidence, 0) < 0.95 or h % 10000 < 200)::int as tesseract_checked,
    case when h % 9 = 0 then 'verified' when coalesce(confidence, 0) < 0.8 then 'needs_review' else 'accepted' end as review_status,
    case when h % 9 <> 0 then null when h % 27 = 0 then '' else 'v:' || ocr_text end as verified_text
  from (select *, (pos // 20 + 1)::int as page_number, (pos % 20)::int as line_order,
    case when h % 50 <> 0 then (h % 10001) / 10000::double end as confidence,
    case when h % 41 = 0 then null when h % 4 = 0 then 'text_layer' when h % 4 = 1 then 'tesseract' when h % 4 = 2 then 'consensus' else 'paddle' end as engine,
    (20 + 300 * (h % 2) + h % 7)::double as x0, (30 * (pos % 20))::double as y0 from hashed_lines)
), fx_pages as (
  select *, case when g % 10 = 0 then 'pending' else 'ready' end as status, case when g % 4 = 0 then 'verified' else 'unreviewed' end as review_status,
    case when g % 13 = 0 then null else 600 end as width, case when g % 17 = 0 then 0 else 800 end as height,
    case when g % 11 = 0 then null else 'pages/' || page_id || '.png' end as image_path,
    case when g % 10 <> 0 then timestamp '2026-01-01 00:00:00' + to_seconds(page_id % 86400) end as processed_at
  from (select page_id, doc_id, page_number, count(*) as n_lines, ('0x' || substr(md5('p' || page_id), 1, 8))::bigint as g from fx_lines group by all)
), fx_documents as (
  select doc_id, 'DOC-' || lpad(doc_id::varchar, 8, '0') as id, lang as language, (n_chars % 12)::int as page_count,
    ['modern_print', 'historical_print', 'handwritten', 'palm_leaf', 'inscription'][('0x' || substr(md5('d' || doc_id), 1, 8))::bigint % 7 + 1] as source_type,
    ['uploaded', 'processing', 'review', 'verified', 'failed'][('0x' || substr(md5('t' || doc_id), 1, 8))::bigint % 5 + 1] as status,
    timestamp '2026-01-01 00:00:00' + to_seconds(doc_id // 3) as created_at
  from documents
), fx_verifications as (
  select event_id as seq, user_id as line_key, case when event_type in ('click', 'purchase') then 'accept' when event_type = 'error' then 'reject' else 'edit' end as action,
    'u' || user_id as reviewer, props as new_text, ts as created_at from events
), fx_embeddings as (
  select vec_id as page_id, label::varchar as document_id, embedding from embeddings
), fx_classifications as (
  select *, (('0x' || substr(md5('c' || page_id || source_type), 1, 8))::bigint % 10001) / 10000::double as confidence
  from (select doc_id, page_number, page_id, unnest(range(5))::int as pos, unnest(['modern_print', 'historical_print', 'handwritten', 'palm_leaf', 'inscription']) as source_type from fx_pages)
), fx_script as (
  select doc_id, translate(lower(text), '{LATIN}', '{SCRIPT}') as text from documents
), fx_ctc as (
  select user_id, list(('0x' || substr(md5('k' || event_id), 1, 8))::bigint % 4 order by event_id) as tokens from events group by user_id
), fx_epochs as (
  select run, epoch, (sum(v) // count(*) // 100)::double as cer, count(*) * 9.0::double as exact from (select user_id as run, day(ts)::int as epoch, floor(value * 100)::bigint as v from events) group by run, epoch
), fx_ocr_pairs as (
  select doc_id, line_id, ocr_text as target, translate(ocr_text, 'aei', 'xyz') as prediction from fx_lines
)
"""
