"""Changes to tables as transforms of immutable snapshots: upsert, replace, update, cascading delete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.text import document_id
from spindrift.schema import DOCUMENT_STATUS, REFERENCES, REVIEW_BELOW, conform, in_domain
from spindrift.storage import keep


def upsert(old: DataFrame, new: DataFrame, keys: list[str], allowed: list[str] | None = None, supplied: str = "supplied") -> DataFrame:
    """Rows of new over rows of old with the same keys, column by column.

    A row of new overwrites the columns that its array<string> ``supplied`` names, null included; without
    that column, all columns that new has.  Columns outside ``allowed`` are never written.
    """
    allowed = [c for c in old.columns if c not in keys] if allowed is None else allowed
    gives = [c for c in allowed if c in new.columns]
    named = supplied if supplied in new.columns else None
    out = []
    for c in old.columns:
        if c in keys:
            out.append(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c))
        elif c in gives:
            hit = F.col("n._new").isNotNull()
            if named is not None:
                hit = hit & F.coalesce(F.array_contains(f"n.{supplied}", c), F.lit(False))
            out.append(F.when(hit, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        else:
            out.append(F.col(f"o.{c}").alias(c))
    on = None
    for k in keys:
        test = F.col(f"o.{k}") == F.col(f"n.{k}")
        on = test if on is None else on & test
    return old.alias("o").join(new.withColumn("_new", F.lit(True)).alias("n"), on, "full").select(*out)


def last_wins(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key: the one with the highest ``order``; new goes before old where both have it."""
    both = old.withColumn("_from", F.lit(0)).unionByName(new.withColumn("_from", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("_from", order)).alias("r"))
    return best.select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest)).select(*old.columns)


def replace_children(old: DataFrame, new: DataFrame, parent: str, read: DataFrame | None = None) -> DataFrame:
    """Children of every parent that ``read`` (else new) mentions are replaced by new's: a parent that is read again and gives none loses its old ones."""
    gone = (new if read is None else read).select(parent).distinct()
    return old.join(gone, parent, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def replace_reading(lines: DataFrame, regions: DataFrame, read: DataFrame, reading: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines, regions) after the pages of read(page_id) were read again as reading(page_id, line_order, region_order,
    text, confidence, engine, second, box x0..y1, region_x0..region_y1).

    Both tables lose the pages' old rows.  A region is a page's region_order; ids follow from page and order.
    tesseract_checked tells whether there was a second reading, review_status follows from the confidence.
    """
    region_id = F.xxhash64("page_id", F.lit("region"), "region_order")
    boxes = reading.groupBy("page_id", "region_order").agg(*(F.min_by(f"region_{c}", "line_order").alias(c) for c in ("x0", "y0", "x1", "y1")))
    new_regions = boxes.select(region_id.alias("id"), "page_id", F.lit("text").alias("region_type"), "x0", "y0", "x1", "y1", F.col("region_order").alias("reading_order"))
    new_lines = reading.select(
        F.xxhash64("page_id", F.lit("line"), "region_order", "line_order").alias("id"), "page_id", region_id.alias("region_id"), "line_order", F.coalesce("text", F.lit("")).alias("ocr_text"), "confidence",
        F.coalesce("engine", F.lit("paddle")).alias("engine"), F.col("second").isNotNull().cast("int").alias("tesseract_checked"), "x0", "y0", "x1", "y1",
        F.when(F.coalesce("confidence", F.lit(0.0)) < REVIEW_BELOW, "needs_review").otherwise("accepted").alias("review_status"),
    )
    return replace_children(conform(lines, "lines"), conform(new_lines, "lines"), "page_id", read), replace_children(conform(regions, "regions"), conform(new_regions, "regions"), "page_id", read)


def insert_documents(documents: DataFrame, new: DataFrame, day, now) -> DataFrame:
    """documents plus new(filename, original_path, file_type, ..) as uploaded, with defaults and, where none is given, an id made of the day and the path."""
    made = document_id(day, F.col("original_path"))
    named = new.withColumn("id", F.coalesce(F.col("id"), made) if "id" in new.columns else made)
    return conform(documents, "documents").unionByName(conform(named.withColumns({"status": F.lit("uploaded"), "created_at": now, "updated_at": now}), "documents"))


def set_page_count(documents: DataFrame, counts: DataFrame, now) -> DataFrame:
    """documents after counts(id, page_count); others keep theirs."""
    out = documents.join(counts.select("id", F.col("page_count").alias("_count")), "id", "left")
    values = {"page_count": F.col("_count"), "updated_at": now}
    return out.select(*(F.when(F.col("_count").isNotNull(), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in documents.columns))


def job_progress(jobs: DataFrame, pages: DataFrame, now) -> DataFrame:
    """jobs after pages(document_id, status) moved on: done pages counted, done when all are, failed when one is."""
    n = pages.groupBy("document_id").agg(F.count_if(F.col("status") == "ready").alias("_ready"), F.count_if(F.col("status") == "failed").alias("_failed"), F.count("*").cast("int").alias("_all"))
    out = jobs.join(n, "document_id", "left")
    state = F.when(F.col("_failed") > 0, "failed").when(F.col("_ready") == F.col("_all"), "done").when(F.col("_ready") > 0, "running").otherwise(F.col("status"))
    values = {"status": state, "done_pages": F.col("_ready").cast("int"), "total_pages": F.col("_all"), "updated_at": now}
    return out.select(*(F.when(F.col("_all").isNotNull(), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in jobs.columns))


def cascade(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """All tables after the documents in gone(id) went: children go with their parents, references to a
    region that went become null; a null reference points nowhere and stays.

    Keys that survive in a parent are written once, and each child is read once for every reference it has.
    """
    out, there = dict(tables), {}
    if "documents" in out:
        out["documents"] = out["documents"].join(gone.select("id").distinct(), "id", "left_anti").select(*tables["documents"].columns)
    for child, column, parent, key, rule in REFERENCES:
        if child in out and parent in out and column in out[child].columns:
            if (parent, key) not in there:
                there[parent, key] = keep(out[parent].select(F.col(key).alias("_key"), F.lit(True).alias("_there")))
            marked = out[child].join(there[parent, key], F.col(column) == F.col("_key"), "left")
            if rule == "cascade":
                marked = marked.where(F.col("_there") | F.col(column).isNull())
            else:
                marked = marked.withColumn(column, F.when(F.col("_there"), F.col(column)))
            out[child] = marked.select(*tables[child].columns)
    return out


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Children whose parent doesn't exist; empty when the reference holds."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def set_status(documents: DataFrame, changes: DataFrame, now: Column, error_length: int = 1000) -> DataFrame:
    """documents after changes(id, status, error): an unknown status is an error, a message is cut."""
    new = changes.select("id", in_domain("status", DOCUMENT_STATUS).alias("new_status"), F.left("error", F.lit(error_length)).alias("new_error"), F.lit(True).alias("_hit"))
    out = documents.join(new, "id", "left")
    pick = lambda a, b: F.when(F.col("_hit"), a).otherwise(F.col(b)).alias(b)
    values = {"status": F.col("new_status"), "error": F.col("new_error"), "updated_at": now}
    return out.select(*(pick(values[c], c) if c in values else F.col(c) for c in documents.columns))


def set_source(documents: DataFrame, changes: DataFrame) -> DataFrame:
    """documents after changes(id, source_type, confidence, manual): a manual choice has confidence 1."""
    new = changes.select("id", F.col("source_type").alias("new_type"), F.when(F.col("manual"), F.lit(1.0)).otherwise(F.col("confidence")).alias("new_confidence"), F.col("manual").cast("int").alias("new_manual"), F.lit(True).alias("_hit"))
    out = documents.join(new, "id", "left")
    values = {"source_type": "new_type", "source_confidence": "new_confidence", "source_manual": "new_manual"}
    return out.select(*(F.when(F.col("_hit"), F.col(values[c])).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in documents.columns))
