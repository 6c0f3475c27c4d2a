"""Human review: listings, the nested review tree, the log of verifications, training pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.text import first_text, is_blank, strip, transliterate, tsv_field
from spindrift.schema import ACTIONS


def listing(documents: DataFrame, pages: DataFrame, limit: int = 100) -> DataFrame:
    """The newest documents with their number of verified pages (0 without any); ties by id."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be from 1 to 1000")
    verified = pages.where(F.col("review_status") == "verified").groupBy("doc_id").agg(F.count("*").alias("n"))
    newest = documents.orderBy(F.col("created_at").desc(), "id").limit(limit)
    return newest.join(verified, "doc_id", "left").withColumn("verified_pages", F.coalesce("n", F.lit(0))).drop("n").orderBy(F.col("created_at").desc(), "id")


#: Columns of the views that an interface shows.
SUMMARY = ("id", "filename", "file_type", "language", "source_type", "source_confidence", "source_manual", "status", "page_count", "verified_pages", "error", "created_at", "updated_at")


def summaries(documents: DataFrame) -> DataFrame:
    """The columns of a document that its views show; verified_pages is 0 where it isn't counted."""
    has = documents.columns
    return documents.select(*(F.col(c) if c in has else F.lit(0 if c == "verified_pages" else None).alias(c) for c in SUMMARY))


def by_id(documents: DataFrame, id_: str) -> DataFrame:
    """The one document with that id; no row means that there is none."""
    return summaries(documents.where(F.col("id") == id_))


def ready_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, ready): the numbers of the pages that are done, in order; what is left is resumed without them."""
    return pages.where(F.col("status") == "ready").groupBy("doc_id").agg(F.array_sort(F.collect_list("page_number")).alias("ready"))


def statuses(documents: DataFrame, ids: list[str]) -> DataFrame:
    """What a caller that waits for documents polls: their status, pages and message."""
    return documents.where(F.col("id").isin(*ids)).select("id", "status", "page_count", "error")


def review_lines(documents: DataFrame, pages: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines with their page's size (1 where missing), the text to show and its romanization."""
    p = pages.select("page_id", F.coalesce(F.nullif("width", F.lit(0)), F.lit(1)).alias("page_width"), F.coalesce(F.nullif("height", F.lit(0)), F.lit(1)).alias("page_height"))
    shown = lines.join(p, "page_id").join(documents.select("doc_id", "id", "language"), "doc_id").withColumn("text", first_text("verified_text", "ocr_text"))
    return shown.withColumn("romanized", transliterate("text"))


def review_tree(documents: DataFrame, pages: DataFrame, lines: DataFrame) -> DataFrame:
    """One row per document with pages in order, each with its lines in order; neither has to exist."""
    line = lines.withColumn("text", first_text("verified_text", "ocr_text")).withColumn("romanized", transliterate("text"))
    held = line.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("line_order", "line_id", "ocr_text", "text", "romanized", "confidence", "review_status"))).alias("lines"))
    empty = held.schema["lines"].dataType
    full = pages.join(held, "page_id", "left").withColumn("lines", F.coalesce("lines", F.array().cast(empty)))
    nested = full.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "page_id", "status", "review_status", "lines"))).alias("pages"))
    return documents.join(nested, "doc_id", "left").withColumn("pages", F.coalesce("pages", F.array().cast(nested.schema["pages"].dataType)))


def checked(events: DataFrame) -> DataFrame:
    """events(action, reviewer) plus problem: null, or why one isn't taken."""
    return events.withColumn("problem", F.when(~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False)), "unknown action").when(is_blank("reviewer"), "no reviewer"))


def history(events: DataFrame, key: str = "line_key") -> DataFrame:
    """The log with what each verification replaced (null for the first of a line)."""
    w = Window.partitionBy(key).orderBy("seq")
    return events.withColumn("previous_text", F.lag("new_text").over(w)).withColumn("reviewer", strip("reviewer"))


def latest(events: DataFrame, key: str = "line_key") -> DataFrame:
    """The last verification of each line; a partial aggregate, so a line with many costs no sort."""
    rest = [c for c in events.columns if c != key]
    last = events.groupBy(key).agg(F.max_by(F.struct(*rest), "seq").alias("e"))
    return last.select(key, *(F.col(f"e.{c}").alias(c) for c in rest))


def apply_verifications(lines: DataFrame, events: DataFrame) -> DataFrame:
    """lines(line_id, verified_text, review_status) after the log(line_key, seq, new_text): every action verifies."""
    last = latest(events.select("line_key", "seq", "new_text")).select(F.col("line_key").alias("line_id"), "new_text", F.lit(True).alias("touched"))
    out = lines.join(last, "line_id", "left")
    return out.withColumns({"verified_text": F.when(F.col("touched"), F.col("new_text")).otherwise(F.col("verified_text")), "review_status": F.when(F.col("touched"), "verified").otherwise(F.col("review_status"))}).drop("new_text", "touched")


def page_rollup(lines: DataFrame) -> DataFrame:
    """Pages without a line to review on which something has been verified are verified."""
    found = lines.groupBy("page_id").agg(F.count_if(F.col("review_status") == "needs_review").alias("open_lines"), F.count_if(F.col("review_status") == "verified").alias("verified_lines"))
    return found.withColumn("rolled_up", F.when((F.col("open_lines") == 0) & (F.col("verified_lines") > 0), "verified").otherwise("unreviewed"))


def training_context(documents: DataFrame, pages: DataFrame, lines: DataFrame) -> DataFrame:
    """Each line with its box, its page's image and its document's source type and language."""
    return (
        lines.select("line_id", "page_id", "doc_id", "line_order", "x0", "y0", "x1", "y1", "verified_text")
        .join(pages.select("page_id", "page_number", "image_path"), "page_id").join(documents.select("doc_id", "source_type", "language"), "doc_id")
    )


def training_pairs(context: DataFrame) -> DataFrame:
    """Verified lines with an image and a text that isn't blank, with the path of their crop."""
    crop = F.format_string("crops/%d/page-%04d-line-%04d.png", "doc_id", "page_number", "line_order")
    ok = context.where(F.col("image_path").isNotNull() & ~is_blank("verified_text"))
    return ok.select("line_id", crop.alias("crop_path"), F.col("verified_text").alias("text"), "source_type", "language")


def export_lines(pairs: DataFrame, crops: DataFrame | None = None) -> DataFrame:
    """path<TAB>text of pairs with a text, in order of line; with crops(path), of those whose crop exists."""
    rows = pairs.where(F.coalesce("text", F.lit("")) != "")
    if crops is not None:
        rows = rows.join(crops.select(F.col("path").alias("crop_path")).distinct(), "crop_path", "left_semi")
    return rows.select("line_id", F.concat_ws("\t", "crop_path", tsv_field("text")).alias("value"))
