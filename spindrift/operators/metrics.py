"""Operations metrics.  Each reads every table once: one conditional aggregate instead of a query per number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.numeric import percent, py_round, ratio
from spindrift.schema import GATE


def _one_row(*parts: DataFrame) -> DataFrame:
    """Single-row aggregates side by side."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, F.lit(True))
    return out


def stats(documents: DataFrame, pages: DataFrame, lines: DataFrame) -> DataFrame:
    """Counts, and the mean confidence of lines that an OCR engine read (not a text layer, not unknown)."""
    read = F.when(F.col("engine") != "text_layer", F.col("confidence"))
    return _one_row(
        documents.agg(F.count("*").alias("documents")),
        pages.agg(F.count("*").alias("pages"), F.count_if(F.col("review_status") == "verified").alias("verified_pages")),
        lines.agg(F.count("*").alias("lines"), F.count_if(F.col("review_status") == "needs_review").alias("lines_to_review"), F.avg(read).alias("average_confidence")),
    )


def throughput(pages: DataFrame) -> DataFrame:
    """Ready pages per minute between the first and the last; null with fewer than two or no time between."""
    done = pages.where((F.col("status") == "ready") & F.col("processed_at").isNotNull())
    minutes = F.expr("timestampdiff(SECOND, first_at, last_at)") / 60.0
    found = done.agg(F.count("*").alias("ready_pages"), F.min("processed_at").alias("first_at"), F.max("processed_at").alias("last_at")).withColumn("minutes", minutes)
    return found.select("ready_pages", "minutes", F.when((F.col("ready_pages") >= 2) & (F.col("minutes") > 0), F.col("ready_pages") / F.col("minutes")).alias("pages_per_minute"))


def totals(documents: DataFrame, pages: DataFrame, lines: DataFrame) -> DataFrame:
    """The dashboard's scalars, unrounded; the mean confidence is over all lines that have one."""
    line_row = lines.agg(
        F.count("*").alias("lines"), F.count_if(F.col("review_status") == "accepted").alias("accepted_lines"),
        F.count_if(F.col("review_status").isin("verified", "corrected")).alias("reviewed_lines"),
        F.count_if(F.col("tesseract_checked") == 1).alias("reread_lines"), F.avg("confidence").alias("mean_confidence"),
    )
    found = _one_row(documents.agg(F.count("*").alias("documents")), pages.agg(F.count("*").alias("pages")), line_row, throughput(pages).select("pages_per_minute"))
    return found.select(
        "documents", "pages", "lines", percent("accepted_lines", "lines").alias("auto_accepted_percent"), percent("reviewed_lines", "lines").alias("reviewed_percent"),
        (F.col("mean_confidence") * 100).alias("average_confidence"), "pages_per_minute", percent("reread_lines", "lines").alias("reread_percent"),
    )


def breakdown(rows: DataFrame, column: str, missing: str | None = None, by_count: bool = False) -> DataFrame:
    """Rows per value; null counts as ``missing`` where given.  Ordered by value, or by falling count and value."""
    value = F.coalesce(column, F.lit(missing)) if missing is not None else F.col(column)
    out = rows.groupBy(value.alias(column)).agg(F.count("*").alias("count"))
    return out.orderBy(F.col("count").desc(), column) if by_count else out.orderBy(column)


def bucket(confidence: str = "confidence") -> Column:
    c = F.col(confidence)
    return F.when(c < 0.5, "0-49%").when(c < 0.8, "50-79%").when(c < 0.95, "80-94%").otherwise("95-100%")


def confidence_buckets(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("confidence").isNotNull()).groupBy(bucket().alias("bucket")).agg(F.count("*").alias("count")).orderBy("bucket")


def bar_widths(counts: DataFrame, least: float = 3.0) -> DataFrame:
    """counts(count) plus width: percent of the largest count, which is at least 1."""
    most = counts.agg(F.greatest(F.max("count"), F.lit(1)).alias("most"))
    return counts.join(most, F.lit(True)).withColumn("width", F.greatest(F.lit(least), F.col("count") / F.col("most") * 100)).drop("most")


def dashboard(documents: DataFrame, pages: DataFrame, lines: DataFrame) -> DataFrame:
    """One row: rounded scalars and the three breakdowns as arrays in display order."""
    pack = lambda df, key, order: df.agg(F.array_sort(F.collect_list(F.struct(*order))).alias("s")).select(F.transform("s", lambda x: F.struct(x[key].alias(key), x["count"].alias("count"))).alias(f"{key}_breakdown"))
    status = pack(breakdown(documents, "status"), "status", ["status", "count"])
    source = pack(breakdown(documents, "source_type", "unknown"), "source_type", [(-F.col("count")).alias("falling"), "source_type", "count"])
    buckets = pack(confidence_buckets(lines), "bucket", ["bucket", "count"])
    t = totals(documents, pages, lines)
    for c, places in (("auto_accepted_percent", 1), ("reviewed_percent", 1), ("reread_percent", 1), ("average_confidence", 1), ("pages_per_minute", 2)):
        t = t.withColumn(c, py_round(c, places))
    return _one_row(t, status, source, buckets)


def bench_summary(stages: DataFrame, lines: DataFrame) -> DataFrame:
    """stages(page, stage, seconds): seconds in all and per page of each stage; beside them the pages'
    mean seconds, pages per minute, and the part of lines below the gate."""
    per_stage = stages.groupBy("stage").agg(F.sum("seconds").alias("stage_seconds"), F.avg("seconds").alias("stage_seconds_per_page"))
    per_page = stages.groupBy("page").agg(F.sum("seconds").alias("s")).agg(F.count("*").alias("pages"), F.avg("s").alias("seconds_per_page"), ratio(F.count("*"), F.sum("s") / 60).alias("pages_per_minute"))
    share = lines.agg(ratio(F.count_if(F.coalesce("confidence", F.lit(0.0)) < GATE), F.count("*")).alias("reread_share"))
    return per_stage.join(_one_row(per_page, share), F.lit(True))


def verified_ratio(verified: Column, page_count: Column) -> Column:
    """'3 / 7', or a dash without pages."""
    return F.when(page_count > 0, F.concat_ws(" / ", verified.cast("string"), page_count.cast("string"))).otherwise("–")


def health(engines: DataFrame) -> DataFrame:
    """engines(name, available): whether all are there, and the names of those missing."""
    return engines.agg(F.coalesce(F.bool_and("available"), F.lit(True)).alias("all_available"), F.array_sort(F.collect_list(F.when(~F.col("available"), F.col("name")))).alias("missing"))
