"""Recognition of documents from page images, end to end, with injected engines.

Sample pages, classify and vote, choose each document's route, read every page once by its route,
lay the lines out, read doubtful lines again.  The vote is known before pages are read, so no page has
to be read twice when it changes the route.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.numeric import sample_positions
from spindrift.operators import layout, recognition
from spindrift.schema import DEFAULT_ROUTE, ENGRAVED, SAMPLE_PAGES
from spindrift.storage import discard, keep, keep_together, small_batches

#: Pages with their images that go to a Python worker at once.
PAGES_A_BATCH = 256


def votes(pages: DataFrame, classify: Callable[[Column], Column], sample: int = SAMPLE_PAGES) -> DataFrame:
    """(doc_id, source_type, confidence, votes) from the sampled pages of pages(doc_id, page_number, image)."""
    counted = pages.groupBy("doc_id").agg(F.count("*").cast("int").alias("n"))
    sampled = F.array_contains(sample_positions("n", sample), (F.col("page_number") - 1).cast("int"))
    images = pages.select("doc_id", "page_number", "image").join(counted.hint("shuffle_hash"), "doc_id").where(sampled)
    classes = images.select("doc_id", "page_number", F.posexplode(classify(F.col("image"))).alias("pos", "c"))
    return recognition.source_vote(classes.select("doc_id", "page_number", "pos", "c.source_type", "c.confidence"))


def recognize(
    pages: DataFrame, classify: Callable[[Column], Column], read_pages: Callable[[DataFrame], DataFrame], read_line, enhance: Callable[[Column], Column] | None = None, sample: int = SAMPLE_PAGES
) -> tuple[DataFrame, DataFrame]:
    """(documents with vote and route, lines) of pages(doc_id, page_number, image, language, requested).

    ``lines`` has the text, confidence, box, place in reading order, review status and, where the gate
    asked for one, the second reading.  A document with a page that couldn't be read has the status
    failed and the message of its first such page; all others are up for review.

    Images move once, to the others of their document; from then on only what is small is shuffled.  They are written
    once as they came, which goes when all are read, and once as they were read, with their lines, for the second reading.
    """
    spark = pages.sparkSession
    held, path = keep_together(pages, "doc_id")
    asked = held.groupBy("doc_id").agg(F.coalesce(F.first("requested", ignorenulls=True), F.lit(DEFAULT_ROUTE)).alias("requested"))
    documents = keep(recognition.routes(asked.join(votes(held, classify, sample), "doc_id", "left")))
    routed = held.drop("requested").join(documents.select("doc_id", "route").hint("shuffle_hash"), "doc_id").withColumn("page_id", F.xxhash64("doc_id", "page_number"))
    if enhance is not None:
        # two branches, so that other pages never reach the engine
        routed = routed.where(~F.col("route").isin(*ENGRAVED)).unionByName(routed.where(F.col("route").isin(*ENGRAVED)).withColumn("image", enhance(F.col("image"))))
    key = lambda pos: F.concat_ws("-", F.col("page_id").cast("string"), pos.cast("string"))
    read = read_pages(routed).withColumn("lines", layout.placed_lines(F.col("lines")))
    again = F.array_contains(F.transform("lines", lambda x: recognition.needs_reread(x["confidence"], key(x["pos"]))), True)
    # engines are dear: each page is read once
    with small_batches(spark, PAGES_A_BATCH):
        whole = keep(read.select("doc_id", "page_number", "page_id", "language", "error", "lines", F.when(again, F.col("image")).alias("image")), "zstd")
    discard(spark, path)
    failed = whole.where("error is not null").groupBy("doc_id").agg(F.min_by("error", "page_number").alias("error"))
    documents = documents.join(failed, "doc_id", "left").withColumn("status", F.when(F.col("error").isNotNull(), "failed").otherwise("review"))
    flat = whole.select("doc_id", "page_number", "page_id", "language", "image", F.explode("lines").alias("l"))
    laid = flat.select(
        F.xxhash64("page_id", "l.pos").alias("line_id"), "page_id", "l.pos", "doc_id", "page_number", "language", "l.text", "l.confidence", "l.bbox", "l.engine",
        *(F.get("l.bbox", F.lit(i)).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))), *(f"l.{c}" for c in ("region_x0", "region_y0", "region_x1", "region_y1", "region_order", "line_order")),
        recognition.review_status("l.confidence").alias("review_status"), "image",
    )
    return documents, recognition.gated(laid, read_line, key(F.col("pos")))
