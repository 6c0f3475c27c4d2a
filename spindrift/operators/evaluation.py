"""Quality of recognition and of training: error rates, charsets, splits, best epochs, early stop."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.numeric import py_round, ratio
from spindrift.functions.text import edit_distance
from spindrift.storage import keep

SPLIT = 10


def charset(texts: DataFrame, column: str = "text") -> DataFrame:
    """Distinct characters in code point order; a text is reduced to its own before rows meet."""
    own = texts.select(F.explode(F.array_distinct(F.split(F.col(column), ""))).alias("character"))
    return own.where("character <> ''").distinct().orderBy("character")


def missing_characters(have: DataFrame, texts: DataFrame, column: str = "text") -> DataFrame:
    """Characters of the texts that have(character) lacks; none if it's a superset."""
    return charset(texts, column).join(have.select("character").distinct(), "character", "left_anti").orderBy("character")


def ocr_quality(pairs: DataFrame, *by: str) -> DataFrame:
    """Unrounded error rate over all characters and part of exact matches of pairs(target, prediction); null without pairs."""
    n = F.count("*")
    out = pairs.groupBy(*by).agg(
        n.alias("samples"), F.coalesce(F.sum(edit_distance("prediction", "target")), F.lit(0)).cast("long").alias("edits"), F.coalesce(F.sum(F.char_length("target")), F.lit(0)).cast("long").alias("characters"),
        F.count_if(F.col("prediction") == F.col("target")).alias("exact"),
    )
    return out.withColumn("cer_percent", F.when(F.col("samples") > 0, F.col("edits") * 100 / F.greatest(F.col("characters"), F.lit(1)))).withColumn("exact_percent", F.try_divide(F.col("exact") * F.lit(100.0), F.col("samples")))


def numbered(rows: DataFrame, *order: str, name: str = "row_index") -> DataFrame:
    """Rows with a running number from 0 in the given order, without gathering them in one task.

    Rows are range-partitioned, sorted and written once, so that no row is numbered anew; each partition's
    rows are counted, and the running total of the counts (one per partition) is added to the number
    inside the partition.
    """
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    part, inside = F.shiftrightunsigned("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    laid = keep(laid.withColumn("_part", part))
    counts = laid.groupBy("_part").agg(F.count("*").alias("n"))
    ahead = counts.withColumn("ahead", F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).drop("n")
    return laid.join(F.broadcast(ahead), "_part").withColumn(name, inside + F.col("ahead")).drop("_part", "_at", "ahead")


def split(rows: DataFrame, *order: str, every: int = SPLIT) -> DataFrame:
    """rows plus row_index and validation: every tenth row in order, the first included."""
    return numbered(rows, *order).withColumn("validation", F.col("row_index") % every == 0)


def batches(rows: DataFrame, size: int, seed: int = 7, key: str = "row_index") -> DataFrame:
    """rows plus batch: a reproducible shuffle by md5 of seed and key, then runs of ``size``."""
    shuffled = rows.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))))
    return numbered(shuffled, "_h", key, name="_n").withColumn("batch", F.floor(F.col("_n") / size).cast("long")).drop("_n", "_h")


def epoch_loss(losses: DataFrame, *by: str) -> DataFrame:
    """losses(.., epoch, loss) of single batches as one mean per epoch, to four places."""
    return losses.groupBy(*by, "epoch").agg(py_round(F.avg("loss"), 4).alias("loss"))


def best_epoch(history: DataFrame, *by: str) -> DataFrame:
    """Lowest error rate, highest part of exact matches, and the last epoch with that error rate."""
    return history.groupBy(*by).agg(F.min("cer").alias("best_cer"), F.max("exact").alias("best_exact"), F.max_by("epoch", F.struct(-F.col("cer"), "epoch")).alias("best_epoch"))


def early_stop(history: DataFrame, target: float = 80.0, patience: int = 8, run: str | None = None) -> DataFrame:
    """history(epoch, cer, exact) plus improved, stale and stop.

    An epoch improves on all before it with a lower error rate, or an equal one and more exact matches
    than the best epoch so far had; stale counts epochs since; stop marks the first that reaches the
    target or runs out of patience.  Histories are one row an epoch; ``run`` keeps several apart.
    """
    keys = [run] if run else []
    w = Window.partitionBy(*keys).orderBy("epoch")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    best = F.min(F.struct("cer", (-F.col("exact")).alias("e"))).over(before)
    out = history.withColumn("_best", best).withColumn("improved", F.col("_best").isNull() | (F.struct("cer", (-F.col("exact")).alias("e")) < F.col("_best")))
    out = out.withColumn("_island", F.sum(F.col("improved").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.withColumn("stale", F.row_number().over(Window.partitionBy(*keys, "_island").orderBy("epoch")) - 1)
    ends = (F.col("exact") >= target) | (F.col("stale") >= patience)
    first = F.min(F.when(ends, F.col("epoch"))).over(Window.partitionBy(*keys))
    return out.withColumn("stop", F.coalesce(F.col("epoch") == first, F.lit(False))).drop("_best", "_island")


def download_progress(sizes: DataFrame, done: DataFrame, chunk: int) -> DataFrame:
    """sizes(name, size, prefix, seconds), done(name, start): bytes there, percent, rate and time left (0 without a rate)."""
    ranges = sizes.select("name", "size", F.explode(F.expr(f"if(prefix < size, sequence(prefix, size - 1, {chunk}L), cast(array() as array<bigint>))")).alias("start"))
    todo = ranges.join(done.select("name", "start").distinct(), ["name", "start"], "left_anti").groupBy("name").agg(F.sum(F.least(F.lit(chunk), F.col("size") - F.col("start"))).alias("left"))
    out = sizes.join(todo, "name", "left").withColumn("left", F.coalesce("left", F.lit(0))).withColumn("bytes_done", F.col("size") - F.col("left"))
    rate = F.try_divide((F.col("bytes_done") - F.col("prefix")).cast("double"), F.col("seconds"))
    return out.select("name", "bytes_done", (ratio("bytes_done", "size") * 100).alias("percent"), F.coalesce(rate, F.lit(0.0)).alias("rate"), F.when(rate > 0, F.col("left") / rate).otherwise(F.lit(0.0)).alias("seconds_left"))


def all_passed(checks: DataFrame) -> DataFrame:
    return checks.agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("all_ok"), F.count_if(~F.col("ok")).alias("failed"))
