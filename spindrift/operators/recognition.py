"""Recognition: sampling pages, voting on the source type, routes, the confidence gate, injected engines.

Engines are plain functions that a caller passes in; they run as Arrow functions over batches, with the
model loaded once per Python worker by a factory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from spindrift.functions.images import per_worker
from spindrift.functions.numeric import hash_sample, py_round, ratio, sample_positions
from spindrift.functions.text import is_blank, normalize_texts
from spindrift.schema import AUDIT_RATE, DEFAULT_ROUTE, ENGRAVED, GATE, REVIEW_BELOW, SAMPLE_PAGES, SOURCE_TYPES

#: Votes are counted in parts this small, so a sum doesn't hang on the order of pages and equal sums are equal.
VOTE_PARTS = 10**12
#: Pages that are Python objects at once.
PAGES = 64
LINE = "array<struct<text: string, confidence: double, bbox: array<double>, engine: string>>"


def sampled_pages(documents: DataFrame, k: int = SAMPLE_PAGES) -> DataFrame:
    """documents(page_count) plus sample: positions from 0 of the pages to classify."""
    return documents.withColumn("sample", sample_positions("page_count", k))


def review_status(confidence) -> Column:
    c = F.col(confidence) if isinstance(confidence, str) else confidence
    return F.when(F.coalesce(c, F.lit(0.0)) < REVIEW_BELOW, "needs_review").otherwise("accepted")


def needs_reread(confidence, key: Column, rate: float = AUDIT_RATE) -> Column:
    """Below the gate, or in the reproducible audit sample of the confident ones."""
    c = F.col(confidence) if isinstance(confidence, str) else confidence
    return (F.coalesce(c, F.lit(0.0)) < GATE) | hash_sample(key, rate)


def source_vote(classifications: DataFrame, group: str = "doc_id", page: str = "page_number") -> DataFrame:
    """(group, source_type, confidence, votes) of classifications(group, page, pos, source_type, confidence).

    Each page votes for its best class with that confidence, the first one on ties; the class with the
    largest sum wins, the one voted for first on ties; confidence is its unrounded part of all votes, 0
    when they are all 0.  Sums are exact, of confidences rounded to VOTE_PARTS; one that isn't finite adds nothing.
    """
    c = F.coalesce("confidence", F.lit(0.0))
    top = classifications.groupBy(group, page).agg(F.max_by(F.struct("source_type", c.alias("c")), F.struct(c, -F.col("pos"))).alias("t"))
    parts = F.coalesce(F.rint(F.col("t.c") * F.lit(float(VOTE_PARTS))).try_cast("decimal(28,0)"), F.lit(0).cast("decimal(28,0)"))
    sums = top.groupBy(group, F.col("t.source_type").alias("source_type")).agg(F.sum(parts).alias("parts"), F.min(page).alias("first"))
    score = (F.col("parts").cast("double") / F.lit(float(VOTE_PARTS))).alias("score")
    return sums.groupBy(group).agg(
        F.max_by("source_type", F.struct("parts", -F.col("first"))).alias("source_type"), ratio(F.max("parts"), F.sum("parts")).alias("confidence"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("source_type", score)))).alias("votes"),
    )


def route(source_type) -> Column:
    """The processing route of a source type; anything unknown takes the default."""
    c = F.col(source_type) if isinstance(source_type, str) else source_type
    return F.when(c.isin(*SOURCE_TYPES), c).otherwise(F.lit(DEFAULT_ROUTE))


def routes(votes: DataFrame, requested: str = "requested", detected: str = "source_type") -> DataFrame:
    """votes plus redo and route: only engraved sources that weren't requested change the route."""
    redo = F.coalesce(F.col(detected).isin(*ENGRAVED) & ~F.col(detected).eqNullSafe(F.col(requested)), F.lit(False))
    return votes.withColumn("redo", redo).withColumn("route", F.when(redo, route(detected)).otherwise(route(requested)))


def first_pages(pages: DataFrame, n: int = 2) -> DataFrame:
    return pages.where(F.col("page_number") <= n)


def classification(labels: Column, probabilities: Column) -> Column:
    """array<struct(source_type, confidence, percentage)>, falling by the rounded confidence, first one first."""
    both = F.zip_with(labels, probabilities, lambda s, p: F.struct(s.alias("source_type"), p.alias("p")))
    known = F.filter(both, lambda x: x["source_type"].isNotNull() & x["p"].isNotNull())
    rows = F.transform(known, lambda x, i: F.struct((-py_round(x["p"], 4)).alias("o"), i.alias("i"), x["source_type"].alias("source_type"), py_round(x["p"], 4).alias("confidence"), py_round(x["p"] * 100, 2).alias("percentage")))
    return F.transform(F.array_sort(rows), lambda x: F.struct(x["source_type"].alias("source_type"), x["confidence"].alias("confidence"), x["percentage"].alias("percentage")))


def clean_lines(lines: Column) -> Column:
    """OCR lines with normalized text; those without any go."""
    texts = normalize_texts(F.transform(lines, lambda x: x["text"]))
    return F.filter(F.zip_with(lines, texts, lambda x, t: x.withField("text", t)), lambda x: x["text"] != "")


def word_reading(words: Column) -> Column:
    """struct(text, confidence, words) of array<struct(word, conf)>: blanks and negative confidences go."""
    read = normalize_texts(F.transform(words, lambda w: w["word"]))
    named = F.zip_with(words, read, lambda w, t: F.struct(t.alias("word"), (w["conf"] / 100).alias("conf")))
    kept = F.filter(named, lambda w: (w["word"] != "") & (w["conf"] >= 0))
    mean = F.coalesce(F.try_divide(F.aggregate(kept, F.lit(0.0), lambda a, w: a + w["conf"]), F.size(kept).cast("double")), F.lit(0.0))
    return F.struct(F.array_join(F.transform(kept, lambda w: w["word"]), " ").alias("text"), py_round(mean, 4).alias("confidence"), kept.alias("words"))


def mean_confidence(words: DataFrame) -> DataFrame:
    """(words, confidence): of words(word, conf) that aren't blank, how many there are and the mean of conf, 0 without any."""
    return words.where(~is_blank("word")).agg(F.count("*").alias("words"), F.coalesce(F.avg("conf"), F.lit(0.0)).alias("confidence"))


_READING = StructType([StructField("text", StringType()), StructField("confidence", DoubleType()), StructField("engine", StringType())])


def page_reader(factory: Callable[[], Callable[[bytes, str, str], list[dict]]]):
    """DataFrame(image, language, route, ...) -> the same plus lines and error, by an engine that reads one page image.

    A page that can't be read has no lines and the message, cut to 1000 characters, as its error; the others go on.
    """

    def read(df: DataFrame) -> DataFrame:
        names = df.columns
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", lines {LINE}, error string"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            engine = per_worker(factory)
            kind = pa.list_(pa.struct([("text", pa.string()), ("confidence", pa.float64()), ("bbox", pa.list_(pa.float64())), ("engine", pa.string())]))
            for batch in (b.slice(at, PAGES) for b in batches for at in range(0, b.num_rows, PAGES)):
                lines, errors = [], []
                for row in zip(batch.column("image").to_pylist(), batch.column("language").to_pylist(), batch.column("route").to_pylist(), strict=True):
                    try:
                        got, problem = engine(*row), None
                    except Exception as e:  # one bad page is that document's failure, not the job's
                        got, problem = [], (str(e) or type(e).__name__)[:1000]
                    lines.append(got)
                    errors.append(problem)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lines, kind), pa.array(errors, pa.string())], names=[*names, "lines", "error"])

        return df.mapInArrow(run, schema)

    return read


def line_reader(factory: Callable[[], Callable[[bytes, list[float], str], dict]]):
    """Column function (image, bbox, language) -> reading, by an engine that reads one line."""

    @F.pandas_udf(_READING)
    def read(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        engine = per_worker(factory)
        for image, bbox, language in parts:
            got = [engine(i, [] if b is None else list(b), la) for i, b, la in zip(image, bbox, language, strict=True)]
            yield pd.DataFrame({k: [g.get(k) for g in got] for k in ("text", "confidence", "engine")}, columns=["text", "confidence", "engine"])

    return read


def embedder(factory: Callable[[], Callable[[bytes], list[float]]]):
    """Column function image -> array<double> by a vision model."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        engine = per_worker(factory)
        for image in parts:
            yield pd.Series([None if i is None else [float(x) for x in engine(i)] for i in image], dtype=object)

    return embed


def classifier(factory: Callable[[], Callable[[bytes], list[float]]], labels: tuple[str, ...] = SOURCE_TYPES):
    """Column function image -> classification, by a model that gives a probability for each label; a null image has none."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def probabilities(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        engine = per_worker(factory)
        for image in parts:
            yield pd.Series([[] if i is None else [float(x) for x in engine(i)] for i in image], dtype=object)

    return lambda image: classification(F.array(*map(F.lit, labels)), probabilities(image))


def gated(lines: DataFrame, reader, key: Column) -> DataFrame:
    """lines without their image, plus second: the second reading of the lines that the gate picks, null for the others.

    The gate stands below the engine, so only picked lines reach it; other readings are untouched.  Two
    branches and no join: lines(confidence, bbox, language, image) should be cheap to read twice.
    """
    picks = needs_reread("confidence", key)
    picked = lines.where(picks).withColumn("second", reader("image", "bbox", "language")).drop("image")
    others = lines.where(~picks).drop("image").withColumn("second", F.lit(None).cast(picked.schema["second"].dataType))
    return picked.unionByName(others)
