"""Quality rules: a decision list learned from labelled statistics.

``text_stats`` measures whole texts; ``learn_list`` runs sequential covering (grow a conjunction of
thresholds by information gain, for bad rows and for good ones, prune it on held-out rows, keep it only
if it's precise enough); ``verdict`` turns the list into one ordered CASE expression, in which a rule that
lets rows stay is an exception to those after it, so judging rows is plain Spark.

Defined results: a null text is the empty text (all counts 0, base_failed); repeated rows and ties
are judged alike, as the verdict depends on the row only; labels that are null, or that contradict
each other for one doc_id, are ignored; without usable labels the list is empty and keeps every row
that isn't base_failed; an empty table gives an empty result; columns of the input other than
doc_id and text don't matter to ``text_stats``, and ``quality_filter`` hands them through unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.wordscan import IS_WORD, grams, slices, texts_of

#: Labelled rows that the list is fitted on: the first by a hash of doc_id.  The only bound here.
MAX_LABELLED = 20_000
SEED = 17
#: Part of the held-out rows that a rule hits which must be bad for it to enter the list.
MIN_PRECISION = 0.95
#: The same for a rule that lets rows stay whatever later rules say.
MIN_KEPT = 0.995
MIN_COVER = 8
MAX_CONDITIONS = 4
MAX_RULES = 16
CUTS = 48

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_upper", "n_digits", "n_marks")
SCHEMA = "doc_id long, " + ", ".join(f"{s} long" for s in STATS)
#: What conditions may test: name and its SQL over STATS.
FEATURES = {
    "words": "cast(n_words as double)",
    "mean_word": "word_chars / greatest(n_words, 1D)",
    "symbols": "n_symbols / greatest(n_words, 1D)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1D)",
    "repeats": "n_repeat_words / greatest(n_words, 1D)",
    "distinct": "n_distinct_words / greatest(n_words, 1D)",
    "upper": "n_upper / greatest(word_chars, 1D)",
    "digits": "n_digits / greatest(word_chars, 1D)",
    "marks": "n_marks / greatest(n_words, 1D)",
}


def _flag(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


_SYMBOLS, _UPPER, _DIGITS, _MARKS = _flag(b"#*$%&|<>"), _flag(bytes(range(65, 91))), _flag(bytes(range(48, 58))), _flag(b"!?.,;:")


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """STATS of the texts of an Arrow column."""
    t = texts_of(column).words()
    n, word = t.n, IS_WORD[t.data]
    hashes = t.word_hashes()
    count = lambda doc: np.bincount(doc, minlength=n).astype(np.int64)

    def first_of(values: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order by text and value, and whether each in that order differs from the one before."""
        order = np.lexsort((values, doc))
        v, d = values[order], doc[order]
        new = np.ones(len(v), dtype=bool)
        new[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
        return order, new

    order, new = first_of(hashes, t.doc)
    distinct = count(t.doc[order][new])

    g, at = grams(hashes, t.doc, 3)
    order, new = first_of(g, t.doc[at])
    single = new & np.append(new[1:], True)
    many = at[order][~single]
    covered = np.zeros(len(hashes) + 1, dtype=bool)
    for i in range(3):
        covered[many + i] = True
    repeat = count(t.doc[covered[:-1]])

    starts, ends, doc = t.lines()
    words_before = np.searchsorted(t.starts, np.stack([starts, ends]))
    real = words_before[1] > words_before[0]
    starts, ends, doc = starts[real], ends[real], doc[real]
    order, new = first_of(t.hashes(starts, ends), doc)
    return {
        "n_words": count(t.doc),
        "word_chars": t.per_text(word & ((t.data & 0xC0) != 0x80)),
        "n_symbols": t.per_text(_SYMBOLS[t.data]),
        "n_dup_lines": count(doc[order][~new]),
        "n_repeat_words": repeat,
        "n_lines": count(doc),
        "n_distinct_words": distinct,
        "n_upper": t.per_text(_UPPER[t.data]),
        "n_digits": t.per_text(_DIGITS[t.data]),
        "n_marks": t.per_text(_MARKS[t.data]),
    }


def text_stats(docs: DataFrame) -> DataFrame:
    """(doc_id, *STATS) of every row's whole text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                got = measure(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *(pa.array(got[s], pa.int64()) for s in STATS)], names=["doc_id", *STATS])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, SCHEMA)


def base_failed() -> Column:
    return F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")


#: An ordered rule: a conjunction of (feature, '<=' or '>', threshold), whether rows that meet it stay, and its precision on rows it wasn't grown on.
Rule = tuple[list[tuple[str, str, float]], bool, float]


def _meets(rows: np.ndarray, rule: list[tuple[int, str, float]]) -> np.ndarray:
    return np.all([rows[:, j] <= v if op == "<=" else rows[:, j] > v for j, op, v in rule], axis=0) if rule else np.ones(len(rows), dtype=bool)


def _grown(x: np.ndarray, y: np.ndarray, cuts: list[np.ndarray]) -> list[tuple[int, str, float]]:
    """A conjunction for the rows y, one condition after another by information gain."""
    rule: list[tuple[int, str, float]] = []
    inside = np.ones(len(y), dtype=bool)
    while len(rule) < MAX_CONDITIONS and y[inside].any() and not y[inside].all():
        p0, n0 = y[inside].sum(), (~y[inside]).sum()
        best = (0.0, None)
        for j in range(x.shape[1]):
            order = np.argsort(x[inside, j], kind="stable")
            hits = np.concatenate([[0], np.cumsum(y[inside][order])])
            below = np.searchsorted(x[inside, j][order], cuts[j], side="right")
            for cut, low, pl in zip(cuts[j].tolist(), below.tolist(), hits[below].tolist(), strict=True):
                for op, p, n in (("<=", pl, low - pl), (">", p0 - pl, n0 - (low - pl))):
                    if p and p + n < p0 + n0:
                        gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                        if gain > best[0] + 1e-9:
                            best = (gain, (j, op, cut))
        if best[1] is None:
            break
        j, op, cut = best[1]
        # halfway to the next value, so that rows a little beyond the last good one aren't hit
        above, below = x[inside, j][x[inside, j] > cut], x[inside, j][x[inside, j] <= cut]
        rule.append((j, op, float((below.max() + above.min()) / 2) if len(above) and len(below) else cut))
        inside = _meets(x, rule)
    return rule


def learn_list(x: np.ndarray, bad: np.ndarray, names: list[str]) -> list[Rule]:
    """Sequential covering over features x and the flag bad: ordered rules for either verdict; what meets none is good.

    In each round a rule is grown for the bad ones among the rows that no rule covers yet, pruned on held-out rows,
    and enters if it's precise enough.  If it isn't, one for good rows is grown the same way: an exception
    to the rules that come after it, which have fewer good rows left to spare.  Exceptions at the end
    except nothing and go.
    """
    rules: list[Rule] = []
    if not len(bad) or not bad.any() or bad.all():
        return rules
    held = np.random.Generator(np.random.PCG64(SEED)).random(len(bad)) < 1 / 3
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, CUTS + 1)[1:-1])) for j in range(x.shape[1])]
    left = np.ones(len(bad), dtype=bool)
    while len(rules) < MAX_RULES:
        for keep_, least in ((False, MIN_PRECISION), (True, MIN_KEPT)):
            target = ~bad if keep_ else bad
            gx, gy = x[left & ~held], target[left & ~held]
            hx, hy = x[left & held], target[left & held]
            rule = _grown(gx, gy, cuts)
            # prune from the end while the held-out rows don't speak against it
            worth = lambda r, hx=hx, hy=hy: (lambda m: (hy[m].sum() - (~hy[m]).sum()) / max(1, m.sum()))(_meets(hx, r))
            while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
                rule = rule[:-1]
            hit = _meets(hx, rule)
            precision = float(hy[hit].mean()) if hit.any() else 0.0
            if rule and hit.sum() >= MIN_COVER and precision >= least:
                rules.append(([(names[j], op, v) for j, op, v in rule], keep_, precision))
                left &= ~_meets(x, rule)
                break
        else:
            break
    while rules and rules[-1][1]:
        rules.pop()
    return rules


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """The decision list for documents(doc_id, text) and labels(doc_id, quality: 0 is bad).

    The sample is max_labelled labels, the first by a hash of doc_id: a bound on what the driver and
    the broadcast hold, whatever the tables' sizes.
    """
    sample = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
        .where("low = high").select("doc_id", "low").orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(max_labelled)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    picked = text_stats(texts.join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi"))
    rows = (
        picked.join(F.broadcast(sample), "doc_id").where(~base_failed())
        .selectExpr("doc_id", "low = 0 as bad", *(f"{sql} as {name}" for name, sql in FEATURES.items()))
        .dropDuplicates(["doc_id"]).toPandas().sort_values("doc_id")
    )
    names = list(FEATURES)
    return learn_list(rows[names].to_numpy(float), rows["bad"].to_numpy(bool), names)


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered CASE over STATS: true for rows to keep; the first rule that a row meets decides."""
    out = None
    for rule, keep_, _ in rules:
        test = F.expr(" and ".join(f"{FEATURES[name]} {op} {v!r}D" for name, op, v in rule))
        out = F.when(test, F.lit(keep_)) if out is None else out.when(test, F.lit(keep_))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judge(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, *STATS, base_failed, kept) for every row of docs."""
    rules = fit(docs, labels, max_labelled)
    return text_stats(docs).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def quality_filter(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows of docs that the list keeps, with all their columns, in one pass and without a shuffle."""
    rules = fit(docs, labels, max_labelled)
    names, types = docs.columns, docs.schema
    put = [f"stat_{s}" for s in STATS]
    while set(put) & set(names):
        put = [f"_{p}" for p in put]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in types.fields), *(f"`{p}` bigint" for p in put)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                got = measure(part.column("text"))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(got[s], pa.int64()) for s in STATS)], names=[*names, *put])

    wide = docs.mapInArrow(scan, schema)
    stats = wide.select("*", *(F.col(p).alias(s) for p, s in zip(put, STATS, strict=True))) if not set(STATS) & set(names) else None
    if stats is not None:
        return stats.where(~base_failed() & verdict(rules)).select(*(F.col(f"`{c}`") for c in names))
    # an input column has the name of a statistic: keep it aside under another name
    aside = {c: f"kept_aside_{i}" for i, c in enumerate(names)}
    renamed = wide.select(*(F.col(f"`{c}`").alias(aside[c]) for c in names), *(F.col(f"`{p}`").alias(s) for p, s in zip(put, STATS, strict=True)))
    return renamed.where(~base_failed() & verdict(rules)).select(*(F.col(aside[c]).alias(c) for c in names))


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return judge(docs, labels)


def quality_base(spark, sf_dir: str) -> DataFrame:
    """The columns of op4 that SQL can express."""
    found = text_stats(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("base_failed", base_failed())
    return found.select("doc_id", *STATS[:5], "base_failed")


BASE_SQL = r"""
with w as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), grams as (
  select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w where len(w) > 2)
), many as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as n from grams) where n > 1
), repeats as (
  select doc_id, count(distinct i + k) as n from many, range(3) t(k) group by doc_id
), s as (
  select w.doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as lines, coalesce(n, 0) as n_repeat_words from w left join repeats using (doc_id)
)
select doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from s
"""
