"""Numbers: rounding as Python and JavaScript round, percentages, sampling by hash, boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_round(x, places: int) -> Column:
    """Python's round(x, places): half to even on the exact binary value; infinities and NaN stay."""
    shape = "0." + "0" * places if places else "0"
    finite = F.abs(_c(x).cast("double")) < F.lit(float("inf"))
    rounded = F.regexp_replace(F.call_function("format_number", F.when(finite, _c(x)), F.lit(shape)), ",", "").try_cast("double")
    return F.when(finite, rounded).otherwise(_c(x).cast("double"))


def scaled_round(x, places: int) -> Column:
    """As SQL engines round that scale, round half away from zero and scale back: what counts is the scaled value in double precision, not the decimal digits."""
    return F.round(_c(x).cast("double") * F.lit(10.0**places), 0) / F.lit(10.0**places)


def round_int(x) -> Column:
    """Python's round(x) to an integer, half to even."""
    return F.rint(_c(x)).cast("long")


def js_round(x) -> Column:
    """JavaScript's Math.round: half up."""
    return F.floor(_c(x) + F.lit(0.5)).cast("long")


def ratio(part, whole) -> Column:
    """part / whole, 0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(_c(part).cast("double"), _c(whole).cast("double")), F.lit(0.0))


def percent(part, whole) -> Column:
    return F.coalesce(F.try_divide(_c(part) * F.lit(100.0), _c(whole).cast("double")), F.lit(0.0))


def clamp(x, low, high) -> Column:
    """x between low and high; null stays null (greatest and least would skip it)."""
    return F.when(_c(x).isNotNull(), F.least(F.greatest(_c(x), F.lit(low)), high if isinstance(high, Column) else F.lit(high)))


def hash32(key: Column) -> Column:
    """First 32 bits of md5, as a number: the same in every engine that has md5."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def hash_sample(key: Column, rate: float) -> Column:
    """A reproducible sample of about ``rate`` of the keys."""
    return hash32(key) % 10_000 < int(round(rate * 10_000))


def scaled_size(width, height, most: int = 1600) -> tuple[Column, Column]:
    """Width and height after fitting both within ``most``, never below 1, whole numbers cut off."""
    scale = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(_c(width), _c(height)))
    fit = lambda v: F.when(scale < 1, F.greatest(F.lit(1), (_c(v) * scale).cast("int"))).otherwise(_c(v).cast("int"))
    return fit(width), fit(height)


def crop_box(x0, y0, x1, y1, width, height, padding: int = 4) -> Column:
    """Box rounded, padded and cut to the image."""
    r = lambda v: F.rint(_c(v)).cast("int")
    return F.struct(
        F.greatest(F.lit(0), r(x0) - padding).alias("left"), F.greatest(F.lit(0), r(y0) - padding).alias("top"),
        F.least(_c(width), r(x1) + padding).alias("right"), F.least(_c(height), r(y1) + padding).alias("bottom"),
    )


def overlay(x0, y0, x1, y1, width, height) -> Column:
    """Box in percent of the page; a missing page size counts as 1, no side is thinner than 0.5."""
    w, h = (F.coalesce(F.nullif(_c(v), F.lit(0)), F.lit(1)).cast("double") for v in (width, height))
    part = lambda v, whole, low: F.greatest(F.lit(low), v / whole * 100)
    return F.struct(
        part(_c(x0), w, 0.0).alias("left"), part(_c(y0), h, 0.0).alias("top"),
        part(_c(x1) - _c(x0), w, 0.5).alias("width"), part(_c(y1) - _c(y0), h, 0.5).alias("height"),
    )


def overlap_ratio(a0, a1, b0, b1) -> Column:
    """Vertical overlap of two spans over the lower of their heights, heights at least 1."""
    height = lambda lo, hi: F.greatest(F.lit(1.0), _c(hi) - _c(lo))
    both = F.greatest(F.lit(0.0), F.least(_c(a1), _c(b1)) - F.greatest(_c(a0), _c(b0)))
    return both / F.least(height(a0, a1), height(b0, b1))


def line_height(y0, y1) -> Column:
    return F.greatest(F.lit(1.0), _c(y1) - _c(y0))


def polygon_box(points) -> Column:
    """array<array<double>> of corners to [x0, y0, x1, y1]."""
    xs, ys = F.transform(_c(points), lambda p: p[0]), F.transform(_c(points), lambda p: p[1])
    return F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def sample_positions(n, k: int) -> Column:
    """Evenly spread positions among n, ends included: distinct and sorted; one sample is the first."""
    n = _c(n)
    if k == 1:
        return F.when(n <= 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(0)))
    spread = F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda p: F.rint(p * (n - 1) / F.lit(k - 1)).cast("int"))))
    return F.when(n <= 0, F.array().cast("array<int>")).when(n <= k, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(spread)


def softmax(logits) -> Column:
    """Softmax of an array<double>, shifted by its maximum."""
    x = _c(logits)
    e = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))
