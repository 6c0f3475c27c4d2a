"""Image quality from luminance, as an Arrow function; decoding is injected."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, StructField, StructType

SHARP_ABOVE = 60.0
CONTRAST_ABOVE = 35.0

_MEASURES = StructType([StructField("laplacian_variance", DoubleType()), StructField("luminance_deviation", DoubleType())])
_PIXELS = StructType([StructField("width", IntegerType()), StructField("height", IntegerType()), StructField("luminance", BinaryType())])


def _measure(raw: bytes | None, width: int, height: int) -> tuple[float | None, float | None]:
    if raw is None or not width or not height or len(raw) != width * height:
        return None, None
    x = np.frombuffer(raw, dtype=np.uint8).reshape(height, width).astype(np.float64)
    # edges mirrored around the outermost pixel; a side of one pixel has nothing to mirror
    p = np.pad(x, 1, mode="reflect") if min(x.shape) > 1 else np.pad(x, 1, mode="edge")
    laplacian = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * x
    return float(laplacian.var()), float(x.std())


@F.pandas_udf(_MEASURES)
def measures(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for raw, width, height in parts:
        yield pd.DataFrame([_measure(r, int(w), int(h)) for r, w, h in zip(raw, width, height, strict=True)], columns=["laplacian_variance", "luminance_deviation"])


def quality(luminance: Column, width: Column, height: Column) -> Column:
    """struct(blur_score, contrast_score, is_sharp, is_contrast_sufficient, warnings) of 8-bit luminance, row by row."""
    from spindrift.functions.numeric import py_round

    m = measures(luminance, width, height)
    blur, contrast = py_round(m["laplacian_variance"], 2), py_round(m["luminance_deviation"], 2)
    warnings = F.filter(
        F.array(F.when(blur <= SHARP_ABOVE, F.concat(F.lit("blurred: "), blur.cast("string"))), F.when(contrast <= CONTRAST_ABOVE, F.concat(F.lit("low contrast: "), contrast.cast("string")))), lambda w: w.isNotNull()
    )
    return F.struct(blur.alias("blur_score"), contrast.alias("contrast_score"), (blur > SHARP_ABOVE).alias("is_sharp"), (contrast > CONTRAST_ABOVE).alias("is_contrast_sufficient"), warnings.alias("warnings"))


_loaded: dict[tuple, object] = {}


def per_worker(factory: Callable, *key):
    """What factory(*key) gives, made once in a Python worker for each factory, told by its code and what it holds, and key (say, a language and a model)."""
    name = (hashlib.md5(cloudpickle.dumps(factory)).digest(), *key)
    if name not in _loaded:
        _loaded[name] = factory(*key)
    return _loaded[name]


def decoder(factory: Callable[[], Callable[[bytes], tuple[int, int, bytes]]]):
    """Column function: image file -> struct(width, height, luminance), by a decoder that is loaded once per worker."""

    @F.pandas_udf(_PIXELS)
    def decode(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        engine = per_worker(factory)
        for files in parts:
            yield pd.DataFrame([engine(f) if f is not None else (None, None, None) for f in files], columns=["width", "height", "luminance"])

    return decode


def transformer(factory: Callable[[], Callable[[bytes], bytes]]):
    """Column function: image file -> image file (thumbnail, contrast enhancement, crop), engine injected."""

    @F.pandas_udf(BinaryType())
    def change(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        engine = per_worker(factory)
        for files in parts:
            yield pd.Series([None if f is None else engine(f) for f in files], dtype=object)

    return change


def prepared(file: Column, orient: Callable[[Column], Column], shrink: Callable[[Column], Column], thumbnail: Callable[[Column], Column]) -> Column:
    """struct(image, thumbnail): a file turned upright and made small enough to read, and its small picture, by injected engines."""
    upright = orient(file)
    return F.struct(shrink(upright).alias("image"), thumbnail(upright).alias("thumbnail"))


def cropper(factory: Callable[[], Callable[[bytes, int, int, int, int], bytes]]):
    """Column function (image, box) -> crop as an image file; a null image has none."""

    @F.pandas_udf(BinaryType())
    def crop(parts: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.Series]:
        engine = per_worker(factory)
        for images, boxes in parts:
            sides = zip(images, *(boxes[c] for c in ("left", "top", "right", "bottom")), strict=True)
            yield pd.Series([None if i is None else engine(i, int(a), int(b), int(c), int(d)) for i, a, b, c, d in sides], dtype=object)

    return crop
