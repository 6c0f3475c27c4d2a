"""Reading order of the lines of a page, from their boxes alone.

Lines go from top to bottom into the first region whose left edge is near; regions then go from left
to right.  The fold depends on its order, so it's an aggregate over the sorted lines of one page,
inside the JVM; pages are independent of each other.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from spindrift.functions.numeric import line_height
from spindrift.functions.text import _normal

GAP_HEIGHTS = 2.5


def upper_median(values):
    """The middle value, the upper of two, of an array that isn't empty."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def reading_order(lines: DataFrame, page: str = "page_id", pos: str = "pos") -> DataFrame:
    """lines(page, pos, x0, y0, x1, y1) with region_order from 1, line_order from 0 and the region's box."""
    box = [F.col(c).cast("double").alias(c) for c in ("y0", "x0", "x1", "y1")]
    held = lines.groupBy(page).agg(
        F.array_sort(F.collect_list(F.struct(box[0], box[1], F.col(pos).alias("p"), box[2], box[3]))).alias("l"),
        (upper_median(F.collect_list(line_height("y0", "y1").cast("double"))) * GAP_HEIGHTS).alias("gap"),
    )
    state = F.struct(F.array().cast("array<double>").alias("edge"), F.array().cast("array<int>").alias("region"))

    def put(s, x):
        near = F.array_position(F.transform(s["edge"], lambda e: F.abs(x["x0"] - e) <= F.col("gap")), True).cast("int")
        grown = F.transform(s["edge"], lambda e, i: F.when(i == near - 1, F.least(e, x["x0"])).otherwise(e))
        return F.struct(
            F.when(near > 0, grown).otherwise(F.concat(s["edge"], F.array(x["x0"]))).alias("edge"),
            F.concat(s["region"], F.array(F.when(near > 0, near).otherwise(F.size(s["edge"]) + 1))).alias("region"),
        )

    folded = held.withColumn("r", F.aggregate("l", state, put)["region"])
    flat = folded.select(page, F.explode(F.arrays_zip("l", "r")).alias("z")).select(page, F.col("z.l.p").alias(pos), *(F.col(f"z.l.{c}").alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")), F.col("z.r").alias("_made"))
    regions = flat.groupBy(page, "_made").agg(F.min("_x0").alias("region_x0"), F.min("_y0").alias("region_y0"), F.max("_x1").alias("region_x1"), F.max("_y1").alias("region_y1"))
    regions = regions.withColumn("region_order", F.row_number().over(Window.partitionBy(page).orderBy("region_x0", "region_y0", "_made")))
    placed = flat.join(regions, [page, "_made"]).withColumn("line_order", F.row_number().over(Window.partitionBy(page).orderBy("region_order", "_y0", "_x0", pos)) - 1)
    kept = [c for c in lines.columns if c not in ("region_order", "line_order", "region_x0", "region_y0", "region_x1", "region_y1")]
    return lines.select(*kept).join(placed.drop("_made", "_x0", "_y0", "_x1", "_y1"), [page, pos])


def reading_order_by_page(lines: DataFrame, page: str = "page_id", pos: str = "pos") -> DataFrame:
    """(page, lines) with the whole laid-out page as one array in reading order."""
    keys = ("line_order", "region_order", pos, "x0", "y0", "x1", "y1")
    return reading_order(lines, page, pos).groupBy(page).agg(F.array_sort(F.collect_list(F.struct(*keys))).alias("lines"))


#: Pages that are Python objects at once.
PAGES = 256
_PLACED = pa.list_(pa.struct([
    ("pos", pa.int32()), ("text", pa.string()), ("confidence", pa.float64()), ("bbox", pa.list_(pa.float64())), ("engine", pa.string()),
    ("region_order", pa.int32()), ("line_order", pa.int32()), *((c, pa.float64()) for c in ("region_x0", "region_y0", "region_x1", "region_y1")),
]))


def _rank(v: float | None) -> tuple:
    """Sorts as Spark does: null, numbers, NaN."""
    return (0, 0.0) if v is None else (2, 0.0) if v != v else (1, v)


def _placed(boxes: list) -> list[tuple]:
    """reading_order of one page's boxes, as (pos, region_order, line_order, the region's box) by line_order."""
    sides = [tuple(b[i] if b is not None and i < len(b) else None for i in range(4)) for b in boxes]
    if not sides:
        return []
    order = sorted(range(len(sides)), key=lambda i: (_rank(sides[i][1]), _rank(sides[i][0]), i))
    heights = [1.0 if y0 is None or y1 is None else max(1.0, y1 - y0, key=_rank) for _, y0, _, y1 in sides]
    gap = sorted(heights, key=_rank)[len(heights) // 2] * GAP_HEIGHTS
    edges: list[float | None] = []
    members: list[list[int]] = []
    for i in order:
        x0 = sides[i][0]
        near = next((r for r, e in enumerate(edges) if x0 is not None and e is not None and (gap != gap or abs(x0 - e) <= gap)), None)
        if near is None:
            edges.append(x0)
            members.append([i])
        else:
            edges[near] = min(edges[near], x0, key=_rank)
            members[near].append(i)
    made = [tuple(f((v for i in m if (v := sides[i][c]) is not None), key=_rank, default=None) for c, f in enumerate((min, min, max, max))) for m in members]
    out = []
    for r, at in enumerate(sorted(range(len(made)), key=lambda r: (_rank(made[r][0]), _rank(made[r][1]), r))):
        # a region's lines came from top to bottom and left to right
        out += [(i, r + 1, len(out) + n, *made[at]) for n, i in enumerate(members[at])]
    return out


def _finished(lines: list[dict | None] | None) -> list[tuple] | None:
    if lines is None:
        return None
    kept = [(t, x["confidence"], x["bbox"], x["engine"]) for x in lines if x is not None and (t := _normal(x["text"]))]
    return [(pos, *kept[pos], *place) for pos, *place in _placed([x[2] for x in kept])]


@F.arrow_udf(from_arrow_type(_PLACED))
def _placed_lines(lines: pa.Array) -> pa.Array:
    names = [f.name for f in _PLACED.value_type]
    parts = []
    for at in range(0, len(lines), PAGES):
        pages = map(_finished, lines[at : at + PAGES].to_pylist())
        parts.append(pa.array([None if page is None else [dict(zip(names, x, strict=True)) for x in page] for page in pages], _PLACED))
    return pa.concat_arrays(parts) if parts else pa.array([], _PLACED)


def placed_lines(lines: Column) -> Column:
    """clean_lines and reading_order inside the row, where a page's OCR lines stand together: an array by line_order.

    Each has its place among the clean lines as pos, text, confidence, bbox, engine, region_order, line_order and the region's box.
    """
    return _placed_lines(F.transform(lines, lambda x: F.struct(*(x[f].cast(t).alias(f) for f, t in (("text", "string"), ("confidence", "double"), ("bbox", "array<double>"), ("engine", "string"))))))
