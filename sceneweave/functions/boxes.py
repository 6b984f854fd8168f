"""Boxes: parsing, scaling and overlap. A box is struct<x1, y1, x2, y2: double>, or null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUM = r"(-?\d+(?:\.\d+)?)"
# The textual forms of a box, in order of preference.
BOX_FORMS = [
    rf"<\|box_start\|>\s*\(\s*{NUM}\s*,\s*{NUM}\s*\)\s*,?\s*\(\s*{NUM}\s*,\s*{NUM}\s*\)\s*<\|box_end\|>",
    rf"\{{\s*<\s*{NUM}\s*>\s*<\s*{NUM}\s*>\s*<\s*{NUM}\s*>\s*<\s*{NUM}\s*>\s*\}}",
    rf'"bbox(?:_2d)?"\s*:\s*\[\s*{NUM}\s*,\s*{NUM}\s*,\s*{NUM}\s*,\s*{NUM}\s*\]',
    rf"\[\s*{NUM}\s*,\s*{NUM}\s*,\s*{NUM}\s*,\s*{NUM}\s*\]",
    rf"\(\s*{NUM}\s*,\s*{NUM}\s*\)\s*,\s*\(\s*{NUM}\s*,\s*{NUM}\s*\)",
]
PUBLISHED_BOX = r"\[\s*([-+0-9.eE]+)\s+([-+0-9.eE]+)\s*,\s*([-+0-9.eE]+)\s+([-+0-9.eE]+)\s*\]"
SIDES = ("x1", "y1", "x2", "y2")


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(*[v.cast("double").alias(k) for k, v in zip(SIDES, (x1, y1, x2, y2), strict=True)])


def parts(b: Column) -> list[Column]:
    return [b[k] for k in SIDES]


def clamp(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def rescale(values: list[Column], scale: str = "auto", width: Column | None = None, height: Column | None = None) -> list[Column]:
    """Coordinates in the unit square. ``auto`` goes by the largest one; ``pixel`` without a size gives nulls."""
    if scale in ("unit", "percent", "milli"):
        return [v / {"unit": 1.0, "percent": 100.0, "milli": 1000.0}[scale] for v in values]
    sides = [width, height, width, height]
    by_size = [F.lit(None).cast("double") if s is None else F.try_divide(v, s.cast("double")) for v, s in zip(values, sides, strict=True)]
    if scale == "pixel":
        return by_size
    peak = F.greatest(*values)
    return [
        F.when(peak <= 1.0, v).when(peak <= 100.0, v / 100.0).when(peak <= 1000.0, v / 1000.0).when(s.isNotNull(), s).otherwise(F.try_divide(v, peak))
        for v, s in zip(values, by_size, strict=True)
    ]


def raw_numbers(text: Column) -> Column:
    """The four numbers of the first box form that the text has, else its first four numbers; null if fewer."""
    found = [F.when(F.regexp_like(text, F.lit(form)), F.array(*[F.regexp_extract(text, form, g).cast("double") for g in (1, 2, 3, 4)])) for form in BOX_FORMS]
    numbers = F.regexp_extract_all(text, F.lit(NUM), F.lit(1))
    loose = F.when(F.size(numbers) >= 4, F.transform(F.slice(numbers, 1, 4), lambda x: x.cast("double")))
    return F.coalesce(*found, loose)


def parse_bbox(text: Column, scale: str = "auto", width: Column | None = None, height: Column | None = None) -> Column:
    """The first box in a reply: scaled, clamped, corners in order; null if there is none or it has no area."""
    raw = raw_numbers(text)
    x1, y1, x2, y2 = (clamp(v) for v in rescale([F.get(raw, F.lit(i)) for i in range(4)], scale, width, height))
    left, right, top, bottom = F.least(x1, x2), F.greatest(x1, x2), F.least(y1, y2), F.greatest(y1, y2)
    return F.when(raw.isNotNull() & (right > left) & (bottom > top), box(left, top, right, bottom))


def xywh_to_xyxy(x: Column, y: Column, w: Column, h: Column) -> list[Column]:
    return [x, y, x + w, y + h]


def normalize_box(values: list[Column], scale: str = "auto", width: Column | None = None, height: Column | None = None, xywh: bool = False) -> Column:
    """A gold box in the unit square. Inverted boxes are null; clamping comes after, so a box can lose its area."""
    x1, y1, x2, y2 = rescale(xywh_to_xyxy(*values) if xywh else values, scale, width, height)
    return F.when((x2 > x1) & (y2 > y1), box(clamp(x1), clamp(y1), clamp(x2), clamp(y2)))


def coerce_box(text: Column) -> Column:
    """The first four numbers of a list or its text, as array<double>; null if there are fewer."""
    numbers = F.regexp_extract_all(text, F.lit(NUM), F.lit(1))
    return F.when(F.size(numbers) >= 4, F.transform(F.slice(numbers, 1, 4), lambda x: x.cast("double")))


def parse_published_box(text: Column) -> Column:
    """``[x1 y1, x2 y2]`` with unit numbers, corners in order; null if there is none."""
    x1, y1, x2, y2 = (F.regexp_extract(text, PUBLISHED_BOX, g).try_cast("double") for g in (1, 2, 3, 4))
    whole = x1.isNotNull() & y1.isNotNull() & x2.isNotNull() & y2.isNotNull()
    return F.when(whole, box(F.least(x1, x2), F.least(y1, y2), F.greatest(x1, x2), F.greatest(y1, y2)))


def milli_box(b: Column) -> Column:
    """``[x1, y1, x2, y2]`` as text on a grid of 0 to 1000, halves to even."""
    return F.concat(F.lit("["), F.concat_ws(", ", *[F.bround(clamp(v) * 1000).cast("long").cast("string") for v in parts(b)]), F.lit("]"))


def iou(a: Column, b: Column, missing: float | None = 0.0) -> Column:
    """Intersection over union; ``missing`` where a box is null."""
    (ax1, ay1, ax2, ay2), (bx1, by1, bx2, by2) = parts(a), parts(b)
    w, h = F.least(ax2, bx2) - F.greatest(ax1, bx1), F.least(ay2, by2) - F.greatest(ay1, by1)
    union = (ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - w * h
    value = F.when((w > 0) & (h > 0) & (union > 0), w * h / union).otherwise(0.0)
    return F.when(a.isNull() | b.isNull(), F.lit(missing).cast("double")).otherwise(value)
