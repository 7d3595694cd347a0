"""Coordinate and shape expressions; every function maps Columns to a Column.

A point is ``STRUCT<x,y>``, a polygon ``ARRAY<STRUCT<x,y>>`` and a box
``STRUCT<x0,y0,x1,y1>``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _lit(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def round_even(value: Column, digits: int = 0) -> Column:
    """Round halves to the even neighbour, as scientific tools do."""
    return F.rint(value * 10.0 ** digits) / 10.0 ** digits


def point(x, y) -> Column:
    return F.struct(_lit(x).alias("x"), _lit(y).alias("y"))


def box(x0, y0, x1, y1) -> Column:
    return F.struct(_lit(x0).alias("x0"), _lit(y0).alias("y0"),
                    _lit(x1).alias("x1"), _lit(y1).alias("y1"))


def rescale(pt: Column, src_dpi, tgt_dpi) -> Column:
    """Move a point between dpi spaces; spaces are scaled, never added."""
    ratio = _lit(tgt_dpi) / _lit(src_dpi)
    return point(pt["x"] * ratio, pt["y"] * ratio)


def rescale_polygon(polygon: Column, src_dpi, tgt_dpi) -> Column:
    return F.transform(polygon, lambda p: rescale(p, src_dpi, tgt_dpi))


def px_to_inch(pt: Column, dpi) -> Column:
    return point(pt["x"] / _lit(dpi), pt["y"] / _lit(dpi))


def px_to_pt(pt: Column, dpi) -> Column:
    return point(pt["x"] / _lit(dpi) * 72, pt["y"] / _lit(dpi) * 72)


def mirror_x(x: Column, centre, view: Column) -> Column:
    """Bottom-side x seen from the top; other views stay as they are."""
    return F.when(view == "bot", _lit(centre) * 2 - x).otherwise(x)


def unrotate(polygon: Column, rot: Column, width, height) -> Column:
    """Undo the rotation a crop had when it was read."""
    return F.transform(polygon, lambda p: (
        F.when(rot == 90, point(p["y"], _lit(height) - 1 - p["x"]))
        .when(rot == 270, point(_lit(width) - 1 - p["y"], p["x"]))
        .otherwise(point(p["x"], p["y"]))))


def crop_to_board(polygon: Column, origin_x, origin_y) -> Column:
    moved = F.transform(polygon, lambda p: point(p["x"] + _lit(origin_x), p["y"] + _lit(origin_y)))
    return F.when(F.size(polygon) >= 4, moved)


def _axis(polygon: Column, axis: str) -> Column:
    return F.transform(polygon, lambda p: p[axis])


def _axis_sum(polygon: Column, axis: str) -> Column:
    return F.aggregate(_axis(polygon, axis), F.lit(0.0), lambda s, v: s + v)


def box_center(polygon: Column) -> Column:
    """Mean of the four corners, rounded half to even."""
    return F.when(polygon.isNotNull(), point(
        F.bround(_axis_sum(polygon, "x") / 4, 0).cast("long"),
        F.bround(_axis_sum(polygon, "y") / 4, 0).cast("long")))


def box_bounds(polygon: Column) -> Column:
    xs, ys = _axis(polygon, "x"), _axis(polygon, "y")
    return box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def in_bounds(x: Column, y: Column, bounds: Column, pad=0) -> Column:
    pad = _lit(pad)
    return (x.between(bounds["x0"] - pad, bounds["x1"] + pad)
            & y.between(bounds["y0"] - pad, bounds["y1"] + pad))


def in_box(x: Column, y: Column, polygon: Column, pad=0) -> Column:
    """Point within the bounds of a polygon, edges included; no polygon, no hit."""
    inside = in_bounds(x, y, box_bounds(polygon), pad)
    return F.coalesce((F.size(polygon) > 0) & inside, F.lit(False))


def pad_bbox(bbox: Column, pad, width, height) -> Column:
    """Grow a box by one pad for all sides, as far as the nearest image edge allows."""
    room = F.least(_lit(pad), bbox["x0"], bbox["y0"],
                   _lit(width) - bbox["x1"], _lit(height) - bbox["y1"])
    grow = F.greatest(F.lit(0), room)
    return box(F.greatest(F.lit(0), bbox["x0"] - grow), F.greatest(F.lit(0), bbox["y0"] - grow),
               F.least(_lit(width), bbox["x1"] + grow), F.least(_lit(height), bbox["y1"] + grow))


def scale_bbox(bbox: Column, scale, width, height) -> Column:
    """Scale a half-open box around its centre and clamp it to the image."""
    grow_x = F.floor((bbox["x1"] - bbox["x0"]) * (_lit(scale) - 1) / 2)
    grow_y = F.floor((bbox["y1"] - bbox["y0"]) * (_lit(scale) - 1) / 2)
    return box(F.greatest(F.lit(0), bbox["x0"] - grow_x), F.greatest(F.lit(0), bbox["y0"] - grow_y),
               F.least(_lit(width), bbox["x1"] + grow_x), F.least(_lit(height), bbox["y1"] + grow_y))


def l1(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.abs(x1 - x2) + F.abs(y1 - y2)


def euclid(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def route_length(points: Column) -> Column:
    """Sum of Manhattan steps along a polyline."""
    steps = F.zip_with(
        F.slice(points, 1, F.size(points) - 1), F.slice(points, 2, F.size(points) - 1),
        lambda a, b: F.abs(b["x"] - a["x"]) + F.abs(b["y"] - a["y"]))
    zero = F.lit(0).cast("double")
    return F.when(F.size(points) > 1, F.aggregate(steps, zero, lambda s, v: s + v)).otherwise(zero)


def segment_class(dx1: Column, dy1: Column, dx2: Column, dy2: Column) -> Column:
    """Corner, slant or straight, from the directions at both ends of a stroke."""
    first, second = F.degrees(F.atan2(dy1, dx1)), F.degrees(F.atan2(dy2, dx2))
    turn = F.abs(first - second) % 180
    turn = F.least(turn, 180 - turn)
    slope = F.abs(first)
    slope = F.least(slope, 180 - slope)
    return (F.when(turn.between(60, 120), "L")
            .when(slope.between(10, 80), "tilt")
            .otherwise("straight"))


LABEL_MARGIN = 60
LABEL_OFFSET = 10


def keepout(name: Column, x: Column, y: Column, lpos: Column, font=36) -> Column:
    """Rectangle a label occupies; the two letters of ``lpos`` pick row and column."""
    font = _lit(font)
    width = F.length(name) * font * 0.6 + LABEL_MARGIN
    height = font + F.lit(LABEL_MARGIN)
    place = F.when(lpos.isin("u", "d", "l", "r", "ul", "ur", "dl", "dr"), lpos).otherwise("ur")
    left = (F.when(place.isin("l", "ul", "dl"), x - width - LABEL_OFFSET)
            .when(place.isin("r", "ur", "dr"), x + LABEL_OFFSET)
            .otherwise(x - width / 2))
    top = (F.when(place.isin("u", "ul", "ur"), y - height - LABEL_OFFSET)
           .when(place.isin("d", "dl", "dr"), y + LABEL_OFFSET)
           .otherwise(y - height / 2))
    return box(left, top, left + width, top + height)
