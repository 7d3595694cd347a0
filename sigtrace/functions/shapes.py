"""Shape metrics, size classes and symbol-body expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import _lit, l1, round_even


def shape_metrics(w: Column, h: Column, area: Column) -> Column:
    return F.struct(
        round_even(F.greatest(w, h) / F.least(w, h), 2).alias("aspect"),
        round_even(area / (w * h), 2).alias("rectangularity"))


def circularity(area: Column, perimeter: Column) -> Column:
    return round_even(F.lit(4 * math.pi) * area / (perimeter * perimeter), 3)


# Lowest areas of board rectangles (the huge ones lie above theirs), aspects and
# share of the board.
HUGE_AREA, LARGE_AREA, MIDDLE_AREA, SMALL_AREA = 50000, 5000, 1000, 300
SLENDER, SQUAT = 4, 3
BOARD_SHARE = 0.5


def classify_rect(area: Column, aspect: Column, fill: Column, board_area) -> Column:
    """Part class of a board rectangle by its size, aspect and how much of its box it fills."""
    large = (area >= LARGE_AREA) & (area <= HUGE_AREA)
    middle = (area >= MIDDLE_AREA) & (area < LARGE_AREA)
    small = (area >= SMALL_AREA) & (area < MIDDLE_AREA)
    slender, squat = aspect >= SLENDER, aspect < SQUAT
    return (F.when(area > _lit(board_area) * BOARD_SHARE, "board")
            .when((area >= LARGE_AREA) & ~slender & (fill > 0.85), "ic")
            .when(slender & ((large & (fill > 0.7)) | (middle & (fill > 0.6))), "resistor")
            .when(squat & large & (fill > 0.8), "inductor")
            .when(squat & middle & (fill > 0.75), "capacitor")
            .when(~squat & small, "trace_segment")
            .when(area > HUGE_AREA, "large_passive").when(large, "medium_passive")
            .when(middle, "small_passive").when(small, "tiny_passive").otherwise("unknown"))


# Fixed value: area above which a middle-sized circle is a crystal.
CRYSTAL_AREA = 3000


def classify_circle(diameter: Column, area: Column) -> Column:
    return (F.when(diameter < 15, "via")
            .when(diameter < 30, "test_point")
            .when((diameter < 80) & (area > CRYSTAL_AREA), "crystal")
            .when(diameter < 80, "inductor_round")
            .when(diameter < 150, "capacitor_elec")
            .when(diameter >= 150, "large_circle")
            .otherwise("unknown"))


def gap_class(gap: Column) -> Column:
    return F.when(gap > 100, "ic").when(gap > 60, "mid").otherwise("small")


def boundary(body: Column) -> Column:
    """Smallest enclosing circle or rectangle of a symbol body.

    ``body`` is a struct ``kind, cx, cy, r, x, y, w, h, gap, len``; the result
    is a struct ``kind, cx, cy, r, x, y, w, h`` and null for unknown kinds.
    """
    def edge(kind, **values):
        names = ("cx", "cy", "r", "x", "y", "w", "h")
        return F.struct(F.lit(kind).alias("kind"), *[
            (values[n] if n in values else F.lit(None)).cast("double").alias(n) for n in names])

    def centred(w, h):
        return edge("rect", x=body["cx"] - F.floor(w / 2), y=body["cy"] - F.floor(h / 2), w=w, h=h)

    def at_least(name, low, default):
        return F.greatest(F.lit(low), F.coalesce(body[name], F.lit(default)))

    kind = body["kind"]
    return (F.when(kind == "circle", edge("circle", cx=body["cx"], cy=body["cy"], r=body["r"]))
            .when(kind == "rect", edge("rect", x=body["x"], y=body["y"], w=body["w"], h=body["h"]))
            .when(kind == "cap", centred(at_least("len", 6, 18), at_least("gap", 4, 12)))
            .when(kind == "line", centred(F.lit(20), F.lit(20)))
            .when(kind == "diode", centred(at_least("w", 8, 0), at_least("h", 8, 0))))


def body_size(body: Column) -> Column:
    """Width and height of a body; lines have none."""
    def size(w, h):
        return F.struct(w.cast("double").alias("w"), h.cast("double").alias("h"))

    kind, zero = body["kind"], F.lit(0)
    known = (F.when(kind == "circle", size(body["r"] * 2, body["r"] * 2))
             .when(kind == "rect", size(body["w"], body["h"]))
             .when(kind == "cap", size(F.coalesce(body["len"], zero), F.coalesce(body["gap"], zero)))
             .when(kind == "diode", size(F.coalesce(body["w"], zero), F.coalesce(body["h"], zero))))
    return known


def body_contains(x: Column, y: Column, body: Column, pad=4) -> Column:
    """Whether a point lies in a body: exact for closed shapes, near for open ones."""
    kind, pad = body["kind"], _lit(pad)
    dx, dy, reach = x - body["cx"], y - body["cy"], body["r"] + pad

    def within(left, top, w, h):
        return x.between(left - pad, left + w + pad) & y.between(top - pad, top + h + pad)

    wide = F.greatest(F.lit(8), F.coalesce(body["w"], F.lit(0)))
    tall = F.greatest(F.lit(8), F.coalesce(body["h"], F.lit(0)))
    return (F.when(kind == "circle", dx * dx + dy * dy <= reach * reach)
            .when(kind == "rect", within(body["x"], body["y"], body["w"], body["h"]))
            .when(kind == "diode", within(body["cx"] - F.floor(wide / 2), body["cy"] - F.floor(tall / 2), wide, tall))
            .when(kind.isin("cap", "line"), l1(x, y, body["cx"], body["cy"]) <= 20))


def body_centre(body: Column) -> Column:
    """Centre of a body; rectangles get it from their corner and size."""
    rect = body["kind"] == "rect"
    return F.struct(
        F.when(rect, body["x"] + body["w"] / 2).otherwise(body["cx"].cast("double")).alias("x"),
        F.when(rect, body["y"] + body["h"] / 2).otherwise(body["cy"].cast("double")).alias("y"))


def size_deviation(w: Column, h: Column, typical_w: Column, typical_h: Column) -> Column:
    return F.when((typical_w != 0) & (typical_h != 0), F.greatest(
        F.abs(1 - w / typical_w), F.abs(1 - h / typical_h)))


def size_check(w: Column, h: Column, typical_w: Column, typical_h: Column, tol=0.6) -> Column:
    """Struct ``ok, dev``: both ratios within the tolerance, else the larger deviation."""
    ratio_w, ratio_h = w / typical_w, h / typical_h
    low, high = 1 - tol, 1 + tol
    defined = (typical_w != 0) & (typical_h != 0) & w.isNotNull() & h.isNotNull()
    ok = ratio_w.between(low, high) & ratio_h.between(low, high)
    return F.when(defined, F.struct(
        ok.alias("ok"),
        F.when(~ok, size_deviation(w, h, typical_w, typical_h)).alias("dev")))


# Penalty weights of a two-plate candidate.
GAP_PENALTY, LEAD_PENALTY, TOUCH_PENALTY = 120, 60, 40


def penalty_score(distance: Column, gap_empty: Column, leads: Column, touches: Column,
                  weights=(GAP_PENALTY, LEAD_PENALTY, TOUCH_PENALTY)) -> Column:
    """Distance plus one weight per failed condition."""
    score = distance
    for passed, weight in zip((gap_empty, leads, touches), weights):
        score = score + F.when(passed, 0).otherwise(weight)
    return score
