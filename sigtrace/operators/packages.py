"""Packages from pin numbers and from recognised crops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import greedy_matching
from .ordered import first_per
from .spatial import near_pairs

ROW_DY, ROW_DX = 14, (20, 320)
EDGE_TOL, EDGE_DY = 30, 25
BODY_PAD = 12


def row_pairs(words: DataFrame, dy: float = ROW_DY, dx=ROW_DX) -> DataFrame:
    """Two pin numbers on one row, left one first.

    ``words``: page_id, ord, x, y, pin.  Rows are thin, so the grid is squeezed to the
    reach of a row in height as well.
    """
    squeeze = dx[1] / dy
    a = words.select("page_id", *[F.col(c).alias(f"a_{c}") for c in ("ord", "x", "y", "pin")])
    b = words.select("page_id", *[F.col(c).alias(f"b_{c}") for c in ("ord", "x", "y", "pin")])
    a = a.withColumn("_ay", F.col("a_y") * squeeze)
    b = b.withColumn("_by", F.col("b_y") * squeeze)
    step = F.abs(F.col("b_x") - F.col("a_x"))
    fits = ((F.col("a_ord") < F.col("b_ord")) & (F.abs(F.col("a_y") - F.col("b_y")) < dy)
            & (step > dx[0]) & (step < dx[1]))
    pairs = near_pairs(a, b, dx[1], ["page_id"], ("a_x", "_ay"), ("b_x", "_by"), where=fits)
    a_left = F.col("a_x") < F.col("b_x")

    def side(first: bool):
        take = a_left if first else ~a_left
        pick = lambda c: F.when(take, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}"))
        return F.struct(F.bround(pick("x"), 0).cast("long").alias("x"), F.bround(pick("y"), 0).cast("long").alias("y"),
                        pick("pin").alias("pin"))

    return pairs.select("page_id", F.struct("a_ord", "b_ord").alias("pair"), side(True).alias("left"),
                        side(False).alias("right"))


def edge_pairs(pairs: DataFrame, tol: float = EDGE_TOL, min_dy: float = EDGE_DY) -> DataFrame:
    """Row pairs that can be opposite edges of one package, as ``i, j`` in input order."""
    a = pairs.select("page_id", F.col("pair").alias("i"), F.col("left.x").alias("x"), F.col("right.x").alias("y"),
                     F.col("left.y").alias("ya"))
    b = pairs.select("page_id", F.col("pair").alias("j"), F.col("left.x").alias("rx"), F.col("right.x").alias("ry"),
                     F.col("left.y").alias("yb"))
    fits = ((F.col("i") < F.col("j")) & (F.abs(F.col("x") - F.col("rx")) < tol)
            & (F.abs(F.col("y") - F.col("ry")) < tol) & (F.abs(F.col("ya") - F.col("yb")) > min_dy))
    return near_pairs(a, b, tol, ["page_id"], where=fits).select("page_id", "i", "j")


def opposite_edges(pairs: DataFrame, tol: float = EDGE_TOL, min_dy: float = EDGE_DY) -> DataFrame:
    """Packages from two row pairs, each pair used once, earliest first; upper edge on top."""
    chosen = greedy_matching(edge_pairs(pairs, tol, min_dy))
    a = pairs.select("page_id", F.col("pair").alias("i"), F.struct("left", "right").alias("_a"))
    b = pairs.select("page_id", F.col("pair").alias("j"), F.struct("left", "right").alias("_b"))
    both = chosen.join(a, ["page_id", "i"]).join(b, ["page_id", "j"])
    upper = F.col("_a.left.y") < F.col("_b.left.y")
    return both.select("page_id", F.struct("i", "j").alias("package"),
                       F.when(upper, F.col("_a")).otherwise(F.col("_b")).alias("top"),
                       F.when(upper, F.col("_b")).otherwise(F.col("_a")).alias("bottom"))


def interpolate_pins(packages: DataFrame) -> DataFrame:
    """Pins of both columns between their corner labels: package, pin, x, y.

    A pin named by both columns belongs to the right one.
    """
    columns = packages.select("page_id", "package", F.explode(F.array(*[
        F.struct(F.lit(i).alias("side"), F.col(f"top.{s}").alias("a"), F.col(f"bottom.{s}").alias("b"))
        for i, s in enumerate(("left", "right"))])).alias("c"))
    a, b = F.col("c.a"), F.col("c.b")
    span = F.abs(a["pin"] - b["pin"])
    pins = columns.filter(span >= 1).select(
        "page_id", "package", "c", F.explode(F.sequence(F.lit(0).cast("long"), span.cast("long"))).alias("i"))
    t = F.col("i") / span
    pins = pins.select("page_id", "package", F.col("c.side").alias("side"),
                       (a["pin"] + F.signum(b["pin"] - a["pin"]).cast("long") * F.col("i")).alias("pin"),
                       F.bround(a["x"] + (b["x"] - a["x"]) * t, 0).cast("long").alias("x"),
                       F.bround(a["y"] + (b["y"] - a["y"]) * t, 0).cast("long").alias("y"))
    return first_per(pins, ["page_id", "package", "pin"], [F.col("side") * -1]).drop("side")


def package_bodies(packages: DataFrame, pins: DataFrame) -> DataFrame:
    """Pin count, padded body box and corner names per package."""
    body = pins.groupBy("page_id", "package").agg(
        (F.min("x") - BODY_PAD).alias("x"), (F.min("y") - BODY_PAD).alias("y"),
        (F.max("x") - F.min("x") + 2 * BODY_PAD).alias("w"), (F.max("y") - F.min("y") + 2 * BODY_PAD).alias("h"))
    corner = lambda edge, side: F.concat(F.lit("pin"), F.col(f"{edge}.{side}.pin").cast("string"))
    return packages.join(body, ["page_id", "package"]).select(
        "page_id", "package",
        F.greatest("top.left.pin", "top.right.pin", "bottom.left.pin", "bottom.right.pin").alias("pin_count"),
        "x", "y", "w", "h", corner("top", "left").alias("top_left"), corner("top", "right").alias("top_right"),
        corner("bottom", "left").alias("bottom_left"), corner("bottom", "right").alias("bottom_right"))


def crop_match(detections: DataFrame, texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """First wanted designator read in each detection's crop; the detection box is its body.

    ``detections``: source, idx, x0, y0, w, h; ``texts``: source, idx, ord, text.
    """
    reads = texts.withColumn("refdes", F.upper(F.trim("text"))).join(
        wanted.select("refdes").distinct(), "refdes", "left_semi")
    first = first_per(reads.select("source", "idx", "ord", "refdes"), ["source", "idx"], ["ord"])
    return detections.join(first.drop("ord"), ["source", "idx"])


def confirm_only(matches: DataFrame, texts: DataFrame, noise: int = 1) -> DataFrame:
    """Matches whose crop reads the designator and at most ``noise`` other texts."""
    clean = texts.withColumn("t", F.upper(F.trim("text"))).filter("t <> ''")
    per = matches.select("source", "idx", "refdes").join(clean.select("source", "idx", "t"), ["source", "idx"])
    good = per.groupBy("source", "idx", "refdes").agg(
        F.count("*").alias("n"), F.bool_or(F.col("t") == F.col("refdes")).alias("named"))
    good = good.filter(F.col("named") & (F.col("n") <= noise + 1))
    return matches.join(good.select("source", "idx", "refdes"), ["source", "idx", "refdes"], "left_semi")
