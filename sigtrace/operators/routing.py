"""Routes between located parts: candidates, conflicts, scores and waypoints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..session import cut

# Vertical offsets of detours, separation of parallel lines, score weights.
DETOURS = [-400, -200, -100, -50, 50, 100, 200, 400]
MIN_SEPARATION = 20
CROSSING_WEIGHT, PROXIMITY_WEIGHT, LABEL_WEIGHT, LENGTH_WEIGHT = 10, 8, 5, 0.02
OUTLINE_W, OUTLINE_H, OUTLINE_STROKE = 220, 160, 3
LINE_FONT, MARK_FONT = 28, 36
CELL = 256

KEY = ["board_id"]


def route_candidates(edges: DataFrame) -> DataFrame:
    """Manhattan routes per edge: straight if aligned, else two corners and the detours.

    ``edges``: board_id, edge_id, from_x, from_y, to_x, to_y.  Result: one row per
    route with ``cand``, its ``points`` and ``length``.
    """
    x1, y1, x2, y2 = (F.col(c) for c in ("from_x", "from_y", "to_x", "to_y"))
    start, end = geo.point(x1, y1), geo.point(x2, y2)
    bent = [F.array(start, geo.point(x1, y2), end), F.array(start, geo.point(x2, y1), end)]
    bent += [F.array(start, geo.point(x1, y1 + d), geo.point(x2, y1 + d), end) for d in DETOURS]
    aligned = (x1 == x2) | (y1 == y2)
    routes = F.when(aligned, F.array(F.array(start, end))).otherwise(F.array(*bent))
    out = edges.select("*", F.posexplode(routes).alias("cand", "points"))
    return out.withColumn("length", geo.route_length(F.col("points")))


def segments_of(routes: DataFrame, keys: list[str]) -> DataFrame:
    """Axis-aligned segments ``axis, pos, lo, hi`` of each route; a dot counts as horizontal."""
    n = F.size("points") - 1
    pairs = F.arrays_zip(F.slice("points", F.lit(1), n).alias("a"), F.slice("points", F.lit(2), n).alias("b"))
    rows = routes.select(*keys, F.explode(pairs).alias("s"))
    a, b = F.col("s.a"), F.col("s.b")
    flat = a["y"] == b["y"]
    return rows.select(
        *keys, F.when(flat, "h").otherwise("v").alias("axis"), F.when(flat, a["y"]).otherwise(a["x"]).alias("pos"),
        F.when(flat, F.least(a["x"], b["x"])).otherwise(F.least(a["y"], b["y"])).alias("lo"),
        F.when(flat, F.greatest(a["x"], b["x"])).otherwise(F.greatest(a["y"], b["y"])).alias("hi"))


def _piles(routed: DataFrame) -> DataFrame:
    return routed.groupBy(*KEY, "axis", "pos", "lo", "hi").agg(F.count("*").alias("n"))


def _along(df: DataFrame, lo: str, hi: str, name: str) -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.floor(F.col(lo) / CELL), F.floor(F.col(hi) / CELL))))


def _as_other(df: DataFrame) -> DataFrame:
    return df.select("board_id", *[F.col(c).alias(f"o_{c}") for c in df.columns if c != "board_id"])


def _crosses():
    return ((F.col("axis") != F.col("o_axis")) & (F.col("lo") < F.col("o_pos")) & (F.col("o_pos") < F.col("hi"))
            & (F.col("o_lo") < F.col("pos")) & (F.col("pos") < F.col("o_hi")))


def _close(sep: float):
    gap = F.abs(F.col("pos") - F.col("o_pos"))
    return ((F.col("axis") == F.col("o_axis")) & (F.col("hi") > F.col("o_lo")) & (F.col("o_hi") > F.col("lo"))
            & (gap > 0) & (gap < sep))


def _both_axes(df: DataFrame) -> DataFrame:
    """Zero-length segments run along both axes."""
    dots = df.filter("axis = 'h' and lo = hi")
    return df.unionByName(dots.withColumn("axis", F.lit("v")).withColumn("_p", F.col("pos"))
                          .withColumn("pos", F.col("lo")).withColumn("lo", F.col("_p"))
                          .withColumn("hi", F.col("_p")).drop("_p"))


def crossings(segs: DataFrame, routed: DataFrame, keys: list[str]) -> DataFrame:
    """Strict crossings of each candidate with the routed segments.

    A crossing is found in the one cell that holds the crossing point; equal routed
    segments are counted before the join.
    """
    piles = _piles(routed)
    a = segs.filter("lo < hi")
    # The cell of a crossing is (cell of the vertical's x, cell of the horizontal's y).
    mine = _along(a, "lo", "hi", "_run").withColumn("_at", F.floor(F.col("pos") / CELL))
    other = _along(piles.filter("lo < hi"), "lo", "hi", "_run").withColumn("_at", F.floor(F.col("pos") / CELL))
    o = _as_other(other)
    on = ((mine["board_id"] == o["board_id"]) & (F.col("_run") == F.col("o__at"))
          & (F.col("_at") == F.col("o__run")) & _crosses())
    return mine.join(o, on).groupBy(*[mine[k] for k in keys]).agg(F.sum("o_n").alias("crossings"))


def proximity(segs: DataFrame, routed: DataFrame, keys: list[str], sep: float = MIN_SEPARATION) -> DataFrame:
    """Routed segments that run beside a candidate's, nearer than ``sep`` but not on it."""
    around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    mine = _along(_both_axes(segs), "lo", "hi", "_run").withColumn("_at", F.floor(F.col("pos") / sep))
    other = (_along(_piles(_both_axes(routed)), "lo", "hi", "_run")
             .withColumn("_o", F.explode(around)).withColumn("_at", F.floor(F.col("pos") / sep) + F.col("_o")).drop("_o"))
    o = _as_other(other)
    first = F.floor(F.greatest("lo", "o_lo") / CELL) == F.col("_run")
    on = ((mine["board_id"] == o["board_id"]) & (F.col("axis") == F.col("o_axis"))
          & (F.col("_run") == F.col("o__run")) & (F.col("_at") == F.col("o__at")) & first & _close(sep))
    return mine.join(o, on).groupBy(*[mine[k] for k in keys]).agg(F.sum("o_n").alias("proximity"))


def label_hits(segs: DataFrame, keepouts: DataFrame, keys: list[str]) -> DataFrame:
    """Keep-out rectangles that a candidate's segments pass through."""
    boxes = (keepouts.groupBy(*KEY, F.col("x0").alias("rx0"), F.col("y0").alias("ry0"),
                              F.col("x1").alias("rx1"), F.col("y1").alias("ry1")).agg(F.count("*").alias("n")))
    boxes = _along(_along(boxes, "rx0", "rx1", "_cx"), "ry0", "ry1", "_cy")
    flat = F.col("axis") == "h"
    mine = _along(segs, "lo", "hi", "_run").withColumn("_at", F.floor(F.col("pos") / CELL))
    mine = (mine.withColumn("_sx", F.when(flat, F.col("_run")).otherwise(F.col("_at")))
            .withColumn("_sy", F.when(flat, F.col("_at")).otherwise(F.col("_run"))))
    near0, near1 = F.when(flat, F.col("rx0")).otherwise(F.col("ry0")), F.when(flat, F.col("rx1")).otherwise(F.col("ry1"))
    far0, far1 = F.when(flat, F.col("ry0")).otherwise(F.col("rx0")), F.when(flat, F.col("ry1")).otherwise(F.col("rx1"))
    inside = ((far0 < F.col("pos")) & (F.col("pos") < far1) & (F.col("hi") > near0) & (F.col("lo") < near1))
    first = F.floor(F.greatest(F.col("lo"), near0) / CELL) == F.col("_run")
    on = ((mine["board_id"] == boxes["board_id"]) & (F.col("_sx") == F.col("_cx"))
          & (F.col("_sy") == F.col("_cy")) & inside & first)
    return mine.join(boxes, on).groupBy(*[mine[k] for k in keys]).agg(F.sum("n").alias("label_hits"))


def _own(segs: DataFrame, routed: DataFrame, keys: list[str]) -> DataFrame:
    """Conflicts of a candidate with its own edge's routed segments, a handful per edge."""
    def count(a, b, test, name):
        o = b.select(*KEY, F.col("edge_id").alias("o_edge"), *[F.col(c).alias(f"o_{c}") for c in ("axis", "pos", "lo", "hi")])
        on = (a["board_id"] == o["board_id"]) & (F.col("edge_id") == F.col("o_edge")) & test
        return a.join(o, on).groupBy(*[a[k] for k in keys]).agg(F.count("*").alias(name))

    cross = count(segs, routed, _crosses(), "own_crossings")
    close = count(_both_axes(segs), _both_axes(routed), _close(MIN_SEPARATION), "own_proximity")
    return cross.join(close, keys, "full")


def score_routes(candidates: DataFrame, routed: DataFrame, keepouts: DataFrame) -> DataFrame:
    """Candidates with their conflicts and score against a fixed set of routed segments.

    ``routed``: board_id, edge_id, axis, pos, lo, hi.  An edge never conflicts with itself.
    """
    keys = [*KEY, "edge_id", "cand"]
    segs = segments_of(candidates, keys)
    counts = [crossings(segs, routed, keys), proximity(segs, routed, keys), label_hits(segs, keepouts, keys),
              _own(segs, routed, keys)]
    out = reduce(lambda a, c: a.join(c, keys, "left"), counts, candidates)
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = (out.withColumn("crossings", n("crossings") - n("own_crossings"))
           .withColumn("proximity", n("proximity") - n("own_proximity"))
           .withColumn("label_hits", n("label_hits")).drop("own_crossings", "own_proximity"))
    score = (F.col("crossings") * CROSSING_WEIGHT + F.col("proximity") * PROXIMITY_WEIGHT
             + F.col("label_hits") * LABEL_WEIGHT + F.col("length") * LENGTH_WEIGHT)
    return out.withColumn("score", F.round(score, 4))


def best_routes(scored: DataFrame) -> DataFrame:
    keys = [*KEY, "edge_id"]
    rest = [c for c in scored.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct("score", "cand")).alias("_b")
    return scored.groupBy(*keys).agg(best).select(*keys, "_b.*")


def plan_routes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Best route per edge against the plainest route of every other edge."""
    candidates = cut(route_candidates(edges))  # every conflict count below starts from them
    plain = segments_of(candidates.filter("cand = 0"), [*KEY, "edge_id"])
    zones = nodes.select("board_id", geo.keepout(
        F.col("refdes"), F.col("x"), F.col("y"), F.col("lpos"), F.col("fs")).alias("k")).select("board_id", "k.*")
    return best_routes(score_routes(candidates, plain, zones))


def waypoints(routes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Line and mark records; a cross-side line is dashed and its far end becomes a via.

    ``nodes``: board_id, refdes, x, y, view_name, lpos, fs, outline.
    """
    lines = routes.select(
        "board_id", F.lit("rx").alias("layer"), F.lit("line").alias("kind"),
        F.col("points")[0]["x"].cast("long").alias("x"), F.col("points")[0]["y"].cast("long").alias("y"),
        F.transform(F.slice("points", F.lit(2), F.size("points")),
                    lambda p: F.struct(p["x"].cast("long").alias("x"), p["y"].cast("long").alias("y"))).alias("through"),
        F.col("cross_side").alias("dash"), F.lit("").alias("label"), F.lit("d").alias("lpos"),
        F.lit(LINE_FONT).alias("fs"))
    vias = routes.filter("cross_side").select("board_id", F.col("to_ref").alias("refdes")).distinct()
    marks = nodes.join(vias.withColumn("_via", F.lit(True)), ["board_id", "refdes"], "left")
    shown = F.coalesce("outline", F.lit(False))
    marks = marks.select(
        "board_id", F.lit("marks").alias("layer"), F.lit("mark").alias("kind"),
        F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col("refdes").alias("label"),
        "lpos", F.col("fs").cast("int").alias("fs"), F.when(F.col("_via"), "via").alias("mark_type"),
        F.when(shown, F.struct(F.col("view_name").alias("view"), F.col("x").cast("long").alias("cx"),
                               F.col("y").cast("long").alias("cy"), F.lit(OUTLINE_W).alias("w"),
                               F.lit(OUTLINE_H).alias("h"), F.lit(OUTLINE_STROKE).alias("stroke"))).alias("outline"))
    return lines.unionByName(marks, allowMissingColumns=True)
