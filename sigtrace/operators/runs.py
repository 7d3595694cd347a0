"""Run-length rows of pixel masks: runs, dash lines, frames, windows and nets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import cluster_1d, first_per, islands


def runs(mask: DataFrame, axis: str = "h") -> DataFrame:
    """Maximal consecutive pixels per row (``h``) or column (``v``) as ``page_id, pos, lo, hi``."""
    line, along = ("y", "x") if axis == "h" else ("x", "y")
    return islands(mask.select("page_id", F.col(line).alias("pos"), along), ["page_id", "pos"], along)


def line_width(mask: DataFrame) -> DataFrame:
    """Median vertical run length per page, truncated."""
    lengths = runs(mask, "v").select("page_id", (F.col("hi") - F.col("lo") + 1).alias("len"))
    return lengths.groupBy("page_id").agg(F.median("len").cast("long").alias("line_width"))


def dash_lines(df: DataFrame, lo: int = 8, hi: int = 25, min_dashes: int = 6) -> DataFrame:
    """Rows or columns with enough runs of dash length, with the span they cover."""
    length = F.col("hi") - F.col("lo") + 1
    return (df.filter(length.between(lo, hi)).groupBy("page_id", "pos")
            .agg(F.count("*").alias("dashes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
            .filter(F.col("dashes") >= min_dashes))


def edges(lines: DataFrame, gap: int = 6) -> DataFrame:
    return cluster_1d(lines, ["page_id"], "pos", gap, "lo", "hi")


def frame_box(h_edges: DataFrame, v_edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """Frame around an anchor: nearest edge as top/left, largest as bottom/right.

    ``anchors`` has one ``page_id, ax, ay`` per page; pages need two edges each way.
    """
    def ends(side: DataFrame, at: str, first: str, last: str) -> DataFrame:
        near = F.struct(F.abs(F.col("mean_pos") - F.col(at)), F.col("mean_pos"))
        return (side.join(anchors, "page_id").groupBy("page_id")
                .agg(F.min_by("mean_pos", near).alias(first), F.max("mean_pos").alias(last),
                     F.count("*").alias("_n"))
                .filter(F.col("_n") >= 2).drop("_n"))

    rows, cols = ends(h_edges, "ay", "top", "bottom"), ends(v_edges, "ax", "left", "right")
    return rows.join(cols, "page_id").select(
        "page_id", F.col("left").alias("x"), F.col("top").alias("y"),
        (F.col("right") - F.col("left")).alias("w"), (F.col("bottom") - F.col("top")).alias("h"))


TILE = 64


def _run_tiles(df: DataFrame) -> DataFrame:
    return (df.withColumn("_tx", F.explode(F.sequence(F.floor(F.col("lo") / TILE), F.floor(F.col("hi") / TILE))))
            .withColumn("_ty", F.floor(F.col("pos") / TILE)))


def _window_tiles(df: DataFrame) -> DataFrame:
    cover = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / TILE), F.floor((F.col(hi) - 1) / TILE)))
    return (df.filter((F.col("wx1") > F.col("wx0")) & (F.col("wy1") > F.col("wy0")))
            .withColumn("_tx", cover("wx0", "wx1")).withColumn("_ty", cover("wy0", "wy1")))


def windows_hit(windows: DataFrame, run_rows: DataFrame) -> DataFrame:
    """Half-open windows ``page_id, wx0, wy0, wx1, wy1`` that contain a mask pixel.

    Equal windows are asked once, and a semi join stops at the first run found.
    """
    asked = windows.select("page_id", "wx0", "wy0", "wx1", "wy1").distinct()
    w, r = _window_tiles(asked).alias("w"), _run_tiles(run_rows).alias("r")
    on = ((F.col("w.page_id") == F.col("r.page_id")) & (F.col("w._tx") == F.col("r._tx"))
          & (F.col("w._ty") == F.col("r._ty"))
          & (F.col("r.pos") >= F.col("w.wy0")) & (F.col("r.pos") < F.col("w.wy1"))
          & (F.col("r.lo") < F.col("w.wx1")) & (F.col("r.hi") >= F.col("w.wx0")))
    return w.join(r, on, "left_semi").select("page_id", "wx0", "wy0", "wx1", "wy1").distinct()


def _clamp(value, low=0):
    return F.greatest(F.lit(low), value)


def touch(symbols: DataFrame, run_rows: DataFrame, r: int) -> DataFrame:
    """Symbols with a mask pixel in ``[x-r, x+r) x [y-r, y+r)``."""
    x, y = F.col("x"), F.col("y")
    asked = (symbols.withColumn("wx0", _clamp(x - r)).withColumn("wx1", x + r)
             .withColumn("wy0", _clamp(y - r)).withColumn("wy1", y + r))
    hit = windows_hit(asked, run_rows)
    return asked.join(hit, ["page_id", "wx0", "wy0", "wx1", "wy1"], "left_semi").select(*symbols.columns)


def side_evidence(symbols: DataFrame, run_rows: DataFrame, touch_r: int = 25, band: int = 22,
                  side=(20, 50), width: int | None = None, height: int | None = None) -> DataFrame:
    """Per symbol the flags ``touch, e, w, n, s``: mask pixels around it and on each side."""
    x, y, (near, far) = F.col("x"), F.col("y"), side
    right = lambda v: v if width is None else F.least(v, F.lit(width - 1))
    lower = lambda v: v if height is None else F.least(v, F.lit(height - 1))
    spans = {
        "touch": (_clamp(x - touch_r), x + touch_r, _clamp(y - touch_r), y + touch_r),
        "e": (right(x + near), right(x + far), _clamp(y - band), y + band),
        "w": (_clamp(x - far), _clamp(x - near), _clamp(y - band), y + band),
        "n": (_clamp(x - band), x + band, _clamp(y - far), _clamp(y - near)),
        "s": (_clamp(x - band), x + band, lower(y + near), lower(y + far)),
    }
    windows = F.array(*[F.struct(F.lit(name).alias("side"), a.alias("wx0"), b.alias("wx1"),
                                 c.alias("wy0"), d.alias("wy1")) for name, (a, b, c, d) in spans.items()])
    places = symbols.select("page_id", "x", "y").distinct()
    asked = places.select("page_id", "x", "y", F.inline(windows))
    hit = windows_hit(asked, run_rows).withColumn("hit", F.lit(True))
    flags = (asked.join(hit, ["page_id", "wx0", "wy0", "wx1", "wy1"], "left")
             .groupBy("page_id", "x", "y")
             .agg(*[F.coalesce(F.bool_or((F.col("side") == s) & F.col("hit")), F.lit(False)).alias(s)
                    for s in spans]))
    return symbols.join(flags, ["page_id", "x", "y"])


def membership(evidence: DataFrame) -> DataFrame:
    """Whether a symbol is passed by the line, hangs off it, or is not on it."""
    across, along = F.col("e") & F.col("w"), F.col("n") & F.col("s")
    any_side = F.col("e") | F.col("w") | F.col("n") | F.col("s")
    through = F.col("touch") & (across | along)
    return (evidence
            .withColumn("membership", F.when(through, "flow_through")
                        .when(F.col("touch") & any_side, "branch").otherwise("none"))
            .withColumn("flow_dir", F.when(through & across, "H").when(through, "V")))


def main_path(df: DataFrame) -> DataFrame:
    return df.filter((F.col("membership") == "flow_through") & F.col("refdes").isNotNull())


def net_of_symbol(symbols: DataFrame, labelled_runs: DataFrame) -> DataFrame:
    """Net under each symbol position; null where the point is on no run.

    ``labelled_runs`` has ``page_id, pos, lo, hi, label``; runs of a row are disjoint.
    """
    r = (_run_tiles(labelled_runs)
         .select(F.col("page_id").alias("_p"), F.col("pos").alias("_pos"), "_tx", "lo", "hi", "label"))
    s = symbols.withColumn("_sx", F.floor(F.col("x") / TILE))
    on = ((F.col("page_id") == F.col("_p")) & (F.col("y") == F.col("_pos")) & (F.col("_sx") == F.col("_tx"))
          & F.col("x").between(F.col("lo"), F.col("hi")))
    return s.join(r, on, "left").select(*symbols.columns, F.col("label").alias("net"))


def net_bridge(parts: DataFrame, labelled_runs: DataFrame, reach: int) -> DataFrame:
    """Nets left and right of a part; a true two-terminal part sees two different ones."""
    sides = parts.select("page_id", "ord", "y", F.explode(F.array(
        F.struct(F.lit("net_a").alias("side"), (F.col("x") - reach).alias("x")),
        F.struct(F.lit("net_b").alias("side"), (F.col("x") + reach).alias("x")))).alias("_p"))
    probes = sides.select("page_id", "ord", "y", F.col("_p.side").alias("side"), F.col("_p.x").alias("x"))
    nets = (net_of_symbol(probes, labelled_runs).groupBy("page_id", "ord")
            .agg(F.max(F.when(F.col("side") == "net_a", F.col("net"))).alias("net_a"),
                 F.max(F.when(F.col("side") == "net_b", F.col("net"))).alias("net_b")))
    return nets.withColumn("bridges", F.coalesce(F.col("net_a") != F.col("net_b"), F.lit(False)))


def walk_distance(symbols: DataFrame, hops: DataFrame, r: int = 60) -> DataFrame:
    """Least hop count in ``[x-r, x+r) x [y-r, y+r)`` around each symbol, null if none.

    ``hops`` has ``page_id, pos, lo, hi, dist``.
    """
    x, y = F.col("x"), F.col("y")
    places = (symbols.select("page_id", "x", "y").distinct()
              .withColumn("wx0", _clamp(x - r)).withColumn("wx1", x + r)
              .withColumn("wy0", _clamp(y - r)).withColumn("wy1", y + r))
    # Per tile row of the line only the smallest distance of equal runs matters.
    near = _run_tiles(hops).select(F.col("page_id").alias("_p"), F.col("_tx").alias("_rx"),
                                   F.col("_ty").alias("_ry"), "pos", "lo", "hi", "dist")
    w = _window_tiles(places)
    on = ((F.col("page_id") == F.col("_p")) & (F.col("_tx") == F.col("_rx")) & (F.col("_ty") == F.col("_ry"))
          & (F.col("pos") >= F.col("wy0")) & (F.col("pos") < F.col("wy1"))
          & (F.col("lo") < F.col("wx1")) & (F.col("hi") >= F.col("wx0")))
    found = w.join(near, on).groupBy("page_id", "x", "y").agg(F.min("dist").alias("walk_d"))
    return symbols.join(found, ["page_id", "x", "y"], "left")


def nearest_run(run_rows: DataFrame, seeds: DataFrame) -> DataFrame:
    """Run closest to each page's seed ``page_id, sx, sy``; first in raster order on ties."""
    px = F.greatest(F.col("lo"), F.least(F.col("hi"), F.col("sx")))
    gap = (px - F.col("sx")) * (px - F.col("sx")) + (F.col("pos") - F.col("sy")) * (F.col("pos") - F.col("sy"))
    scored = run_rows.join(seeds, "page_id").withColumn("_d", gap)
    return first_per(scored, ["page_id"], ["_d", "pos", "lo"]).select("page_id", "pos", "lo", "hi")
