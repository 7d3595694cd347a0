"""Masks and statistics over sparse pixel rows ``page_id, x, y, b, g, r``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import colour
from ..functions.geometry import round_even, scale_bbox
from .graph import label_runs
from .ordered import cluster_1d, first_per, top_per
from .spatial import points_in_boxes

XY = ["page_id", "x", "y"]


def _bgr():
    return F.col("b").cast("int"), F.col("g").cast("int"), F.col("r").cast("int")


def grey():
    return colour.luma(*_bgr())


def spread():
    return colour.chan_diff(*_bgr())


def mask_chan_diff(pixels: DataFrame, threshold: int = 40, light: int = 0) -> DataFrame:
    """Coloured pixels; ``light`` also takes in paler rims."""
    limit = min(threshold, light) if light > 0 else threshold
    return pixels.filter(spread() > limit)


def mask_color(pixels: DataFrame, colours: list[str] | None = None, rules: dict | None = None,
               edge: bool = True, sat_min: int = 30) -> DataFrame:
    """Pixels of the named colours (all by default): their core and, if wanted, soft rim."""
    rules = rules or colour.COLOUR_RULES
    chosen = [rules[name] for name in colours or rules]
    tests = [colour.colour_core(spec) for spec in chosen]
    if edge:
        tests.append(colour.colour_edge(*chosen, sat_min=sat_min))
    return pixels.filter(reduce(lambda a, c: a | c, tests))


def mask_legend(pixels: DataFrame, legend: DataFrame, tol: int = 40) -> DataFrame:
    """Pixels within a tolerance of a legend colour on every channel, with its label.

    An equi-join on coarse colour cells; only the legend is spread to neighbouring cells.
    """
    step = tol + 1
    around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    cells = legend.select("label", *[F.col(c).cast("int").alias(f"l_{c}") for c in "bgr"])
    on, near = F.lit(True), F.lit(True)
    px = pixels
    for c in "bgr":
        px = px.withColumn(f"_p{c}", F.floor(F.col(c) / step))
        cells = cells.withColumn("_o", F.explode(around))
        cells = cells.withColumn(f"_l{c}", F.floor(F.col(f"l_{c}") / step) + F.col("_o")).drop("_o")
        on = on & (F.col(f"_p{c}") == F.col(f"_l{c}"))
        near = near & (F.abs(F.col(c).cast("int") - F.col(f"l_{c}")) <= tol)
    return px.join(cells, on & near).select(*pixels.columns, "label")


def dark_mask(pixels: DataFrame, threshold: int = 150, drop_green: bool = False) -> DataFrame:
    dark = pixels.filter(grey() < threshold)
    return dark.filter(~colour.colour_core(colour.LINE_RULES["green"])) if drop_green else dark


def mask_and(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select(*XY).distinct(), XY, "left_semi")


def mask_or(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*XY).unionByName(b.select(*XY)).distinct()


def mask_minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select(*XY).distinct(), XY, "left_anti")


def roi_expand(regions: DataFrame, width: int, height: int, scale: float = 1.5) -> DataFrame:
    """Region boxes (``bbox`` half-open) scaled around their centre."""
    return regions.withColumn("bbox", scale_bbox(F.col("bbox"), scale, width, height))


def mask_in_rois(mask: DataFrame, rois: DataFrame) -> DataFrame:
    """Mask pixels inside some half-open region box of their page."""
    b = F.col("bbox")
    boxes = rois.select("page_id", b["x0"].alias("bx0"), b["y0"].alias("by0"),
                        (b["x1"] - 1).alias("bx1"), (b["y1"] - 1).alias("by1")).distinct()
    return points_in_boxes(mask, boxes, ["page_id"], how="left_semi").select(*mask.columns).distinct()


def _median(c: str):
    return F.median(c).cast("int")  # channels have 256 values, so the buffers stay small


def region_stats(labelled: DataFrame) -> DataFrame:
    """Area, bounds and truncated median colour per component of ``page_id, label``."""
    return labelled.groupBy("page_id", "label").agg(
        F.count("*").alias("area"), F.min("x").alias("x0"), F.min("y").alias("y0"),
        F.max("x").alias("x1"), F.max("y").alias("y1"),
        _median("b").alias("b"), _median("g").alias("g"), _median("r").alias("r"))


def net_stats(labelled_runs: DataFrame) -> DataFrame:
    """Area and half-open bounds per component, from its runs."""
    return labelled_runs.groupBy("page_id", "label").agg(
        F.sum(F.col("hi") - F.col("lo") + 1).alias("area"), F.min("lo").alias("x0"), F.min("pos").alias("y0"),
        (F.max("hi") + 1).alias("x1"), (F.max("pos") + 1).alias("y1"))


def main_net(nets: DataFrame, min_share: float = 0.5) -> DataFrame:
    """Largest component per page, its share of all dark pixels and whether it is the main net."""
    total = nets.groupBy("page_id").agg(
        F.sum("area").alias("total"), F.max("area").alias("area"),
        F.min_by("label", F.struct(F.col("area") * -1, F.col("label"))).alias("label"))
    share = F.col("area") / F.col("total")
    return total.select("page_id", "label", "area", "total", round_even(share, 3).alias("ratio"),
                        (share >= min_share).alias("is_main"))


def top_nets(nets: DataFrame, n: int = 5000) -> DataFrame:
    """Report of the ``n`` largest nets of each page."""
    place = Window.partitionBy("page_id").orderBy(F.col("area").desc(), "label")
    return nets.withColumn("_place", F.row_number().over(place)).filter(F.col("_place") <= n).drop("_place")


def board_bbox(labelled_runs: DataFrame) -> DataFrame:
    """Bounds and box area of the largest component of each page."""
    nets = net_stats(labelled_runs)
    best = first_per(nets, ["page_id"], [F.col("area") * -1, F.col("label")])
    return best.select("page_id", "x0", "y0", "x1", "y1", "area",
                       ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("board_area"))


def dark_core(labelled: DataFrame, share: float = 0.25) -> DataFrame:
    """Pixels strictly darker than the interpolated brightness percentile of their component."""
    lit = labelled.withColumn("luma", grey())
    limits = lit.groupBy("page_id", "label").agg(F.percentile("luma", share).alias("limit"))
    return lit.join(limits, ["page_id", "label"]).filter("luma < limit")


def luminance_core(masked: DataFrame, threshold: int = 120, legend: DataFrame | None = None,
                   adaptive: bool = False) -> DataFrame:
    """Masked pixels darker than one limit, their colour's legend sample or its median on their page.

    ``masked`` has ``colour``; ``legend`` has ``colour, b, g, r``.
    """
    lit = masked.withColumn("luma", grey())
    if legend is None and not adaptive:
        return lit.filter(F.col("luma") < threshold)
    limits = lit.groupBy("page_id", "colour").agg(F.median("luma").alias("limit"))
    if legend is not None:
        weight = F.col("r") * 0.299 + F.col("g") * 0.587 + F.col("b") * 0.114
        samples = legend.select("colour", weight.alias("_sample")).groupBy("colour").agg(F.max("_sample").alias("_sample"))
        limits = limits.join(samples, "colour", "left").select("page_id", "colour", F.coalesce("_sample", "limit").alias("limit"))
    return lit.join(limits, ["page_id", "colour"]).filter("luma < limit")


DEFAULT_INK = 30


def base_color(pixels: DataFrame, diff: int = 40, dark: int = 150) -> DataFrame:
    """Median colour of dark uncoloured pixels per page, a dark default where there are none."""
    ink = (grey() < dark) & (spread() <= diff)
    value = lambda c: F.coalesce(F.median(F.when(ink, F.col(c))).cast("int"), F.lit(DEFAULT_INK)).alias(c)
    return pixels.groupBy("page_id").agg(value("b"), value("g"), value("r"))


def mask_stats(mask: DataFrame, labelled_runs: DataFrame, page_area: int) -> DataFrame:
    """Pixels, share of the page, components and area of the five largest, per page."""
    nets = net_stats(labelled_runs)
    ranked = first_n_areas(nets, 5)
    counts = nets.groupBy("page_id").agg(F.sum("area").alias("pixels"), F.count("*").alias("components"))
    return counts.join(ranked, "page_id").withColumn("share", F.round(F.col("pixels") / page_area, 6))


def first_n_areas(nets: DataFrame, n: int) -> DataFrame:
    top = top_per(nets, ["page_id"], [F.col("area").desc(), F.col("label")], n)
    return top.groupBy("page_id").agg(F.sum("area").alias("top_area"), F.count("*").alias("top_n"))


def cleanup_metrics(before_runs: DataFrame, after: DataFrame,
                    dark: int = 150, diff: int = 40, pale=(10, 40)) -> DataFrame:
    """How a cleaned page compares with the original, per page.

    Share of the original main net's pixels still dark, pieces that net fell into,
    coloured and pale pixels left over.  ``before_runs`` are labelled runs of the
    original dark mask; ``after`` are the pixels of the cleaned page.
    """
    main = main_net(net_stats(before_runs))
    main_runs = before_runs.join(main.select("page_id", "label", F.col("area").alias("main_area")), ["page_id", "label"])
    cells = main_runs.select("page_id", F.col("pos").alias("y"), F.explode(F.sequence("lo", "hi")).alias("x"))
    kept = dark_mask(after, dark).join(cells, XY, "left_semi")
    pieces = label_runs(kept)
    part = pieces.groupBy("page_id").agg(
        F.sum(F.col("hi") - F.col("lo") + 1).alias("kept"), F.count_distinct("label").alias("main_cc"))
    md = spread()
    rest = after.groupBy("page_id").agg(
        F.count_if((grey() < dark) & (md > diff)).alias("colored_resid"),
        F.count_if((md > pale[0]) & (md <= pale[1])).alias("light_resid"))
    out = main.select("page_id", "area").join(part, "page_id", "left").join(rest, "page_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("page_id", round_even(F.coalesce("kept", F.lit(0)) / F.col("area"), 4).alias("main_kept"),
                      zero("main_cc"), zero("colored_resid"), zero("light_resid"))


def grid_cells(mask: DataFrame, size: int = 30, min_thick: int = 4) -> DataFrame:
    """Tight bounds and median colour of the mask in each grid cell; thin cells are dropped."""
    cells = mask.groupBy("page_id", F.floor(F.col("x") / size).alias("gx"), F.floor(F.col("y") / size).alias("gy")).agg(
        F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"),
        _median("b").alias("b"), _median("g").alias("g"), _median("r").alias("r"))
    return cells.filter(F.least(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) + 1 >= min_thick)


def legend_line_width(labelled_mask: DataFrame, boxes: DataFrame | None = None) -> DataFrame:
    """Median column thickness per legend colour inside the legend box, then over colours.

    ``labelled_mask`` is ``mask_legend`` output; ``boxes``: page_id, bx0, by0, bx1, by1.
    """
    inside = labelled_mask
    if boxes is not None:
        inside = points_in_boxes(labelled_mask, boxes, ["page_id"]).select(*labelled_mask.columns)
    columns = inside.groupBy("page_id", "label", "x").agg(F.count("*").alias("thick"))
    colours = columns.groupBy("page_id", "label").agg(F.median("thick").alias("thick"))
    return colours.groupBy("page_id").agg(F.median("thick").alias("line_width"))


def robust_width(regions: DataFrame, k: float = 1.5, ratio: float = 2.5, keys=("page_id",)) -> DataFrame:
    """Line width learned from the short sides of regions, outliers left out, and the cap from it."""
    keys = list(keys)
    sides = regions.select(*keys, F.least("w", "h").alias("side")).filter("side > 0")
    # Equal sides are counted first: a page brings only its distinct sides to the medians.
    counted = sides.groupBy(*keys, "side").agg(F.count("*").alias("n"))
    first = counted.groupBy(*keys).agg(F.percentile("side", 0.5, F.col("n")).alias("med"))
    kept = counted.join(first, keys).filter(F.col("side") <= F.col("med") * k)
    width = kept.groupBy(*keys).agg(F.percentile("side", 0.5, F.col("n")).alias("clean"))
    out = first.join(width, keys, "left").withColumn("line_width", F.coalesce("clean", "med"))
    return out.select(*keys, "line_width", (F.col("line_width") * ratio).alias("cap"))


def typical_size(sizes: DataFrame) -> DataFrame:
    """Median width and height per symbol key, over counts of equal sizes."""
    def side(c):
        counted = sizes.filter(F.col(c).isNotNull()).groupBy("sym", c).agg(F.count("*").alias("n"))
        return counted.groupBy("sym").agg(F.percentile(c, 0.5, F.col("n")).alias(f"typical_{c}"))

    return side("w").join(side("h"), "sym")


def color_bands(pixels: DataFrame, min_px: int = 3, gap: int = 8, diff: int = 40) -> DataFrame:
    """Bands of coloured rows with their median colour, per page."""
    coloured = mask_chan_diff(pixels, diff)
    rows = coloured.groupBy("page_id", "y").agg(F.count("*").alias("n")).filter(F.col("n") > min_px)
    bands = cluster_1d(rows, ["page_id"], "y", gap).select(
        "page_id", F.col("cluster").alias("band"), F.col("first_pos").alias("y0"), F.col("last_pos").alias("y1"))
    lines = bands.withColumn("y", F.explode(F.sequence("y0", "y1")))
    return (coloured.join(lines, ["page_id", "y"]).groupBy("page_id", "band", "y0", "y1")
            .agg(_median("b").alias("b"), _median("g").alias("g"), _median("r").alias("r"), F.count("*").alias("n")))
