"""Queries over pixel pages: masks, runs, components, nets, legends, membership."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import colour, shapes
from ..operators import associate, graph, pixels, runs
from ..session import cut
from .bindings import PAGE_H, PAGE_W, Evidence
from .catalogue import query

_LUMA = "((299 * r + 587 * g + 114 * b + 500) // 1000)"
_DIFF = "greatest(abs(g - r), abs(g - b), abs(r - b))"
DARK = 150

_COL = f"""c AS (SELECT *, {_LUMA} AS l, {_DIFF} AS md, greatest(b, g, r) - least(b, g, r) AS sp, greatest(b, g, r) AS mx FROM v_pixel),
    a AS (SELECT *, CASE WHEN sp = 0 THEN 0.0 WHEN mx = r THEN (g - b) * 60.0::DOUBLE / sp WHEN mx = g THEN (b - r) * 60.0::DOUBLE / sp + 120 ELSE (r - g) * 60.0::DOUBLE / sp + 240 END AS ang FROM c),
    t AS (SELECT *, CAST(floor(CASE WHEN ang < 0 THEN ang + 360 ELSE ang END / 2 + 0.5) AS INTEGER) % 180 AS hue,
      CASE WHEN mx = 0 THEN 0 ELSE CAST(floor(sp * 255.0::DOUBLE / mx + 0.5) AS INTEGER) END AS sat FROM a),
    k AS (SELECT *, (g > 120 AND r < 110 AND b < 110) AS green, (r > 150 AND g < 110 AND b < 200 AND (hue BETWEEN 0 AND 25 OR hue BETWEEN 150 AND 170)) AS red,
      (g > 120 AND r < 110 AND b > 120) AS cyan, (g > 120 AND r > 120 AND b < 100) AS yellow, (l >= 40 AND l < 200 AND sat > 30) AS rim FROM t)"""


@query("q_masks", f"""WITH {_COL}
    SELECT page_id, x, y, CAST(l AS INTEGER) AS luma, CAST((b + g + r) // 3 AS INTEGER) AS mean, CAST(md AS INTEGER) AS diff, hue, sat,
      CASE WHEN g > 120 AND r < 110 AND b < 110 THEN 'green' WHEN r > 120 AND g < 110 AND b < 110 THEN 'red' WHEN g > 120 AND b > 120 AND r < 110 THEN 'cyan'
        WHEN r > 120 AND g > 120 AND b < 110 THEN 'yellow' END AS line_color,
      md > 40 AS coloured, l < 150 AND NOT (g > 120 AND r < 110 AND b < 110) AS dark,
      green OR red OR cyan OR yellow OR (rim AND (hue BETWEEN 58 AND 82 OR hue BETWEEN 0 AND 25 OR hue BETWEEN 150 AND 170 OR hue BETWEEN 80 AND 100 OR hue BETWEEN 18 AND 42)) AS annotated FROM k""")
def q_masks(ev):
    px = ev.v_pixel
    b, g, r = F.col("b").cast("int"), F.col("g").cast("int"), F.col("r").cast("int")
    tone = colour.hue_sat(b, g, r)
    base = px.select("page_id", "x", "y", colour.luma(b, g, r).alias("luma"), colour.channel_mean(b, g, r).alias("mean"),
                     colour.chan_diff(b, g, r).alias("diff"), tone["hue"].alias("hue"), tone["sat"].alias("sat"),
                     colour.colour_class().alias("line_color"))
    for name, mask in (("coloured", pixels.mask_chan_diff(px)), ("dark", pixels.dark_mask(px, DARK, drop_green=True)),
                       ("annotated", pixels.mask_color(px))):
        base = base.join(mask.select("page_id", "x", "y", F.lit(True).alias(name)), ["page_id", "x", "y"], "left")
    return base.fillna(False, ["coloured", "dark", "annotated"])


def dark_runs(ev: Evidence):
    return runs.runs(pixels.dark_mask(ev.v_pixel, DARK))


_RUNS = f"""d AS (SELECT page_id, x, y FROM v_pixel WHERE {_LUMA} < 150),
    i AS (SELECT page_id, y, x, x - row_number() OVER (PARTITION BY page_id, y ORDER BY x) AS grp FROM d),
    rn AS (SELECT page_id, y AS pos, min(x) AS lo, max(x) AS hi FROM i GROUP BY page_id, y, grp)"""


@query("q_runs", f"WITH {_RUNS} SELECT page_id, pos, lo, hi FROM rn")
def q_runs(ev):
    return dark_runs(ev)


@query("q_line_width", f"""
    WITH d AS (SELECT page_id, x, y FROM v_pixel WHERE {_LUMA} < 150),
    i AS (SELECT page_id, x, y, y - row_number() OVER (PARTITION BY page_id, x ORDER BY y) AS grp FROM d),
    v AS (SELECT page_id, x, count(*) AS len FROM i GROUP BY page_id, x, grp)
    SELECT page_id, CAST(floor(median(len)) AS BIGINT) AS line_width FROM v GROUP BY page_id""")
def q_line_width(ev):
    return runs.line_width(pixels.dark_mask(ev.v_pixel, DARK))


_LINES = """{n} AS (SELECT page_id, pos, min(lo) AS lo, max(hi) AS hi FROM {src} WHERE hi - lo + 1 BETWEEN 1 AND 3 GROUP BY page_id, pos HAVING count(*) >= 3),
    {n}f AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY page_id ORDER BY pos) <= 2 THEN 0 ELSE 1 END AS fresh FROM {n}),
    {n}g AS (SELECT *, sum(fresh) OVER (PARTITION BY page_id ORDER BY pos) AS cluster FROM {n}f),
    {n}e AS (SELECT page_id, CAST(cluster AS BIGINT) AS cluster, CAST(floor(avg(pos)) AS BIGINT) AS mean_pos, min(pos) AS first_pos, max(pos) AS last_pos,
      min(lo) AS span_lo, max(hi) AS span_hi, count(*) AS n FROM {n}g GROUP BY page_id, cluster)"""
_VRUNS = f"""vi AS (SELECT page_id, x, y, y - row_number() OVER (PARTITION BY page_id, x ORDER BY y) AS grp FROM d),
    vr AS (SELECT page_id, x AS pos, min(y) AS lo, max(y) AS hi FROM vi GROUP BY page_id, x, grp)"""


def edges(mask, axis: str):
    return runs.edges(runs.dash_lines(runs.runs(mask, axis), 1, 3, 3), gap=2)


@query("q_clusters", f"WITH {_RUNS}, {_LINES.format(n='h', src='rn')} SELECT page_id, cluster, mean_pos, first_pos, last_pos, span_lo, span_hi, n FROM he")
def q_clusters(ev):
    return edges(pixels.dark_mask(ev.v_pixel, DARK), "h")


@query("q_frame", f"""WITH {_RUNS}, {_VRUNS}, {_LINES.format(n='h', src='rn')}, {_LINES.format(n='v', src='vr')},
    hh AS (SELECT page_id, arg_min(mean_pos, abs(mean_pos - 3) * 1000 + mean_pos) AS y0, max(mean_pos) AS y1 FROM he GROUP BY page_id HAVING count(*) >= 2),
    vv AS (SELECT page_id, arg_min(mean_pos, abs(mean_pos - 4) * 1000 + mean_pos) AS x0, max(mean_pos) AS x1 FROM ve GROUP BY page_id HAVING count(*) >= 2)
    SELECT hh.page_id, x0 AS x, y0 AS y, x1 - x0 AS w, y1 - y0 AS h FROM hh JOIN vv ON hh.page_id = vv.page_id""")
def q_frame(ev):
    mask = cut(pixels.dark_mask(ev.v_pixel, DARK).select("page_id", "x", "y"))  # only pages with dark pixels have a frame
    anchors = mask.select("page_id").distinct().select("page_id", F.lit(4).alias("ax"), F.lit(3).alias("ay"))
    return runs.frame_box(edges(mask, "h"), edges(mask, "v"), anchors)


@query("q_legend", """
    WITH m AS (SELECT p.*, l.label FROM v_pixel p JOIN v_legend l ON abs(p.b - l.b) <= 40 AND abs(p.g - l.g) <= 40 AND abs(p.r - l.r) <= 40),
    c AS (SELECT page_id, label, x, count(*) AS thick FROM m GROUP BY ALL),
    t AS (SELECT page_id, label, median(thick) AS thick FROM c GROUP BY ALL),
    w AS (SELECT page_id, median(thick) AS line_width FROM t GROUP BY page_id)
    SELECT m.page_id, m.label, count(*) AS n, min(m.x) AS x0, max(m.y) AS y1, any_value(w.line_width) AS line_width
    FROM m JOIN w ON m.page_id = w.page_id GROUP BY m.page_id, m.label""")
def q_legend(ev):
    mask = pixels.mask_legend(ev.v_pixel, ev.v_legend, 40)
    stats = mask.groupBy("page_id", "label").agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("y").alias("y1"))
    return stats.join(pixels.legend_line_width(mask), "page_id")


@query("q_bands", f"""
    WITH c AS (SELECT * FROM v_pixel WHERE {_DIFF} > 40),
    rw AS (SELECT page_id, y FROM c GROUP BY page_id, y HAVING count(*) > 9),
    f AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY page_id ORDER BY y) <= 2 THEN 0 ELSE 1 END AS fresh FROM rw),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY page_id ORDER BY y) AS band FROM f),
    s AS (SELECT page_id, band, min(y) AS y0, max(y) AS y1 FROM g GROUP BY page_id, band),
    m AS (SELECT s.page_id, s.band, s.y0, s.y1, CAST(floor(median(c.b)) AS INTEGER) AS b, CAST(floor(median(c.g)) AS INTEGER) AS g, CAST(floor(median(c.r)) AS INTEGER) AS r
      FROM s JOIN c ON s.page_id = c.page_id AND c.y BETWEEN s.y0 AND s.y1 GROUP BY ALL),
    q AS (SELECT t.page_id, t.ord, t.y, m.band, m.b, m.g, m.r, row_number() OVER (PARTITION BY t.ord ORDER BY abs((m.y0 + m.y1) / 2.0 - t.y), m.band) AS rn
      FROM v_spot t LEFT JOIN m ON t.page_id = m.page_id AND abs((m.y0 + m.y1) / 2.0 - t.y) <= 6)
    SELECT page_id, ord, y, CAST(band AS BIGINT) AS band, b, g, r FROM q WHERE rn = 1""")
def q_bands(ev):
    bands = pixels.color_bands(ev.v_pixel, min_px=9, gap=2)
    return associate.legend_match(ev.v_spot.select("page_id", "ord", "y"), bands, max_dist=6)


# Labels of the dark mask's components by rounds of neighbouring minima.
_LABELS = """px AS ({src}),
    nb AS (SELECT a.page_id, a.y * 64 + a.x AS p, b.y * 64 + b.x AS q FROM px a JOIN px b ON a.page_id = b.page_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
    lb(it, page_id, p, label, moved) AS (
      SELECT 0, page_id, y * 64 + x, y * 64 + x, true FROM px
      UNION ALL
      SELECT c.it + 1, c.page_id, c.p, n.label, n.label < c.label FROM lb c JOIN (
        SELECT nb.page_id, nb.p, min(o.label) AS label FROM nb JOIN lb o ON nb.page_id = o.page_id AND nb.q = o.p GROUP BY nb.page_id, nb.p) n
        ON c.page_id = n.page_id AND c.p = n.p WHERE EXISTS (SELECT 1 FROM lb z WHERE z.moved)),
    cc AS (SELECT page_id, p % 64 AS x, p // 64 AS y, min(label) AS label FROM lb GROUP BY page_id, p)"""
_DARK_PX = f"SELECT page_id, x, y FROM v_pixel WHERE {_LUMA} < 150"
_COL_PX = f"SELECT page_id, x, y FROM v_pixel WHERE {_DIFF} > 90"


def raster(label):
    """A run's id as the raster position used by the SQL side."""
    return F.shiftright(label, graph.ROW_BITS) * PAGE_W + label % (1 << graph.ROW_BITS)


@query("q_components", f"""WITH {_LABELS.format(src=_COL_PX)}
    SELECT cc.page_id, cc.label, count(*) AS area, min(cc.x) AS x0, min(cc.y) AS y0, max(cc.x) AS x1, max(cc.y) AS y1,
      CAST(floor(median(v.b)) AS INTEGER) AS b, CAST(floor(median(v.g)) AS INTEGER) AS g, CAST(floor(median(v.r)) AS INTEGER) AS r
    FROM cc JOIN v_pixel v ON cc.page_id = v.page_id AND cc.x = v.x AND cc.y = v.y GROUP BY cc.page_id, cc.label""", recursive=True)
def q_components(ev):
    mask = cut(pixels.mask_chan_diff(ev.v_pixel, 90))
    stats = pixels.region_stats(graph.label_pixels(mask))
    return stats.withColumn("label", raster(F.col("label")))


@query("q_nets", f"""WITH {_LABELS.format(src=_DARK_PX)},
    n AS (SELECT page_id, label, count(*) AS area FROM cc GROUP BY page_id, label),
    t AS (SELECT page_id, CAST(sum(area) AS BIGINT) AS total, max(area) AS area, arg_min(label, -area * 10000 + label) AS label, count(*) AS components FROM n GROUP BY page_id),
    k AS (SELECT page_id, CAST(sum(area) AS BIGINT) AS top_area FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY area DESC, label) AS rn FROM n) WHERE rn <= 5 GROUP BY page_id)
    SELECT t.page_id, t.label, t.area, t.total, round_even(t.area::DOUBLE / t.total * 1000, 0) / 1000 AS ratio, t.area::DOUBLE / t.total >= 0.5 AS is_main,
      t.components, k.top_area, round(t.total::DOUBLE / 3072, 6) AS share FROM t JOIN k ON t.page_id = k.page_id""", recursive=True)
def q_nets(ev):
    mask = pixels.dark_mask(ev.v_pixel, DARK)
    labelled = graph.label_runs(mask)
    main = pixels.main_net(pixels.net_stats(labelled)).withColumn("label", raster(F.col("label")))
    stats = pixels.mask_stats(mask, labelled, PAGE_W * PAGE_H).select("page_id", "components", "top_area", "share")
    return main.join(stats, "page_id")


@query("q_top_nets", f"""WITH {_LABELS.format(src=_DARK_PX)}
    SELECT page_id, label, count(*) AS area, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM cc
    GROUP BY page_id, label
    QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY count(*) DESC, label) <= 5000""", recursive=True)
def q_top_nets(ev):
    nets = pixels.net_stats(graph.label_runs(pixels.dark_mask(ev.v_pixel, DARK)))
    return pixels.top_nets(nets.withColumn("label", raster(F.col("label"))))


@query("q_board_bbox", f"""WITH {_LABELS.format(src="SELECT page_id, x, y FROM v_pixel WHERE (b + g + r) // 3 < 230")},
    n AS (SELECT page_id, label, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1, count(*) AS area FROM cc GROUP BY page_id, label)
    SELECT page_id, x0, y0, x1, y1, area, (x1 - x0) * (y1 - y0) AS board_area FROM (
      SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY area DESC, label) AS rn FROM n) WHERE rn = 1""", recursive=True)
def q_board_bbox(ev):
    mask = ev.v_pixel.filter(colour.channel_mean(F.col("b"), F.col("g"), F.col("r")) < 230)
    return pixels.board_bbox(graph.label_runs(mask))


_HOPS = _RUNS + """, nd AS (SELECT page_id, pos, lo, hi, pos * 64 + lo AS node FROM rn),
    ed AS (SELECT a.page_id, a.node AS a, b.node AS b FROM nd a JOIN nd b ON a.page_id = b.page_id AND abs(a.pos - b.pos) = 1 AND a.lo <= b.hi + 1 AND b.lo - 1 <= a.hi),
    sd AS (SELECT page_id, node FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY (greatest(lo, least(hi, 16)) - 16) ** 2 + (pos - 12) ** 2, pos, lo) AS k FROM nd) WHERE k = 1),
    bf(dist, page_id, node) AS (
      SELECT 0, page_id, node FROM sd
      UNION
      SELECT DISTINCT bf.dist + 1, ed.page_id, ed.b FROM bf JOIN ed ON bf.page_id = ed.page_id AND bf.node = ed.a WHERE bf.dist < 60),
    hp AS (SELECT page_id, node, min(dist) AS dist FROM bf GROUP BY page_id, node)"""


def hops(ev: Evidence):
    nodes = cut(graph.with_node(dark_runs(ev)))
    seeds = nodes.select("page_id").distinct().select("page_id", F.lit(16).alias("sx"), F.lit(12).alias("sy"))
    start = graph.with_node(runs.nearest_run(nodes, seeds)).select("page_id", "node")
    reached = graph.hop_distance(nodes, graph.run_edges(nodes), start)
    return nodes.join(reached, ["page_id", "node"])


@query("q_hops", f"WITH {_HOPS} SELECT nd.page_id, nd.pos, nd.lo, nd.hi, hp.dist FROM nd JOIN hp ON nd.page_id = hp.page_id AND nd.node = hp.node", recursive=True)
def q_hops(ev):
    return hops(ev).select("page_id", "pos", "lo", "hi", "dist")


@query("q_walk", f"""WITH {_HOPS}
    SELECT s.page_id, s.ord, CAST(min(hp.dist) AS INTEGER) AS walk_d FROM v_spot s LEFT JOIN (nd JOIN hp ON nd.page_id = hp.page_id AND nd.node = hp.node)
      ON s.page_id = nd.page_id AND nd.pos >= greatest(s.y - 3, 0) AND nd.pos < s.y + 3 AND nd.lo < s.x + 3 AND nd.hi >= greatest(s.x - 3, 0)
    GROUP BY s.page_id, s.ord""", recursive=True)
def q_walk(ev):
    near = runs.walk_distance(ev.v_spot, hops(ev).select("page_id", "pos", "lo", "hi", "dist"), r=3)
    return near.select("page_id", "ord", F.col("walk_d").cast("int").alias("walk_d"))


@query("q_dark_core", f"""WITH {_LABELS.format(src=_COL_PX)},
    v AS (SELECT cc.page_id, cc.label, v.x, v.y, {_LUMA} AS luma FROM cc JOIN v_pixel v ON cc.page_id = v.page_id AND cc.x = v.x AND cc.y = v.y),
    q AS (SELECT page_id, label, quantile_cont(luma, 0.25) AS lim FROM v GROUP BY page_id, label)
    SELECT v.page_id, v.label, v.x, v.y, CAST(v.luma AS INTEGER) AS luma FROM v JOIN q ON v.page_id = q.page_id AND v.label = q.label WHERE v.luma < q.lim""", recursive=True)
def q_dark_core(ev):
    labelled = graph.label_pixels(pixels.mask_chan_diff(ev.v_pixel, 90))
    return pixels.dark_core(labelled).select("page_id", raster(F.col("label")).alias("label"), "x", "y", "luma")


_CLASSED = """m AS (SELECT page_id, x, y, l, CASE WHEN g > 120 AND r < 110 AND b < 110 THEN 'green' WHEN r > 120 AND g < 110 AND b < 110 THEN 'red'
      WHEN g > 120 AND b > 120 AND r < 110 THEN 'cyan' WHEN r > 120 AND g > 120 AND b < 110 THEN 'yellow' END AS colour FROM
      (SELECT *, {luma} AS l FROM v_pixel))""".format(luma=_LUMA)


@query("q_lum_core", f"""WITH {_CLASSED},
    t AS (SELECT page_id, colour, median(l) AS med FROM m WHERE colour IS NOT NULL GROUP BY page_id, colour),
    i AS (SELECT page_id, CAST(floor(median(b) FILTER ({_LUMA} < 150 AND {_DIFF} <= 40)) AS INTEGER) AS ink FROM v_pixel GROUP BY page_id)
    SELECT m.page_id, m.colour, count(*) FILTER (m.l < 120) AS fixed, count(*) FILTER (m.l < t.med) AS adaptive,
      count(*) FILTER (m.l < CASE WHEN m.colour = 'green' THEN 121.5 ELSE t.med END) AS sampled, coalesce(any_value(i.ink), 30) AS ink
    FROM m JOIN t ON m.page_id = t.page_id AND m.colour = t.colour JOIN i ON m.page_id = i.page_id GROUP BY m.page_id, m.colour""")
def q_lum_core(ev):
    masked = ev.v_pixel.withColumn("colour", colour.colour_class()).filter("colour is not null")
    legend = ev.spark.createDataFrame([("green", 0, 0, 0)], "colour string, b int, g int, r int").select(
        "colour", (F.col("b") + 15).alias("b"), (F.col("g") + 204).alias("g"), (F.col("r") + 0).alias("r"))
    ink = pixels.base_color(ev.v_pixel).select("page_id", F.col("b").alias("ink"))
    count = lambda df, name: df.groupBy("page_id", "colour").agg(F.count("*").alias(name))
    out = masked.select("page_id", "colour").distinct()
    for name, kept in (("fixed", pixels.luminance_core(masked)), ("adaptive", pixels.luminance_core(masked, adaptive=True)),
                       ("sampled", pixels.luminance_core(masked, legend=legend))):
        out = out.join(count(kept, name), ["page_id", "colour"], "left")
    return out.fillna(0, ["fixed", "adaptive", "sampled"]).join(ink, "page_id")


@query("q_cells", f"""
    SELECT page_id, x // 8 AS gx, y // 8 AS gy, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, CAST(floor(median(b)) AS INTEGER) AS b,
      CAST(floor(median(g)) AS INTEGER) AS g, CAST(floor(median(r)) AS INTEGER) AS r FROM v_pixel WHERE {_DIFF} > 40
    GROUP BY ALL HAVING least(max(x) - min(x), max(y) - min(y)) + 1 >= 4""")
def q_cells(ev):
    return pixels.grid_cells(pixels.mask_chan_diff(ev.v_pixel), 8, 4)


_AFTER = f"(SELECT page_id, x, y, b, g, CASE WHEN {_DIFF} > 120 THEN 255 ELSE r END AS r FROM v_pixel)"


@query("q_cleanup", f"""WITH {_LABELS.format(src=_DARK_PX)},
    n AS (SELECT page_id, label, count(*) AS area FROM cc GROUP BY page_id, label),
    mn AS (SELECT page_id, max(area) AS area, arg_min(label, -area * 10000 + label) AS label FROM n GROUP BY page_id),
    af AS {_AFTER},
    kp AS (SELECT cc.page_id, cc.x, cc.y FROM cc JOIN mn ON cc.page_id = mn.page_id AND cc.label = mn.label
      JOIN af ON cc.page_id = af.page_id AND cc.x = af.x AND cc.y = af.y WHERE {_LUMA} < 150),
    kb AS (SELECT a.page_id, a.y * 64 + a.x AS p, b.y * 64 + b.x AS q FROM kp a JOIN kp b ON a.page_id = b.page_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
    kl(it, page_id, p, label, moved) AS (
      SELECT 0, page_id, y * 64 + x, y * 64 + x, true FROM kp
      UNION ALL
      SELECT c.it + 1, c.page_id, c.p, n.label, n.label < c.label FROM kl c JOIN (
        SELECT kb.page_id, kb.p, min(o.label) AS label FROM kb JOIN kl o ON kb.page_id = o.page_id AND kb.q = o.p GROUP BY kb.page_id, kb.p) n
        ON c.page_id = n.page_id AND c.p = n.p WHERE EXISTS (SELECT 1 FROM kl z WHERE z.moved)),
    ks AS (SELECT page_id, count(DISTINCT p) AS kept, count(DISTINCT label) AS pieces FROM (SELECT page_id, p, min(label) AS label FROM kl GROUP BY page_id, p) GROUP BY page_id),
    rs AS (SELECT page_id, count(*) FILTER ({_LUMA} < 150 AND {_DIFF} > 40) AS colored_resid, count(*) FILTER ({_DIFF} > 10 AND {_DIFF} <= 40) AS light_resid FROM af GROUP BY page_id)
    SELECT mn.page_id, round_even(coalesce(ks.kept, 0)::DOUBLE / mn.area * 10000, 0) / 10000 AS main_kept, coalesce(ks.pieces, 0) AS main_cc,
      rs.colored_resid, rs.light_resid FROM mn LEFT JOIN ks ON mn.page_id = ks.page_id LEFT JOIN rs ON mn.page_id = rs.page_id""", recursive=True)
def q_cleanup(ev):
    px = ev.v_pixel
    before = graph.label_runs(pixels.dark_mask(px, DARK))
    after = px.withColumn("r", F.when(pixels.spread() > 120, 255).otherwise(F.col("r")))
    return pixels.cleanup_metrics(before, after)


@query("q_bridges", f"""WITH {_LABELS.format(src=_COL_PX)}, {_LABELS.format(src=f"SELECT page_id, x, y FROM v_pixel WHERE {_LUMA} < 150 AND {_DIFF} <= 90").replace('px ', 'qx ').replace('px a', 'qx a').replace('px b', 'qx b').replace('nb ', 'ob ').replace('nb.', 'ob.').replace('lb', 'mb').replace('cc AS', 'dd AS').replace('FROM px', 'FROM qx')},
    e AS (SELECT cc.page_id, cc.label AS region, count(DISTINCT dd.label) AS wires FROM cc JOIN dd ON cc.page_id = dd.page_id AND abs(cc.x - dd.x) <= 1 AND abs(cc.y - dd.y) <= 1 GROUP BY ALL)
    SELECT page_id, region, wires, wires >= 2 AS bridge FROM e""", recursive=True)
def q_bridges(ev):
    coloured = pixels.spread() > 90
    px = cut(ev.v_pixel.select("page_id", "x", "y", coloured.alias("coloured"), (~coloured & (pixels.grey() < DARK)).alias("ink")).filter("coloured OR ink"))
    regions, ink = px.filter("coloured").select("page_id", "x", "y"), px.filter("ink").select("page_id", "x", "y")
    found = graph.run_bridges(graph.label_runs(regions), graph.label_runs(ink))
    return found.withColumn("region", raster(F.col("region")))


@query("q_degree", f"""
    WITH d AS (SELECT page_id, x, y FROM v_pixel WHERE {_LUMA} < 150)
    SELECT a.page_id, a.x, a.y, CAST(count(b.x) AS BIGINT) AS degree, CASE WHEN count(b.x) = 1 THEN 'end' WHEN count(b.x) >= 3 THEN 'junction' END AS node_kind
    FROM d a LEFT JOIN d b ON a.page_id = b.page_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND (a.x <> b.x OR a.y <> b.y) GROUP BY a.page_id, a.x, a.y""")
def q_degree(ev):
    return graph.degree_nodes(pixels.dark_mask(ev.v_pixel, DARK))


@query("q_set_algebra", f"""
    WITH a AS (SELECT page_id, x, y FROM v_pixel WHERE {_DIFF} > 40), b AS (SELECT page_id, x, y FROM v_pixel WHERE {_LUMA} < 150),
    z AS (SELECT page_id, greatest(x0 - (x1 - x0) // 4, 0) AS x0, greatest(y0 - (y1 - y0) // 4, 0) AS y0, least(x1 + (x1 - x0) // 4, 64) AS x1, least(y1 + (y1 - y0) // 4, 48) AS y1
      FROM (SELECT page_id, x AS x0, y AS y0, least(x + 4 + ord % 5, 64) AS x1, least(y + 4 + ord % 3, 48) AS y1 FROM v_spot))
    SELECT 'and' AS op, * FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'or', * FROM (SELECT * FROM a UNION SELECT * FROM b)
    UNION ALL SELECT 'minus', * FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
    UNION ALL SELECT 'roi', a.* FROM a WHERE EXISTS (SELECT 1 FROM z WHERE z.page_id = a.page_id AND a.x >= z.x0 AND a.x < z.x1 AND a.y >= z.y0 AND a.y < z.y1)""")
def q_set_algebra(ev):
    a = pixels.mask_chan_diff(ev.v_pixel).select("page_id", "x", "y")
    b = pixels.dark_mask(ev.v_pixel, DARK).select("page_id", "x", "y")
    regions = ev.v_spot.select("page_id", F.struct(
        F.col("x").alias("x0"), F.col("y").alias("y0"), F.least(F.col("x") + 4 + F.col("ord") % 5, F.lit(PAGE_W)).alias("x1"),
        F.least(F.col("y") + 4 + F.col("ord") % 3, F.lit(PAGE_H)).alias("y1")).alias("bbox"))
    rois = pixels.roi_expand(regions, PAGE_W, PAGE_H)
    tag = lambda df, op: df.select(F.lit(op).alias("op"), "page_id", "x", "y")
    return (tag(pixels.mask_and(a, b), "and").unionByName(tag(pixels.mask_or(a, b), "or"))
            .unionByName(tag(pixels.mask_minus(a, b), "minus")).unionByName(tag(pixels.mask_in_rois(a, rois), "roi")))


def _side(x0, x1, y0, y1):
    return f"EXISTS (SELECT 1 FROM d WHERE d.page_id = s.page_id AND d.x >= {x0} AND d.x < {x1} AND d.y >= {y0} AND d.y < {y1})"


_MEMBER = f"""d AS (SELECT page_id, x, y FROM v_pixel WHERE {_DIFF} > 90),
    f AS (SELECT s.*, {_side('s.x - 3', 's.x + 3', 's.y - 3', 's.y + 3')} AS touch, {_side('least(s.x + 3, 63)', 'least(s.x + 8, 63)', 's.y - 2', 's.y + 2')} AS e,
      {_side('greatest(s.x - 8, 0)', 'greatest(s.x - 3, 0)', 's.y - 2', 's.y + 2')} AS w_, {_side('s.x - 2', 's.x + 2', 'greatest(s.y - 8, 0)', 'greatest(s.y - 3, 0)')} AS n,
      {_side('s.x - 2', 's.x + 2', 'least(s.y + 3, 47)', 'least(s.y + 8, 47)')} AS so FROM v_spot s)"""


@query("q_membership", f"""WITH {_MEMBER}
    SELECT page_id, ord, touch, e, w_ AS w, n, so AS s, CASE WHEN NOT touch THEN 'none' WHEN (e AND w_) OR (n AND so) THEN 'flow_through' WHEN e OR w_ OR n OR so THEN 'branch' ELSE 'none' END AS membership,
      CASE WHEN touch AND e AND w_ THEN 'H' WHEN touch AND n AND so THEN 'V' END AS flow_dir FROM f""")
def q_membership(ev):
    line = runs.runs(pixels.mask_chan_diff(ev.v_pixel, 90))
    seen = runs.side_evidence(ev.v_spot.select("page_id", "ord", "x", "y"), line, 3, 2, (3, 8), PAGE_W, PAGE_H)
    return runs.membership(seen).select("page_id", "ord", "touch", "e", "w", "n", "s", "membership", "flow_dir")


@query("q_touch", f"""WITH d AS (SELECT page_id, x, y FROM v_pixel WHERE {_DIFF} > 90) SELECT s.page_id, s.ord FROM v_spot s WHERE {_side('s.x - 1', 's.x + 1', 's.y - 1', 's.y + 1')}""")
def q_touch(ev):
    return runs.touch(ev.v_spot.select("page_id", "ord", "x", "y"), runs.runs(pixels.mask_chan_diff(ev.v_pixel, 90)), 1).select("page_id", "ord")


def _count(what, x0, x1, y0, y1):
    return (f"(SELECT count(*) FROM v_pixel v WHERE v.page_id = s.page_id AND v.x >= greatest(0, {x0}) AND v.x < {x1} AND v.y >= greatest(0, {y0}) AND v.y < {y1} AND {what})")


@query("q_evidence", f"""
    WITH s AS (SELECT *, 4 + ord % 5 AS gap, 6 + ord % 4 AS len, ord % 2 = 0 AS across FROM v_spot),
    g AS (SELECT *, greatest(2, gap // 2) // 2 AS hi_, greatest(6, gap // 2) AS ow, len // 2 AS hl, gap // 2 AS hg FROM s),
    n AS (SELECT s.page_id, s.ord,
      CASE WHEN across THEN {_count(_LUMA + ' < 150', 's.x - hi_', 's.x + hi_', 's.y - hl', 's.y + hl')} ELSE {_count(_LUMA + ' < 150', 's.x - hl', 's.x + hl', 's.y - hi_', 's.y + hi_')} END AS n_band,
      CASE WHEN across THEN {_count(_LUMA + ' < 150', 's.x - hg - ow', 's.x - hg', 's.y - hl', 's.y + hl')} ELSE {_count(_LUMA + ' < 150', 's.x - hl', 's.x + hl', 's.y - hg - ow', 's.y - hg')} END AS n_first,
      CASE WHEN across THEN {_count(_LUMA + ' < 150', 's.x + hg', 's.x + hg + ow', 's.y - hl', 's.y + hl')} ELSE {_count(_LUMA + ' < 150', 's.x - hl', 's.x + hl', 's.y + hg', 's.y + hg + ow')} END AS n_second,
      {_count(_DIFF + ' > 90', 's.x - 3', 's.x + 3', 's.y - 3', 's.y + 3')} AS n_touch,
      CASE WHEN across THEN (s.x + hi_ - greatest(0, s.x - hi_)) * (s.y + hl - greatest(0, s.y - hl)) ELSE (s.x + hl - greatest(0, s.x - hl)) * (s.y + hi_ - greatest(0, s.y - hi_)) END AS area, x, y FROM g s)
    SELECT page_id, ord, n_band, n_first, n_second, n_touch, CAST(abs(x - 16) + abs(y - 12) + CASE WHEN n_band::DOUBLE / area <= 0.25 THEN 0 ELSE 120 END
      + CASE WHEN n_first >= 2 AND n_second >= 2 THEN 0 ELSE 60 END + CASE WHEN n_touch > 0 THEN 0 ELSE 40 END AS BIGINT) AS score FROM n""")
def q_evidence(ev):
    cands = ev.v_spot.select("page_id", "ord", "x", "y", (F.col("ord") % 5 + 4).alias("gap"), (F.col("ord") % 4 + 6).alias("len"),
                             F.when(F.col("ord") % 2 == 0, "h").otherwise("v").alias("dir"))
    b, g, r = (F.col(c).cast("int") for c in "bgr")
    seen = associate.window_evidence(cands, ev.v_pixel, colour.luma(b, g, r) < DARK, colour.chan_diff(b, g, r) > 90, touch_r=3)
    dist = F.abs(F.col("x") - 16) + F.abs(F.col("y") - 12)
    score = shapes.penalty_score(dist, F.col("gap_empty"), F.col("leads"), F.col("touches"))
    return seen.select("page_id", "ord", "n_band", "n_first", "n_second", "n_touch", score.alias("score"))


@query("q_net_of_symbol", f"""WITH {_LABELS.format(src=_DARK_PX)}
    SELECT s.page_id, s.ord, c.label AS net, a.label AS net_a, b.label AS net_b, coalesce(a.label <> b.label, false) AS bridges
    FROM v_spot s LEFT JOIN cc c ON s.page_id = c.page_id AND s.x = c.x AND s.y = c.y
    LEFT JOIN cc a ON s.page_id = a.page_id AND s.x - 2 = a.x AND s.y = a.y LEFT JOIN cc b ON s.page_id = b.page_id AND s.x + 2 = b.x AND s.y = b.y""", recursive=True)
def q_net_of_symbol(ev):
    labelled = cut(graph.label_runs(pixels.dark_mask(ev.v_pixel, DARK)).withColumn("label", raster(F.col("label"))))
    spots = ev.v_spot.select("page_id", "ord", "x", "y")
    on = runs.net_of_symbol(spots, labelled).select("page_id", "ord", "net")
    return on.join(runs.net_bridge(spots, labelled, 2), ["page_id", "ord"])
