"""Queries over board evidence: hits, detections, registry, index, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import shapes, text
from ..operators import associate, packages, quality, registry
from ..operators.ordered import first_per
from ..sources.readers import number_words
from .bindings import Evidence
from .catalogue import query
from .pipelines import board_registry

# Fixture parameters shared by a query and its SQL.
BOARD_CENTRE = 2400
AGREE_TOL = 20


def best_hits(ev: Evidence):
    """One best hit per designator and view."""
    refs = registry.refs_of_hits(ev.v_hit)
    return registry.best_hit(refs.select("view_name", "refdes", "ord", "conf", "x", "y", "src_dpi"),
                             ["view_name", "refdes"])


_BEST = """best AS (SELECT view_name, text AS refdes, ord, conf, x, y, src_dpi FROM (
    SELECT *, row_number() OVER (PARTITION BY view_name, text ORDER BY conf DESC, ord) AS rn FROM v_hit) WHERE rn = 1)"""


@query("q_best_hit", f"WITH {_BEST} SELECT view_name, refdes, ord, conf, x, y, src_dpi FROM best")
def q_best_hit(ev):
    return best_hits(ev)


@query("q_merge_index", f"""WITH {_BEST} SELECT refdes, view_name, ord, conf, x, y FROM (
    SELECT *, row_number() OVER (PARTITION BY refdes ORDER BY coalesce(conf, 0) DESC,
        CASE WHEN view_name = 'top' THEN 0 ELSE 1 END, ord) AS rn FROM best) WHERE rn = 1""")
def q_merge_index(ev):
    """The known index of one view, a row replaced where another view's hit scores higher."""
    best = best_hits(ev).select("refdes", "view_name", "ord", "conf", "x", "y")
    return registry.merge_index(best.filter("view_name = 'top'"), best.filter("view_name <> 'top'"), "conf")


@query("q_agreement", f"""
    WITH p AS (SELECT DISTINCT view_name, text, engine, x, y FROM v_hit),
    a AS (SELECT q.view_name, q.text, q.x, q.y, count(DISTINCT o.engine) AS engines
          FROM (SELECT DISTINCT view_name, text, x, y FROM p) q JOIN p o
            ON q.view_name = o.view_name AND q.text = o.text AND abs(q.x - o.x) + abs(q.y - o.y) <= {AGREE_TOL}
          GROUP BY q.view_name, q.text, q.x, q.y)
    SELECT view_name, refdes, ord, conf, engines, agree FROM (
        SELECT h.view_name, h.text AS refdes, h.ord, h.conf, a.engines, a.engines >= 2 AS agree,
               row_number() OVER (PARTITION BY h.view_name, h.text
                                  ORDER BY CASE WHEN a.engines >= 2 THEN 0 ELSE 1 END, h.conf DESC, h.ord) AS rn
        FROM v_hit h JOIN a ON h.view_name = a.view_name AND h.text = a.text AND h.x = a.x AND h.y = a.y
        WHERE length(h.text) <= 6) WHERE rn = 1""")
def q_agreement(ev):
    hits = ev.v_hit.withColumn("refdes", F.col("text"))
    places = associate.engine_agreement(hits, AGREE_TOL)
    seen = hits.join(places, ["view_name", "refdes", "x", "y"])
    best = registry.best_agreed(seen.select("view_name", "refdes", "text", "ord", "conf", "engines", "agree"),
                                ["view_name", "refdes"])
    return best.select("view_name", "refdes", "ord", "conf", "engines", "agree")


def merged_registry(ev: Evidence):
    missing = ev.v_chain.select("device", "refdes", F.concat("refdes", F.lit(" not found")).alias("note"),
                                (F.col("chain_id") * 8 + F.col("idx")).alias("ord"))
    return board_registry(ev.v_hit, ev.v_anchor, missing, by=("device",))


_REGISTRY = """sch AS (SELECT device, text AS refdes, arg_min(x, ord) AS x, arg_min(y, ord) AS y FROM v_hit WHERE view_name = 'sch' GROUP BY device, text),
    anc AS (SELECT device, refdes, view_name, arg_max(x, ord) AS x, arg_max(y, ord) AS y FROM v_anchor GROUP BY device, refdes, view_name),
    top AS (SELECT device, text AS refdes, x, y FROM (
      SELECT *, row_number() OVER (PARTITION BY device, text ORDER BY conf DESC, ord) AS rn FROM v_hit WHERE view_name = 'top') WHERE rn = 1),
    mis AS (SELECT device, refdes, arg_max(concat(refdes, ' not found'), chain_id * 8 + idx) AS note FROM v_chain GROUP BY device, refdes),
    refs AS (SELECT device, refdes FROM sch UNION SELECT device, refdes FROM anc UNION SELECT device, refdes FROM top UNION SELECT device, refdes FROM mis),
    reg AS (SELECT r.device, r.refdes, s.x AS sch_x, coalesce(t.x, h.x) AS top_x, coalesce(t.y, h.y) AS top_y, b.x AS bot_x,
        CASE WHEN t.refdes IS NOT NULL OR b.refdes IS NOT NULL THEN 'confirmed' WHEN m.note IS NOT NULL THEN 'unverified'
             WHEN h.refdes IS NOT NULL THEN 'ocr_hit' ELSE 'schematic_only' END AS status,
        coalesce(m.note, '') AS note
      FROM refs r LEFT JOIN sch s ON r.device = s.device AND r.refdes = s.refdes
      LEFT JOIN (SELECT * FROM anc WHERE view_name = 'top') t ON r.device = t.device AND r.refdes = t.refdes
      LEFT JOIN (SELECT * FROM anc WHERE view_name = 'bot') b ON r.device = b.device AND r.refdes = b.refdes
      LEFT JOIN top h ON r.device = h.device AND r.refdes = h.refdes LEFT JOIN mis m ON r.device = m.device AND r.refdes = m.refdes)"""


@query("q_registry", f"""WITH {_REGISTRY}
    SELECT device, refdes, CASE WHEN refdes LIKE 'IC%' THEN 'IC' WHEN refdes LIKE 'Q%' THEN 'transistor'
        WHEN refdes LIKE 'R%' THEN 'resistor' WHEN refdes LIKE 'C%' THEN 'capacitor' WHEN refdes LIKE 'L%' THEN 'inductor'
        WHEN refdes LIKE 'D%' THEN 'diode' WHEN refdes LIKE 'F%' THEN 'filter' ELSE 'other' END AS type,
      status, note, CAST(sch_x AS DOUBLE) AS sch_x, CAST(top_x AS DOUBLE) AS top_x, CAST(top_y AS DOUBLE) AS top_y,
      CAST(bot_x AS DOUBLE) AS bot_x,
      sch_x IS NOT NULL AND (top_x IS NOT NULL OR bot_x IS NOT NULL) AS linked FROM reg""")
def q_registry(ev):
    reg = merged_registry(ev)
    at = lambda view, c: F.try_element_at("views", F.lit(view))["px"][c]
    return reg.select("device", "refdes", "type", "status", "note", at("schematic", "x").alias("sch_x"),
                      at("pcb_top", "x").alias("top_x"), at("pcb_top", "y").alias("top_y"),
                      at("pcb_bot", "x").alias("bot_x"), registry.is_linked(F.col("views")).alias("linked"))


@query("q_registry_summary", f"""WITH {_REGISTRY}
    SELECT device, count(*) AS components, count(*) FILTER (status = 'confirmed') AS confirmed,
      count(*) FILTER (status = 'ocr_hit') AS ocr_hit, count(*) FILTER (status = 'unverified') AS unverified,
      count(*) FILTER (status = 'schematic_only') AS schematic_only,
      count(*) FILTER (sch_x IS NOT NULL AND (top_x IS NOT NULL OR bot_x IS NOT NULL)) AS linked FROM reg GROUP BY device""")
def q_registry_summary(ev):
    return registry.registry_summary(merged_registry(ev), by=["device"])


_CLASS = """CASE WHEN area > 15120000 THEN 'board'
      WHEN area > 50000 THEN CASE WHEN aspect < 4 AND fill > 0.85 THEN 'ic' ELSE 'large_passive' END
      WHEN area >= 5000 THEN CASE WHEN aspect < 4 AND fill > 0.85 THEN 'ic' WHEN aspect >= 4 AND fill > 0.7 THEN 'resistor'
        WHEN aspect < 3 AND fill > 0.8 THEN 'inductor' ELSE 'medium_passive' END
      WHEN area >= 1000 THEN CASE WHEN aspect >= 4 AND fill > 0.6 THEN 'resistor' WHEN aspect < 3 AND fill > 0.75 THEN 'capacitor'
        ELSE 'small_passive' END
      WHEN area >= 300 THEN CASE WHEN aspect >= 3 THEN 'trace_segment' ELSE 'tiny_passive' END ELSE 'unknown' END"""
_METRICS = """m AS (SELECT *, round_even(CAST(greatest(w, h) AS DOUBLE) / least(w, h) * 100, 0) / 100 AS aspect,
      round_even(area / (w * h) * 100, 0) / 100 AS fill FROM v_box)"""
_CIRCLE = """CASE WHEN w < 15 THEN 'via' WHEN w < 30 THEN 'test_point' WHEN w < 80 AND area > 3000 THEN 'crystal'
      WHEN w < 80 THEN 'inductor_round' WHEN w < 150 THEN 'capacitor_elec' ELSE 'large_circle' END"""
BOARD_AREA = 4800 * 6300


def classified(ev: Evidence):
    box = ev.v_box.withColumn("m", shapes.shape_metrics(F.col("w"), F.col("h"), F.col("area")))
    box = box.select("*", "m.aspect", F.col("m.rectangularity").alias("fill")).drop("m")
    return box.withColumn("category", shapes.classify_rect(F.col("area"), F.col("aspect"), F.col("fill"), BOARD_AREA))


@query("q_classify", f"""WITH {_METRICS}
    SELECT page_id, ord, aspect, fill, {_CLASS} AS category, {_CIRCLE} AS circle_class,
      round_even(4 * pi() * area / (CAST(2 * (w + h) AS DOUBLE) * (2 * (w + h))) * 1000, 0) / 1000 AS circularity,
      row_number() OVER (PARTITION BY page_id ORDER BY area DESC, ord) - 1 AS idx FROM m
    WHERE area BETWEEN 300 AND 200000 AND least(w, h) >= 5 AND CAST(greatest(w, h) AS DOUBLE) / least(w, h) <= 10
      AND area / (w * h) >= 0.4""")
def q_classify(ev):
    kept = registry.shape_filter(classified(ev))
    perimeter = (F.col("w") + F.col("h")) * 2
    kept = kept.withColumn("circle_class", shapes.classify_circle(F.col("w"), F.col("area"))).withColumn(
        "circularity", shapes.circularity(F.col("area"), perimeter.cast("double")))
    ranked = registry.index_by_area(kept, "page_id")
    return ranked.select("page_id", "ord", "aspect", "fill", "category", "circle_class", "circularity", "idx")


@query("q_category_counts", f"WITH {_METRICS} SELECT category, count(*) AS n FROM (SELECT {_CLASS} AS category FROM m) GROUP BY 1")
def q_category_counts(ev):
    return registry.category_counts(classified(ev))


@query("q_index_summary", f"""WITH {_BEST}
    SELECT count(*) AS total, count(*) FILTER (view_name = 'top') AS in_top, count(*) FILTER (view_name = 'bot') AS in_bot,
      count(*) FILTER (view_name = 'sch') AS in_sch, count(*) FILTER (src_dpi = 600) AS with_role,
      count(*) FILTER (conf >= 0.5) AS validated FROM best""")
def q_index_summary(ev):
    index = best_hits(ev).withColumn("role", F.when(F.col("src_dpi") == 600, "main")).withColumn(
        "validated", F.col("conf") >= 0.5)
    return registry.index_summary(index)


@query("q_coords", """
    WITH c AS (SELECT ord, src_dpi, x, y, CASE ord % 3 WHEN 0 THEN 0 WHEN 1 THEN 90 ELSE 270 END AS rot FROM v_hit),
    u AS (SELECT *, CASE rot WHEN 90 THEN y WHEN 270 THEN 2099 - y ELSE x END AS ux,
      CASE rot WHEN 90 THEN 1599 - x WHEN 270 THEN x ELSE y END AS uy,
      CASE rot WHEN 90 THEN 0 WHEN 270 THEN 0 ELSE 30 END AS ex, CASE rot WHEN 90 THEN -30 WHEN 270 THEN 30 ELSE 0 END AS ey,
      CASE rot WHEN 90 THEN 10 WHEN 270 THEN -10 ELSE 0 END AS fx, CASE rot WHEN 90 THEN 0 WHEN 270 THEN 0 ELSE 10 END AS fy FROM c)
    SELECT ord, round(x * (600.0::DOUBLE / src_dpi), 4) AS x600, round(CAST(x AS DOUBLE) / src_dpi * 72, 4) AS x_pt,
      round(CAST(y AS DOUBLE) / src_dpi, 4) AS y_inch,
      CAST(round_even((4 * ux + 2 * ex + 2 * fx) / 4.0 + 100, 0) AS BIGINT) AS cx,
      CAST(round_even((4 * uy + 2 * ey + 2 * fy) / 4.0 + 200, 0) AS BIGINT) AS cy,
      CAST(least(ux, ux + ex, ux + fx, ux + ex + fx) + 100 AS BIGINT) AS x0,
      CAST(greatest(uy, uy + ey, uy + fy, uy + ey + fy) + 200 AS BIGINT) AS y1, src_dpi AS name_dpi FROM u""")
def q_coords(ev):
    rot = F.when(F.col("ord") % 3 == 0, 0).when(F.col("ord") % 3 == 1, 90).otherwise(270)
    x, y = F.col("x"), F.col("y")
    polygon = F.array(geo.point(x, y), geo.point(x + 30, y), geo.point(x + 30, y + 10), geo.point(x, y + 10))
    board = geo.crop_to_board(geo.unrotate(polygon, rot, 2100, 1600), 100, 200)
    at = geo.point(x, y)
    out = ev.v_hit.select("ord", "src_dpi", at.alias("p"), board.alias("box"),
                          F.concat(F.lit("scan_"), F.col("src_dpi"), F.lit("dpi.png")).alias("file"))
    p, box = F.col("p"), F.col("box")
    return out.select("ord", F.round(geo.rescale(p, F.col("src_dpi"), 600)["x"], 4).alias("x600"),
                      F.round(geo.px_to_pt(p, F.col("src_dpi"))["x"], 4).alias("x_pt"),
                      F.round(geo.px_to_inch(p, F.col("src_dpi"))["y"], 4).alias("y_inch"),
                      geo.box_center(box)["x"].alias("cx"), geo.box_center(box)["y"].alias("cy"),
                      geo.box_bounds(box)["x0"].alias("x0"), geo.box_bounds(box)["y1"].alias("y1"),
                      text.dpi_from_name(F.col("file")).alias("name_dpi"))


@query("q_crops", """
    WITH g AS (SELECT *, greatest(0, least(50, x0, y0, 5000 - (x0 + w), 6500 - (y0 + h))) AS pad FROM v_box)
    SELECT ord, greatest(0, x0 - pad) AS cx0, greatest(0, y0 - pad) AS cy0, least(5000, x0 + w + pad) AS cx1,
      least(6500, y0 + h + pad) AS cy1, greatest(0, x0 - CAST(floor(w * 0.5 / 2) AS BIGINT)) AS sx0,
      least(6500, y0 + h + CAST(floor(h * 0.5 / 2) AS BIGINT)) AS sy1,
      printf('r%04d_%s_%dx%d_w%dh%d.png', ord, kind, x0 + w // 2, y0 + h // 2, w, h) AS crop FROM g""")
def q_crops(ev):
    box = geo.box(F.col("x0"), F.col("y0"), F.col("x0") + F.col("w"), F.col("y0") + F.col("h"))
    rows = ev.v_box.select("*", geo.pad_bbox(box, 50, 5000, 6500).alias("p"), geo.scale_bbox(box, 1.5, 5000, 6500).alias("s"))
    mid = lambda o, s: (F.col(o) + F.floor(F.col(s) / 2)).cast("long")
    return rows.select("ord", F.col("p.x0").alias("cx0"), F.col("p.y0").alias("cy0"), F.col("p.x1").alias("cx1"),
                       F.col("p.y1").alias("cy1"), F.col("s.x0").alias("sx0"), F.col("s.y1").alias("sy1"),
                       text.crop_name(F.col("ord"), F.col("kind"), mid("x0", "w"), mid("y0", "h"), F.col("w"), F.col("h")).alias("crop"))


@query("q_filters", """
    WITH b AS (SELECT * FROM (VALUES ('top', 100, 100, 1200, 1800), ('bot', 0, 300, 1500, 2000)) t(view_name, bx0, by0, bx1, by1))
    SELECT h.ord, h.view_name, upper(split_part(h.text, '_', 1)) AS ref_key,
      CASE WHEN h.x % 150 > 100 THEN 'ic' WHEN h.x % 150 > 60 THEN 'mid' ELSE 'small' END AS gap_kind
    FROM v_hit h JOIN b ON h.view_name = b.view_name
    WHERE h.x BETWEEN b.bx0 AND b.bx1 AND h.y BETWEEN b.by0 AND b.by1 AND length(h.text) <= 4 AND h.x >= 500""")
def q_filters(ev):
    boards = ev.spark.createDataFrame([("top", 100, 100, 1200, 1800), ("bot", 0, 300, 1500, 2000)],
                                      "view_name string, bx0 int, by0 int, bx1 int, by1 int")
    hits = registry.refdes_like(registry.inside_board(ev.v_hit, boards)).filter(F.length("text") <= 4)
    hits = registry.min_area(hits.withColumn("area", F.col("x")), 500)
    return hits.select("ord", "view_name", text.norm_key(F.col("text")).alias("ref_key"),
                       shapes.gap_class(F.col("x") % 150).alias("gap_kind"))


@query("q_first", """SELECT text, ord, engine, view_name, x, y FROM (
    SELECT *, row_number() OVER (PARTITION BY text ORDER BY ord) AS rn FROM v_hit) WHERE rn = 1""")
def q_first(ev):
    return first_per(ev.v_hit.select("text", "ord", "engine", "view_name", "x", "y"), ["text"], ["ord"])


@query("q_chain_refs", """
    WITH e AS (SELECT chain_id, idx, concat(refdes, ' via ', 'IC', CAST(chain_id % 400 AS STRING), '/Z9') AS elem FROM v_chain),
    u AS (SELECT DISTINCT text AS refdes FROM v_hit)
    SELECT chain_id, idx, elem, refdes, pos FROM (
      SELECT chain_id, idx, elem, unnest(regexp_extract_all(elem, '[A-Z]{1,3}[0-9]{1,4}[A-Z]?')) AS refdes,
             CAST(unnest(range(len(regexp_extract_all(elem, '[A-Z]{1,3}[0-9]{1,4}[A-Z]?')))) AS INTEGER) AS pos FROM e)
    WHERE refdes IN (SELECT refdes FROM u)""")
def q_chain_refs(ev):
    elem = F.concat("refdes", F.lit(" via IC"), (F.col("chain_id") % 400).cast("string"), F.lit("/Z9"))
    elements = ev.v_chain.select("chain_id", "idx", elem.alias("elem"))
    known = ev.v_hit.select(F.col("text").alias("refdes"))
    return registry.chain_refs(elements, known, ["chain_id"]).select("chain_id", "idx", "elem", "refdes", "pos")


# Texts read in the crop of each detection: one per order line of its part.
_CROP_TEXTS = """SELECT b.page_id AS source, b.ord AS idx, l_orderkey * 8 + l_linenumber AS ord,
        concat('IC', CAST(l_suppkey % 300 AS STRING)) AS text FROM lineitem JOIN v_box b ON l_partkey = b.ord"""


@query("q_crop_match", f"""
    WITH d AS (SELECT page_id AS source, ord AS idx, ord FROM v_box),
    t AS ({_CROP_TEXTS}),
    w AS (SELECT DISTINCT refdes FROM v_anchor WHERE refdes LIKE 'IC%'),
    m AS (SELECT source, idx, arg_min(text, ord) AS refdes FROM t WHERE text IN (SELECT refdes FROM w) GROUP BY source, idx),
    j AS (SELECT d.source, d.idx, d.ord, m.refdes FROM d JOIN m ON d.source = m.source AND d.idx = m.idx),
    c AS (SELECT j.source, j.idx, j.refdes, count(*) AS n, bool_or(t.text = j.refdes) AS named
          FROM j JOIN t ON j.source = t.source AND j.idx = t.idx GROUP BY 1, 2, 3)
    SELECT j.source, j.idx, j.ord, j.refdes, coalesce(c.named AND c.n <= 31, false) AS confirmed
    FROM j LEFT JOIN c ON j.source = c.source AND j.idx = c.idx AND j.refdes = c.refdes""")
def q_crop_match(ev):
    det = ev.v_box.select(F.col("page_id").alias("source"), F.col("ord").alias("idx"), "ord")
    texts = ev.sql(_CROP_TEXTS)
    wanted = ev.v_anchor.filter(F.startswith("refdes", F.lit("IC"))).select("refdes")
    found = packages.crop_match(det, texts, wanted)
    sure = packages.confirm_only(found, texts, noise=30).select("source", "idx", F.lit(True).alias("_c"))
    return found.join(sure, ["source", "idx"], "left").select(
        "source", "idx", "ord", "refdes", F.coalesce("_c", F.lit(False)).alias("confirmed"))


@query("q_by_category", f"WITH {_METRICS} SELECT ord, category FROM (SELECT ord, {_CLASS} AS category FROM m) WHERE category IN ('ic', 'resistor')")
def q_by_category(ev):
    return registry.by_category(classified(ev), ["ic", "resistor"]).select("ord", "category")


@query("q_text_find", """
    WITH h AS (SELECT *, CAST(floor(ord / 600000000) AS BIGINT) AS page_id FROM v_hit),
    b AS (SELECT CAST(s_suppkey AS BIGINT) AS page_id, s_suppkey * 17 % 2000 AS bx0, s_suppkey * 23 % 2000 AS by0 FROM supplier),
    i AS (SELECT h.page_id, count(*) AS in_box, CAST(sum(CAST(floor(h.x * (600.0::DOUBLE / h.src_dpi)) AS BIGINT)) AS BIGINT) AS sum_x FROM h JOIN b ON h.page_id = b.page_id
          AND h.x * (600.0::DOUBLE / h.src_dpi) BETWEEN bx0 AND bx0 + 900 AND h.y * (600.0::DOUBLE / h.src_dpi) BETWEEN by0 AND by0 + 900 GROUP BY h.page_id),
    f AS (SELECT page_id, ord, text, CAST(floor(x * (600.0::DOUBLE / src_dpi)) AS BIGINT) AS x, CAST(floor(y * (600.0::DOUBLE / src_dpi)) AS BIGINT) AS y,
          row_number() OVER (PARTITION BY page_id ORDER BY ord) AS rn FROM h WHERE lower(text) LIKE '%ic1%')
    SELECT f.page_id, f.ord, f.text, f.x, f.y, i.in_box, i.sum_x FROM f LEFT JOIN i ON f.page_id = i.page_id WHERE rn = 1""")
def q_text_find(ev):
    hits = ev.v_hit.withColumn("page_id", F.floor(F.col("ord") / 600000000))
    boxes = ev.table("supplier").select(
        F.col("s_suppkey").cast("long").alias("page_id"), (F.col("s_suppkey") * 17 % 2000).alias("bx0"),
        (F.col("s_suppkey") * 23 % 2000).alias("by0"))
    boxes = boxes.select("*", (F.col("bx0") + 900).alias("bx1"), (F.col("by0") + 900).alias("by1"))
    inside = associate.texts_in_box(hits, boxes, 600).groupBy("page_id").agg(
        F.count("*").alias("in_box"), F.sum("x").alias("sum_x"))
    return associate.find_text(hits, "Ic1", 600).join(inside, "page_id", "left").select(
        "page_id", "ord", "text", "x", "y", "in_box", "sum_x")


_READS = "r AS (SELECT l_orderkey AS ord, concat(CASE l_partkey % 3 WHEN 0 THEN 'IC' WHEN 1 THEN 'C' ELSE 'L ' END, CAST(l_partkey % 40 AS STRING)) AS text FROM lineitem)"
_NORM = "translate({0}, 'IL', '11')"


@query("q_reads", f"""
    WITH {_READS},
    d AS (SELECT DISTINCT ord, text, translate(upper(replace(trim(text), ' ', '')), 'IL', '11') AS n FROM r),
    t AS (SELECT l.ord, l.refdes, coalesce(bool_or(d.n <> '' AND (contains({_NORM.format('l.refdes')}, d.n) OR contains(d.n, {_NORM.format('l.refdes')}))
            OR contains(d.text, 'FL-363')), false) AS reverse_ok,
          coalesce(bool_or(d.text = l.refdes), false) AS matched, count(d.text) AS texts,
          coalesce(bool_or(contains(d.text, l.refdes) OR contains(l.refdes, d.text) OR starts_with(d.text, substring(l.refdes, 1, 2))), false) AS fuzzy
          FROM v_label l LEFT JOIN d ON l.ord = d.ord GROUP BY l.ord, l.refdes)
    SELECT ord, refdes, reverse_ok, CASE WHEN matched THEN 'match' WHEN texts = 0 THEN 'not_found' ELSE 'mismatch' END AS verdict,
      CASE WHEN fuzzy THEN 'match' WHEN texts = 0 THEN 'not_found' ELSE 'mismatch' END AS fuzzy_verdict FROM t""")
def q_reads(ev):
    labels, reads = ev.v_label.select("ord", "refdes"), ev.sql(_READS[6:-1])
    exact = quality.read_back(labels, reads).select("ord", "refdes", "verdict")
    fuzzy = quality.read_back(labels, reads, fuzzy=True).select("ord", F.col("verdict").alias("fuzzy_verdict"))
    checked = quality.reverse_check(labels, reads).select("ord", "reverse_ok")
    return exact.join(fuzzy, "ord").join(checked, "ord")


@query("q_verify_summary", f"""
    WITH {_READS}, d AS (SELECT DISTINCT ord, text FROM r),
    t AS (SELECT l.ord, coalesce(bool_or(d.text = l.refdes), false) AS matched, count(d.text) AS texts
          FROM v_label l LEFT JOIN d ON l.ord = d.ord GROUP BY l.ord)
    SELECT count(*) AS total, count(*) FILTER (matched) AS "match", count(*) FILTER (NOT matched AND texts > 0) AS mismatch,
      count(*) FILTER (NOT matched AND texts = 0) AS not_found FROM t""")
def q_verify_summary(ev):
    return quality.verify_summary(quality.read_back(ev.v_label.select("ord", "refdes"), ev.sql(_READS[6:-1])))


@query("q_relocate", f"""
    WITH {_READS},
    c AS (SELECT l.* FROM v_label l WHERE NOT EXISTS (SELECT 1 FROM (
            SELECT ord, text, translate(upper(replace(trim(text), ' ', '')), 'IL', '11') AS n FROM r) d
          WHERE d.ord = l.ord AND d.n <> '' AND (contains({_NORM.format('l.refdes')}, d.n) OR contains(d.n, {_NORM.format('l.refdes')})))),
    k AS (SELECT c.page_id, c.ord, c.refdes, c.x, c.y, s.ord AS symbol, s.x0 AS sx, s.y0 AS sy,
          abs(c.x - s.x0) + abs(c.y - s.y0) AS distance,
          row_number() OVER (PARTITION BY c.ord ORDER BY abs(c.x - s.x0) + abs(c.y - s.y0), s.ord) AS rn
          FROM c JOIN v_box s ON c.page_id = s.page_id),
    g AS (SELECT * FROM k WHERE rn <= 10 AND NOT (sx BETWEEN x AND x + 200 AND sy BETWEEN y AND y + 200)
          AND contains(translate(refdes, 'IL', '11'), translate(substring('CRLQID', CAST(symbol % 6 AS INTEGER) + 1, 1), 'IL', '11')))
    SELECT page_id, ord, refdes, symbol, sx AS symbol_x, sy AS symbol_y, distance FROM (
      SELECT *, row_number() OVER (PARTITION BY ord ORDER BY distance, symbol) AS pick FROM g) WHERE pick = 1""")
def q_relocate(ev):
    x, y = F.col("x"), F.col("y")
    checked = quality.reverse_check(ev.v_label, ev.sql(_READS[6:-1]))
    failed = checked.filter("NOT reverse_ok").withColumn("text_box", F.array(
        geo.point(x, y), geo.point(x + 200, y), geo.point(x + 200, y + 200), geo.point(x, y + 200)))
    boxes = ev.v_box.select("page_id", F.col("ord").alias("s_ord"), F.col("x0").alias("sx"), F.col("y0").alias("sy"))
    # Each symbol reads as one letter; the letter I counts as a one in both texts.
    reads = boxes.select("s_ord", F.substring(F.lit("CRLQID"), (F.col("s_ord") % 6).cast("int") + 1, F.lit(1)).alias("text"))
    out = quality.relocate(failed, boxes, reads)
    return out


@query("q_quality", f"""WITH {_BEST},
    v4 AS (SELECT text AS refdes, arg_min(x, ord) AS x, arg_min(y, ord) AS y FROM v_hit WHERE engine = 'v4' GROUP BY text),
    v6 AS (SELECT text AS refdes, arg_min(x, ord) * (2 + CAST(substring(text, 2, 1) = '1' AS INTEGER)) AS x,
           arg_min(y, ord) * (2 + CAST(substring(text, 2, 1) = '1' AS INTEGER)) AS y FROM v_hit WHERE engine = 'v4' GROUP BY text),
    mix AS (SELECT v4.refdes, CASE WHEN abs(CAST(v6.x AS DOUBLE) / v4.x - 2) <= 0.01 AND abs(CAST(v6.y AS DOUBLE) / v4.y - 2) <= 0.01 THEN 2.0::DOUBLE
        WHEN abs(CAST(v6.x AS DOUBLE) / v4.x - 3) <= 0.01 AND abs(CAST(v6.y AS DOUBLE) / v4.y - 3) <= 0.01 THEN 3.0::DOUBLE END AS ratio
        FROM v4 JOIN v6 ON v4.refdes = v6.refdes WHERE v4.x > 0 AND v4.y > 0),
    leak AS (SELECT text AS refdes, x, y, count(DISTINCT view_name) AS views FROM v_hit GROUP BY text, x, y HAVING count(DISTINCT view_name) > 1)
    SELECT 'dpi_mixup' AS rule, refdes, CAST(ratio AS BIGINT) AS detail, CAST(1 AS BIGINT) AS n FROM mix WHERE ratio IS NOT NULL
    UNION ALL SELECT 'view_leak', refdes, max(views), count(*) FROM leak GROUP BY refdes
    UNION ALL SELECT rule, refdes, CAST(0 AS BIGINT), count(*) FROM (
      SELECT refdes, unnest(list_filter([CASE WHEN NOT (600.0 / src_dpi = 2) THEN 'scale' END, CASE WHEN src_dpi <> 300 THEN 'dpi' END,
         CASE WHEN NOT (x BETWEEN 50 AND 1500 AND y BETWEEN 50 AND 2000) THEN 'center' END,
         CASE WHEN NOT (x - 5 BETWEEN 50 AND 1500 AND x + 5 BETWEEN 50 AND 1500 AND y BETWEEN 50 AND 2000) THEN 'box' END], lambda t: t IS NOT NULL)) AS rule FROM best)
      GROUP BY rule, refdes
    UNION ALL SELECT 'missing_engine', refdes, CAST(0 AS BIGINT), count(*) FROM best WHERE conf = 0 GROUP BY refdes""")
def q_quality(ev):
    best = best_hits(ev)
    v4 = first_per(ev.v_hit.filter("engine = 'v4'").select(F.col("text").alias("refdes"), "ord", "x", "y"), ["refdes"], ["ord"])
    factor = F.when(F.substring("refdes", 2, 1) == "1", 3).otherwise(2)
    other = v4.select("refdes", (F.col("x") * factor).alias("x"), (F.col("y") * factor).alias("y"))
    mix = quality.dpi_mixups(v4, other).select(F.lit("dpi_mixup").alias("rule"), "refdes",
                                               F.col("ratio").cast("long").alias("detail"), F.lit(1).cast("long").alias("n"))
    leaks = quality.view_leaks(ev.v_hit.withColumn("refdes", F.col("text"))).groupBy("refdes").agg(
        F.max("views").alias("detail"), F.count("*").alias("n")).select(F.lit("view_leak").alias("rule"), "refdes", "detail", "n")
    x, y = F.col("x"), F.col("y")
    rows = best.select(
        "refdes", "x", "y", "conf", F.lit(2.0).alias("scale"), "src_dpi", F.lit(600).alias("tgt_dpi"),
        (F.col("src_dpi") * 2).alias("tgt_image_dpi"), F.lit(1).alias("image_w"), F.lit(1).alias("image_h"),
        F.lit(1).alias("tgt_w"), F.lit(1).alias("tgt_h"), geo.box(50, 50, 1500, 2000).alias("board"),
        F.array(geo.point(x - 5, y), geo.point(x + 5, y), geo.point(x + 5, y), geo.point(x - 5, y)).alias("box"))
    broken = quality.validate_index(rows).select("refdes", F.explode("failed").alias("rule"))
    nil = F.lit(0).cast("long").alias("detail")
    broken = broken.groupBy("rule", "refdes").agg(F.count("*").alias("n")).select("rule", "refdes", nil, "n")
    lost = quality.require_provenance(best.withColumn("engine", F.when(F.col("conf") != 0, "known")), ["engine", "x"])
    lost = lost.select("refdes", F.explode("missing").alias("m")).withColumn("rule", F.concat(F.lit("missing_"), "m"))
    lost = lost.groupBy("rule", "refdes").agg(
        F.count("*").alias("n")).select("rule", "refdes", nil, "n")
    return mix.unionByName(leaks).unionByName(broken).unionByName(lost)


@query("q_misreads", """
    WITH u AS (SELECT DISTINCT refdes FROM v_chain),
    t AS (SELECT DISTINCT text FROM v_hit WHERE text NOT IN (SELECT refdes FROM u)),
    p AS (SELECT * FROM (VALUES (0, '1', 'I'), (1, 'I', '1'), (2, '0', 'O'), (3, 'O', '0'), (4, '5', 'S'), (5, 'S', '5'),
          (6, 'B', '8'), (7, '8', 'B'), (8, 'Q', 'O'), (9, 'O', 'Q')) x(k, a, b)),
    f AS (SELECT text, arg_min(replace(text, a, b), k) AS fix FROM t, p
          WHERE replace(text, a, b) <> text AND replace(text, a, b) IN (SELECT refdes FROM u) GROUP BY text)
    SELECT h.ord, h.text, coalesce(f.fix, h.text) AS corrected,
      CASE WHEN f.fix IS NOT NULL THEN concat(h.text, ' -> ', f.fix) END AS correction
    FROM v_hit h LEFT JOIN f ON h.text = f.text""")
def q_misreads(ev):
    return registry.correct_misreads(ev.v_hit.select("ord", "text"), ev.v_chain)


# Designators read at each detection, scored: one per order line of its part.
_DET_REFS = """SELECT b.page_id, b.ord AS det, l_orderkey * 8 + l_linenumber AS ord, concat('C', CAST(l_suppkey % 400 AS STRING)) AS refdes,
        l_extendedprice AS score FROM lineitem JOIN v_box b ON l_partkey = b.ord"""


@query("q_label_det", f"""
    WITH {_METRICS},
    r AS ({_DET_REFS}),
    b AS (SELECT page_id, det, refdes FROM (SELECT *, row_number() OVER (PARTITION BY page_id, det ORDER BY score DESC, ord) AS rn FROM r) WHERE rn = 1),
    d AS (SELECT m.page_id, m.ord, {_CLASS} AS category FROM m)
    SELECT d.page_id, d.ord, b.refdes, CASE WHEN b.refdes IS NOT NULL THEN 'ocr_found' ELSE 'unverified' END AS status,
      CASE d.category WHEN 'board' THEN 'PCB 大板' WHEN 'ic' THEN 'IC 封装' WHEN 'resistor' THEN '电阻' WHEN 'capacitor' THEN '电容'
        WHEN 'inductor' THEN '电感' WHEN 'medium_passive' THEN '中型无源器件' WHEN 'small_passive' THEN '小型无源器件'
        WHEN 'tiny_passive' THEN '微型无源器件' WHEN 'trace_segment' THEN '走线段' WHEN 'large_passive' THEN '大型无源器件'
        ELSE '未分类' END || CASE WHEN b.refdes IS NULL THEN '' ELSE concat(' — 附近有: ', b.refdes) END AS description
    FROM d LEFT JOIN b ON d.page_id = b.page_id AND d.ord = b.det""")
def q_label_det(ev):
    refs = ev.sql(_DET_REFS).withColumn("source", F.lit("label"))
    out = registry.label_detections(classified(ev).select("page_id", "ord", "category"), refs)
    near = F.when(F.col("refdes").isNotNull(), F.array("refdes"))
    return out.select("page_id", "ord", "refdes", "status", text.describe(F.col("category"), near).alias("description"))


@query("q_words", r"""
    WITH w AS (SELECT page_id, CAST(page_id % 90 AS STRING) AS pin, concat(CAST(length(html) % 500 AS STRING), '.5') AS x FROM pages)
    SELECT 'pin' AS what, CAST(page_id AS STRING) AS id, pin AS val, round(CAST(x AS DOUBLE) * 300 / 72, 4) AS num FROM w WHERE CAST(pin AS BIGINT) BETWEEN 1 AND 64
    UNION ALL SELECT 'coord', CAST(page_id AS STRING), concat('R', CAST(page_id AS STRING)), CAST(length(url) AS DOUBLE) FROM pages
    UNION ALL SELECT 'head', CAST(doc_id AS STRING), upper(replace(trim(regexp_extract(text, '\S+\s*\S*')), ' ', '')), NULL FROM documents
      WHERE regexp_matches(trim(regexp_extract(text, '\S+\s*\S*')), '(?i)^(IC|Q|F|FI|D|J|C|R|L|X|U|TR|Z)\s*\d+')
    UNION ALL SELECT 'model', CAST(doc_id AS STRING), m, NULL FROM (
      SELECT doc_id, upper(trim(unnest(string_split_regex(text, '\s+')))) AS m FROM documents)
      WHERE regexp_matches(m, '^[A-Z]{1,4}\d[\w\-]{2,}$') OR regexp_matches(m, '^[A-Z]{1,4}-\d{2,}$')
    UNION ALL SELECT 'misread', CAST(ord AS STRING), translate(refdes, 'IL', '11'), NULL FROM v_label""")
def q_words(ev):
    pages, docs = ev.table("pages"), ev.table("documents")
    none = F.lit(None).cast("double").alias("num")
    line = F.concat(F.lit('<word xMin="'), (F.length("html") % 500).cast("string"), F.lit('.5" yMin="'),
                    F.length("url").cast("string"), F.lit('" xMax="1" yMax="2">'), (F.col("page_id") % 90).cast("string"),
                    F.lit("</word>"))
    pins = number_words(pages.select("page_id", line.alias("value")), keep=("page_id",)).select(
        F.lit("pin").alias("what"), F.col("page_id").cast("string").alias("id"), F.col("pin").cast("string").alias("val"),
        F.round("x", 4).alias("num"))
    listing = F.concat(F.lit("("), F.length("url").cast("string"), F.lit(",7) = R"), F.col("page_id").cast("string"))
    coords = pages.select("page_id", F.inline(text.parse_coord_list(listing))).select(
        F.lit("coord").alias("what"), F.col("page_id").cast("string").alias("id"), F.col("refdes").alias("val"),
        F.col("x").cast("double").alias("num"))
    ident = F.col("doc_id").cast("string").alias("id")
    first = text.refdes_head(F.regexp_extract("text", r"\S+\s*\S*", 0))
    heads = docs.select(F.lit("head").alias("what"), ident, first.alias("val"), none).filter("val is not null")
    tokens = docs.select(ident, F.explode(F.split("text", r"\s+")).alias("t"))
    models = tokens.select(F.lit("model").alias("what"), "id", text.model_text(F.col("t")).alias("val"), none).filter("val is not null")
    lossy = ev.v_label.select(F.lit("misread").alias("what"), F.col("ord").cast("string").alias("id"),
                              text.norm_misread(F.col("refdes")).alias("val"), none)
    return pins.unionByName(coords).unionByName(heads).unionByName(models).unionByName(lossy)
