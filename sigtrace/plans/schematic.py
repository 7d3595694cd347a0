"""Queries over schematic evidence: symbols, labels, bodies, segments, chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import shapes, text
from ..operators import associate, dedup, packages, pixels, quality, registry
from ..operators.ordered import first_per
from ..operators.runs import main_path
from ..session import cut
from .bindings import Evidence
from .board import BOARD_CENTRE, _BEST, best_hits
from .catalogue import query

_EXPECT = """CASE regexp_extract({0}, '^[A-Z]+') WHEN 'Q' THEN 'circle' WHEN 'L' THEN 'circle' WHEN 'C' THEN 'cap'
    WHEN 'R' THEN 'cap' WHEN 'IC' THEN 'ic' WHEN 'FI' THEN 'ic' ELSE '-' END"""
LABEL_RADIUS, LABEL_BONUS = 220, 40


@query("q_nearest_label", f"""
    WITH c AS (SELECT s.page_id, s.ord, s.sym, s.x, s.y, l.refdes, abs(s.x - l.x) + abs(s.y - l.y) AS d, row_number() OVER (
        PARTITION BY s.ord ORDER BY abs(s.x - l.x) + abs(s.y - l.y) - CASE WHEN {_EXPECT.format('l.refdes')} = s.sym THEN {LABEL_BONUS} ELSE 0 END, l.ord) AS rn
      FROM v_symbol s LEFT JOIN v_label l ON s.page_id = l.page_id AND abs(s.x - l.x) + abs(s.y - l.y) <= {LABEL_RADIUS})
    SELECT page_id, ord, sym, x, y, refdes, d AS text_symbol_dist,
      CASE regexp_extract(refdes, '^[A-Z]+') WHEN 'Q' THEN 'circle' WHEN 'IC' THEN 'ic' WHEN 'FI' THEN 'ic' WHEN 'L' THEN 'ind'
        WHEN 'R' THEN 'res' ELSE CASE WHEN refdes IS NULL THEN NULL ELSE 'cap' END END AS drawn_as FROM c WHERE rn = 1""")
def q_nearest_label(ev):
    out = associate.nearest_label(ev.v_symbol, ev.v_label, LABEL_RADIUS, LABEL_BONUS)
    return out.withColumn("drawn_as", F.when(F.col("refdes").isNotNull(), text.symbol_type(F.col("refdes"))))


@query("q_nearest_symbol", f"""
    WITH c AS (SELECT l.page_id, l.ord, l.refdes, l.x, l.y, s.x AS symbol_x, s.y AS symbol_y, s.sym AS symbol_type,
        abs(s.x - l.x) + abs(s.y - l.y) AS text_symbol_dist, row_number() OVER (
        PARTITION BY l.ord ORDER BY abs(s.x - l.x) + abs(s.y - l.y) - CASE WHEN {_EXPECT.format('l.refdes')} = s.sym THEN 60 ELSE 0 END, s.ord) AS rn
      FROM v_label l JOIN v_symbol s ON s.page_id = l.page_id AND abs(s.x - l.x) + abs(s.y - l.y) <= 150)
    SELECT page_id, ord, refdes, x, y, symbol_x, symbol_y, symbol_type, text_symbol_dist FROM c WHERE rn = 1""")
def q_nearest_symbol(ev):
    return associate.nearest_symbol(ev.v_label.drop("weight"), ev.v_symbol)


@query("q_nearby5", """
    WITH n AS (SELECT b.page_id, b.ord, l.refdes, l.ord AS hit_ord, sqrt((b.x - l.x) * (b.x - l.x) + (b.y - l.y) * (b.y - l.y)) AS d
      FROM v_symbol b JOIN v_label l ON b.page_id = l.page_id AND (b.x - l.x) * (b.x - l.x) + (b.y - l.y) * (b.y - l.y) < 160000),
    f AS (SELECT page_id, ord, refdes, hit_ord, round_even(d * 10, 0) / 10 AS dist FROM (
      SELECT *, row_number() OVER (PARTITION BY ord, refdes ORDER BY hit_ord) AS rn FROM n) WHERE rn = 1)
    SELECT page_id, ord, refdes, hit_ord, dist, CAST(rank AS INTEGER) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY ord ORDER BY dist, hit_ord) AS rank FROM f) WHERE rank <= 5""")
def q_nearby5(ev):
    return associate.nearby_refs(ev.v_symbol, ev.v_label, radius=400)


@query("q_on_label", """
    WITH b AS (SELECT page_id, ord, x - 60 AS bx0, y - 15 AS by0, x + 60 AS bx1, y + 15 AS by1 FROM v_label),
    o AS (SELECT *, w % 3 = 0 AS own FROM v_box),
    f AS (SELECT DISTINCT o.ord FROM o JOIN b ON o.page_id = b.page_id AND o.x0 BETWEEN bx0 - 4 AND bx1 + 4 AND o.y0 BETWEEN by0 - 4 AND by1 + 4)
    SELECT o.page_id, o.ord, CASE WHEN o.ord % 3 = 0 THEN true ELSE false END AS own_label,
      f.ord IS NOT NULL AS foreign_label, CASE WHEN o.kind = 'cap' THEN o.score + 7 ELSE o.score END AS score
    FROM o LEFT JOIN f ON o.ord = f.ord WHERE o.h <> 20""")
def q_on_label(ev):
    x, y = F.col("x"), F.col("y")
    boxes = ev.v_label.select("page_id", (x - 60).alias("bx0"), (y - 15).alias("by0"), (x + 60).alias("bx1"), (y + 15).alias("by1"))
    shift = F.when(F.col("ord") % 3 == 0, 0).otherwise(61)
    parts = ev.v_box.select("page_id", "ord", "kind", "h", "score", F.col("x0").alias("x"), F.col("y0").alias("y"))
    parts = parts.withColumn("text_box", F.array(
        geo.point(x - 60 + shift, y - 15), geo.point(x + 60 + shift, y - 15),
        geo.point(x + 60 + shift, y + 15), geo.point(x - 60 + shift, y + 15)))
    parts = associate.exclude(parts, [
        {"name": "height", "enabled": True, "truth_score": 95, "predicate": F.col("h") == 20},
        {"name": "kind", "enabled": True, "truth_score": 60, "predicate": F.col("kind") == "cap", "weight": 7},
        {"name": "weak", "enabled": True, "truth_score": 30, "predicate": F.col("ord") > 0},
        {"name": "off", "enabled": False, "truth_score": 100, "predicate": F.col("ord") > 0}])
    own = associate.on_label(parts).select("ord", F.lit(True).alias("_own"))
    foreign = associate.in_any_box(parts, boxes, 4).select("ord", F.lit(True).alias("_foreign"))
    flag = lambda c: F.coalesce(c, F.lit(False))
    return parts.join(own, "ord", "left").join(foreign, "ord", "left").select(
        "page_id", "ord", flag("_own").alias("own_label"), flag("_foreign").alias("foreign_label"), "score")


def bodies(ev: Evidence):
    """Symbol bodies of all kinds at the box places."""
    kind = F.when(F.col("kind") == "ic", "rect").otherwise(F.col("kind"))
    rect, circle, cap = kind == "rect", kind == "circle", kind == "cap"
    x, y, w, h = F.col("x0"), F.col("y0"), F.col("w"), F.col("h")
    body = F.struct(kind.alias("kind"), F.when(~rect, x).alias("cx"), F.when(~rect, y).alias("cy"),
                    F.when(circle, F.floor(w / 2)).alias("r"), F.when(rect, x).alias("x"), F.when(rect, y).alias("y"),
                    F.when(rect | (kind == "diode"), w).alias("w"), F.when(rect | (kind == "diode"), h).alias("h"),
                    F.when(cap, F.floor(h / 4)).alias("gap"), F.when(cap, w).alias("len"))
    rows = ev.v_box.select("page_id", "ord", "kind", x.alias("x"), y.alias("y"), body.alias("symbol_body"))
    rows = rows.withColumn("sym_boundary", shapes.boundary(F.col("symbol_body")))
    # The exchange keeps the long CASE expressions of the view out of everything built on them.
    return rows.repartition("page_id", "ord")


_EDGE = """e AS (SELECT page_id, ord, CASE WHEN kind = 'circle' THEN 'circle' ELSE 'rect' END AS ek, x0 AS cx, y0 AS cy, w // 2 AS r,
      CASE kind WHEN 'ic' THEN x0 WHEN 'cap' THEN x0 - greatest(6, w) // 2 WHEN 'line' THEN x0 - 10 WHEN 'diode' THEN x0 - greatest(8, w) // 2 ELSE x0 - w // 2 END AS ex,
      CASE kind WHEN 'ic' THEN y0 WHEN 'cap' THEN y0 - greatest(4, h // 4) // 2 WHEN 'line' THEN y0 - 10 WHEN 'diode' THEN y0 - greatest(8, h) // 2 ELSE y0 - w // 2 END AS ey,
      CASE kind WHEN 'ic' THEN w WHEN 'cap' THEN greatest(6, w) WHEN 'line' THEN 20 WHEN 'diode' THEN greatest(8, w) ELSE 2 * (w // 2) END AS ew,
      CASE kind WHEN 'ic' THEN h WHEN 'cap' THEN greatest(4, h // 4) WHEN 'line' THEN 20 WHEN 'diode' THEN greatest(8, h) ELSE 2 * (w // 2) END AS eh,
      kind, x0, y0, w, h FROM v_box)"""
_MIXED = """(greatest({r}.ex - 6, least({c}.cx, {r}.ex + {r}.ew + 6)) - {c}.cx) ** 2 + (greatest({r}.ey - 6, least({c}.cy, {r}.ey + {r}.eh + 6)) - {c}.cy) ** 2 <= ({c}.r + 6) ** 2"""


@query("q_overlaps", f"""
    WITH {_EDGE},
    g AS (SELECT page_id, ek, ex, ey, ew, eh, CASE WHEN ek = 'circle' THEN cx END AS cx, CASE WHEN ek = 'circle' THEN cy END AS cy,
          CASE WHEN ek = 'circle' THEN r END AS r, min(ord) AS ord, count(*) AS n FROM e GROUP BY ALL)
    SELECT a.page_id, a.ord AS a_ord, b.ord AS b_ord, a.n AS a_copies, b.n AS b_copies, a.n * b.n AS pairs
    FROM g a JOIN g b ON a.page_id = b.page_id AND a.ord < b.ord AND CASE
      WHEN a.ek = 'circle' AND b.ek = 'circle' THEN (a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2 <= (a.r + b.r + 6) ** 2
      WHEN a.ek = 'rect' AND b.ek = 'rect' THEN a.ex + a.ew + 6 >= b.ex AND b.ex + b.ew + 6 >= a.ex AND a.ey + a.eh + 6 >= b.ey AND b.ey + b.eh + 6 >= a.ey
      WHEN a.ek = 'circle' THEN {_MIXED.format(c='a', r='b')} ELSE {_MIXED.format(c='b', r='a')} END
    UNION ALL SELECT page_id, ord, ord, n, n, n * (n - 1) // 2 FROM g WHERE n > 1""")
def q_overlaps(ev):
    return associate.overlaps(bodies(ev))



@query("q_nms", """
    WITH b AS (SELECT page_id, ord, x0 + w // 2 AS cx, y0 + h // 2 AS cy, w, h,
               row_number() OVER (PARTITION BY page_id ORDER BY score, ord) AS pr FROM v_box),
    e AS (SELECT a.ord AS lo, z.ord AS hi FROM b a JOIN b z ON a.page_id = z.page_id AND a.pr < z.pr
          AND abs(a.cx - z.cx) < greatest(a.w, z.w) * 0.4::DOUBLE AND abs(a.cy - z.cy) < greatest(a.h, z.h) * 0.4::DOUBLE),
    s(it, ord, st) AS (
      SELECT 0, ord, 'open' FROM b
      UNION ALL
      SELECT s.it + 1, s.ord, CASE WHEN s.st <> 'open' THEN s.st
          WHEN EXISTS (SELECT 1 FROM e JOIN s k ON e.lo = k.ord WHERE e.hi = s.ord AND k.st = 'kept') THEN 'gone'
          WHEN NOT EXISTS (SELECT 1 FROM e JOIN s k ON e.lo = k.ord WHERE e.hi = s.ord AND k.st = 'open') THEN 'kept' ELSE 'open' END
      FROM s WHERE EXISTS (SELECT 1 FROM s o WHERE o.st = 'open')),
    f AS (SELECT ord, st FROM s WHERE it = (SELECT max(it) FROM s))
    SELECT b.page_id, b.ord, f.st = 'kept' AS kept, CASE WHEN f.st = 'kept' THEN b.ord ELSE (
        SELECT arg_min(k.ord, kb.pr) FROM e JOIN f k ON e.lo = k.ord JOIN b kb ON kb.ord = k.ord WHERE e.hi = b.ord AND k.st = 'kept') END AS kept_by
    FROM b JOIN f ON b.ord = f.ord""", recursive=True)
def q_nms(ev):
    half = lambda o, s: (F.col(o) + F.floor(F.col(s) / 2)).alias("c" + o[0])
    boxes = ev.v_box.select("page_id", "ord", "score", "w", "h", half("x0", "w"), half("y0", "h"))
    judged = dedup.dedup_boxes(boxes, ["score", "ord"])
    return judged.select("page_id", "ord", "kept", F.col("kept_by.ord").alias("kept_by"))


@query("q_circles", """
    WITH b AS (SELECT page_id, ord, x0 AS cx, y0 AS cy, w // 2 AS r, row_number() OVER (PARTITION BY page_id ORDER BY src, ord) AS pr
        FROM (SELECT *, 0 AS src FROM v_box WHERE kind = 'circle' UNION ALL SELECT *, 1 FROM v_box WHERE kind <> 'circle' AND w >= 60)),
    e AS (SELECT a.ord AS lo, z.ord AS hi FROM b a JOIN b z ON a.page_id = z.page_id AND a.pr < z.pr
          AND sqrt((a.cx - z.cx) ** 2 + (a.cy - z.cy) ** 2) < greatest(a.r, z.r) * 0.6::DOUBLE),
    s(it, ord, st) AS (
      SELECT 0, ord, 'open' FROM b
      UNION ALL
      SELECT s.it + 1, s.ord, CASE WHEN s.st <> 'open' THEN s.st
          WHEN EXISTS (SELECT 1 FROM e JOIN s k ON e.lo = k.ord WHERE e.hi = s.ord AND k.st = 'kept') THEN 'gone'
          WHEN NOT EXISTS (SELECT 1 FROM e JOIN s k ON e.lo = k.ord WHERE e.hi = s.ord AND k.st = 'open') THEN 'kept' ELSE 'open' END
      FROM s WHERE EXISTS (SELECT 1 FROM s o WHERE o.st = 'open'))
    SELECT b.page_id, b.ord, b.r FROM b JOIN s ON b.ord = s.ord WHERE s.it = (SELECT max(it) FROM s) AND s.st = 'kept'""", recursive=True)
def q_circles(ev):
    rows = ev.v_box.select("page_id", "ord", F.col("x0").alias("cx"), F.col("y0").alias("cy"),
                           F.floor(F.col("w") / 2).alias("r"), "kind", "w")
    both = dedup.union_candidates(round=rows.filter("kind = 'circle'"), other=rows.filter("kind <> 'circle' and w >= 60"))
    return dedup.dedup_circles(both, ["src_ord", "ord"]).filter("kept").select("page_id", "ord", "r")


@query("q_breaks", """
    WITH b AS (SELECT page_id, ord, x % 1200 AS cx, y % 1200 AS cy, CAST(floor(weight) AS BIGINT) % 200 AS gap FROM v_label),
    e AS (SELECT a.ord AS lo, z.ord AS hi FROM b a JOIN b z ON a.page_id = z.page_id AND a.ord < z.ord
          AND abs(a.cx - z.cx) < 20 AND abs(a.cy - z.cy) < 20),
    s(it, ord, st) AS (
      SELECT 0, ord, 'open' FROM b
      UNION ALL
      SELECT s.it + 1, s.ord, CASE WHEN s.st <> 'open' THEN s.st
          WHEN EXISTS (SELECT 1 FROM e JOIN s k ON e.lo = k.ord WHERE e.hi = s.ord AND k.st = 'kept') THEN 'gone'
          WHEN NOT EXISTS (SELECT 1 FROM e JOIN s k ON e.lo = k.ord WHERE e.hi = s.ord AND k.st = 'open') THEN 'kept' ELSE 'open' END
      FROM s WHERE EXISTS (SELECT 1 FROM s o WHERE o.st = 'open')),
    k AS (SELECT ord FROM s WHERE it = (SELECT max(it) FROM s) AND st = 'kept'),
    d AS (SELECT b.ord, b.gap, coalesce((SELECT min(k.ord) FROM e JOIN k ON e.lo = k.ord WHERE e.hi = b.ord), b.ord) AS kept_by FROM b)
    SELECT b.page_id, b.ord, b.cx, b.cy, m.gap FROM b JOIN (SELECT kept_by, min(gap) AS gap FROM d GROUP BY kept_by) m ON b.ord = m.kept_by""", recursive=True)
def q_breaks(ev):
    rows = ev.v_label.select("page_id", "ord", (F.col("x") % 1200).alias("cx"), (F.col("y") % 1200).alias("cy"),
                             (F.floor("weight") % 200).cast("long").alias("gap"))
    return dedup.dedup_breaks(rows, ["ord"])


_INSIDE = """CASE kind WHEN 'circle' THEN dx * dx + dy * dy <= (r + 4) * (r + 4)
      WHEN 'ic' THEN dx BETWEEN -4 AND w + 4 AND dy BETWEEN -4 AND h + 4
      WHEN 'diode' THEN px BETWEEN ex - 4 AND ex + ew + 4 AND py BETWEEN ey - 4 AND ey + eh + 4 ELSE abs(dx) + abs(dy) <= 20 END"""


@query("q_verdicts", f"""
    WITH {_EDGE},
    p AS (SELECT *, ord % 47 - 10 AS dx, ord % 31 - 8 AS dy, x0 + ord % 47 - 10 AS px, y0 + ord % 31 - 8 AS py, ord % 11 = 0 AS lab FROM e),
    v AS (SELECT *, CASE WHEN lab THEN 'on_label' WHEN {_INSIDE} THEN 'ok' ELSE 'corrected' END AS sym_verify FROM p)
    SELECT page_id, ord, sym_verify, CASE WHEN sym_verify <> 'corrected' THEN px WHEN kind = 'ic' THEN x0 + w / 2.0::DOUBLE ELSE x0 END::DOUBLE AS final_x,
      CASE WHEN sym_verify <> 'corrected' THEN py WHEN kind = 'ic' THEN y0 + h / 2.0::DOUBLE ELSE y0 END::DOUBLE AS final_y FROM v""")
def q_verdicts(ev):
    return moved_parts(ev).select("page_id", "ord", "sym_verify", "final_x", "final_y")


def moved_parts(ev: Evidence):
    """Self-checked parts whose points lie a little off their bodies."""
    parts = bodies(ev).withColumn("x", F.col("x") + F.col("ord") % 47 - 10).withColumn("y", F.col("y") + F.col("ord") % 31 - 8)
    x, y = F.col("x"), F.col("y")
    label = F.array(geo.point(x - 1, y - 1), geo.point(x + 1, y - 1), geo.point(x + 1, y + 1), geo.point(x - 1, y + 1))
    return associate.verdicts(parts.withColumn("text_box", F.when(F.col("ord") % 11 == 0, label)))


_SIZES = """z AS (SELECT ord, page_id, kind AS sym, CAST(CASE kind WHEN 'circle' THEN 2 * (w // 2) ELSE w END AS DOUBLE) AS w,
      CAST(CASE kind WHEN 'circle' THEN 2 * (w // 2) WHEN 'cap' THEN h // 4 ELSE h END AS DOUBLE) AS h FROM v_box WHERE kind <> 'line')"""


def sizes(ev: Evidence):
    size = shapes.body_size(F.col("symbol_body"))
    return bodies(ev).select("page_id", "ord", F.col("kind").alias("sym"), size.alias("s")).filter("s is not null").select(
        "page_id", "ord", "sym", "s.w", "s.h")


@query("q_sizes", f"WITH {_SIZES} SELECT sym, median(w) AS typical_w, median(h) AS typical_h FROM z GROUP BY sym")
def q_sizes(ev):
    return pixels.typical_size(sizes(ev))


@query("q_outliers", f"""WITH {_SIZES}, t AS (SELECT sym, median(w) AS tw, median(h) AS th FROM z GROUP BY sym)
    SELECT ord, z.sym, w / tw BETWEEN 0.4 AND 1.6 AND h / th BETWEEN 0.4 AND 1.6 AS size_check,
      CASE WHEN NOT (w / tw BETWEEN 0.4 AND 1.6 AND h / th BETWEEN 0.4 AND 1.6) THEN round_even(greatest(abs(1 - w / tw), abs(1 - h / th)) * 100, 0) / 100 END AS size_dev
    FROM z JOIN t ON z.sym = t.sym""")
def q_outliers(ev):
    rows = sizes(ev)
    return quality.size_outliers(rows, pixels.typical_size(rows)).select("ord", "sym", "size_check", "size_dev")


_PLACED = f"""{_BEST}, i AS (SELECT refdes, arg_min(x, k) AS x, arg_min(y, k) AS y, arg_min(view_name, k) AS view_name FROM (
      SELECT *, CASE view_name WHEN 'top' THEN 0 ELSE 1 END AS k FROM best WHERE view_name <> 'sch') GROUP BY refdes),
    l AS (SELECT c.chain_id, c.idx, c.refdes, CASE WHEN i.view_name = 'bot' THEN {2 * BOARD_CENTRE} - i.x ELSE i.x END AS x, i.y, i.view_name
      FROM v_chain c LEFT JOIN i ON c.refdes = i.refdes)"""


def board_index(ev: Evidence):
    """One board place per designator: the top one where there is one."""
    rows = best_hits(ev).filter("view_name <> 'sch'").select("refdes", "view_name", "x", "y")
    return first_per(rows, ["refdes"], [F.when(F.col("view_name") == "top", 0).otherwise(1)])


def located_chain(ev: Evidence):
    return registry.backfill_positions(ev.v_chain, board_index(ev), BOARD_CENTRE)


@query("q_chain_edges", f"""WITH {_PLACED},
    n AS (SELECT chain_id, idx, refdes AS from_ref, lead(refdes) OVER w AS to_ref, x AS from_x, y AS from_y, view_name AS from_view,
      lead(x) OVER w AS to_x, lead(y) OVER w AS to_y, lead(view_name) OVER w AS to_view FROM l WHERE x IS NOT NULL
      WINDOW w AS (PARTITION BY chain_id ORDER BY idx))
    SELECT *, abs(from_x - to_x) + abs(from_y - to_y) AS length, from_view <> to_view AS cross_side FROM n WHERE to_ref IS NOT NULL""")
def q_chain_edges(ev):
    return registry.chain_edges(located_chain(ev))


@query("q_missing", f"WITH {_PLACED} SELECT chain_id, idx, refdes FROM l WHERE x IS NULL")
def q_missing(ev):
    return registry.missing_positions(ev.v_chain, board_index(ev)).select("chain_id", "idx", "refdes")


@query("q_chain_order", """
    WITH f AS (SELECT chain_id, refdes, ord, walk_d FROM (SELECT *, row_number() OVER (PARTITION BY chain_id, refdes ORDER BY ord) AS rn FROM (
      SELECT page_id AS chain_id, refdes, ord, CASE WHEN ord % 5 = 0 THEN NULL ELSE CAST(floor(weight) AS BIGINT) % 900 END AS walk_d FROM v_label)) WHERE rn = 1)
    SELECT chain_id, refdes, ord, walk_d, row_number() OVER (PARTITION BY chain_id ORDER BY walk_d NULLS LAST, ord) AS idx FROM f""")
def q_chain_order(ev):
    walk = F.when(F.col("ord") % 5 != 0, (F.floor("weight") % 900).cast("long"))
    return registry.chain_order(ev.v_label.select(F.col("page_id").alias("chain_id"), "refdes", "ord", walk.alias("walk_d")))


_ENDS = f"""{_PLACED}, r AS (SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY idx) AS a,
      row_number() OVER (PARTITION BY chain_id ORDER BY idx DESC) AS z FROM l WHERE x IS NOT NULL),
    n AS (SELECT chain_id, avg(x) FILTER (a <= 3) AS up_x, avg(y) FILTER (a <= 3) AS up_y, avg(x) FILTER (z <= 3) AS down_x,
      avg(y) FILTER (z <= 3) AS down_y FROM r GROUP BY chain_id)"""


@query("q_flow_ends", f"WITH {_ENDS} SELECT chain_id, round(up_x, 6) AS up_x, round(up_y, 6) AS up_y, round(down_x, 6) AS down_x, round(down_y, 6) AS down_y FROM n")
def q_flow_ends(ev):
    ends = registry.flow_ends(located_chain(ev).filter("x is not null"))
    return ends.select("chain_id", *[F.round(c, 6).alias(c) for c in ("up_x", "up_y", "down_x", "down_y")])


@query("q_heading", f"""WITH {_ENDS},
    g AS (SELECT l.chain_id, l.idx, l.x AS x1, l.y AS y1, l.x + l.idx % 3 * 20 - 20 AS x2, l.y + l.chain_id % 5 * 10 - 20 AS y2 FROM l WHERE x IS NOT NULL),
    d AS (SELECT g.*, sqrt((x1 - up_x) * (x1 - up_x) + (y1 - up_y) * (y1 - up_y)) > sqrt((x2 - up_x) * (x2 - up_x) + (y2 - up_y) * (y2 - up_y)) AS swap,
      g.idx % 3 - 1 AS ax, g.chain_id % 3 - 1 AS ay FROM g JOIN n ON g.chain_id = n.chain_id),
    t AS (SELECT *, abs(degrees(atan2(ay, ax)) - degrees(atan2(chain_id % 2, 1))) % 180 AS turn0, abs(degrees(atan2(ay, ax))) AS slope0 FROM d)
    SELECT chain_id, idx, CASE WHEN swap THEN x2 ELSE x1 END AS tail_x, CASE WHEN swap THEN y2 ELSE y1 END AS tail_y,
      CASE WHEN swap THEN x1 ELSE x2 END AS head_x, CASE WHEN swap THEN y1 ELSE y2 END AS head_y,
      CASE WHEN least(turn0, 180 - turn0) BETWEEN 60 AND 120 THEN 'L' WHEN least(slope0, 180 - slope0) BETWEEN 10 AND 80 THEN 'tilt' ELSE 'straight' END AS shape FROM t""")
def q_heading(ev):
    placed = located_chain(ev).filter("x is not null")
    c, i = F.col("chain_id"), F.col("idx")
    segs = placed.select("chain_id", "idx", F.col("x").alias("x1"), F.col("y").alias("y1"),
                         (F.col("x") + i % 3 * 20 - 20).alias("x2"), (F.col("y") + c % 5 * 10 - 20).alias("y2"))
    shape = geo.segment_class(i % 3 - 1, c % 3 - 1, F.lit(1), c % 2)
    return registry.segment_heading(segs, registry.flow_ends(placed)).select(
        "chain_id", "idx", "tail_x", "tail_y", "head_x", "head_y", shape.alias("shape"))


@query("q_alternate", f"""WITH p AS (SELECT text AS refdes, x, y, min(ord) AS ord FROM v_hit WHERE view_name = 'top' GROUP BY text, x, y),
    m AS (SELECT refdes, arg_min(x, ord) AS mx, arg_min(y, ord) AS my FROM p GROUP BY refdes),
    c AS (SELECT chain_id, idx, v.refdes, lag(mx) OVER w AS px, lag(my) OVER w AS py FROM v_chain v JOIN m ON v.refdes = m.refdes
          WINDOW w AS (PARTITION BY chain_id ORDER BY idx))
    SELECT chain_id, idx, refdes, x, y, dist, ord FROM (
      SELECT c.chain_id, c.idx, c.refdes, p.x, p.y, p.ord, CASE WHEN px IS NULL THEN 0 ELSE abs(p.x - px) + abs(p.y - py) END AS dist,
        row_number() OVER (PARTITION BY c.chain_id, c.idx ORDER BY CASE WHEN px IS NULL THEN 0 ELSE abs(p.x - px) + abs(p.y - py) END, p.ord) AS rn
      FROM c JOIN p ON c.refdes = p.refdes) WHERE rn = 1""")
def q_alternate(ev):
    places = ev.v_hit.filter("view_name = 'top'").select(F.col("text").alias("refdes"), "ord", "x", "y")
    return registry.choose_alternate(ev.v_chain, places)


@query("q_touched", """
    WITH t AS (SELECT DISTINCT refdes FROM v_anchor)
    SELECT l.ord, l.refdes, CASE substring(l.refdes, 1, 1) WHEN 'I' THEN 'IC' WHEN 'Q' THEN 'transistor' WHEN 'C' THEN 'capacitor'
      WHEN 'L' THEN 'inductor' WHEN 'F' THEN 'filter' END AS type FROM v_label l JOIN t ON l.refdes = t.refdes
    WHERE substring(l.refdes, 1, 1) IN ('I', 'Q', 'C', 'L', 'F') AND l.ord % 2 = 0""")
def q_touched(ev):
    flow = ev.v_label.withColumn("membership", F.when(F.col("ord") % 2 == 0, "flow_through").otherwise("branch"))
    touched = main_path(flow).select("ord", "refdes")
    return registry.touched_and_serial(touched, ev.v_anchor, registry.SERIAL_RULES)


@query("q_votes", """
    WITH v AS (SELECT x % 1200 AS x, y % 1200 AS y, page_id FROM v_label),
    s AS (SELECT b.page_id, b.ord, b.score, 1 + (SELECT count(*) FROM v WHERE v.page_id = b.page_id
            AND abs(v.x - b.x0 % 1200) + abs(v.y - b.y0 % 1200) <= 40) AS votes, b.x0 // 2400 AS cell FROM v_box b),
    z AS (SELECT *, score - votes * 15.0 AS final FROM s)
    SELECT page_id, cell, ord, votes, round(final, 4) AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY page_id, cell ORDER BY final, ord) AS rn FROM z) WHERE rn = 1""")
def q_votes(ev):
    sources = ev.v_label.select("page_id", (F.col("x") % 1200).alias("x"), (F.col("y") % 1200).alias("y"))
    cands = ev.v_box.select("page_id", "ord", "score", (F.col("x0") % 1200).alias("x"), (F.col("y0") % 1200).alias("y"),
                            F.floor(F.col("x0") / 2400).alias("cell"))
    voted = associate.votes(cands, sources, tol=40)
    best = associate.best_candidate(voted, ["page_id", "cell"])
    return best.select("page_id", "cell", "ord", "votes", F.round("score", 4).alias("score"))


@query("q_closest", """
    WITH c AS (SELECT page_id, ord, x, y, row_number() OVER (PARTITION BY page_id ORDER BY abs(x - 2400) + abs(y - 3150), ord) AS rn FROM v_label)
    SELECT page_id, ord, x, y FROM c WHERE rn <= 60""")
def q_closest(ev):
    rows = ev.v_label.select("page_id", "ord", "x", "y")
    return associate.closest_n(rows, ["page_id"], geo.l1(F.col("x"), F.col("y"), F.lit(2400), F.lit(3150)))


@query("q_first_source", """
    WITH a AS (SELECT page_id, x AS k, ord, 'label' AS src FROM v_label),
    b AS (SELECT page_id, x0 AS k, ord, 'box' AS src FROM v_box)
    SELECT * FROM a UNION ALL SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.page_id = b.page_id AND a.k = b.k)""")
def q_first_source(ev):
    a = ev.v_label.select("page_id", F.col("x").alias("k"), "ord", F.lit("label").alias("src"))
    b = ev.v_box.select("page_id", F.col("x0").alias("k"), "ord", F.lit("box").alias("src"))
    return dedup.first_source(a, b, keys=["page_id", "k"])


@query("q_enclosing", f"""WITH {_EDGE},
    h AS (SELECT l.ord, e.ord AS shape, CASE WHEN ek = 'circle' THEN abs(l.x - cx) + abs(l.y - cy)
            ELSE abs(l.x - (ex + ew / 2.0::DOUBLE)) + abs(l.y - (ey + eh / 2.0::DOUBLE)) END AS d
      FROM v_label l JOIN e ON l.page_id = e.page_id AND CASE WHEN ek = 'circle' THEN (l.x - cx) * (l.x - cx) + (l.y - cy) * (l.y - cy) <= (r + 4) * (r + 4)
        ELSE l.x BETWEEN ex - 4 AND ex + ew + 4 AND l.y BETWEEN ey - 4 AND ey + eh + 4 END),
    b AS (SELECT ord, shape FROM (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY d, shape) AS rn FROM h) WHERE rn = 1),
    n AS (SELECT l.ord, s.ord AS detection, abs(l.x - s.x0) + abs(l.y - s.y0) AS distance, row_number() OVER (
        PARTITION BY l.ord ORDER BY abs(l.x - s.x0) + abs(l.y - s.y0), s.ord) AS rn
      FROM v_label l JOIN v_box s ON l.page_id = s.page_id AND abs(l.x - s.x0) + abs(l.y - s.y0) <= 420
      WHERE s.area > 3000 AND s.area < 120000 AND least(s.w, s.h) / greatest(s.w, s.h)::DOUBLE > 0.3 AND s.area / (s.w * s.h) >= 0.7)
    SELECT l.ord, b.shape, n.detection, CAST(n.distance AS DOUBLE) AS distance FROM v_label l LEFT JOIN b ON l.ord = b.ord LEFT JOIN n ON l.ord = n.ord AND n.rn = 1""")
def q_enclosing(ev):
    edges = bodies(ev).select("page_id", "ord", F.col("sym_boundary").alias("edge"))
    labels = ev.v_label.select("page_id", "ord", "x", "y")
    inside = associate.enclosing_shape(labels, edges).select("ord", "shape")
    near = associate.nearest_detection(labels, ev.v_box).select("ord", "detection", F.col("distance").cast("double").alias("distance"))
    return inside.join(near, "ord")


@query("q_gaps", """
    WITH s AS (SELECT page_id, axis, pos, lo, hi, min(ord) AS ord FROM v_segment WHERE hi - lo >= 20 GROUP BY ALL),
    g AS (SELECT a.page_id, a.axis, a.ord AS a_ord, b.ord AS b_ord, b.lo - a.hi AS gap, a.pos AS p1, b.pos AS p2, (a.hi + b.lo) // 2 AS mid
      FROM s a JOIN s b ON a.page_id = b.page_id AND a.axis = b.axis AND abs(a.pos - b.pos) <= 8 AND b.lo - a.hi > 15 AND b.lo - a.hi <= 120)
    SELECT page_id, axis, a_ord, b_ord, gap, CASE WHEN axis = 'h' THEN mid ELSE p END AS cx, CASE WHEN axis = 'h' THEN p ELSE mid END AS cy
    FROM (SELECT *, unnest(list_distinct([p1, p2])) AS p FROM g)""")
def q_gaps(ev):
    return associate.collinear_gaps(ev.v_segment, max_gap=120, min_len=20)


@query("q_nearest_gap", """
    WITH s AS (SELECT page_id, axis, pos, lo, hi, min(ord) AS ord FROM v_segment GROUP BY ALL),
    g AS (SELECT a.page_id, a.axis, a.ord AS a_ord, b.ord AS b_ord, b.lo - a.hi AS gap, a.pos AS p1, b.pos AS p2, (a.hi + b.lo) // 2 AS mid
      FROM s a JOIN s b ON a.page_id = b.page_id AND a.axis = b.axis AND abs(a.pos - b.pos) <= 8 AND b.lo - a.hi > 15 AND b.lo - a.hi <= 60),
    p AS (SELECT page_id, a_ord, b_ord, gap, CASE WHEN axis = 'h' THEN mid ELSE p END AS cx, CASE WHEN axis = 'h' THEN p ELSE mid END AS cy
      FROM (SELECT *, unnest(list_distinct([p1, p2])) AS p FROM g)),
    k AS (SELECT y.page_id, y.ord, y.x, y.y, p.cx, p.cy, p.gap, row_number() OVER (PARTITION BY y.ord
            ORDER BY abs(y.x - p.cx) + abs(y.y - p.cy), p.a_ord, p.b_ord) AS rn
      FROM (SELECT page_id, ord, x % 1200 AS x, y % 1500 AS y FROM v_symbol) y JOIN p ON y.page_id = p.page_id AND abs(y.x - p.cx) + abs(y.y - p.cy) <= 60)
    SELECT y.page_id, y.ord, k.cx AS gap_x, k.cy AS gap_y, k.gap FROM v_symbol y LEFT JOIN k ON y.ord = k.ord AND k.rn = 1""")
def q_nearest_gap(ev):
    symbols = ev.v_symbol.select("page_id", "ord", (F.col("x") % 1200).alias("x"), (F.col("y") % 1500).alias("y"))
    return associate.nearest_collinear_gap(symbols, ev.v_segment, 60, max_gap=60).select("page_id", "ord", "gap_x", "gap_y", "gap")


@query("q_parallel", """
    WITH s AS (SELECT page_id, axis, pos, lo, hi, min(ord) AS f, max(ord) AS l FROM v_segment WHERE hi - lo BETWEEN 15 AND 90 GROUP BY ALL),
    q AS (SELECT a.page_id, a.f AS a_ord, b.l AS b_last, a.axis, (a.pos + b.pos) // 2 AS mid, (a.lo + a.hi + b.lo + b.hi) // 4 AS along,
        abs(a.pos - b.pos) AS gap, a.hi - a.lo AS len
      FROM s a JOIN s b ON a.page_id = b.page_id AND a.axis = b.axis AND a.f < b.l AND abs(a.pos - b.pos) BETWEEN 8 AND 40
        AND abs((a.hi - a.lo) - (b.hi - b.lo)) <= greatest(5, (a.hi - a.lo) * 0.5) AND least(a.hi, b.hi) - greatest(a.lo, b.lo) >= 5),
    p AS (SELECT page_id, a_ord, b_last, CASE WHEN axis = 'v' THEN mid ELSE along END AS cx, CASE WHEN axis = 'v' THEN along ELSE mid END AS cy,
      gap, len, CASE WHEN axis = 'v' THEN 'h' ELSE 'v' END AS dir FROM q)
    SELECT page_id, a_ord, b_last, cx, cy, gap, len, dir FROM p""")
def q_parallel(ev):
    return associate.parallel_pairs(ev.v_segment)


@query("q_varactor", """
    WITH s AS (SELECT page_id, axis, pos, lo, hi, min(ord) AS f, max(ord) AS l FROM v_segment WHERE hi - lo BETWEEN 15 AND 90 GROUP BY ALL),
    q AS (SELECT a.page_id, a.axis, (a.pos + b.pos) // 2 AS mid, (a.lo + a.hi + b.lo + b.hi) // 4 AS along
      FROM s a JOIN s b ON a.page_id = b.page_id AND a.axis = b.axis AND a.f < b.l AND abs(a.pos - b.pos) BETWEEN 6 AND 30
        AND abs((a.hi - a.lo) - (b.hi - b.lo)) <= greatest(5, (a.hi - a.lo) * 0.5) AND least(a.hi, b.hi) - greatest(a.lo, b.lo) >= 5),
    p AS (SELECT page_id, CASE WHEN axis = 'v' THEN mid ELSE along END AS cx, CASE WHEN axis = 'v' THEN along ELSE mid END AS cy FROM q)
    SELECT b.ord, EXISTS (SELECT 1 FROM p WHERE p.page_id = b.page_id AND abs(p.cx - b.x % 1200) <= 25 AND abs(p.cy - b.y % 1500) <= 25) AS varactor
    FROM v_symbol b WHERE b.sym = 'diode'""")
def q_varactor(ev):
    parts = ev.v_symbol.filter("sym = 'diode'").select("page_id", "ord", (F.col("x") % 1200).alias("x"), (F.col("y") % 1500).alias("y"))
    return associate.varactors(parts, ev.v_segment, 25, gap=(6, 30)).select("ord", "varactor")


@query("q_merge_regions", """
    WITH g AS (SELECT page_id, x0, y0, w, h, area, min(ord) AS f, max(ord) AS l, count(*) AS n FROM v_region GROUP BY ALL),
    p AS (SELECT a.page_id, a.f AS a_ord, b.l AS b_last, a.n AS a_copies, b.n AS b_copies, least(a.x0, b.x0) AS x0, least(a.y0, b.y0) AS y0,
        greatest(a.x0 + a.w, b.x0 + b.w) AS x1, greatest(a.y0 + a.h, b.y0 + b.h) AS y1, a.area + b.area AS area
      FROM g a JOIN g b ON a.page_id = b.page_id AND a.f < b.l AND abs(a.w - b.w) <= greatest(a.w, b.w) * 0.2 AND abs(a.h - b.h) <= greatest(a.h, b.h) * 0.2
        AND ((abs(a.x0 + a.w - b.x0) <= 6 AND abs(a.y0 - b.y0) <= 6) OR (abs(a.y0 + a.h - b.y0) <= 6 AND abs(a.x0 - b.x0) <= 6)
          OR (abs(a.y0 + a.h - b.y0) <= 6 AND ((a.x0 <= b.x0 AND a.x0 + a.w >= b.x0 + b.w) OR (b.x0 <= a.x0 AND b.x0 + b.w >= a.x0 + a.w)))
          OR (abs(a.x0 + a.w - b.x0) <= 6 AND ((a.y0 <= b.y0 AND a.y0 + a.h >= b.y0 + b.h) OR (b.y0 <= a.y0 AND b.y0 + b.h >= a.y0 + a.h)))))
    SELECT page_id, a_ord, b_last, a_copies, b_copies, x0, y0, x1, y1, round(area::DOUBLE / ((x1 - x0) * (y1 - y0)), 4) AS fill FROM p
    WHERE area::DOUBLE / ((x1 - x0) * (y1 - y0)) >= 0.55""")
def q_merge_regions(ev):
    return associate.mergeable_pairs(ev.v_region)


@query("q_widths", """
    WITH s AS (SELECT page_id, least(w, h) AS side FROM v_box),
    m AS (SELECT page_id, median(side) AS med FROM s GROUP BY page_id),
    c AS (SELECT s.page_id, median(side) AS clean FROM s JOIN m ON s.page_id = m.page_id WHERE side <= med * 1.5 GROUP BY s.page_id)
    SELECT page_id, clean AS line_width, clean * 2.5 AS cap FROM c""")
def q_widths(ev):
    return pixels.robust_width(ev.v_box)


_WORDS = """w AS (SELECT CAST(floor(ord / 250) AS BIGINT) AS page_id, ord, CAST(x % 2400 AS DOUBLE) + 0.25 AS x, CAST(y % 1600 AS DOUBLE) + 0.25 AS y, CAST(ord % 64 + 1 AS BIGINT) AS pin FROM v_label)"""
_PAIRS = _WORDS + """, p AS (SELECT a.page_id, a.ord AS a_ord, b.ord AS b_ord,
      CAST(round_even(CASE WHEN a.x < b.x THEN a.x ELSE b.x END, 0) AS BIGINT) AS lx, CAST(round_even(CASE WHEN a.x < b.x THEN a.y ELSE b.y END, 0) AS BIGINT) AS ly,
      CASE WHEN a.x < b.x THEN a.pin ELSE b.pin END AS lp, CAST(round_even(CASE WHEN a.x < b.x THEN b.x ELSE a.x END, 0) AS BIGINT) AS rx,
      CAST(round_even(CASE WHEN a.x < b.x THEN b.y ELSE a.y END, 0) AS BIGINT) AS ry, CASE WHEN a.x < b.x THEN b.pin ELSE a.pin END AS rp
    FROM w a JOIN w b ON a.page_id = b.page_id AND a.ord < b.ord AND abs(a.y - b.y) < 14 AND abs(a.x - b.x) > 20 AND abs(a.x - b.x) < 320)"""


def pin_pairs(ev: Evidence):
    words = ev.v_label.select(
        F.floor(F.col("ord") / 250).alias("page_id"), "ord", ((F.col("x") % 2400).cast("double") + 0.25).alias("x"),
        ((F.col("y") % 1600).cast("double") + 0.25).alias("y"), (F.col("ord") % 64 + 1).alias("pin"))
    return packages.row_pairs(words)


@query("q_pairs", f"WITH {_PAIRS} SELECT page_id, a_ord, b_ord, lx, ly, lp, rx, ry, rp FROM p")
def q_pairs(ev):
    return pin_pairs(ev).select("page_id", "pair.a_ord", "pair.b_ord", F.col("left.x").alias("lx"), F.col("left.y").alias("ly"),
                                F.col("left.pin").alias("lp"), F.col("right.x").alias("rx"), F.col("right.y").alias("ry"),
                                F.col("right.pin").alias("rp"))


@query("q_packages", f"""
    WITH {_PAIRS},
    n AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY a_ord, b_ord) AS k FROM p),
    e AS (SELECT a.page_id, a.k AS i, b.k AS j FROM n a JOIN n b ON a.page_id = b.page_id AND a.k < b.k AND abs(a.lx - b.lx) < 30
          AND abs(a.rx - b.rx) < 30 AND abs(a.ly - b.ly) > 25),
    s(it, page_id, i, j, st) AS (
      SELECT 0, page_id, i, j, 'open' FROM e
      UNION ALL
      SELECT s.it + 1, s.page_id, s.i, s.j, CASE WHEN s.st <> 'open' THEN s.st
        WHEN EXISTS (SELECT 1 FROM s k WHERE k.page_id = s.page_id AND k.st = 'kept' AND (k.i IN (s.i, s.j) OR k.j IN (s.i, s.j))) THEN 'gone'
        WHEN NOT EXISTS (SELECT 1 FROM s k WHERE k.page_id = s.page_id AND k.st = 'open' AND (k.i IN (s.i, s.j) OR k.j IN (s.i, s.j))
             AND (k.i < s.i OR (k.i = s.i AND k.j < s.j))) THEN 'kept' ELSE 'open' END
      FROM s WHERE EXISTS (SELECT 1 FROM s o WHERE o.st = 'open')),
    m AS (SELECT DISTINCT page_id, i, j FROM s WHERE st = 'kept'),
    g AS (SELECT m.page_id, m.i, m.j, CASE WHEN a.ly < b.ly THEN a ELSE b END AS t, CASE WHEN a.ly < b.ly THEN b ELSE a END AS o
          FROM m JOIN n a ON m.page_id = a.page_id AND m.i = a.k JOIN n b ON m.page_id = b.page_id AND m.j = b.k),
    c AS (SELECT page_id, i, j, 0 AS side, t.lp AS pa, o.lp AS pb, t.lx AS xa, t.ly AS ya, o.lx AS xb, o.ly AS yb FROM g
          UNION ALL SELECT page_id, i, j, 1, t.rp, o.rp, t.rx, t.ry, o.rx, o.ry FROM g),
    q AS (SELECT *, unnest(range(0, abs(pa - pb) + 1)) AS z FROM c WHERE pa <> pb),
    r AS (SELECT page_id, i, j, pa + sign(pb - pa) * z AS pin, side, round_even(xa + (xb - xa) * (z::DOUBLE / abs(pa - pb)), 0) AS x,
          round_even(ya + (yb - ya) * (z::DOUBLE / abs(pa - pb)), 0) AS y FROM q),
    u AS (SELECT page_id, i, j, pin, arg_max(x, side) AS x, arg_max(y, side) AS y FROM r GROUP BY page_id, i, j, pin)
    SELECT g.page_id, a.a_ord, a.b_ord, greatest(g.t.lp, g.t.rp, g.o.lp, g.o.rp) AS pin_count, CAST(count(*) AS BIGINT) AS pins,
      CAST(min(u.x) - 12 AS BIGINT) AS x, CAST(min(u.y) - 12 AS BIGINT) AS y, CAST(max(u.x) - min(u.x) + 24 AS BIGINT) AS w,
      CAST(max(u.y) - min(u.y) + 24 AS BIGINT) AS h, concat('pin', g.t.lp) AS top_left, concat('pin', g.o.rp) AS bottom_right
    FROM g JOIN n a ON g.page_id = a.page_id AND g.i = a.k JOIN u ON g.page_id = u.page_id AND g.i = u.i AND g.j = u.j
    GROUP BY ALL""", recursive=True)
def q_packages(ev):
    found = cut(packages.opposite_edges(cut(pin_pairs(ev))))
    pins = packages.interpolate_pins(found)
    counts = pins.groupBy("page_id", "package").agg(F.count("*").alias("pins"))
    return packages.package_bodies(found, pins).join(counts, ["page_id", "package"]).select(
        "page_id", "package.i.a_ord", "package.i.b_ord", "pin_count", "pins", "x", "y", "w", "h", "top_left", "bottom_right")
