"""Hits, anchors and chains fused into components, chain order and board positions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions.text import (chain_tokens, component_type, misread_variants, norm_key,
                              plausible_refdes, refdes_all)
from ..session import cut
from .ordered import first_per, rank_within, top_per, with_neighbour
from .spatial import nearest_k


def refs_of_hits(hits: DataFrame, text: str = "text") -> DataFrame:
    """One row per designator found in each hit's text."""
    return hits.withColumn("refdes", F.explode(refdes_all(F.col(text))))


def best_hit(hits: DataFrame, keys: list[str], score: str = "conf", order: str = "ord") -> DataFrame:
    """Row with the highest score per key; the earlier row stays on ties."""
    return first_per(hits, keys, [F.coalesce(F.col(score), F.lit(0)) * -1, F.col(order)])


def best_agreed(hits: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Per normalised designator the hit with the best (agree, conf) among plausible ones."""
    return first_per(hits.filter(plausible_refdes(F.col(text))), keys,
                     [F.col("agree").cast("int") * -1, F.col("conf") * -1, F.col("ord")])


_VIEW = "struct<px:struct<x:double,y:double>,alts:array<struct<x:double,y:double>>,src:string,conf:double,evidence:string>"


def _seen(df: DataFrame, view: str | Column, source: str, conf: Column | None = None,
          evidence: Column | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    view = F.lit(view) if isinstance(view, str) else view
    none = lambda t: F.lit(None).cast(t)
    return df.select(
        *by, norm_key(F.col("refdes")).alias("refdes"), view.alias("view"), F.lit(source).alias("src"),
        F.col("ord").cast("long").alias("ord"),
        geo.point(F.col("x").cast("double"), F.col("y").cast("double")).alias("px"),
        (none("double") if conf is None else conf.cast("double")).alias("conf"),
        (none("string") if evidence is None else evidence).alias("evidence"))


def merge_sources(schematic: DataFrame, anchors: DataFrame, ai_hits: DataFrame,
                  not_located: DataFrame | None = None, names: DataFrame | None = None,
                  ai_view: str = "pcb_top", by: tuple[str, ...] = ()) -> DataFrame:
    """One row per designator (and device, with ``by``) with its views, status, type, name and note.

    ``schematic``: refdes, ord, x, y; ``anchors``: the same and view_name (top/bot),
    note; ``ai_hits``: one best hit per designator with conf; ``not_located``:
    refdes, note, ord; ``names``: refdes, name.  Anchors confirm; a hit fills only an
    empty view; a missing part is unverified unless confirmed.  All schematic places
    of a part are kept in ``alts`` when there are several.  ``by`` names the columns
    that tell devices apart, present in every source.

    Each source is reduced to one row per part before the sources meet, with partial
    aggregation on the map side.
    """
    part = [*by, "refdes"]
    sch = _seen(schematic, "schematic", "schematic", by=by)
    # Equal places of a part are merged first, so a list holds only its distinct places.
    spots = sch.groupBy(*part, "view", "src", "px").agg(F.min("ord").alias("ord"))
    sch = spots.groupBy(*part, "view", "src").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "px"))), lambda s: s["px"]).alias("_all"))
    sch = sch.select(*part, "view", F.lit(1).alias("grade"), "src", F.col("_all")[0].alias("px"),
                     F.when(F.size("_all") > 1, F.col("_all"))
                     .otherwise(F.array().cast("array<struct<x:double,y:double>>")).alias("alts"),
                     F.lit(None).cast("double").alias("conf"), F.lit(None).cast("string").alias("evidence"))
    note = F.col("note") if "note" in anchors.columns else F.lit("")
    no_alts = F.array().cast("array<struct<x:double,y:double>>").alias("alts")
    # The last anchor of a view replaces earlier ones.
    anc = _seen(anchors, F.concat(F.lit("pcb_"), F.col("view_name")), "anchor", evidence=note, by=by)
    anc = first_per(anc, [*part, "view"], [F.col("ord") * -1]).select(
        *part, "view", F.lit(3).alias("grade"), "src", "px", no_alts, "conf", "evidence")
    ai = _seen(ai_hits, ai_view, "ai_run", conf=F.col("conf"), by=by)
    ai = first_per(ai, [*part, "view"], ["ord"]).select(
        *part, "view", F.lit(2).alias("grade"), "src", "px", no_alts, "conf", "evidence")
    rows = reduce(DataFrame.unionByName, [sch, anc, ai])
    entry = F.struct("px", "alts", "src", "conf", "evidence").cast(_VIEW)
    per_view = rows.groupBy(*part, "view").agg(
        F.max_by(entry, "grade").alias("entry"), F.max("grade").alias("grade"))
    parts = per_view.groupBy(*part).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("view", "entry")))).alias("views"),
        F.max("grade").alias("grade"))
    if not_located is not None:
        missing = first_per(not_located.select(*part, "note", "ord"), part, [F.col("ord") * -1])
        parts = parts.join(missing.select(*part, "note"), part, "full")
    else:
        parts = parts.withColumn("note", F.lit(None).cast("string"))
    # Only a part without an anchor can be unverified, and once it is, a hit changes nothing.
    status = (F.when(F.col("grade") == 3, "confirmed").when(F.col("note").isNotNull(), "unverified")
              .when(F.col("grade") == 2, "ocr_hit").otherwise("schematic_only"))
    parts = parts.withColumn("status", status).withColumn("type", component_type(F.col("refdes")))
    if names is not None:
        named = first_per(names.select(*part, "name"), part, ["name"])
        parts = parts.join(named, part, "left")
    else:
        parts = parts.withColumn("name", F.lit(None).cast("string"))
    return parts.select(*part, "type", F.coalesce("name", F.lit("")).alias("name"),
                        F.coalesce("views", F.create_map().cast(f"map<string,{_VIEW}>")).alias("views"),
                        "status", F.coalesce("note", F.lit("")).alias("note"))


def is_linked(views: Column) -> Column:
    return F.map_contains_key(views, "schematic") & (
        F.map_contains_key(views, "pcb_top") | F.map_contains_key(views, "pcb_bot"))


def cross_view_links(components: DataFrame) -> DataFrame:
    return components.filter(is_linked(F.col("views")))


def registry_summary(components: DataFrame, by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Totals of the registry, one row per value of ``by`` or one in all.  The linked parts are ``cross_view_links``."""
    status = F.col("status")
    return components.groupBy(*by).agg(
        F.count("*").alias("components"),
        *[F.count_if(status == s).alias(s) for s in ("confirmed", "ocr_hit", "unverified", "schematic_only")],
        F.count_if(is_linked(F.col("views"))).alias("linked"))


def chain_refs(elements: DataFrame, universe: DataFrame, keys: list[str], text: str = "elem") -> DataFrame:
    """Designators named in each chain element that the registry knows, with their place."""
    tokens = elements.select(*keys, "idx", F.col(text).alias("elem"),
                             F.posexplode(chain_tokens(F.col(text))).alias("pos", "refdes"))
    return tokens.join(universe.select("refdes").distinct(), "refdes", "left_semi")


def chain_elements(refs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``chain_elems`` array per designator of a device; equal places are merged first.

    ``by`` names the columns that tell devices apart: within one, a part stands in the
    chain a few times.
    """
    return refs.groupBy(*by, "refdes").agg(F.array_sort(F.collect_set(F.struct("idx", "elem"))).alias("chain_elems"))


def category_counts(detections: DataFrame, by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Detections per category, within each image that ``by`` names."""
    return detections.groupBy(*by, "category").agg(F.count("*").alias("n"))


def index_summary(index: DataFrame, by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Totals of a component index, or of each index that ``by`` names: rows, rows per view, with a role, validated."""
    return index.groupBy(*by).agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("view_name") == v).alias(f"in_{v}") for v in ("top", "bot", "sch")],
        F.count_if(F.col("role").isNotNull()).alias("with_role"),
        F.count_if(F.coalesce("validated", F.lit(False))).alias("validated"))


def merge_index(existing: DataFrame, found: DataFrame, score: str = "score") -> DataFrame:
    """Keep the known row of a designator unless a new one scores higher."""
    rows = (existing.withColumn("_new", F.lit(0)).unionByName(found.withColumn("_new", F.lit(1)), True))
    return first_per(rows, ["refdes"], [F.coalesce(F.col(score), F.lit(0)) * -1, F.col("_new"), F.col("ord")]).drop("_new")


def index_by_area(detections: DataFrame, key: str = "view") -> DataFrame:
    """Number detections from 0 per view, largest area first, then input order."""
    ranked = rank_within(detections, [key], [F.col("area").desc(), F.col("ord")], "idx")
    return ranked.withColumn("idx", F.col("idx") - 1)


def label_detections(detections: DataFrame, refs: DataFrame) -> DataFrame:
    """Best-scoring designator per detection and the status that follows from it.

    ``refs``: page_id, det (the detection's ord), ord, refdes, score, source.
    """
    best = first_per(refs.select("page_id", "det", "ord", "refdes", "score", "source"), ["page_id", "det"],
                     [F.coalesce(F.col("score"), F.lit(0)) * -1, F.col("ord")])
    best = best.select("page_id", F.col("det").alias("ord"), "refdes", "source")
    return detections.join(best, ["page_id", "ord"], "left").withColumn(
        "status", F.when(F.col("refdes").isNotNull(), "ocr_found").otherwise("unverified"))


def inside_board(df: DataFrame, boards: DataFrame) -> DataFrame:
    """Rows whose centre lies within their view's board box, edges included.

    ``boards``: view_name, bx0, by0, bx1, by1, one row per view.
    """
    inside = F.col("x").between(F.col("bx0"), F.col("bx1")) & F.col("y").between(F.col("by0"), F.col("by1"))
    return df.join(boards.select("view_name", "bx0", "by0", "bx1", "by1"), "view_name").filter(inside).select(*df.columns)


def by_category(detections: DataFrame, categories: list[str] | None = None, limit: int | None = None,
                keys: tuple[str, ...] = ("view_name",)) -> DataFrame:
    """Detections of the wanted classes; ``limit`` takes the first by ``idx`` of each of ``keys``."""
    out = detections if categories is None else detections.filter(F.col("category").isin(categories))
    if limit is None:
        return out
    place = Window.partitionBy(*keys).orderBy("idx")
    return out.withColumn("_place", F.row_number().over(place)).filter(F.col("_place") <= limit).drop("_place")


def shape_filter(df: DataFrame, area=(300, 200000), aspect_max=10.0, fill_min=0.4, side_min=5) -> DataFrame:
    long, short = F.greatest("w", "h"), F.least("w", "h")
    return df.filter(F.col("area").between(*area) & (short >= side_min) & (long / short <= aspect_max)
                     & (F.col("area") / (F.col("w") * F.col("h")) >= fill_min))


def refdes_like(df: DataFrame, text: str = "text") -> DataFrame:
    return df.filter(plausible_refdes(F.col(text)))


def min_area(df: DataFrame, n: int) -> DataFrame:
    return df.filter(F.col("area") >= n)


# Chains ------------------------------------------------------------------------------


def chain_order(components: DataFrame, chain: str = "chain_id") -> DataFrame:
    """One row per designator, by walked distance with unknown ones last, numbered from 1."""
    once = first_per(components.filter(F.col("refdes").isNotNull()), [chain, "refdes"], ["ord"])
    return rank_within(once, [chain], [F.col("walk_d").asc_nulls_last(), F.col("ord")], "idx")


def backfill_positions(chain: DataFrame, index: DataFrame, centre: float) -> DataFrame:
    """Chain rows with a board place: their own, else the index's, mirrored from the bottom.

    ``chain``: chain_id, idx, refdes and optionally pcb_x, pcb_y, pcb_view; ``index``:
    refdes, x, y, view_name, one row per designator.  Rows without a place keep nulls.
    """
    own = {c: (F.col(c) if c in chain.columns else F.lit(None)) for c in ("pcb_x", "pcb_y", "pcb_view")}
    rows = chain.select(*[c for c in chain.columns if c not in own], own["pcb_x"].cast("double").alias("_x"),
                        own["pcb_y"].cast("double").alias("_y"), own["pcb_view"].cast("string").alias("_v"))
    idx = index.select("refdes", geo.mirror_x(F.col("x"), centre, F.col("view_name")).cast("double").alias("_ix"),
                       F.col("y").cast("double").alias("_iy"), F.col("view_name").alias("_iv"))
    has_own = F.col("_x").isNotNull()
    joined = rows.join(idx, "refdes", "left")
    return joined.select(
        *[c for c in chain.columns if c not in own],
        F.bround(F.when(has_own, F.col("_x")).otherwise(F.col("_ix")), 0).cast("long").alias("x"),
        F.bround(F.when(has_own, F.col("_y")).otherwise(F.col("_iy")), 0).cast("long").alias("y"),
        F.when(has_own, F.coalesce("_v", F.lit("top"))).otherwise(F.col("_iv")).alias("view_name"))


def missing_positions(chain: DataFrame, index: DataFrame) -> DataFrame:
    """Chain elements with neither an own place nor one in the index."""
    open_rows = chain.filter(F.col("pcb_x").isNull()) if "pcb_x" in chain.columns else chain
    return open_rows.join(index.filter("x is not null").select("refdes"), "refdes", "left_anti").select(*chain.columns)


def chain_edges(located: DataFrame, chain: str = "chain_id") -> DataFrame:
    """Consecutive located elements; elements without a place are stepped over."""
    rows = located.filter(F.col("x").isNotNull() & F.col("refdes").isNotNull())
    linked = with_neighbour(rows, [chain], [F.col("idx")], 1,
                            {"refdes": "to_ref", "x": "to_x", "y": "to_y", "view_name": "to_view"})
    return linked.filter("to_ref is not null").select(
        chain, "idx", F.col("refdes").alias("from_ref"), "to_ref", F.col("x").alias("from_x"),
        F.col("y").alias("from_y"), F.col("view_name").alias("from_view"), "to_x", "to_y", "to_view",
        geo.l1(F.col("x"), F.col("y"), F.col("to_x"), F.col("to_y")).alias("length"),
        (F.col("view_name") != F.col("to_view")).alias("cross_side"))


def flow_ends(chain: DataFrame, k: int = 3, key: str = "chain_id") -> DataFrame:
    """Mean place of the first and of the last ``k`` elements of each chain."""
    rows = chain.select(key, "idx", "x", "y")

    def end(order, name):
        return top_per(rows, [key], [order], k).groupBy(key).agg(
            F.avg("x").alias(f"{name}_x"), F.avg("y").alias(f"{name}_y"))

    return end(F.col("idx").asc(), "up").join(end(F.col("idx").desc(), "down"), key)


def segment_heading(segments: DataFrame, ends: DataFrame, key: str = "chain_id") -> DataFrame:
    """The end of a stroke nearer the upstream point is its tail; ties keep the first end."""
    s = segments.join(ends.select(key, "up_x", "up_y"), key)
    d1 = geo.euclid(F.col("x1"), F.col("y1"), F.col("up_x"), F.col("up_y"))
    d2 = geo.euclid(F.col("x2"), F.col("y2"), F.col("up_x"), F.col("up_y"))
    swap = d1 > d2
    pick = lambda a, b: F.when(swap, F.col(a)).otherwise(F.col(b))
    return s.select(*segments.columns, pick("x2", "x1").alias("tail_x"), pick("y2", "y1").alias("tail_y"),
                    pick("x1", "x2").alias("head_x"), pick("y1", "y2").alias("head_y"))


def choose_alternate(chain: DataFrame, places: DataFrame, key: str = "chain_id", by: tuple[str, ...] = ()) -> DataFrame:
    """Among the places of a chain element the one closest to the element before it.

    ``places``: refdes, ord, x, y (several per designator); ``by`` names the columns that tell
    devices apart.  The first place of the previous element is the point of reference; the first
    element takes its first place.  The search goes by grid cells of each part's places, so
    an element never meets all places of its designator.
    """
    part = F.struct(*by, "refdes").alias("part")
    spots = places.groupBy(part, F.col("x").alias("sx"), F.col("y").alias("sy")).agg(F.min("ord").alias("s_ord"))
    main = first_per(spots, ["part"], ["s_ord"]).select("part", F.col("sx").alias("mx"), F.col("sy").alias("my"), "s_ord")
    located = chain.select(key, "idx", part).join(main, "part")
    before = cut(with_neighbour(located, [key], [F.col("idx")], -1, {"mx": "x", "my": "y"}))
    near = nearest_k(before.filter("x IS NOT NULL").select("part", "x", "y"), spots, 1, key="part")
    out = [key, "idx", F.col("part.refdes").alias("refdes")]
    first = before.filter("x IS NULL").select(*out, F.col("mx").alias("x"), F.col("my").alias("y"), F.lit(0).cast("long").alias("dist"), F.col("s_ord").alias("ord"))
    rest = before.select(key, "idx", "part", "x", "y").join(near, ["part", "x", "y"]).select(
        *out, F.col("sx").alias("x"), F.col("sy").alias("y"), F.col("distance").alias("dist"), F.col("s_ord").alias("ord"))
    return first.unionByName(rest)


def correct_misreads(hits: DataFrame, universe: DataFrame) -> DataFrame:
    """Replace texts the chain does not know by a variant it does know.

    ``hits`` has ``text``; the result keeps it and adds ``corrected`` and ``correction``
    (null where nothing changed).  Each distinct text is looked up once.
    """
    known = universe.select("refdes").distinct()
    texts = hits.select("text").distinct().join(known, F.col("text") == F.col("refdes"), "left_anti")
    options = texts.select("text", F.posexplode(misread_variants(F.col("text"))).alias("_pos", "_variant"))
    fixed = (options.join(known, F.col("_variant") == F.col("refdes"), "left_semi")
             .groupBy("text").agg(F.min_by("_variant", "_pos").alias("_fix")))
    out = hits.join(fixed, "text", "left")
    reason = F.when(F.col("_fix").isNotNull(), F.concat("text", F.lit(" -> "), "_fix"))
    return out.select(*hits.columns, F.coalesce("_fix", "text").alias("corrected"), reason.alias("correction"))


def touched_and_serial(touched: DataFrame, parts: DataFrame, rules: list[tuple[str, str | None]]) -> DataFrame:
    """Touched parts of the classes that sit in series, as (type, designator pattern or null)."""
    plain = [t for t, pattern in rules if not pattern]
    test = reduce(lambda a, c: a | c, [(F.col("type") == t) & F.col("refdes").rlike(p) for t, p in rules if p],
                  F.col("type").isin(plain))
    typed = touched.withColumn("type", component_type(F.col("refdes"))).filter(test)
    return typed.join(parts.select("refdes").distinct(), "refdes", "left_semi").select(*touched.columns, "type")


# Classes of parts that carry the signal.
SERIAL_RULES = [("transistor", None), ("IC", None), ("filter", None), ("xtal", None),
                ("capacitor", None), ("inductor", None)]
