"""Readers of evidence documents; each returns flat rows with an input position ``ord``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.text import norm_key
from ..operators.ordered import first_per
from . import tables


def _file():
    return F.col("_metadata.file_path").alias("source")


def _point(c: str):
    px = F.col(c)
    return [px[0].alias("x"), px[1].alias("y")]


def _polygon(c):
    return F.transform(c, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def _documents(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return spark.read.schema(ddl).option("multiLine", True).json(path).select("*", _file())


def read_ocr_runs(spark: SparkSession, path: str) -> DataFrame:
    """Hits of recognition runs, from the result list and both raw stages."""
    runs = _documents(spark, path, schema.OCR_RUN)
    parts = [runs.select("source", "run_id", "view", "image", F.col("dpi").alias("src_dpi"), "ts",
                         F.lit(section).alias("section"), F.posexplode(section).alias("ord", "h"))
             for section in ("hits", "raw_stage1", "raw_stage2")]
    hits = reduce(DataFrame.unionByName, parts).filter("h.text is not null and h.px is not null")
    return hits.select("source", "section", F.col("ord").cast("long").alias("ord"), "run_id", "view", "image",
                       "src_dpi", "ts", "h.text", F.coalesce("h.conf", F.lit(0.0)).alias("conf"), *_point("h.px"),
                       _polygon(F.col("h.box")).alias("box"), "h.engine", "h.agree", "h.norm", "h.refdes_like")


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """Rectangles or circles of a crop index, one row per shape."""
    docs = _documents(spark, path, schema.DETECTIONS)
    shape = F.when(F.col("rectangles").isNotNull(), "rect").otherwise("circle")
    rows = docs.select("source", F.coalesce("view", "_meta.view").alias("view"),
                       F.coalesce("image", "_meta.image").alias("image"),
                       F.coalesce("image_dpi", "_meta.image_dpi").alias("image_dpi"), "board_bbox",
                       shape.alias("shape"), F.posexplode(F.coalesce("rectangles", "circles")).alias("ord", "d"))
    corner = F.col("d.bbox")
    return rows.select(
        "source", "view", "image", "image_dpi", "shape", F.col("ord").cast("long").alias("ord"),
        F.coalesce("d.idx", "ord").alias("idx"), corner[0].alias("x0"), corner[1].alias("y0"),
        (corner[2] - corner[0]).alias("w"), (corner[3] - corner[1]).alias("h"), "d.area", "d.aspect",
        "d.rectangularity", "d.radius", "d.diameter", "d.circularity", "d.method", "d.category", "d.status",
        "d.refdes", F.col("board_bbox")[0].alias("board_x0"), F.col("board_bbox")[1].alias("board_y0"),
        F.col("board_bbox")[2].alias("board_x1"), F.col("board_bbox")[3].alias("board_y1"))


def _keyed(spark: SparkSession, path: str) -> DataFrame:
    """Entries of objects keyed by designator, keys starting with an underscore left out."""
    docs = spark.read.option("wholetext", True).text(path).select("value", _file())
    pairs = docs.select("source", F.posexplode(F.from_json("value", "map<string,string>")).alias("ord", "key", "entry"))
    return pairs.filter(~F.startswith("key", F.lit("_"))).withColumn("ord", F.col("ord").cast("long"))


def read_component_index(spark: SparkSession, path: str) -> DataFrame:
    rows = _keyed(spark, path).select("source", "ord", "key", F.from_json("entry", schema.INDEX_ENTRY).alias("e"))
    return rows.select("source", "ord", F.col("key").alias("refdes"), F.coalesce("e.view", F.lit("top")).alias("view_name"),
                       *_point("e.center"), _polygon(F.col("e.box")).alias("box"), "e.src", "e.scale",
                       "e.transform.src_dpi", "e.transform.tgt_dpi", "e.tgt_image_dpi",
                       F.col("e.tgt_image_size")[0].alias("tgt_w"), F.col("e.tgt_image_size")[1].alias("tgt_h"),
                       F.when(F.col("e.tgt_board_bbox").isNotNull(), F.struct(*[
                           F.col("e.tgt_board_bbox")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])).alias("board"),
                       "e.validated", "e.agree", "e.role", "e.score")


def read_chain(spark: SparkSession, path: str) -> DataFrame:
    rows = _documents(spark, path, schema.CHAIN).select("source", F.posexplode("chain").alias("ord", "c"))
    return rows.select(F.col("source").alias("chain_id"), F.col("ord").cast("long").alias("ord"),
                       F.coalesce("c.idx", F.col("ord") + 1).cast("long").alias("idx"), "c.refdes",
                       F.col("c.symbol_type").alias("type"), F.col("c.sch_px")[0].alias("sch_x"),
                       F.col("c.sch_px")[1].alias("sch_y"), F.col("c.pcb_px")[0].alias("pcb_x"),
                       F.col("c.pcb_px")[1].alias("pcb_y"), "c.pcb_view", "c.walk_d", "c.status")


def read_label_positions(spark: SparkSession, path: str) -> DataFrame:
    """Designator places from an object of arrays or a list of records; the first one wins."""
    docs = spark.read.option("wholetext", True).text(path).select("value", _file())
    is_list = F.ltrim("value").startswith("[")
    listed = docs.filter(is_list).select(
        "source", F.posexplode(F.from_json("value", f"array<{schema.LABEL_RECORD}>")).alias("ord", "r"))
    listed = listed.select("source", "ord", "r.refdes", "r.x", "r.y", "r.box")
    entry = F.from_json("entry", "array<string>")
    keyed = docs.filter(~is_list).select(
        "source", F.posexplode(F.from_json("value", "map<string,string>")).alias("ord", "refdes", "entry"))
    keyed = keyed.select("source", "ord", "refdes", F.bround(entry[0].cast("double"), 0).alias("x"),
                         F.bround(entry[1].cast("double"), 0).alias("y"),
                         F.from_json(F.get(entry, 4), schema.BOX).alias("box"))
    rows = listed.unionByName(keyed).withColumn("ord", F.col("ord").cast("long"))
    rows = rows.withColumn("box", _polygon(F.col("box")))
    return first_per(rows, ["source", "refdes"], ["ord"])


def read_legend(spark: SparkSession, path: str) -> DataFrame:
    rows = _documents(spark, path, schema.LEGEND).select("source", F.posexplode("entries").alias("ord", "e"))
    rows = rows.filter("e.color_bgr is not null and e.label is not null and e.label <> ''")
    return rows.select("source", F.col("ord").cast("long").alias("ord"), F.upper("e.label").alias("label"),
                       *_point("e.px"), "e.conf", *[F.col("e.color_bgr")[i].alias(c) for i, c in enumerate("bgr")])


def read_anchors(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables ``anchors`` (refdes, view_name, x, y, note), ``not_located`` and ``chain``."""
    docs = _documents(spark, path, schema.ANCHORS)
    sides = [docs.select("source", F.lit(view).alias("view_name"), F.lit(i).alias("_side"),
                         F.posexplode(f"confirmed_anchors_{view}").alias("_pos", "key", "a"))
             for i, view in enumerate(("top", "bot"))]
    rows = reduce(DataFrame.unionByName, sides)
    anchors = rows.select("source", (F.col("_side").cast("long") * 2 ** 31 + F.col("_pos")).alias("ord"),
                          norm_key(F.col("key")).alias("refdes"), "view_name", *_point("a.label_px"),
                          F.coalesce("a.note", F.lit("")).alias("note"))
    missing = docs.select("source", F.posexplode("not_located").alias("ord", "note"))
    ref = F.regexp_extract("note", r"^([A-Z]{1,3}[0-9]{1,4}[A-Z]?)\b", 1)
    missing = missing.select("source", F.col("ord").cast("long").alias("ord"), ref.alias("refdes"), "note").filter("refdes <> ''")
    chain = docs.select("source", F.posexplode("chain_order_schematic").alias("idx", "elem"))
    return {"anchors": anchors, "not_located": missing, "chain": chain}


def read_part_names(spark: SparkSession, path: str) -> DataFrame:
    return _keyed(spark, path).select("source", "ord", F.col("key").alias("refdes"), F.col("entry").alias("name"))


# Resolutions and markup of the word files.
WORD_DPI, PAGE_DPI = 72, 300
_WORD = r'<word xMin="([\d.]+)" yMin="([\d.]+)" xMax="[\d.]+" yMax="[\d.]+">(\d+)</word>'


def number_words(lines: DataFrame, text: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Pin-number words ``x, y, pin`` in markup lines, at 300 dpi; only 1..64 are pins."""
    word = lines.select(*keep, F.explode(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))).alias("w"))
    part = lambda i, t: F.regexp_extract("w", _WORD, i).cast(t)
    rows = word.select(*keep, (part(1, "double") * PAGE_DPI / WORD_DPI).alias("x"),
                       (part(2, "double") * PAGE_DPI / WORD_DPI).alias("y"), part(3, "long").alias("pin"))
    return rows.filter(F.col("pin").between(1, 64))


def read_words(spark: SparkSession, path: str) -> DataFrame:
    return number_words(spark.read.text(path).select("value", _file()), keep=("source",))


def read_pixels(spark: SparkSession, path: str, pages: list | None = None) -> DataFrame:
    """Decoded pixel rows; ``pages`` prunes the page partitions."""
    pixels = tables.read(spark, path).select("page_id", "x", "y", "b", "g", "r")
    return pixels if pages is None else pixels.filter(F.col("page_id").isin(pages))
