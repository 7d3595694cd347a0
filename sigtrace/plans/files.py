"""Round trips: the driver's tables written as the documents that readers take, and read back; sinks written and read."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources import readers, tables, writers
from .bindings import Evidence
from .catalogue import query


def _folder(ev: Evidence) -> str:
    return f"{shared_dir(ev.spark)}/files-{uuid.uuid4().hex}"


def _documents(ev: Evidence, docs: DataFrame, by: str) -> str:
    """A folder with one JSON file per row; rows of one ``by`` share a document already."""
    path = _folder(ev)
    docs.repartition(F.col(by)).withColumn("_doc", F.col(by)).drop(by).write.partitionBy("_doc").json(path)
    return f"{path}/_doc=*/*.json"


def _batches(ev: Evidence, docs: DataFrame, by: str, size: int = 64) -> str:
    """A folder of JSON arrays, each with the documents of ``size`` neighbouring values of ``by``: files cost more than rows."""
    batch = F.floor(F.col(by) / size).alias("_batch")
    own = docs.select(batch, F.to_json(F.struct(*[F.col(c) for c in docs.columns if c != by])).alias("value"))
    lists = own.groupBy("_batch").agg(F.concat(F.lit("["), F.concat_ws(",", F.collect_list("value")), F.lit("]")).alias("value"))
    return _texts(ev, lists, "_batch")


def _texts(ev: Evidence, docs: DataFrame, by: str) -> str:
    """Like ``_documents`` for rows (``by``, value) that are a whole document as text."""
    path = _folder(ev)
    docs.repartition(F.col(by)).write.partitionBy(by).text(path)
    return f"{path}/{by}=*/*.txt"


def _listed(order: str, *columns) -> Column:
    """The rows of a group as an array of structs in order."""
    both = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*columns).alias("_v"))))
    return F.transform(both, lambda s: s["_v"])


_RUNS = """SELECT l_suppkey AS run, l_orderkey * 8 + l_linenumber AS seq, concat('C', CAST(l_partkey AS STRING)) AS text,
    CAST(l_discount AS DOUBLE) AS conf, CAST(l_partkey % 1600 AS DOUBLE) AS x, CAST(l_orderkey % 2100 AS DOUBLE) AS y,
    l_linenumber % 2 = 0 AS raw FROM lineitem"""


@query("r_ocr_runs", f"""WITH r AS ({_RUNS})
    SELECT concat('run', CAST(run AS STRING)) AS run_id, CASE WHEN raw THEN 'raw_stage1' ELSE 'hits' END AS section,
      row_number() OVER (PARTITION BY run, raw ORDER BY seq, text, conf, x, y) - 1 AS ord, text, conf, x, y, CAST(300 AS INTEGER) AS src_dpi FROM r""")
def r_ocr_runs(ev):
    rows = ev.sql(_RUNS)
    hit = (F.col("text"), F.col("conf"), F.array("x", "y").alias("px"))
    per = rows.groupBy("run", "raw").agg(_listed("seq", *hit).alias("own"))
    docs = per.groupBy("run").agg(F.max(F.when(~F.col("raw"), F.col("own"))).alias("hits"), F.max(F.when(F.col("raw"), F.col("own"))).alias("raw_stage1"))
    docs = docs.select("run", F.concat(F.lit("run"), F.col("run").cast("string")).alias("run_id"), F.lit(300).alias("dpi"), "hits", "raw_stage1")
    return readers.read_ocr_runs(ev.spark, _batches(ev, docs, "run")).select("run_id", "section", "ord", "text", "conf", "x", "y", "src_dpi")


@query("r_detections", """
    SELECT CASE WHEN kind = 'circle' THEN 'circle' ELSE 'rect' END AS shape, page_id AS image, CAST(ord AS INTEGER) AS idx, CAST(x0 AS DOUBLE) AS x0,
      CAST(y0 AS DOUBLE) AS y0, CAST(w AS DOUBLE) AS w, CAST(h AS DOUBLE) AS h, CAST(area AS DOUBLE) AS area, kind AS category, CAST(6300 AS DOUBLE) AS board_y1 FROM v_box""")
def r_detections(ev):
    box = ev.v_box.withColumn("round", F.col("kind") == "circle")
    shape = (F.col("ord").cast("int").alias("idx"), F.array("x0", "y0", F.col("x0") + F.col("w"), F.col("y0") + F.col("h")).alias("bbox"),
             F.col("area").cast("double").alias("area"), F.col("kind").alias("category"))
    docs = box.groupBy("page_id", "round").agg(_listed("ord", *shape).alias("own"))
    docs = docs.select(F.concat_ws("-", "page_id", "round").alias("doc"), F.col("page_id").alias("image"), F.array(*map(F.lit, (0, 0, 4800, 6300))).alias("board_bbox"),
                       F.when(F.col("round"), F.col("own")).alias("circles"), F.when(~F.col("round"), F.col("own")).alias("rectangles"))
    return readers.read_detections(ev.spark, _documents(ev, docs, "doc")).select(
        "shape", "image", "idx", "x0", "y0", "w", "h", "area", "category", "board_y1")


@query("r_component_index", """
    SELECT concat('C', CAST(ord AS STRING)) AS refdes, CASE WHEN ord % 2 = 0 THEN 'bot' ELSE 'top' END AS view_name, CAST(x0 AS DOUBLE) AS x,
      CAST(y0 AS DOUBLE) AS y, CAST(300 AS DOUBLE) AS src_dpi, ord % 3 = 0 AS validated FROM v_box""")
def r_component_index(ev):
    box = ev.v_box
    entry = F.struct(F.array("x0", "y0").alias("center"), F.when(F.col("ord") % 2 == 0, "bot").alias("view"),
                     F.struct(F.lit(300).alias("src_dpi"), F.lit(600).alias("tgt_dpi")).alias("transform"), (F.col("ord") % 3 == 0).alias("validated"))
    own = box.select("page_id", F.struct(F.concat(F.lit("C"), F.col("ord").cast("string")).alias("key"), entry.alias("value")).alias("e"))
    docs = own.groupBy("page_id").agg(F.to_json(F.map_from_entries(F.collect_list("e"))).alias("value"))
    docs = docs.withColumn("value", F.concat(F.lit('{"_meta": {"x": 1}, '), F.substring("value", 2, 1 << 30)))
    return readers.read_component_index(ev.spark, _texts(ev, docs, "page_id")).select("refdes", "view_name", "x", "y", "src_dpi", "validated")


@query("r_chain", """
    SELECT CAST(turn AS BIGINT) AS idx, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ord, concat('C', CAST(conv_id AS STRING)) AS refdes,
      role AS type, CAST(length(text) AS DOUBLE) AS walk_d, CAST(turn * 10 AS DOUBLE) AS sch_x FROM conversations""")
def r_chain(ev):
    turns = ev.table("conversations")
    part = (F.col("turn").cast("int").alias("idx"), F.concat(F.lit("C"), F.col("conv_id").cast("string")).alias("refdes"), F.col("role").alias("symbol_type"),
            F.array(F.col("turn") * 10, F.lit(0)).alias("sch_px"), F.length("text").cast("double").alias("walk_d"))
    docs = turns.groupBy("conv_id").agg(_listed("turn", *part).alias("chain"))
    docs = docs.groupBy((F.col("conv_id") % 16).alias("batch"), "conv_id").agg(F.first("chain").alias("chain"))
    path = _folder(ev)
    docs.repartition(F.col("conv_id")).write.partitionBy("batch", "conv_id").json(path)
    return readers.read_chain(ev.spark, f"{path}/batch=*/conv_id=*/*.json").select("idx", "ord", "refdes", "type", "walk_d", "sch_x")


_FIRST_LABEL = """SELECT page_id, refdes, arg_min(x, ord) AS x, arg_min(y, ord) AS y FROM v_label GROUP BY page_id, refdes"""


@query("r_label_positions", f"SELECT refdes, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM ({_FIRST_LABEL})")
def r_label_positions(ev):
    docs = ev.v_label.groupBy("page_id").agg(F.to_json(_listed("ord", "refdes", "x", "y")).alias("value"))
    return readers.read_label_positions(ev.spark, _texts(ev, docs, "page_id")).select("refdes", "x", "y")


@query("r_legend", "SELECT upper(n_name) AS label, CAST(n_nationkey AS INTEGER) AS b, CAST(n_regionkey AS INTEGER) AS g, CAST(7 AS INTEGER) AS r FROM nation")
def r_legend(ev):
    entry = (F.lower("n_name").alias("label"), F.array(F.col("n_nationkey").cast("int"), F.col("n_regionkey").cast("int"), F.lit(7)).alias("color_bgr"))
    docs = ev.table("nation").groupBy("n_regionkey").agg(_listed("n_nationkey", *entry).alias("entries"))
    return readers.read_legend(ev.spark, _documents(ev, docs, "n_regionkey")).select("label", "b", "g", "r")


@query("r_anchors", """
    SELECT 'anchor' AS what, concat('C', CAST(s_suppkey AS STRING)) AS refdes, CASE WHEN s_suppkey % 2 = 0 THEN 'top' ELSE 'bot' END AS view_name,
      CAST(s_suppkey AS DOUBLE) AS x, s_name AS note FROM supplier
    UNION ALL SELECT 'missing', concat('Q', CAST(s_suppkey AS STRING)), NULL, NULL, concat('Q', CAST(s_suppkey AS STRING), ' ', s_name) FROM supplier WHERE s_suppkey < 10000
    UNION ALL SELECT 'chain', NULL, NULL, NULL, s_name FROM supplier""")
def r_anchors(ev):
    rows = ev.table("supplier").withColumn("top", F.col("s_suppkey") % 2 == 0)
    ref = lambda p: F.concat(F.lit(p), F.col("s_suppkey").cast("string"))
    entry = F.struct(F.concat(ref("c"), F.lit("_1")).alias("key"), F.struct(F.array("s_suppkey", F.lit(5)).alias("label_px"), F.col("s_name").alias("note")).alias("value"))
    docs = rows.groupBy("s_nationkey").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("top"), entry))).alias("confirmed_anchors_top"),
        F.map_from_entries(F.collect_list(F.when(~F.col("top"), entry))).alias("confirmed_anchors_bot"),
        F.collect_list(F.concat(ref("Q"), F.lit(" "), F.col("s_name"))).alias("not_located"), F.collect_list("s_name").alias("chain_order_schematic"))
    found = readers.read_anchors(ev.spark, _documents(ev, docs, "s_nationkey"))
    none = F.lit(None).cast("string")
    tag = lambda what, *columns: [F.lit(what).alias("what"), *columns]
    anchors = found["anchors"].select(*tag("anchor", "refdes", "view_name", "x", "note"))
    lost = found["not_located"].select(*tag("missing", "refdes", none.alias("view_name"), F.lit(None).cast("double").alias("x"), "note"))
    chain = found["chain"].select(*tag("chain", none.alias("refdes"), none.alias("view_name"), F.lit(None).cast("double").alias("x"), F.col("elem").alias("note")))
    return anchors.unionByName(lost).unionByName(chain)


@query("r_pixels", "SELECT page_id, x, y, b, g, r FROM v_pixel")
def r_pixels(ev):
    """Page partitions replaced one by one (K1), then read back (S10)."""
    path, pixels = _folder(ev), ev.v_pixel
    writers.write_table(pixels.withColumn("b", F.lit(0).cast("long")).withColumn("part", F.pmod("page_id", F.lit(8))), path, ["part"])
    writers.write_table(pixels.withColumn("part", F.pmod("page_id", F.lit(8))), path, ["part"])
    return readers.read_pixels(ev.spark, path)


@query("k_table", "SELECT o_orderkey, o_totalprice FROM orders")
def k_table(ev):
    """A table replaced as a whole, from rows read out of itself."""
    path, orders = _folder(ev), ev.table("orders").select("o_orderkey", "o_totalprice")
    writers.write_table(orders.withColumn("o_orderkey", -F.col("o_orderkey")), path)
    writers.write_table(tables.read(ev.spark, path).withColumn("o_orderkey", -F.col("o_orderkey")), path)
    return tables.read(ev.spark, path)


@query("k_knowledge", "SELECT l_partkey AS part, min(l_quantity) AS size FROM lineitem GROUP BY l_partkey")
def k_knowledge(ev):
    """Sizes appended round by round: a part once known is never overwritten."""
    path = _folder(ev)
    lines = ev.table("lineitem").groupBy(F.col("l_partkey").alias("part")).agg(F.min("l_quantity").alias("size"))
    writers.append_knowledge(lines.filter("part % 2 = 0"), path, ["part"])
    writers.append_knowledge(lines.unionByName(lines.filter("part % 2 = 0").withColumn("size", F.col("size") + 1000)).filter("part % 2 = 1 OR size > 1000"), path, ["part"])
    return ev.spark.read.parquet(path)


@query("k_waypoints", """SELECT o_custkey % 10 AS board_id, o_orderkey AS ord, CASE WHEN o_orderkey % 3 = 0 THEN 'mark' ELSE 'line' END AS kind,
    CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS far FROM orders""")
def k_waypoints(ev):
    path, orders = _folder(ev), ev.table("orders")
    mark = F.col("o_orderkey") % 3 == 0
    writers.write_waypoints(orders.select((F.col("o_custkey") % 10).alias("board_id"), F.col("o_orderkey").alias("ord"), F.when(mark, "mark").otherwise("line").alias("kind"),
                                          F.when(~mark, F.col("o_custkey")).alias("far")), path)
    return ev.spark.read.schema("ord long, kind string, far long, board_id long").json(path)


@query("k_report", "SELECT CAST(ts AS DATE) AS round, event_type, count(*) AS n, '3' AS tol FROM events GROUP BY 1, 2")
def k_report(ev):
    path = _folder(ev)
    rows = ev.table("events").groupBy(F.col("ts").cast("date").alias("round"), "event_type").agg(F.count("*").alias("n"))
    writers.write_report(rows, path, {"tol": 3})
    return ev.spark.read.parquet(path).select("round", "event_type", "n", F.col("params")["tol"].alias("tol"))


__all__ = ["r_ocr_runs", "r_detections", "r_component_index", "r_chain", "r_label_positions", "r_legend", "r_anchors", "r_pixels",
           "k_table", "k_knowledge", "k_waypoints", "k_report"]
