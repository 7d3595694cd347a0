"""Queries that combine chains with the board, and scores over rounds, batch and stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions.text import component_type
from ..operators import associate, registry, routing, scoring
from ..operators.ordered import first_per
from ..session import shared_dir
from ..streaming import rounds
from .bindings import Evidence
from .catalogue import query


def placed_labels(ev: Evidence):
    """One place per designator."""
    spots = first_per(ev.v_label.select("refdes", "ord", "x", "y"), ["refdes"], ["ord"])
    return spots.withColumn("view_name", F.when(F.col("ord") % 4 == 0, "bot").otherwise("top"))


_PLACES = """pl AS (SELECT refdes, arg_min(x, ord) AS x, arg_min(y, ord) AS y, CASE WHEN min(ord) % 4 = 0 THEN 'bot' ELSE 'top' END AS view_name FROM v_label GROUP BY refdes),
    ch AS (SELECT (c.chain_id - c.chain_id % 16) / 16 AS board, c.chain_id, c.idx, c.refdes, pl.x, pl.y, pl.view_name FROM v_chain c JOIN pl ON c.refdes = pl.refdes),
    ed AS (SELECT CAST(board AS BIGINT) AS board_id, chain_id * 1000 + idx AS edge_id, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2, refdes AS from_ref,
      lead(refdes) OVER w AS to_ref, view_name <> lead(view_name) OVER w AS cross_side FROM ch WINDOW w AS (PARTITION BY chain_id ORDER BY idx)),
    e AS (SELECT * FROM ed WHERE to_ref IS NOT NULL)"""


def board_edges(ev: Evidence):
    chain = ev.v_chain.select("chain_id", "idx", "refdes")
    located = registry.backfill_positions(chain, placed_labels(ev), 0)
    # The labels are in top-view space already: undo the mirroring of bottom places.
    located = located.withColumn("x", F.when(F.col("view_name") == "bot", F.col("x") * -1).otherwise(F.col("x")))
    edges = registry.chain_edges(located)
    return edges.select(F.floor(F.col("chain_id") / 16).alias("board_id"), (F.col("chain_id") * 1000 + F.col("idx")).alias("edge_id"),
                        "from_ref", "to_ref", "from_x", "from_y", "to_x", "to_y", "cross_side")


def board_nodes(ev: Evidence):
    chain = ev.v_chain.select(F.floor(F.col("chain_id") / 16).alias("board_id"), "refdes").distinct()
    nodes = chain.join(placed_labels(ev), "refdes")
    return nodes.select("board_id", "refdes", "x", "y", "view_name", F.when(F.col("ord") % 2 == 0, "ur").otherwise("dl").alias("lpos"),
                        F.lit(36).alias("fs"), F.startswith("refdes", F.lit("IC")).alias("outline"))


_ROUTE = _PLACES + """,
    o AS (SELECT e.*, 0 AS cand, [{'x': x1, 'y': y1}, {'x': x2, 'y': y2}] AS pts FROM e WHERE x1 = x2 OR y1 = y2
      UNION ALL SELECT e.*, 0, [{'x': x1, 'y': y1}, {'x': x1, 'y': y2}, {'x': x2, 'y': y2}] FROM e WHERE NOT (x1 = x2 OR y1 = y2)
      UNION ALL SELECT e.*, 1, [{'x': x1, 'y': y1}, {'x': x2, 'y': y1}, {'x': x2, 'y': y2}] FROM e WHERE NOT (x1 = x2 OR y1 = y2)
      UNION ALL SELECT e.*, k, [{'x': x1, 'y': y1}, {'x': x1, 'y': y1 + d}, {'x': x2, 'y': y1 + d}, {'x': x2, 'y': y2}] FROM e,
        (VALUES (2, -400), (3, -200), (4, -100), (5, -50), (6, 50), (7, 100), (8, 200), (9, 400)) t(k, d) WHERE NOT (x1 = x2 OR y1 = y2)),
    sg AS (SELECT board_id, edge_id, cand, pts[i] AS a, pts[i + 1] AS b FROM (SELECT *, unnest(range(1, len(pts))) AS i FROM o)),
    rt AS (SELECT * FROM sg WHERE cand = 0),
    kz AS (SELECT DISTINCT ch.board AS board_id, ch.refdes, ch.x, ch.y, length(ch.refdes) * 36 * 0.6::DOUBLE + 60 AS lw, 96 AS lh, m.par FROM ch
      JOIN (SELECT refdes, min(ord) % 2 AS par FROM v_label GROUP BY refdes) m ON ch.refdes = m.refdes),
    ko AS (SELECT board_id, CASE WHEN par = 0 THEN x + 10 ELSE x - lw - 10 END AS kx0, CASE WHEN par = 0 THEN y - lh - 10 ELSE y + 10 END AS ky0,
      CASE WHEN par = 0 THEN x + lw + 10 ELSE x - 10 END AS kx1, CASE WHEN par = 0 THEN y - 10 ELSE y + lh + 10 END AS ky1 FROM kz),
    cr AS (SELECT s.edge_id, s.cand, count(*) FILTER ((s.a.y = s.b.y AND t.a.x = t.b.x AND least(s.a.x, s.b.x) < t.a.x AND t.a.x < greatest(s.a.x, s.b.x)
          AND least(t.a.y, t.b.y) < s.a.y AND s.a.y < greatest(t.a.y, t.b.y)) OR (s.a.x = s.b.x AND t.a.y = t.b.y AND least(t.a.x, t.b.x) < s.a.x
          AND s.a.x < greatest(t.a.x, t.b.x) AND least(s.a.y, s.b.y) < t.a.y AND t.a.y < greatest(s.a.y, s.b.y))) AS crossings,
        count(*) FILTER (CASE WHEN s.a.y = s.b.y AND t.a.y = t.b.y THEN greatest(s.a.x, s.b.x) > least(t.a.x, t.b.x) AND greatest(t.a.x, t.b.x) > least(s.a.x, s.b.x)
            AND abs(s.a.y - t.a.y) > 0 AND abs(s.a.y - t.a.y) < 20 WHEN s.a.x = s.b.x AND t.a.x = t.b.x THEN greatest(s.a.y, s.b.y) > least(t.a.y, t.b.y)
            AND greatest(t.a.y, t.b.y) > least(s.a.y, s.b.y) AND abs(s.a.x - t.a.x) > 0 AND abs(s.a.x - t.a.x) < 20 ELSE false END) AS proximity
      FROM sg s JOIN rt t ON s.board_id = t.board_id AND s.edge_id <> t.edge_id GROUP BY s.edge_id, s.cand),
    lh AS (SELECT s.edge_id, s.cand, count(*) AS label_hits FROM sg s JOIN ko k ON s.board_id = k.board_id AND CASE WHEN s.a.y = s.b.y THEN
        k.ky0 < s.a.y AND s.a.y < k.ky1 AND greatest(s.a.x, s.b.x) > k.kx0 AND least(s.a.x, s.b.x) < k.kx1
        ELSE k.kx0 < s.a.x AND s.a.x < k.kx1 AND greatest(s.a.y, s.b.y) > k.ky0 AND least(s.a.y, s.b.y) < k.ky1 END GROUP BY s.edge_id, s.cand),
    ln AS (SELECT edge_id, cand, sum(abs(a.x - b.x) + abs(a.y - b.y)) AS length FROM sg GROUP BY edge_id, cand),
    sc AS (SELECT o.board_id, o.edge_id, o.cand, o.pts, o.x1, o.y1, o.from_ref, o.to_ref, o.cross_side, coalesce(crossings, 0) AS crossings, coalesce(proximity, 0) AS proximity, coalesce(label_hits, 0) AS label_hits,
        CAST(ln.length AS DOUBLE) AS length, round(coalesce(crossings, 0) * 10 + coalesce(proximity, 0) * 8 + coalesce(label_hits, 0) * 5 + ln.length * 0.02::DOUBLE, 4) AS score
      FROM o JOIN ln ON o.edge_id = ln.edge_id AND o.cand = ln.cand LEFT JOIN cr ON o.edge_id = cr.edge_id AND o.cand = cr.cand LEFT JOIN lh ON o.edge_id = lh.edge_id AND o.cand = lh.cand),
    br AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY score, cand) AS rn FROM sc) WHERE rn = 1)"""


@query("q_routes", f"WITH {_ROUTE} SELECT board_id, edge_id, CAST(cand AS INTEGER) AS cand, crossings, proximity, label_hits, length, score FROM br")
def q_routes(ev):
    best = routing.plan_routes(board_edges(ev), board_nodes(ev))
    return best.select("board_id", "edge_id", "cand", "crossings", "proximity", "label_hits", "length", "score")


@query("q_waypoints", f"""WITH {_ROUTE},
    nd AS (SELECT DISTINCT CAST(ch.board AS BIGINT) AS board_id, ch.refdes, ch.x, ch.y FROM ch),
    vi AS (SELECT DISTINCT board_id, to_ref FROM br WHERE cross_side)
    SELECT board_id, 'line' AS kind, x1 AS x, y1 AS y, '' AS label, CAST(len(pts) - 1 AS INTEGER) AS corners, cross_side AS dash, CAST(NULL AS VARCHAR) AS mark_type, CAST(NULL AS INTEGER) AS outline_w FROM br
    UNION ALL SELECT nd.board_id, 'mark', nd.x, nd.y, nd.refdes, CAST(NULL AS INTEGER), CAST(NULL AS BOOLEAN), CASE WHEN vi.to_ref IS NOT NULL THEN 'via' END,
      CASE WHEN nd.refdes LIKE 'IC%' THEN 220 END FROM nd LEFT JOIN vi ON nd.board_id = vi.board_id AND nd.refdes = vi.to_ref""")
def q_waypoints(ev):
    nodes = board_nodes(ev)
    out = routing.waypoints(routing.plan_routes(board_edges(ev), nodes), nodes)
    return out.select("board_id", "kind", "x", "y", "label", F.when(F.col("through").isNotNull(), F.size("through")).alias("corners"),
                      "dash", "mark_type", F.col("outline.w").alias("outline_w"))


# Scores ------------------------------------------------------------------------------

_TRUTH = """tr AS (SELECT fact, count(*) AS events, list_reduce(list_prepend(80, list(CASE kind WHEN 'human' THEN 1000 WHEN 'ok' THEN 10 WHEN 'fail' THEN -20 ELSE -30 END ORDER BY ts, seq, kind)),
      lambda a, b: CASE WHEN b = 1000 THEN 100 ELSE greatest(0, least(100, a + b)) END) AS score FROM v_truth GROUP BY fact)
    SELECT fact, events, CAST(score AS BIGINT) AS score, CASE WHEN score >= 90 THEN 'hard' WHEN score >= 40 THEN 'weight' ELSE 'ignore' END AS tier FROM tr"""


@query("q_truth", f"WITH {_TRUTH}")
def q_truth(ev):
    return scoring.truth_score(ev.v_truth)


@query("q_stable", """
    WITH r AS (SELECT fact, CAST(ts AS DATE) AS round, bool_and(kind = 'ok') AS ok FROM v_truth GROUP BY fact, CAST(ts AS DATE)),
    b AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY fact ORDER BY round) AS bad FROM r),
    s AS (SELECT fact, bad, count(*) AS len FROM b WHERE ok GROUP BY fact, bad),
    p AS (SELECT fact, max(len) AS longest, CAST(sum(len // 2) AS BIGINT) AS rewards FROM s GROUP BY fact)
    SELECT r.fact, count(*) AS rounds, coalesce(any_value(p.longest), 0) AS longest, coalesce(any_value(p.rewards), 0) AS rewards, coalesce(any_value(p.rewards), 0) * 10 AS bonus
    FROM r LEFT JOIN p ON r.fact = p.fact GROUP BY r.fact""")
def q_stable(ev):
    return scoring.stable_rounds(ev.v_truth.withColumn("round", F.to_date("ts")), n=2)


@query("q_leaderboard", """
    SELECT round, method, main_cc, main_kept, wide, row_number() OVER (PARTITION BY round ORDER BY wide > 60000, main_cc, main_kept DESC, method) AS place FROM v_round""")
def q_leaderboard(ev):
    return scoring.leaderboard(ev.v_round)


@query("q_delta", """
    WITH c AS (SELECT fact, CAST(ts AS DATE) AS round, count(*) AS n, max(seq) AS last FROM v_truth GROUP BY ALL),
    p AS (SELECT fact, round + 1 AS round, n, last FROM c),
    d AS (SELECT coalesce(c.round, p.round) AS round, CASE WHEN p.fact IS NULL THEN 'added' WHEN c.fact IS NULL THEN 'removed'
        WHEN c.n <> p.n OR c.last <> p.last THEN 'changed' END AS change FROM c FULL JOIN p ON c.fact = p.fact AND c.round = p.round)
    SELECT CAST(round AS DATE) AS round, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'changed') AS changed,
      count(*) FILTER (change = 'removed') AS removed FROM d WHERE change IS NOT NULL GROUP BY round""")
def q_delta(ev):
    now = ev.v_truth.groupBy("fact", F.to_date("ts").alias("round")).agg(F.count("*").alias("n"), F.max("seq").alias("last"))
    before = now.withColumn("round", F.date_add("round", 1))
    return scoring.delta_counts(scoring.round_delta(now, before, ["fact", "round"], ["n", "last"]), ["round"])


@query("q_recall", """
    WITH g AS (SELECT DISTINCT view_name AS round, engine AS method, text AS refdes, x, y FROM v_hit WHERE ord % 7 = 0),
    p AS (SELECT view_name AS round, engine AS method, text AS refdes, x, y FROM v_hit WHERE ord % 7 <> 0),
    h AS (SELECT g.*, EXISTS (SELECT 1 FROM p WHERE p.round = g.round AND p.method = g.method AND p.refdes = g.refdes
            AND (p.x - g.x) * (p.x - g.x) + (p.y - g.y) * (p.y - g.y) <= 100) AS hit FROM g)
    SELECT round, method, count(*) FILTER (hit) AS hits, count(*) AS truth, round(count(*) FILTER (hit)::DOUBLE / count(*), 4) AS recall FROM h GROUP BY round, method""")
def q_recall(ev):
    hits = ev.v_hit.select(F.col("view_name").alias("round"), F.col("engine").alias("method"), F.col("text").alias("refdes"), "x", "y", "ord")
    truth = hits.filter("ord % 7 = 0").drop("ord").distinct()
    return scoring.recall(associate.gt_hits(hits.filter("ord % 7 <> 0").drop("ord"), truth, 10))


# Streams: the driver's tables are laid down as run files and read back as a stream. -----


def _drain(stream, mode: str):
    """Run a stream over what is there and return all its rows; a batch that runs again replaces its rows."""
    spark = stream.sparkSession
    run = f"{shared_dir(spark)}/stream/drain-{_serial()}"
    if mode == "append":
        sink = stream.writeStream.format("parquet").option("path", f"{run}/out").outputMode("append")
    else:
        sink = stream.writeStream.foreachBatch(
            lambda df, batch: df.write.mode("overwrite").parquet(f"{run}/out/batch={batch}")).outputMode(mode)
    query_ = sink.option("checkpointLocation", f"{run}/checkpoint").trigger(availableNow=True).start()
    query_.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{run}/out").select(*stream.columns)


def _serial() -> str:
    return uuid.uuid4().hex


def _runs(df, parts: int, order: str):
    """Rows cut into runs that follow each other in time; rows without a time come first."""
    at = F.col(order).cast("timestamp").cast("double")
    bounds = df.select(at.alias("at")).approxQuantile("at", [i / parts for i in range(1, parts)], 0.01)
    for low, high in zip([None, *bounds], [*bounds, None]):
        part = df if low is None else df.filter(at > low)
        yield part if high is None else part.filter(at <= high if low is not None else at.isNull() | (at <= high))


def _run_files(df, parts: int, order: str):
    """Write rows as run files one after the other in time order, as runs add them."""
    path = f"{shared_dir(df.sparkSession)}/stream/runs-{_serial()}"
    for part in _runs(df, parts, order):
        part.write.mode("append").parquet(path)
    return path


def _drain_runs(df, parts: int, order: str, watch):
    """Run the stream that ``watch`` makes of a folder as each run lands there; return all its rows.

    A run may have any number of files, which come in no order of time: the stream takes them as
    one batch, as the watermark of a batch with some of them would drop the others as late.
    """
    path, run = (f"{shared_dir(df.sparkSession)}/stream/{kind}-{_serial()}" for kind in ("runs", "drain"))
    for part in _runs(df, parts, order):
        part.write.mode("append").parquet(path)
        stream = watch(df.sparkSession.readStream.schema(df.schema).parquet(path))
        (stream.writeStream.format("parquet").option("path", f"{run}/out").outputMode("append")
         .option("checkpointLocation", f"{run}/checkpoint").trigger(availableNow=True).start().awaitTermination())
    return df.sparkSession.read.schema(stream.schema).parquet(f"{run}/out").select(*stream.columns)


def streamed_hits(ev: Evidence):
    rows = ev.sql("""SELECT concat('run', CAST(l_suppkey % 10 AS STRING)) AS run_id, CASE l_linestatus WHEN 'F' THEN 'v4' ELSE 'v6' END AS engine,
        CASE l_returnflag WHEN 'A' THEN 'top' WHEN 'N' THEN 'bot' ELSE 'sch' END AS view_name, CAST(l_partkey AS STRING) AS text,
        l_discount AS conf, 300 AS src_dpi, l_partkey AS x, l_suppkey AS y, l_orderkey * 8 + l_linenumber AS ord, l_shipdate AS ts FROM lineitem""")
    return rounds.stream_hits(ev.spark, _run_files(rows, 4, "ts"), 2, fmt="parquet")


_SHITS = """h AS (SELECT concat('run', CAST(l_suppkey % 10 AS STRING)) AS run_id, CASE l_linestatus WHEN 'F' THEN 'v4' ELSE 'v6' END AS engine,
      CASE l_returnflag WHEN 'A' THEN 'top' WHEN 'N' THEN 'bot' ELSE 'sch' END AS view_name, l_orderkey * 8 + l_linenumber AS ord, l_shipdate AS ts FROM lineitem)"""


@query("s_hits", f"WITH {_SHITS} SELECT run_id, engine, view_name, ord, ts FROM h")
def s_hits(ev):
    return _drain(streamed_hits(ev), "append").select("run_id", "engine", "view_name", "ord", "ts")


@query("s_dedup", "SELECT event_id AS ord, user_id, ts FROM events")
def s_dedup(ev):
    events = ev.table("events").select(F.col("event_id").alias("ord"), "user_id", F.col("ts").cast("timestamp").alias("ts"))
    again = events.filter("ord % 3 = 0")  # a resumed scan delivers these a second time
    return _drain_runs(events.unionByName(again), 4, "ts", lambda stream: rounds.stream_dedup(stream, "1 day", keys=("ord",)))


@query("s_round", """
    SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS round_start, event_type, count(*) AS hits FROM events
    WHERE CAST(ts AS DATE) < (SELECT max(CAST(ts AS DATE)) FROM events) GROUP BY 1, 2""")
def s_round(ev):
    events = ev.table("events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    return _drain_runs(events, 4, "ts", lambda stream: rounds.stream_round_metrics(stream, "1 day", "1 minute", by=("event_type",)))


@query("s_truth", f"""WITH lim AS (SELECT max(ts) - INTERVAL 1 MINUTE AS w FROM v_truth),
    tr AS (SELECT fact, count(*) AS events, list_reduce(list_prepend(80, list(CASE kind WHEN 'human' THEN 1000 WHEN 'ok' THEN 10 WHEN 'fail' THEN -20 ELSE -30 END ORDER BY ts, seq, kind)),
      lambda a, b: CASE WHEN b = 1000 THEN 100 ELSE greatest(0, least(100, a + b)) END) AS score FROM v_truth, lim
      WHERE date_trunc('second', ts) + INTERVAL 1 SECOND <= date_trunc('milliseconds', w) GROUP BY fact)
    SELECT fact, events, CAST(score AS BIGINT) AS score FROM tr""")
def s_truth(ev):
    events = ev.v_truth.withColumn("ts", F.col("ts").cast("timestamp"))
    scored = _drain_runs(events, 4, "ts", lambda stream: rounds.stream_truth_score(stream, "1 minute"))
    last = F.max_by(F.struct("events", "score"), "events").alias("s")
    return scored.groupBy("fact").agg(last).select("fact", "s.events", "s.score")


@query("q_types", """SELECT ord, CASE WHEN refdes LIKE 'IC%' THEN 'IC' WHEN refdes LIKE 'Q%' THEN 'transistor' WHEN refdes LIKE 'R%' THEN 'resistor'
    WHEN refdes LIKE 'C%' THEN 'capacitor' WHEN refdes LIKE 'L%' THEN 'inductor' WHEN refdes LIKE 'D%' THEN 'diode' ELSE 'filter' END AS type,
    CAST(abs(x - 2400) + abs(y - 3150) AS DOUBLE) AS length FROM v_label""")
def q_types(ev):
    route = F.array(geo.point(F.col("x"), F.col("y")), geo.point(F.lit(2400), F.col("y")), geo.point(F.lit(2400), F.lit(3150)))
    return ev.v_label.select("ord", component_type(F.col("refdes")).alias("type"), F.round(geo.route_length(route), 1).alias("length"))
