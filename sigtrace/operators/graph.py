"""Iterative operators over run and pixel graphs: components, hops, degrees, matching."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .runs import TILE, runs

BAND_RUNS = 100_000
BAND_BITS = 12  # rows of a band in ``components``, as a power of two
ROW_BITS = 32  # a run's id is its row and start column, each an int, packed into one long


def with_node(run_rows: DataFrame) -> DataFrame:
    """Add ``node``; ids order runs by row, then by start, within a page.

    No two places share an id; a place beyond the range of ints is an error.
    """
    half = 1 << (ROW_BITS - 1)
    fits = F.col("pos").between(-half, half - 1) & F.col("lo").between(-half, half - 1)
    node = F.shiftleft(F.col("pos").cast("long"), ROW_BITS) + F.col("lo")
    return run_rows.withColumn("node", F.when(fits, node).otherwise(F.raise_error(F.lit("place beyond 32 bits")).cast("long")))


def run_edges(nodes: DataFrame) -> DataFrame:
    """8-connected neighbours: runs of adjacent rows that overlap or meet diagonally.

    Runs are filed in column tiles, so a long row never meets all of the next one.
    """
    def tiled(df, grow):
        lo, hi = F.col("lo") - grow, F.col("hi") + grow
        return df.withColumn("_t", F.explode(F.sequence(F.floor(lo / TILE), F.floor(hi / TILE))))

    up = tiled(nodes, 0).select("page_id", F.col("pos").alias("_row"), "_t", F.col("node").alias("a"),
                                F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"))
    down = tiled(nodes, 1).select("page_id", (F.col("pos") - 1).alias("_row"), "_t", F.col("node").alias("b"),
                                  F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"))
    pairs = up.join(down, ["page_id", "_row", "_t"])
    once = F.floor(F.greatest(F.col("a_lo"), F.col("b_lo") - 1) / TILE) == F.col("_t")  # where they first meet
    return (pairs.filter(once & (F.col("a_lo") <= F.col("b_hi") + 1) & (F.col("b_lo") - 1 <= F.col("a_hi")))
            .select("page_id", "a", "b"))


def _stars(most: int):
    """Contracts sorted edges ``page_id, band, u, v`` in pieces of whole bands, or of ``most`` and more edges of one.

    Both functions are made here, so that executors need nothing of this package.
    """
    def contract(rows: pd.DataFrame) -> pd.DataFrame:
        """Each node ``u`` of some edges with the smallest node ``v`` they lead it to, but for those smallest nodes."""
        page, names = pd.factorize(rows["page_id"])
        at, node = np.concatenate([page, page]), np.concatenate([rows["u"].to_numpy(), rows["v"].to_numpy()])
        order = np.lexsort((node, at))
        at, node = at[order], node[order]
        fresh = (np.diff(at, prepend=-1) != 0) | (np.diff(node, prepend=node[0]) != 0)
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.cumsum(fresh) - 1
        at, node = at[fresh], node[fresh]
        a, b = place[:len(page)], place[len(page):]
        low = np.arange(len(node))
        while len(a):
            x, y = low[a], low[b]
            np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
            while (low[low] != low).any():
                low = low[low]
            open_ = low[a] != low[b]
            a, b = a[open_], b[open_]
        moved = low != np.arange(len(node))
        return pd.DataFrame({"page_id": names[at[moved]], "u": node[moved], "v": node[low[moved]]})

    def contracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, many, piece = [], 0, 0
        for batch in batches:
            held.append(batch)
            many += len(batch)
            if many < most:
                continue
            rows = pd.concat(held, ignore_index=True)
            last = (rows["page_id"] == rows["page_id"].iloc[-1]) & (rows["band"] == rows["band"].iloc[-1])
            whole, rest = rows[~last], rows[last]
            if len(whole):  # they may begin with the end of a band that was split
                yield contract(whole).assign(piece=piece)
                piece = 0
            elif len(rest):
                yield contract(rest).assign(piece=piece)
                piece, rest = piece + 1, rest[:0]
            held, many = ([rest], len(rest)) if len(rest) else ([], 0)
        if many:
            yield contract(pd.concat(held, ignore_index=True)).assign(piece=piece)

    return contracted


def components(nodes: DataFrame, edges: DataFrame, most: int = BAND_RUNS) -> DataFrame:
    """Label each ``node`` with the smallest node of its component.

    Edges are first contracted band by band (4096 rows of a page) and within a band in pieces of some ``most``, each to
    stars around its smallest nodes.  That settles all pages of one piece; on the others the stars go
    through alternating large-star and small-star steps.
    """
    e = edges.select("page_id", F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v")
    band = F.shiftright("u", ROW_BITS + BAND_BITS).alias("band")
    kind = edges.schema["page_id"].dataType.simpleString()
    stars = (e.select("page_id", band, F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
             .repartition("page_id", "band").sortWithinPartitions("page_id", "band")
             .mapInPandas(_stars(most), f"page_id {kind}, u long, v long, piece long"))
    stars = cut(stars.select("page_id", band, "piece", "u", "v"))
    split = stars.groupBy("page_id").agg(F.min("band").alias("first"), F.max("band").alias("last"), F.max("piece").alias("piece"))
    split = cut(split.filter("first <> last OR piece > 0").select("page_id"))
    labels = stars.select("page_id", "u", "v")
    if not split.isEmpty():
        joined = _star_steps(labels.join(split, "page_id", "left_semi").distinct())
        labels = labels.join(split, "page_id", "left_anti").unionByName(joined)
    labels = labels.select("page_id", F.col("u").alias("node"), F.col("v").alias("_label"))
    return (nodes.join(labels, ["page_id", "node"], "left")
            .withColumn("label", F.coalesce("_label", "node")).drop("_label"))


def _star_steps(e: DataFrame) -> DataFrame:
    """Edges ``u > v`` turned into stars around the smallest nodes.

    Alternating large-star and small-star steps: neighbours larger than a node move
    to its smallest neighbour, then the rest does, until every component is a star.
    Minima are combined before each shuffle, so a hub costs no more than its edges.
    """
    e, before = cut(e), None
    while True:
        print_of = e.agg(F.count("*"), F.bit_xor(F.xxhash64("page_id", "u", "v"))).first()
        if print_of == before or print_of[0] == 0:
            return e
        before = print_of
        both = e.unionByName(e.select("page_id", F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("page_id", "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.filter("v > u").join(low, ["page_id", "u"])
                 .select("page_id", F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("page_id", "u").agg(F.min("v").alias("m"))
        moved = (large.join(low, ["page_id", "u"]).filter("v <> m")
                 .select("page_id", F.col("v").alias("u"), F.col("m").alias("v")))
        e = cut(moved.unionByName(low.select("page_id", "u", F.col("m").alias("v"))).distinct())


def label_runs(mask: DataFrame) -> DataFrame:
    """8-connected components of a mask as labelled runs ``page_id, pos, lo, hi, node, label``."""
    nodes = cut(with_node(runs(mask)))
    return components(nodes, run_edges(nodes))


def label_pixels(mask: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """Mask pixels with the label of their component."""
    labelled = labelled if labelled is not None else label_runs(mask)
    cells = labelled.select("page_id", F.col("pos").alias("y"), "label",
                            F.explode(F.sequence("lo", "hi")).alias("x"))
    return mask.join(cells, ["page_id", "x", "y"])


def _bands(nodes: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(pages, nodes with ``band``): a page with up to ``most`` runs is one band, others have half as many in each."""
    row = F.shiftright("node", ROW_BITS)
    pages = nodes.groupBy("page_id").agg(F.min(row).alias("_top"), F.when(F.count("*") <= most, F.lit(1 << ROW_BITS)).otherwise(
        F.greatest(F.lit(1), F.floor((F.max(row) - F.min(row) + 1) * most / (2 * F.count("*"))))).alias("_rows"))
    return pages, nodes.select("page_id", "node").join(pages, "page_id").select(
        "page_id", "node", F.floor((row - F.col("_top")) / F.col("_rows")).alias("band"))


def _spread(key, edges: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
    """Hops within a band from its new marks, as far as they better what is known; only bettered nodes are returned."""
    known = dict(zip(marks["node"].to_numpy()[~marks["fresh"]].tolist(), marks["dist"].to_numpy()[~marks["fresh"]].tolist(), strict=True))
    fresh = marks[marks["fresh"]].sort_values("dist")
    out: dict[int, int] = {}
    order = np.argsort(edges["a"].to_numpy(), kind="stable")
    ends, heads = edges["a"].to_numpy()[order], edges["b"].to_numpy()[order]
    starts = np.flatnonzero(np.diff(ends, prepend=ends[0] - 1 if len(ends) else 0))
    after = dict(zip(ends[starts].tolist(), np.split(heads, starts[1:]), strict=True)) if len(ends) else {}
    waiting, level, front = list(zip(fresh["dist"].tolist(), fresh["node"].tolist(), strict=True))[::-1], 0, []
    while waiting or front:
        if not front:
            level = waiting[-1][0]
        while waiting and waiting[-1][0] <= level:
            front.append(waiting.pop()[1])
        better = [n for n in dict.fromkeys(front) if level < known.get(n, 1 << 62)]
        for n in better:
            known[n] = out[n] = level
        front = [m for n in better if n in after for m in after[n].tolist()]
        level += 1
    return pd.DataFrame({"page_id": [key[0]] * len(out), "band": [key[1]] * len(out), "node": list(out), "dist": list(out.values())})


def hop_distance(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, most: int = BAND_RUNS) -> DataFrame:
    """Breadth-first hops over runs from each page's seed ``page_id, node``.

    Returns the reached nodes with ``dist``.  A page is cut into bands of rows; a round
    walks each band that a better distance has entered from end to end, then passes on
    what leaves it.  So jobs follow the bands that a line crosses, not its runs, and a page of
    up to ``most`` runs takes one round.  A band holds ``most`` runs or one row.
    """
    _, placed = _bands(nodes, most)
    placed = cut(placed)
    kind = nodes.schema["page_id"].dataType.simpleString()
    ways = edges.select("page_id", "a", "b").unionByName(edges.select("page_id", F.col("b").alias("a"), F.col("a").alias("b")))
    of = lambda end, band: placed.select("page_id", F.col("node").alias(end), F.col("band").alias(band))
    ways = cut(ways.join(of("a", "band"), ["page_id", "a"]).join(of("b", "to"), ["page_id", "b"]))
    within, across = ways.filter("band = to"), ways.filter("band <> to")
    fresh = cut(seeds.join(placed, ["page_id", "node"]).select("page_id", "band", "node", F.lit(0).cast("long").alias("dist")))
    state = None
    while True:
        active = fresh.select("page_id", "band").distinct()
        marks = fresh.withColumn("fresh", F.lit(True))
        if state is not None:
            marks = marks.unionByName(state.join(active, ["page_id", "band"], "left_semi").withColumn("fresh", F.lit(False)))
        local = within.join(active, ["page_id", "band"], "left_semi").groupBy("page_id", "band")
        marks = marks.select(*[F.col(c).alias(c) for c in marks.columns])  # columns of its own, apart from those of the edges
        found = cut(local.cogroup(marks.groupBy("page_id", "band")).applyInPandas(_spread, f"page_id {kind}, band long, node long, dist long"))
        state = found if state is None else cut(state.unionByName(found).groupBy("page_id", "band", "node").agg(F.min("dist").alias("dist")))
        sent = (found.drop("band").join(across.select("page_id", F.col("a").alias("node"), "b", F.col("to").alias("band")), ["page_id", "node"])
                .groupBy("page_id", "band", F.col("b").alias("node")).agg((F.min("dist") + 1).alias("dist")))
        old = state.select("page_id", "node", F.col("dist").alias("had"))
        fresh = cut(sent.join(old, ["page_id", "node"], "left").filter("had IS NULL OR dist < had").select("page_id", "band", "node", "dist"))
        if fresh.isEmpty():
            return state.select("page_id", "node", F.col("dist").cast("int").alias("dist"))


NEIGHBOURS = [(-1, -1), (0, -1), (1, -1), (-1, 0), (1, 0), (-1, 1), (0, 1), (1, 1)]


def neighbours(df: DataFrame, offsets=NEIGHBOURS) -> DataFrame:
    """One row per pixel and offset, with the neighbour's place as ``nx, ny``."""
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in offsets])
    return (df.withColumn("_o", F.explode(steps))
            .withColumn("nx", F.col("x") + F.col("_o.dx")).withColumn("ny", F.col("y") + F.col("_o.dy")).drop("_o"))


def degree_nodes(mask: DataFrame) -> DataFrame:
    """Pixels with their number of neighbours; one is an end, three or more a junction.

    Every pixel sends one count to each neighbouring place, so no join is needed.
    """
    places = mask.select("page_id", "x", "y").distinct()
    sent = neighbours(places).select("page_id", F.col("nx").alias("x"), F.col("ny").alias("y"),
                                     F.lit(1).alias("n"), F.lit(0).alias("own"))
    counted = (sent.unionByName(places.select("page_id", "x", "y", F.lit(0).alias("n"), F.lit(1).alias("own")))
               .groupBy("page_id", "x", "y").agg(F.sum("n").alias("degree"), F.max("own").alias("own"))
               .filter("own = 1").drop("own"))
    return counted.withColumn("node_kind", F.when(F.col("degree") == 1, "end")
                              .when(F.col("degree") >= 3, "junction"))


def wire_bridges(regions: DataFrame, wires: DataFrame, min_wires: int = 2) -> DataFrame:
    """Coloured regions whose pixels and their neighbours meet enough different wires.

    Both inputs have ``page_id, x, y, label``.
    """
    around = [(0, 0), *NEIGHBOURS]
    near = neighbours(regions.select("page_id", "x", "y", F.col("label").alias("region")), around)
    near = near.select("page_id", "region", F.col("nx").alias("x"), F.col("ny").alias("y")).distinct()
    met = near.join(wires.select("page_id", "x", "y", F.col("label").alias("wire")), ["page_id", "x", "y"])
    return (met.select("page_id", "region", "wire").distinct().groupBy("page_id", "region")
            .agg(F.count("*").alias("wires")).withColumn("bridge", F.col("wires") >= min_wires))


def run_bridges(regions: DataFrame, wires: DataFrame, min_wires: int = 2) -> DataFrame:
    """``wire_bridges`` of labelled runs ``page_id, pos, lo, hi, label``: a region's runs, grown by one, against the wires' runs."""
    def tiled(df, lo, hi):
        return df.withColumn("_t", F.explode(F.sequence(F.floor(lo / TILE), F.floor(hi / TILE))))

    lo, hi = F.col("lo"), F.col("hi")
    grown = tiled(regions.select("page_id", F.explode(F.array(*[F.col("pos") + d for d in (-1, 0, 1)])).alias("pos"),
                                 F.col("label").alias("region"), (lo - 1).alias("g_lo"), (hi + 1).alias("g_hi")), F.col("g_lo"), F.col("g_hi"))
    lines = tiled(wires.select("page_id", "pos", "lo", "hi", F.col("label").alias("wire")), lo, hi)
    met = grown.join(lines, ["page_id", "pos", "_t"]).filter((F.col("g_lo") <= hi) & (lo <= F.col("g_hi")))
    return (met.select("page_id", "region", "wire").distinct().groupBy("page_id", "region")
            .agg(F.count("*").alias("wires")).withColumn("bridge", F.col("wires") >= min_wires))


def greedy_matching(edges: DataFrame) -> DataFrame:
    """Pairs ``page_id, i, j`` chosen in order of (i, j), each end used once.

    Per round an edge is chosen if it is the first one left at both of its ends,
    so the first of a page always is.  A node never pairs with itself.
    """
    left, chosen = cut(edges.filter("page_id IS NOT NULL AND i <> j").select("page_id", "i", "j")), []
    while not left.isEmpty():
        edge = F.struct("i", "j")
        ends = left.select("page_id", edge.alias("e"), F.explode(F.array("i", "j")).alias("at"))
        first = ends.groupBy("page_id", "at").agg(F.min("e").alias("e"))
        pick = first.groupBy("page_id", "e").count().filter("count = 2").select("page_id", "e.i", "e.j")
        pick = cut(pick)
        used = pick.select("page_id", F.explode(F.array("i", "j")).alias("at"))
        rest = left
        for side in ("i", "j"):
            rest = rest.join(used.select("page_id", F.col("at").alias(side)), ["page_id", side], "left_anti")
        left = cut(rest.select("page_id", "i", "j"))
        chosen.append(pick)
    return reduce(DataFrame.unionByName, chosen) if chosen else left
