"""The three pipelines as plans over evidence tables of any number of pages, boards and devices.

Each takes tables and returns one; pages, boards or devices are keys all the way, and nothing
is written. The walk along the line and de-duplication run jobs while the plan is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import component_type
from ..operators import associate, graph, registry, routing, runs
from ..session import cut

#: Reach of labels in a full round, and of the walk along the line around a symbol.
LABEL_RADIUS, WALK_REACH = 220, 60


def schematic_round(symbols: DataFrame, labels: DataFrame, line: DataFrame, seeds: DataFrame, radius: float = LABEL_RADIUS,
                    walk: int = WALK_REACH, **windows) -> DataFrame:
    """Symbols, labels and the mask of a signal line to the ordered parts it passes through.

    ``symbols``: page_id, ord, sym, x, y; ``labels``: page_id, ord, refdes, x, y; ``line``: page_id, x, y;
    ``seeds``: one page_id, sx, sy per page. Each symbol takes its nearest label, is told to be on the line by
    the pixels around it, and the parts on the main path are ordered by how far the line has been walked to them.
    ``windows`` go to the side windows. Returns the symbols' columns, refdes, membership, flow_dir, walk_d, type and idx.
    """
    named = associate.nearest_label(symbols, labels, radius).drop("text_symbol_dist")
    nodes = cut(graph.with_node(runs.runs(line)))
    placed = runs.membership(runs.side_evidence(named, nodes, **windows))
    path = cut(runs.main_path(placed).drop("touch", "e", "w", "n", "s"))
    start = graph.with_node(runs.nearest_run(nodes, seeds)).select("page_id", "node")
    hops = nodes.join(graph.hop_distance(nodes, graph.run_edges(nodes), start), ["page_id", "node"])
    walked = runs.walk_distance(path, hops.select("page_id", "pos", "lo", "hi", "dist"), r=walk)
    return registry.chain_order(walked.withColumn("type", component_type(F.col("refdes"))), "page_id")


def board_registry(hits: DataFrame, anchors: DataFrame, not_located: DataFrame | None = None, names: DataFrame | None = None,
                   by: tuple[str, ...] = (), schematic: str = "sch", side: str = "top") -> DataFrame:
    """Recognised texts, confirmed anchors and lists of missing parts to one registry, a row per part (and device).

    ``hits``: ``by``, view_name, text, ord, conf, x, y; the schematic's places stand beside the best hit of the board's side.
    """
    refs = registry.refs_of_hits(hits.filter(F.col("view_name") == side))
    best = registry.best_hit(refs.select(*by, "refdes", "ord", "conf", "x", "y"), [*by, "refdes"])
    drawn = hits.filter(F.col("view_name") == schematic).select(*by, F.col("text").alias("refdes"), "ord", "x", "y")
    return registry.merge_sources(drawn, anchors, best, not_located, names, by=by)


def combined_route(chain: DataFrame, index: DataFrame, nodes: DataFrame, centre: float, board: Column | None = None) -> DataFrame:
    """A chain in order and the places of its parts to waypoints on the board: lines and marks.

    ``chain``: chain_id, idx, refdes; ``index``: refdes, x, y, view_name; ``nodes``: see ``routing.waypoints``;
    ``board`` tells a chain's board, by default the chain itself. Places of the bottom are mirrored at ``centre``.
    """
    board = F.col("chain_id") if board is None else board
    edges = registry.chain_edges(registry.backfill_positions(chain, index, centre))
    edges = edges.select(board.alias("board_id"), F.concat_ws("-", "chain_id", "idx").alias("edge_id"), "from_ref", "to_ref",
                         "from_x", "from_y", "to_x", "to_y", "cross_side")
    return routing.waypoints(routing.plan_routes(edges, nodes), nodes)


__all__ = ["schematic_round", "board_registry", "combined_route"]
