"""Exact first-wins de-duplication of detections, without listing conflicting pairs.

Walking rows in priority order and keeping a row unless it conflicts with a kept
one is decided here tile by tile: a tile sweeps over its rows in order and leaves
open only what depends on rows of other tiles that are still open.  Rows of equal
place and size are decided once, and all that conflicts with a kept row goes by a join
on grid cells, so a tile never holds more than a bounded number of rows, also
where thousands of near-copies sit on one spot.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

BASE = 4.0
TILE_ROWS = 10_000
_POWERS = list(range(-4, 16))


def _class(t: Column) -> Column:
    """Exponent k with BASE**k <= t < BASE**(k+1)."""
    ladder = F.when(t < BASE ** (_POWERS[0] + 1), _POWERS[0])
    for k in _POWERS[1:]:
        ladder = ladder.when(t < BASE ** (k + 1), k)
    return ladder.otherwise(_POWERS[-1])


class _Grid:
    """Size classes present in the data and the cells in which they meet.

    The classes are a few values on a logarithmic scale, whatever the data's size.
    """

    def __init__(self, work: DataFrame, shape: str):
        rows = work.groupBy("kx", "ky").agg(F.max("tx").alias("tx"), F.max("ty").alias("ty")).collect()
        self.classes = [(r.kx, r.ky) for r in rows]
        self.shape = shape
        least = BASE ** _POWERS[0]  # a distance of zero still needs a cell
        self.reach_x = {k: max([least, *(r.tx for r in rows if r.kx == k)]) for k, _ in self.classes}
        self.reach_y = {k: max([least, *(r.ty for r in rows if r.ky == k)]) for _, k in self.classes}

    @staticmethod
    def _table(values: dict, key: Column) -> Column:
        return F.element_at(F.create_map(*[F.lit(v) for item in values.items() for v in item]), key)

    def _cells(self, df: DataFrame) -> DataFrame:
        return (df.withColumn("ux", F.floor(F.col("cx") / self._table(self.reach_x, F.col("jx"))))
                .withColumn("uy", F.floor(F.col("cy") / self._table(self.reach_y, F.col("jy")))))

    def spread(self, rows: DataFrame) -> DataFrame:
        """File rows for every size class that may look for them, in all cells in reach."""
        around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
        seekers = F.array(*[F.struct(F.lit(a).alias("ax"), F.lit(b).alias("ay")) for a, b in self.classes])
        filed = self._cells(rows.withColumn("_s", F.explode(seekers))
                            .withColumn("ax", F.col("_s.ax")).withColumn("ay", F.col("_s.ay"))
                            .withColumn("jx", F.greatest("ax", "kx")).withColumn("jy", F.greatest("ay", "ky")))
        return (filed.withColumn("_ox", F.explode(around)).withColumn("_oy", F.explode(around))
                .withColumn("ux", F.col("ux") + F.col("_ox")).withColumn("uy", F.col("uy") + F.col("_oy"))
                .drop("_s", "_ox", "_oy", "kx", "ky"))

    def lookup(self, rows: DataFrame) -> DataFrame:
        """One copy of each row per size class it can meet, in its own cell."""
        meets = F.array_distinct(F.array(*[
            F.struct(F.greatest(F.lit(a), F.col("kx")).alias("jx"), F.greatest(F.lit(b), F.col("ky")).alias("jy"))
            for a, b in self.classes]))
        return self._cells(rows.withColumn("_j", F.explode(meets))
                           .withColumn("ax", F.col("kx")).withColumn("ay", F.col("ky"))
                           .withColumn("jx", F.col("_j.jx")).withColumn("jy", F.col("_j.jy")).drop("_j"))

    def conflicts(self, rows: DataFrame, others: DataFrame) -> DataFrame:
        """Pairs of a row and another (``k_prio``) that it conflicts with."""
        offers = self.spread(others.select("page_id", F.col("prio").alias("k_prio"), "cx", "cy", "tx", "ty", "kx", "ky"))
        for c in ("cx", "cy", "tx", "ty"):
            offers = offers.withColumnRenamed(c, f"k_{c}")
        dx, dy = F.abs(F.col("cx") - F.col("k_cx")), F.abs(F.col("cy") - F.col("k_cy"))
        if self.shape == "circle":
            close = F.sqrt(dx * dx + dy * dy) < F.greatest("tx", "k_tx")
        else:
            close = (dx < F.greatest("tx", "k_tx")) & (dy < F.greatest("ty", "k_ty"))
        cell = ["page_id", "ax", "ay", "jx", "jy", "ux", "uy"]
        return self.lookup(rows).join(offers, cell).filter(close).select("page_id", "prio", "k_prio")


def _tiled(rows: DataFrame, most: int) -> DataFrame:
    """Rows with the origin and side of their page's tiles: one tile up to ``most`` rows, else half as many each on average.

    A tile is wider than two distances; a page that is little more than a line is cut across only.
    """
    reach = F.greatest(F.max("tx"), F.max("ty"))
    wide, high = F.max("cx") - F.min("cx") + 1, F.max("cy") - F.min("cy") + 1
    tiles = F.when(F.count("*") <= most, 1).otherwise(F.ceil(2 * F.count("*") / most))
    side = F.greatest(2 * reach, F.sqrt(wide * high / tiles), F.greatest(wide, high) / tiles)
    pages = rows.groupBy("page_id").agg(reach.alias("reach"), side.alias("side"), F.min("cx").alias("ox"), F.min("cy").alias("oy"))
    return rows.join(pages, "page_id")


def _views(rows: DataFrame) -> DataFrame:
    """Each row in its own tile (``own``) and in the neighbours whose rows it can reach."""
    at = lambda c, step: F.floor((F.col(f"c{c}") - F.col(f"o{c}") + step) / F.col("side"))
    span = {c: F.sequence(at(c, -F.col("reach")), at(c, F.col("reach"))) for c in "xy"}
    spread = rows.withColumn("u", F.explode(span["x"])).withColumn("v", F.explode(span["y"]))
    return spread.withColumn("own", (F.col("u") == at("x", 0)) & (F.col("v") == at("y", 0)))


def _sweep(shape: str):
    """Decide a tile's rows in order of priority, as far as rows of other tiles don't stand before them."""
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        cx, cy, tx, ty = (pdf[c].to_numpy() for c in ("cx", "cy", "tx", "ty"))
        own, side = pdf["own"].to_numpy(), max(tx.max(), ty.max()) or 1.0
        column, line = np.floor(cx / side).astype(np.int64).tolist(), np.floor(cy / side).astype(np.int64).tolist()
        fate = np.zeros(len(pdf), np.int8)  # 0 open, 1 kept, 2 dropped
        cells: dict[tuple[int, int], list[int]] = {}  # rows before that are kept or open
        for i, (c, r) in enumerate(zip(column, line, strict=True)):
            near = [k for a in (c - 1, c, c + 1) for b in (r - 1, r, r + 1) for k in cells.get((a, b), ())]
            if near:
                k = np.array(near)
                dx, dy = np.abs(cx[k] - cx[i]), np.abs(cy[k] - cy[i])
                if shape == "circle":
                    met = fate[k[np.sqrt(dx * dx + dy * dy) < np.maximum(tx[k], tx[i])]]
                else:
                    met = fate[k[(dx < np.maximum(tx[k], tx[i])) & (dy < np.maximum(ty[k], ty[i]))]]
                fate[i] = 2 if (met == 1).any() else 0 if len(met) or not own[i] else 1
            else:
                fate[i] = 1 if own[i] else 0
            if fate[i] < 2:
                cells.setdefault((c, r), []).append(i)
        told = own & (fate > 0)
        return pd.DataFrame({"rid": pdf["rid"].to_numpy()[told], "is_kept": fate[told] == 1})
    return work


def greedy_nms(df: DataFrame, order: list[str], cx: Column, cy: Column, tx: Column,
               ty: Column | None = None, shape: str = "box", most: int = TILE_ROWS) -> DataFrame:
    """Add ``kept``, ``kept_by`` and ``rounds``: which rows first-wins de-duplication keeps.

    Rows conflict if their centres differ by less than the larger ``tx`` and ``ty``
    (``box``) or lie closer than the larger ``tx`` (``circle``).  ``order`` must be
    unique per page.  ``kept_by`` is the order struct of the first kept row that a
    dropped one conflicts with; for a kept row it is its own.  A row without a size
    conflicts only with larger ones, a row without a place with none; rows without
    a page are left out.

    A page is cut into tiles.  In a round each tile decides its first ``most`` rows in
    one sweep in order of priority; a row waits only if an undecided one of another
    tile stands before it.  What conflicts with a kept row then goes at once, however
    many rows that are.  So rounds follow the tiles that a chain of conflicts crosses.
    """
    ty = tx if ty is None else ty
    work = df.select(
        "page_id", F.struct(*order).alias("prio"), cx.cast("double").alias("cx"), cy.cast("double").alias("cy"),
        F.coalesce(tx.cast("double"), F.lit(0.0)).alias("tx"), F.coalesce(ty.cast("double"), F.lit(0.0)).alias("ty"))
    work = work.filter("page_id IS NOT NULL")
    work = work.withColumn("kx", _class(F.col("tx"))).withColumn("ky", _class(F.col("ty")))
    work = cut(work.withColumn("rid", F.monotonically_increasing_id()))
    grid = _Grid(work, shape)
    nowhere = F.col("cx").isNull() | F.col("cy").isNull()
    # Rows of equal place and size conflict and meet the same others: the first stands for all.  Without a size they don't.
    solid = F.when(F.least("tx", "ty") <= 0, F.col("rid"))
    first = (work.filter(~nowhere).groupBy("page_id", "cx", "cy", "tx", "ty", "kx", "ky", solid.alias("alone"))
             .agg(F.min_by(F.struct("prio", "rid"), "prio").alias("f")).select("page_id", "f.*", "cx", "cy", "tx", "ty", "kx", "ky"))
    left, kept, rounds = cut(_tiled(first, most)), [work.filter(nowhere).select("rid")], 0
    while not left.isEmpty():
        rounds += 1
        tile = Window.partitionBy("page_id", "u", "v").orderBy("prio")
        view = _views(left).withColumn("seq", F.row_number().over(tile)).filter(F.col("seq") <= most)
        fate = cut(view.select("page_id", "u", "v", "seq", "rid", "cx", "cy", "tx", "ty", "own")
                   .groupBy("page_id", "u", "v").applyInPandas(_sweep(shape), "rid long, is_kept boolean"))
        new = fate.filter("is_kept").select("rid")
        kept.append(new)
        rest = cut(left.join(fate, "rid", "left_anti"))
        if rest.isEmpty():
            break
        met = grid.conflicts(rest, left.join(new, "rid", "left_semi"))
        left = cut(rest.join(met.select("page_id", "prio").distinct(), ["page_id", "prio"], "left_anti"))
    winners = cut(work.join(reduce(DataFrame.unionByName, kept), "rid", "left_semi"))
    own = winners.select("page_id", "prio", F.col("prio").alias("k_prio"))
    met = grid.conflicts(work, winners).filter("k_prio < prio").unionByName(own) if grid.classes else own
    by = met.groupBy("page_id", "prio").agg(F.min("k_prio").alias("kept_by"))
    by = by.withColumn("kept", F.col("kept_by") == F.col("prio")).withColumn("rounds", F.lit(rounds))
    return (df.withColumn("prio", F.struct(*order)).join(by, ["page_id", "prio"])
            .select(*df.columns, "kept", "kept_by", "rounds"))


BOX_SHARE, CIRCLE_SHARE = 0.4, 0.6
SYMBOL_DISTANCE, BREAK_DISTANCE = 15, 20


def dedup_boxes(df: DataFrame, order: list[str]) -> DataFrame:
    """Boxes ``cx, cy, w, h`` closer than 0.4 of the larger side on both axes are one."""
    return greedy_nms(df, order, F.col("cx"), F.col("cy"), F.col("w") * BOX_SHARE, F.col("h") * BOX_SHARE)


def dedup_circles(df: DataFrame, order: list[str]) -> DataFrame:
    """Circles ``cx, cy, r`` closer than 0.6 of the larger radius are one."""
    return greedy_nms(df, order, F.col("cx"), F.col("cy"), F.col("r") * CIRCLE_SHARE, shape="circle")


def dedup_points(df: DataFrame, order: list[str], distance: float = SYMBOL_DISTANCE) -> DataFrame:
    return greedy_nms(df, order, F.col("cx"), F.col("cy"), F.lit(float(distance)))


def dedup_breaks(df: DataFrame, order: list[str], distance: float = BREAK_DISTANCE) -> DataFrame:
    """Kept breaks, each with the smallest gap among the breaks it stands for."""
    judged = dedup_points(df, order, distance)
    gaps = judged.groupBy("page_id", "kept_by").agg(F.min("gap").alias("_gap"))
    kept = judged.filter("kept").join(gaps, ["page_id", "kept_by"])
    return kept.withColumn("gap", F.col("_gap")).select(*df.columns)


def union_candidates(**sources: DataFrame) -> DataFrame:
    """Detections of several methods in one table; earlier methods come first."""
    tagged = [df.withColumn("src", F.lit(name)).withColumn("src_ord", F.lit(i))
              for i, (name, df) in enumerate(sources.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def first_source(*sources: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the first source that has any row for a target."""
    tagged = [df.withColumn("_rank", F.lit(i)) for i, df in enumerate(sources)]
    rows = reduce(DataFrame.unionByName, tagged)
    best = rows.groupBy(*keys).agg(F.min("_rank").alias("_rank"))
    return rows.join(best, [*keys, "_rank"], "left_semi").drop("_rank")
