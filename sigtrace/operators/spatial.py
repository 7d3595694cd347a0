"""Spatial joins as equi-joins on grid cells; no plan here contains a nested loop.

Three rules keep dense places cheap: identical points are merged before a join,
boxes are filed on a grid whose cells match their size, and nearest-neighbour
searches look at fine cells first and widen only for what is still open.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

LEVELS = (64, 512, 4096, 32768)
# Pairs of boxes grow with the square of a cell, so these sizes follow the boxes more closely.
PAIR_LEVELS = (32, 64, 128, 256, 512, 4096, 32768)


def cell(value, size: float) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.floor(value / F.lit(size)).cast("long")


def near_pairs(left: DataFrame, right: DataFrame, radius: float, keys: list[str],
               left_xy=("x", "y"), right_xy=("rx", "ry"), how: str = "inner",
               where: Column | None = None, wide: int = 1) -> DataFrame:
    """Pairs in neighbouring cells of size ``radius``; callers add the exact test.

    Columns other than ``keys`` must not clash.  ``where`` becomes part of the
    join condition, as outer and semi joins need it there.  Cells ``wide`` times as large
    hold more rows, but a right row is filed in fewer: some 9 cells, 4 or 2.25 for 1, 2 or 4.
    """
    size = radius * wide

    def reached(c):
        if wide > 1:
            return F.sequence(cell(F.col(c) - radius, size), cell(F.col(c) + radius, size))
        return F.array(*[cell(c, size) + i for i in (-1, 0, 1)])

    a = (left.withColumn("_cx", cell(left_xy[0], size)).withColumn("_cy", cell(left_xy[1], size)))
    b = right.withColumn("_rcx", F.explode(reached(right_xy[0]))).withColumn("_rcy", F.explode(reached(right_xy[1])))
    for k in keys:
        b = b.withColumnRenamed(k, f"_r_{k}")
    on = (F.col("_cx") == F.col("_rcx")) & (F.col("_cy") == F.col("_rcy"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_r_{k}"))
    if where is not None:
        on = on & where
    joined = a.join(b, on, how)
    return joined.drop("_cx", "_cy", "_rcx", "_rcy", *[f"_r_{k}" for k in keys])


def _search(queries, targets, reach, keys, bonus):
    """Best target per query point within ``reach``: lowest score, then input order."""
    distance = F.abs(F.col("x") - F.col("rx")) + F.abs(F.col("y") - F.col("ry"))
    score = distance - F.when(F.col("q_class") == F.col("t_class"), bonus).otherwise(0)
    point = [*keys, "x", "y", "q_class"]
    return (near_pairs(queries, targets, reach, keys, where=distance <= reach)
            .groupBy(*point)
            .agg(F.min_by(F.struct(distance.alias("d"), score.alias("score"), "t_ord", "t_row", "rx", "ry"),
                          F.struct(score.alias("score"), F.col("t_ord"))).alias("hit")))


def nearest(queries: DataFrame, targets: DataFrame, radius: float, keys: list[str],
            q_class: Column, t_class: Column, payload: list[str], bonus: float = 0,
            fine: float | None = None, order: str = "ord") -> DataFrame:
    """Nearest target per query by Manhattan distance, minus ``bonus`` if classes agree.

    ``queries`` and ``targets`` have ``keys, x, y`` and ``order``; ties go to the
    target first in ``order``.  The result has one row per query with a struct
    ``hit`` (``d, score, t_ord, t_row, rx, ry``), null where nothing is in reach.
    """
    # Equal points of one class give one answer: search once, hand it to all copies.
    asked = queries.withColumn("q_class", F.coalesce(q_class, F.lit("")))
    points = asked.select(*keys, "x", "y", "q_class").distinct()
    offers = (targets.withColumn("t_class", F.coalesce(t_class, F.lit("-")))
              .groupBy(*keys, "x", "y", "t_class")
              .agg(F.min(order).alias("t_ord"),
                   F.min_by(F.struct(*payload), order).alias("t_row"))
              .withColumnRenamed("x", "rx").withColumnRenamed("y", "ry"))
    fine = fine or bonus + radius / 8
    if fine >= radius:
        found = _search(points, offers, radius, keys, bonus)
    else:
        # Anything beyond the fine reach scores above fine - bonus, so a score up
        # to that is final and dense places never meet the wide cells.
        close = _search(points, offers, fine, keys, bonus).filter(
            F.col("hit.score") <= fine - bonus)
        on = [*keys, "x", "y", "q_class"]
        wide = _search(points.join(close, on, "left_anti"), offers, radius, keys, bonus)
        found = close.unionByName(wide)
    return asked.join(found, [*keys, "x", "y", "q_class"], "left").drop("q_class")


def nearest_k(points: DataFrame, targets: DataFrame, n: int, key: str = "page_id", ident: str = "s_ord", xy=("sx", "sy")) -> DataFrame:
    """The ``n`` nearest targets of each distinct point (``key, x, y``) by Manhattan distance, ties to the smaller ``ident``.

    Rings of growing reach, begun where a page's density promises enough targets: a pass
    looks only beyond the pass before and only for points that still lack some, keeps the best
    so far, and ends a point as soon as its n-th distance lies within reach or its page is
    exhausted.  Returns key, x, y, ident, the target's place, ``distance`` and ``rank``.
    """
    place = [key, "x", "y"]
    tx, ty = xy
    asked = points.select(*place).distinct()
    spread = targets.select(key, F.col(tx).alias("x"), F.col(ty).alias("y"), F.lit(1).alias("n")).unionByName(asked.withColumn("n", F.lit(0)))
    wide, high = F.max("x") - F.min("x") + 1, F.max("y") - F.min("y") + 1
    pages = spread.groupBy(key).agg((wide + high).cast("double").alias("limit"), F.sum("n").alias("many"),
                                    F.sqrt(2 * n * wide * high / F.greatest(F.sum("n"), F.lit(1))).alias("reach"))
    pages = cut(pages.filter("many > 0").drop("many"))
    todo = cut(asked.join(pages, key).withColumn("before", F.lit(-1.0)))
    offers = targets.select(key, ident, tx, ty)
    some, found = None, []
    around = F.array(*map(F.lit, (-1, 0, 1)))
    at = lambda c: F.floor(F.col(c) / F.col("reach"))
    step = 0
    while not todo.isEmpty():
        scale = pages.select(key, (F.col("reach") * 4 ** step).alias("reach"))
        filed = (offers.join(scale, key).withColumn("_cx", at(tx)).withColumn("_cy", at(ty)).drop("reach")
                 .withColumn("_cx", F.explode(F.transform(around, lambda o: F.col("_cx") + o)))
                 .withColumn("_cy", F.explode(F.transform(around, lambda o: F.col("_cy") + o))))
        distance = F.abs(F.col("x") - F.col(tx)) + F.abs(F.col("y") - F.col(ty))
        pairs = (todo.withColumn("_cx", at("x")).withColumn("_cy", at("y")).join(filed, [key, "_cx", "_cy"])
                 .withColumn("distance", distance).filter("distance > before AND distance <= reach"))
        # All pairs of a point meet in its cell, so they are ranked where they were joined, without a shuffle.
        near = _first_n(pairs, [key, "_cx", "_cy", "x", "y"], n, ident).select(*place, ident, tx, ty, "distance", "rank", "reach", "limit", "_full")
        if some is not None:
            near = _first_n(near.drop("rank", "_full").unionByName(some), place, n, ident)
        near = cut(near)
        ended = F.col("_full") | (F.col("reach") >= F.col("limit"))
        left = todo.join(near.filter(F.col("rank") == n).select(*place), place, "left_anti")
        todo = cut(left.filter("reach < limit").withColumn("before", F.col("reach")).withColumn("reach", F.col("reach") * 4))
        found.append(near.filter(ended).drop("reach", "limit", "_full"))
        some = near.filter(~ended).drop("rank", "_full").withColumn("reach", F.col("reach") * 4)
        step += 1
    return reduce(DataFrame.unionByName, found) if found else asked.join(offers, key).select(
        *place, ident, tx, ty, F.lit(0).alias("distance"), F.lit(0).alias("rank")).limit(0)


def _first_n(pairs: DataFrame, keys: list[str], n: int, ident: str) -> DataFrame:
    """The ``n`` nearest rows per key with their ``rank``, and whether the key has that many (``_full``)."""
    own = Window.partitionBy(*keys)
    ranked = pairs.withColumn("rank", F.row_number().over(own.orderBy("distance", ident))).filter(F.col("rank") <= n)
    return ranked.withColumn("_full", F.max("rank").over(own) == n)


def level_of(extent: Column, levels: tuple[int, ...] = LEVELS) -> Column:
    """Coarsest-needed grid level: the first cell size not below the extent."""
    ladder = F.when(extent <= levels[0], 0)
    for i, size in enumerate(levels[1:], 1):
        ladder = ladder.when(extent <= size, i)
    return ladder.otherwise(len(levels) - 1)


def _size(level: Column, levels: tuple[int, ...] = LEVELS) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in levels]), level + 1)


def _covered(lo: Column, hi: Column, size: Column) -> Column:
    return F.explode(F.sequence(F.floor(lo / size), F.floor(hi / size)))


def _file_boxes(df: DataFrame, level: Column, pad: float, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    size = _size(F.col("_level"), levels)
    return (df.withColumn("_level", level)
            .withColumn("_cx", _covered(F.col("bx0") - pad, F.col("bx1") + pad, size))
            .withColumn("_cy", _covered(F.col("by0") - pad, F.col("by1") + pad, size)))


def points_in_boxes(points: DataFrame, boxes: DataFrame, keys: list[str], pad: float = 0,
                    where: Column | None = None, how: str = "inner") -> DataFrame:
    """Points (``x, y``) within boxes (``bx0, by0, bx1, by1``), edges and pad included.

    A box covers at most a few cells of its level; a point looks at one cell per
    level.  Columns other than ``keys`` must not clash.
    """
    extent = F.greatest(F.col("bx1") - F.col("bx0"), F.col("by1") - F.col("by0")) + 2 * pad
    b = _file_boxes(boxes, level_of(extent), pad)
    for c in (*keys, "_level", "_cx", "_cy"):
        b = b.withColumnRenamed(c, f"_b{c}")
    levels = F.array(*[F.lit(i) for i in range(len(LEVELS))])
    p = (points.withColumn("_level", F.explode(levels))
         .withColumn("_cx", F.floor(F.col("x") / _size(F.col("_level"))))
         .withColumn("_cy", F.floor(F.col("y") / _size(F.col("_level")))))
    on = F.lit(True)
    for c in (*keys, "_level", "_cx", "_cy"):
        on = on & (F.col(c) == F.col(f"_b{c}"))
    on = on & (F.col("x").between(F.col("bx0") - pad, F.col("bx1") + pad)
               & F.col("y").between(F.col("by0") - pad, F.col("by1") + pad))
    if where is not None:
        on = on & where
    joined = p.join(b, on, how)
    return joined.drop("_level", "_cx", "_cy", *[f"_b{c}" for c in (*keys, "_level", "_cx", "_cy")])


def touching_boxes(boxes: DataFrame, keys: list[str], pad: float, ident: str = "ord",
                   test: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Unordered pairs of boxes whose padded bounds meet, each exactly once.

    ``boxes`` has ``keys, ident, bx0, by0, bx1, by1, row``; the result has ``keys``
    and the structs ``a`` and ``b`` of ``row`` with ``a`` first by ``ident``.  A pair
    meets on the grid of its larger box, in the cell of the intersection's corner.
    ``test`` is a further symmetric condition on the two row structs.
    """
    extent = F.greatest(F.col("bx1") - F.col("bx0"), F.col("by1") - F.col("by0")) + 2 * pad
    base = cut(boxes.withColumn("_own", level_of(extent, PAIR_LEVELS)))  # read once for each side of the join
    own = _file_boxes(base, F.col("_own"), pad, PAIR_LEVELS)
    every = _file_boxes(
        base.withColumn("_l", F.explode(F.sequence(F.col("_own"), F.lit(len(PAIR_LEVELS) - 1)))),
        F.col("_l"), pad, PAIR_LEVELS).drop("_l")
    left = own.select(*keys, "_level", "_cx", "_cy", *[F.col(c).alias(f"l_{c}") for c in
                      (ident, "bx0", "by0", "bx1", "by1", "row")])
    right = every.select(*keys, "_level", "_cx", "_cy", F.col("_own").alias("r_own"),
                         *[F.col(c).alias(f"r_{c}") for c in (ident, "bx0", "by0", "bx1", "by1", "row")])
    size = _size(F.col("_level"), PAIR_LEVELS)
    once = ((F.floor((F.greatest("l_bx0", "r_bx0") - pad) / size) == F.col("_cx"))
            & (F.floor((F.greatest("l_by0", "r_by0") - pad) / size) == F.col("_cy")))
    meet = ((F.col("l_bx0") - pad <= F.col("r_bx1") + pad) & (F.col("r_bx0") - pad <= F.col("l_bx1") + pad)
            & (F.col("l_by0") - pad <= F.col("r_by1") + pad) & (F.col("r_by0") - pad <= F.col("l_by1") + pad))
    l_first = F.col(f"l_{ident}") < F.col(f"r_{ident}")
    fresh = (F.col("r_own") < F.col("_level")) | l_first
    found = fresh & meet & once  # the cheapest first: this is worked out for every two boxes of a cell
    if test is not None:
        found = found & test(F.col("l_row"), F.col("r_row"))
    return (left.join(right, [*keys, "_level", "_cx", "_cy"]).filter(found)
            .select(*keys, F.when(l_first, F.col("l_row")).otherwise(F.col("r_row")).alias("a"),
                    F.when(l_first, F.col("r_row")).otherwise(F.col("l_row")).alias("b")))
