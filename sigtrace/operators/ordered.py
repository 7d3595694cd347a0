"""Ordered operators that stay distributed when one key holds most rows.

A window over a key sorts all its rows in one task.  Up to ``HOT_ROWS`` rows
that is the cheapest plan; keys above it are ranked through range partitions,
whose size does not depend on the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

HOT_ROWS = 2_000_000


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int) -> DataFrame:
    return df.groupBy(*keys).count().filter(F.col("count") > hot_rows).select(*keys)


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    on = [left[k].eqNullSafe(right[k]) for k in keys]
    return left.join(right, on, how)


def _rank_by_ranges(df: DataFrame, keys: list[str], order: list[Column], out: str) -> DataFrame:
    placed = (df.repartitionByRange(*[F.col(k) for k in keys], *order)
              .sortWithinPartitions(*[F.col(k) for k in keys], *order)
              .withColumn("_at", F.monotonically_increasing_id())
              .withColumn("_part", F.spark_partition_id()))
    placed = cut(placed)  # both branches below must see the same placement
    parts = placed.groupBy(*keys, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_part").alias("_p"), "_first",
                          F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    on = [placed[k].eqNullSafe(starts[f"_{k}"]) for k in keys] + [placed["_part"] == starts["_p"]]
    ranked = placed.join(starts, on).withColumn(
        out, (F.col("_at") - F.col("_first") + F.col("_offset") + 1).cast("long"))
    return ranked.select(*df.columns, out)


def _total(df: DataFrame, order: list[Column]) -> list[Column]:
    """``order`` with all columns as last keys: rows that still tie are equal, so every plan ranks them alike."""
    return [*order, *[F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString()]]


def rank_within(df: DataFrame, keys: list[str], order: list[Column], out: str = "rank",
                hot_rows: int = HOT_ROWS) -> DataFrame:
    """Dense 1-based position of each row within its key; ties go by the other columns."""
    order = _total(df, order)
    window = Window.partitionBy(*keys).orderBy(*order)
    number = F.row_number().over(window).cast("long").alias(out)
    hot = hot_keys(df, keys, hot_rows)
    if hot.isEmpty():
        return df.select("*", number)
    cold = _null_safe(df, hot, keys, "left_anti").select("*", number)
    return cold.unionByName(
        _rank_by_ranges(_null_safe(df, hot, keys, "left_semi"), keys, order, out))


def with_neighbour(df: DataFrame, keys: list[str], order: list[Column], step: int,
                   columns: dict[str, str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add values of the row ``step`` places later (earlier if negative) within its key."""
    order = _total(df, order)
    hot = hot_keys(df, keys, hot_rows)
    window = Window.partitionBy(*keys).orderBy(*order)
    plain = [F.lead(src, step).over(window).alias(dst) for src, dst in columns.items()]
    if hot.isEmpty():
        return df.select("*", *plain)
    cold = _null_safe(df, hot, keys, "left_anti").select("*", *plain)
    ranked = _rank_by_ranges(_null_safe(df, hot, keys, "left_semi"), keys, order, "_rank")
    other = ranked.select(*[F.col(k).alias(f"_{k}") for k in keys],
                          (F.col("_rank") - step).alias("_at"),
                          *[F.col(src).alias(dst) for src, dst in columns.items()])
    on = ([ranked[k].eqNullSafe(other[f"_{k}"]) for k in keys] + [ranked["_rank"] == other["_at"]])
    joined = ranked.join(other, on, "left").select(*df.columns, *columns.values())
    return cold.unionByName(joined)


def first_per(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """First row per key by ``order``; combined before the shuffle, so copies are cheap."""
    rest = [c for c in df.columns if c not in keys]
    key = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    best = F.min_by(F.struct(*rest), key).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*").select(*df.columns)


def top_per(df: DataFrame, keys: list[str], order: list[Column], n: int, out: str = "rank") -> DataFrame:
    """The first ``n`` rows per key; Spark cuts each input partition to ``n`` before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(window)).filter(F.col(out) <= n)


def islands(df: DataFrame, keys: list[str], pos: str, chunk: int = 4096) -> DataFrame:
    """Maximal stretches of consecutive integers per key as rows ``keys, lo, hi``.

    Stretches are found within chunks of ``chunk`` positions, so no task ever sees
    more than one chunk; pieces that touch a chunk border are then joined up.
    """
    part = F.floor(F.col(pos) / chunk)
    place = Window.partitionBy(*keys, "_chunk").orderBy(pos)
    pieces = (df.select(*keys, F.col(pos).cast("long").alias(pos)).distinct()
              .withColumn("_chunk", part)
              .withColumn("_group", F.col(pos) - F.row_number().over(place))
              .groupBy(*keys, "_chunk", "_group")
              .agg(F.min(pos).alias("lo"), F.max(pos).alias("hi")))
    at_border = (F.pmod("lo", F.lit(chunk)) == 0) | (F.pmod("hi", F.lit(chunk)) == chunk - 1)
    inner = pieces.filter(~at_border).select(*keys, "lo", "hi")
    line = Window.partitionBy(*keys).orderBy("lo")
    linked = (pieces.filter(at_border).select(*keys, "lo", "hi")
              .withColumn("_new", (F.col("lo") != F.lag("hi").over(line) + 1).cast("int"))
              .withColumn("_id", F.sum(F.coalesce("_new", F.lit(1))).over(
                  line.rowsBetween(Window.unboundedPreceding, 0)))
              .groupBy(*keys, "_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))
    return inner.unionByName(linked.select(*keys, "lo", "hi"))


def cluster_1d(df: DataFrame, keys: list[str], pos: str, gap: float,
               lo: str | None = None, hi: str | None = None, chunk: int = 4096) -> DataFrame:
    """Group sorted positions whose step stays within ``gap``.

    Rows sharing a position are merged first.  Groups are found within chunks ``chunk``
    gaps wide; only those within a gap of a chunk's border are then joined up over the key, so
    no task ever sorts all positions of one.  Returns the truncated mean of the
    positions, their range, the span of ``lo``/``hi`` and the number of positions; ``cluster`` counts a key's groups from 1.
    """
    width = chunk * max(float(gap), 1.0)
    points = df.groupBy(*keys, pos).agg(F.min(lo or pos).alias("_lo"), F.max(hi or pos).alias("_hi"))

    def grouped(rows: DataFrame, by: list[str], first: str, last: str) -> DataFrame:
        line = Window.partitionBy(*by).orderBy(first)
        return (rows.withColumn("_new", F.when(F.col(first) - F.lag(last).over(line) <= gap, 0).otherwise(1))
                .withColumn("_group", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
                .groupBy(*by, "_group"))

    def merged(group, first: str, last: str, many) -> DataFrame:
        return group.agg(F.min(first).alias("first_pos"), F.max(last).alias("last_pos"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"),
                         F.sum(many[0]).alias("_sum"), F.sum(many[1]).alias("n"))

    chunks = points.withColumn("_chunk", F.floor(F.col(pos) / width))
    pieces = merged(grouped(chunks, [*keys, "_chunk"], pos, pos), pos, pos, (F.col(pos).cast("double"), F.lit(1)))
    start = F.col("_chunk") * width
    border = F.coalesce((F.col("first_pos") - start <= gap) | (start + width - F.col("last_pos") <= gap), F.lit(True))
    final = ["first_pos", "last_pos", "_lo", "_hi", "_sum", "n"]
    inner = pieces.filter(~border).select(*keys, *final)
    linked = merged(grouped(pieces.filter(border).select(*keys, *final), keys, "first_pos", "last_pos"), "first_pos", "last_pos", ("_sum", "n"))
    both = cut(inner.unionByName(linked.select(*keys, *final)))  # few rows, which the ranks below read twice
    return rank_within(both, keys, [F.col("first_pos")], "cluster").select(
        *keys, "cluster", (F.col("_sum") / F.col("n")).cast("long").alias("mean_pos"), "first_pos", "last_pos",
        F.col("_lo").alias("span_lo"), F.col("_hi").alias("span_hi"), "n")
