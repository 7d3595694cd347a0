"""Evidence scores over rounds: truth score, stability, recall, deltas, leaderboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import rank_within

# Effect of an event kind on a score, limits and tiers.
STEPS = {"ok": 10, "fail": -20, "conflict": -30}
HUMAN_SCORE = 100
LOW, HIGH = 0, 100
START_SCORE = 80
HARD_TIER, WEIGHT_TIER = 90, 40
STABLE_BONUS = 10
FOLD_CHUNK = 10_000


def tier(score: Column) -> Column:
    return F.when(score >= HARD_TIER, "hard").when(score >= WEIGHT_TIER, "weight").otherwise("ignore")


def _clamp(value, low, high):
    return F.least(high, F.greatest(low, value))


def effect(kind: Column) -> Column:
    """An event as the function x -> clamp(x + add, low, high)."""
    add = F.lit(0)
    for name, step in STEPS.items():
        add = F.when(kind == name, step).otherwise(add)
    fixed = kind == "human"
    return F.struct(F.when(fixed, 0).otherwise(add).alias("add"),
                    F.when(fixed, HUMAN_SCORE).otherwise(LOW).alias("low"),
                    F.when(fixed, HUMAN_SCORE).otherwise(HIGH).alias("high"))


def _then(f: Column, g: Column) -> Column:
    """Such functions are closed under composition: first ``f``, then ``g``."""
    return F.struct((f["add"] + g["add"]).alias("add"),
                    _clamp(f["low"] + g["add"], g["low"], g["high"]).alias("low"),
                    _clamp(f["high"] + g["add"], g["low"], g["high"]).alias("high"))


def _neutral() -> Column:
    wide = 1_000_000_000
    return F.struct(F.lit(0).alias("add"), F.lit(-wide).alias("low"), F.lit(wide).alias("high"))


def compose(steps: Column) -> Column:
    """One effect of an ordered array of structs with an effect ``f`` each."""
    return F.aggregate(steps, _neutral(), lambda acc, s: _then(acc, s["f"]))


def truth_score(events: DataFrame, start: int = START_SCORE, chunk: int = FOLD_CHUNK) -> DataFrame:
    """Fold each fact's events in time order into a score within 0..100 and its tier.

    ``events``: fact, ts, seq, kind.  Events with equal ts and seq apply the worst
    effect first, so the score never depends on ``chunk``.  Events compose like functions, so a long history
    is folded in ordered chunks, then the chunks likewise: no task or array ever holds
    more than ``chunk`` events, however many one fact has.
    """
    rows = events.select("fact", F.struct("ts", "seq").alias("at"), effect(F.col("kind")).alias("f"))
    counts = rows.groupBy("fact").agg(F.count("*").alias("n"))
    longest = counts.agg(F.max("n")).first()[0] or 0

    def fold(grouped):
        steps = F.array_sort(F.collect_list(F.struct("at", "f")))
        return grouped.agg(compose(steps).alias("f"))

    while longest > chunk:
        ranked = rank_within(rows, ["fact"], [F.col("at"), F.col("f")], "_rank")
        ranked = ranked.withColumn("_c", F.floor((F.col("_rank") - 1) / chunk))
        rows = fold(ranked.groupBy("fact", "_c")).select("fact", F.col("_c").alias("at"), "f")
        longest = -(-longest // chunk)
    done = fold(rows.groupBy("fact")).join(counts, "fact")
    score = _clamp(F.lit(start) + F.col("f.add"), F.col("f.low"), F.col("f.high"))
    return done.select("fact", F.col("n").alias("events"), score.cast("long").alias("score"), tier(score).alias("tier"))


def stable_rounds(events: DataFrame, n: int = 3) -> DataFrame:
    """Streaks of rounds in which every event of a fact was ok, and the bonus they earn.

    ``events``: fact, round, kind.  Events are reduced to one flag per round first.
    """
    rounds = events.groupBy("fact", "round").agg(F.bool_and(F.col("kind") == "ok").alias("ok"))
    line = Window.partitionBy("fact").orderBy("round")
    streaks = (rounds.withColumn("_bad", F.sum((~F.col("ok")).cast("int")).over(
        line.rowsBetween(Window.unboundedPreceding, 0))).filter("ok")
        .groupBy("fact", "_bad").agg(F.count("*").alias("len")))
    per = streaks.groupBy("fact").agg(F.max("len").alias("longest"), F.sum(F.floor(F.col("len") / n)).alias("rewards"))
    every = rounds.groupBy("fact").agg(F.count("*").alias("rounds"))
    out = every.join(per, "fact", "left").fillna(0, ["longest", "rewards"])
    return out.withColumn("bonus", F.col("rewards") * STABLE_BONUS)


def recall(hits: DataFrame, keys=("round", "method")) -> DataFrame:
    """Share of the truth that was hit, per round and method."""
    out = hits.groupBy(*keys).agg(F.count_if("hit").alias("hits"), F.count("*").alias("truth"))
    return out.withColumn("recall", F.round(F.col("hits") / F.col("truth"), 4))


def round_delta(current: DataFrame, previous: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys added, changed or removed between two rounds (unchanged ones are left out)."""
    a = current.select(*keys, F.struct(*values).alias("_a"), F.lit(True).alias("_in_a"))
    b = previous.select(*keys, F.struct(*values).alias("_b"), F.lit(True).alias("_in_b"))
    change = (F.when(F.col("_in_b").isNull(), "added").when(F.col("_in_a").isNull(), "removed")
              .when(~F.col("_a").eqNullSafe(F.col("_b")), "changed"))
    return a.join(b, keys, "full").withColumn("change", change).filter("change is not null").select(*keys, "change")


def delta_counts(delta: DataFrame, keys: list[str]) -> DataFrame:
    return delta.groupBy(*keys).agg(*[F.count_if(F.col("change") == c).alias(c)
                                      for c in ("added", "changed", "removed")])


WIDE_LIMIT = 60_000


def leaderboard(metrics: DataFrame) -> DataFrame:
    """Methods of each round ranked: not too wide first, then fewest pieces, then most kept."""
    order = [(F.col("wide") > WIDE_LIMIT).asc(), F.col("main_cc").asc(), F.col("main_kept").desc(), F.col("method").asc()]
    return rank_within(metrics, ["round"], order, "place")
