"""Mixing of sources to target weights by capped water-filling; DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sigtrace.session import cut

#: A plan with at most so many sources (about 100 bytes each) is broadcast; a larger one is joined by a shuffle.
BROADCAST_SOURCES = 100_000
#: Bits of a document's random place that one pass over the sizes settles.
STEP_BITS, STEPS = 12, 2

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _numbered(sources: DataFrame) -> DataFrame:
    """Sources with their place ``n`` by code point, null last, without gathering them in one task."""
    ranged = (sources.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
              .select("source", "source_size", F.spark_partition_id().alias("part"),
                      F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("i")))
    ranged = cut(ranged)
    # one row per partition that holds sources, of which there are as many as shuffle partitions
    first = ranged.groupBy("part").agg(F.count("*").alias("many"))
    first = first.select("part", (F.sum("many").over(Window.orderBy("part")) - F.col("many")).alias("first"))
    return ranged.join(F.broadcast(first), "part").select("source", "source_size", (F.col("first") + F.col("i")).alias("n"))


def water_fill(sources: DataFrame, weights: Sequence[int], share: float, epochs: int) -> DataFrame:
    """Adds ``target``: share times all sizes dealt by weight, at most ``epochs`` times the source's size.

    Whoever would get more than its cap is clamped there, and the level of the
    others is taken anew, until none is above; each round is one aggregate.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("n") % len(weights) + 1).cast("int")).cast("long")
    table = cut(_numbered(sources).withColumn("weight", weight))
    cap = F.col("source_size") * epochs
    total = table.agg(F.sum("source_size")).head()[0] or 0
    level = None
    while True:
        clamped = F.lit(False) if level is None else cap < F.col("weight") * level
        held, free = table.agg(F.sum(F.when(clamped, cap).otherwise(0)), F.sum(F.when(clamped, 0).otherwise(F.col("weight")))).head()
        if not free:
            break
        new = max(0.0, (total * share - held) / free)
        if level is not None and new <= level:
            break
        level = new
    target = cap.cast("double") if level is None else F.least(cap.cast("double"), F.col("weight") * F.lit(level))
    return table.withColumn("target", target)


def _cut_points(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """Per source the place where its extra words run out: (source, place, group_words, left_words).

    Documents of a source are taken once more in the order of their random
    place until the words needed are reached.  The place is found digit by digit
    over sums per source and digit, so that no window holds more than 4096 rows
    of a source but the last, which holds the few places with the first digits.
    """
    todo = plan.where("need > 0").select("source", F.col("need").alias("left"), F.lit(0).cast("long").alias("prefix"))
    for step in range(STEPS + 1):
        shift = 64 - STEP_BITS * (step + 1)
        digit = F.shiftrightunsigned("place", shift) if step < STEPS else F.col("place")
        here = F.shiftrightunsigned("d.place", shift + STEP_BITS) == F.col("t.prefix") if step else F.lit(True)
        few = _small(todo)
        sums = (docs.alias("d").join(few.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")) & here)
                .select("d.source", "t.left", digit.alias("digit"), "size")
                .groupBy("source", "left", "digit").agg(F.sum("size").alias("words")))
        by_place = Window.partitionBy("source").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("upto", F.sum("words").over(by_place)).where("upto >= left AND upto - words < left")
        todo = cut(sums.select("source", (F.col("left") - F.col("upto") + F.col("words")).alias("left"),
                               F.col("digit").alias("prefix"), "words"))
    return todo.select("source", F.col("prefix").alias("place"), F.col("words").alias("group_words"), F.col("left").alias("left_words"))


def _small(plan: DataFrame) -> DataFrame:
    return F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan


def mix(df: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, epochs: int = 2, seed: int = 17,
        text_col: str = "text", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """How often each document is taken so that sources come to their target weights.

    Returns all columns in the struct ``doc`` and, beside it, size, source_size,
    target, whole (full repetitions) and taken (words taken, repetitions
    counted; ``taken - whole * size`` of them are a partial repetition).  Every
    source takes its words ``floor(target / source_size)`` times in full, then
    documents in a random order fixed by the seed and the id; the last one is
    taken in part, so that the sum is the target rounded to a whole word.

    Null texts have size 0 and are never taken; a null source is a source of
    its own, numbered last; a source without words has the target 0. Rows with
    the same id share a random place, and where the cut falls among them each is
    taken in part. An empty table gives no rows. Other columns, also ones named
    like the results, stay in ``doc``.
    """
    place = F.xxhash64(F.lit(seed), F.col(id_col).cast("string"))
    sized = df.select(F.struct("*").alias("doc"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), place.alias("place"))
    slim = cut(sized.select("source", "size", "place"))
    table = water_fill(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = (table.withColumn("whole", whole)
            .withColumn("need", F.round("target").cast("long") - F.col("whole") * F.col("source_size")))
    plan = cut(plan.select("source", "source_size", "target", "whole", "need"))
    ends = _cut_points(slim.where("size > 0"), plan)
    plan = cut(plan.join(ends.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s"))
    # places compare as unsigned numbers, as their digits were cut off
    before = F.col("place").bitwiseXOR(F.lit(-(1 << 63)).cast("long")) < F.col("cut").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))
    extra = (F.when(F.col("cut").isNull(), 0).when(before, F.col("size"))
             .when(F.col("place") == F.col("cut"), F.floor(F.col("left_words") * F.col("size") / F.col("group_words"))).otherwise(0)).cast("long")
    small = _small(plan.select(F.col("source").alias("s"), "source_size", "target", F.col("whole").alias("base"), F.col("place").alias("cut"), "group_words", "left_words"))
    out = sized.join(small, F.col("source").eqNullSafe(F.col("s")))
    taken = F.col("base") * F.col("size") + extra
    return out.select("doc", "size", "source_size", "target",
                      F.when(F.col("size") > 0, F.floor(taken / F.col("size"))).otherwise(0).cast("long").alias("whole"), taken.alias("taken"))


def first_words(text: Column, many: Column) -> Column:
    """The text up to the end of its ``many``-th word, blanks kept."""
    cutting = F.split(F.regexp_replace(text, r"^[\x20\x09-\x0D]+", ""), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    return F.regexp_replace(F.array_join(F.slice(cutting, F.lit(1), many.cast("int")), ""), r"[\x20\x09-\x0D]+$", "")


def repeat(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """The mix itself: full repetitions as equal rows, a partial one with the text's first words."""
    rest = F.col("taken") - F.col("whole") * F.col("size")
    full = mixed.where("whole > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("whole").cast("int"))).alias("i")).select("doc.*")
    part = mixed.where(rest > 0).select("doc", rest.alias("rest"))
    cut_doc = F.col("doc").withField(text_col, first_words(F.col(f"doc.{text_col}"), F.col("rest")))
    if "n_chars" in full.columns:
        kind = full.schema["n_chars"].dataType
        cut_doc = cut_doc.withField("n_chars", F.length(first_words(F.col(f"doc.{text_col}"), F.col("rest"))).cast(kind))
    return full.unionAll(part.select(cut_doc.alias("doc")).select("doc.*"))
