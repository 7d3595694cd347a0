"""Data-quality rules over component tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import shapes
from ..functions.text import ref_reads, text_matches, text_verdict
from ..session import cut
from .ordered import first_per
from .spatial import nearest_k


def _failed(rules: dict):
    return F.array_compact(F.array(*[
        F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items()]))


def validate_index(index: DataFrame) -> DataFrame:
    """Rows that break a rule of the component index, with the names of the rules.

    ``index``: refdes, scale, src_dpi, tgt_dpi, tgt_image_dpi, image_w, image_h,
    tgt_w, tgt_h, board (box struct), x, y, box (polygon).
    """
    board = F.col("board")
    rules = {
        "scale": F.col("scale") == F.col("tgt_dpi") / F.col("src_dpi"),
        "dpi": F.col("tgt_image_dpi") == F.col("tgt_dpi"),
        "image_size": (F.col("image_w") == F.col("tgt_w")) & (F.col("image_h") == F.col("tgt_h")),
        "center": geo.in_bounds(F.col("x"), F.col("y"), board),
        "box": (F.size("box") == 4) & F.forall("box", lambda p: geo.in_bounds(p["x"], p["y"], board)),
    }
    return index.withColumn("failed", _failed(rules)).filter(F.size("failed") > 0)


def require_provenance(df: DataFrame, required: list[str]) -> DataFrame:
    """Rows lacking a required field, with the fields; such rows are not to be trusted."""
    rules = {c: F.col(c).isNotNull() for c in required}
    return df.withColumn("missing", _failed(rules)).filter(F.size("missing") > 0)


def dpi_mixups(run: DataFrame, other: DataFrame, ratios=(2.0, 3.0), tol: float = 0.01) -> DataFrame:
    """Designators whose places in two runs differ by one constant dpi ratio.

    Both: refdes, x, y, one row per designator.
    """
    o = other.select("refdes", F.col("x").alias("ox"), F.col("y").alias("oy"))
    joined = run.select("refdes", "x", "y").join(o, "refdes").filter("x > 0 and y > 0")
    rx, ry = F.col("ox") / F.col("x"), F.col("oy") / F.col("y")
    ladder = reduce(lambda a, k: a.when((F.abs(rx - k) <= tol) & (F.abs(ry - k) <= tol), k), ratios[1:],
                    F.when((F.abs(rx - ratios[0]) <= tol) & (F.abs(ry - ratios[0]) <= tol), ratios[0]))
    return joined.withColumn("ratio", ladder).filter("ratio is not null")


def main_ratio(mixups: DataFrame) -> DataFrame:
    """The dpi ratio that most designators show; the smaller one on ties."""
    counts = mixups.groupBy("ratio").agg(F.count("*").alias("n"))
    return counts.agg(F.min_by("ratio", F.struct(F.col("n") * -1, F.col("ratio"))).alias("ratio"), F.max("n").alias("n"))


def view_leaks(df: DataFrame) -> DataFrame:
    """Designators with the very same pixel in more than one view."""
    seen = df.select("refdes", "x", "y", "view_name").distinct()
    return (seen.groupBy("refdes", "x", "y").agg(F.count("*").alias("views"),
                                                 F.array_sort(F.collect_set("view_name")).alias("view_names"))
            .filter("views > 1"))


def size_outliers(components: DataFrame, typical: DataFrame, tol: float = 0.6) -> DataFrame:
    """Components with ``size_check`` (null where undefined) and, if off, ``size_dev``."""
    joined = components.join(typical, "sym", "left")
    check = shapes.size_check(F.col("w"), F.col("h"), F.col("typical_w"), F.col("typical_h"), tol)
    return (joined.withColumn("_c", check).withColumn("size_check", F.col("_c.ok"))
            .withColumn("size_dev", geo.round_even(F.col("_c.dev"), 2)).drop("_c"))


def reverse_check(components: DataFrame, reads: DataFrame) -> DataFrame:
    """Whether any text read at a component confirms its designator.

    ``components``: ord, refdes; ``reads``: ord, text.  Equal reads count once.
    """
    r = reads.select("ord", "text").distinct()
    tested = components.select("ord", "refdes").join(r, "ord", "left").groupBy("ord", "refdes").agg(
        F.coalesce(F.bool_or(ref_reads(F.col("refdes"), F.col("text"))), F.lit(False)).alias("reverse_ok"))
    return components.join(tested.drop("refdes"), "ord")


def relocate(components: DataFrame, symbols: DataFrame, reads: DataFrame, n: int = 10) -> DataFrame:
    """For failed components the nearest of the ``n`` closest symbols that reads its name.

    ``components``: page_id, ord, refdes, x, y (the label's place), text_box;
    ``symbols``: page_id, s_ord, sx, sy; ``reads``: s_ord, text.  Symbols inside the
    component's text box are passed over.  Components of one place share a search, which
    widens until ``n`` symbols are found or the page is exhausted.
    """
    key, box = ["page_id", "ord"], F.when(F.size("text_box") > 0, geo.box_bounds(F.col("text_box")))
    # The failed checks are worked out once, as the search and its answer both need them; of the text box only its bounds.
    own = cut(components.select("page_id", "ord", "refdes", "x", "y", box.alias("bounds")))
    near = own.join(nearest_k(own, symbols, n), ["page_id", "x", "y"])
    outside = near.filter(~F.coalesce(geo.in_bounds(F.col("sx"), F.col("sy"), F.col("bounds")), F.lit(False)))
    texts = reads.select("s_ord", "text").distinct()
    good = outside.join(texts, "s_ord").filter(ref_reads(F.col("refdes"), F.col("text")))
    best = first_per(good.select(*key, "refdes", "s_ord", "sx", "sy", "distance"), [*key, "refdes"], ["distance", "s_ord"])
    return best.select(*key, "refdes", F.col("s_ord").alias("symbol"), F.col("sx").alias("symbol_x"),
                       F.col("sy").alias("symbol_y"), "distance")


def read_back(expected: DataFrame, reads: DataFrame, fuzzy: bool = False) -> DataFrame:
    """Verdict per expected designator from the texts read at its place.

    ``expected``: ord, refdes; ``reads``: ord, text.  Texts are tested one by one and
    combined before the shuffle, so many reads at one place stay cheap.
    """
    r = reads.select("ord", "text").distinct()
    hit = text_matches(F.col("refdes"), F.array("text"), fuzzy)
    tested = expected.select("ord", "refdes").join(r, "ord", "left").groupBy("ord", "refdes").agg(
        F.coalesce(F.bool_or(F.col("text").isNotNull() & hit), F.lit(False)).alias("matched"),
        F.count("text").alias("texts"))
    return tested.withColumn("verdict", F.when(F.col("matched"), "match").when(F.col("texts") == 0, "not_found")
                             .otherwise("mismatch"))


def verify_summary(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("total"),
                       *[F.count_if(F.col("verdict") == v).alias(v) for v in ("match", "mismatch", "not_found")])


__all__ = ["validate_index", "require_provenance", "dpi_mixups", "main_ratio", "view_leaks", "size_outliers",
           "reverse_check", "relocate", "read_back", "verify_summary", "text_verdict"]
