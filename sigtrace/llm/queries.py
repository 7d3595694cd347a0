"""The operators over the driver's tables: opN_<name>, each over its whole table, and the pipeline's own SQL if any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import collocations, cutting_stock, divergence, html, jaccard, langid, licences, lm, mixing, neighbours, packing, quality, tokens


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_best_fit_packing(spark, folder):
    return packing.best_fit_packing(table(spark, folder, "documents"), vocabulary(), 2048)


def op2_token_counts(spark, folder):
    return tokens.token_counts(table(spark, folder, "documents"), vocabulary())


def op3_licence_scans(spark, folder):
    return licences.licence_scan(table(spark, folder, "documents")).drop("spans")


def op4_quality_rules(spark, folder):
    return quality.quality_rules(table(spark, folder, "documents"))


def op5_ngram_jaccard(spark, folder):
    return jaccard.jaccard_groups(table(spark, folder, "documents"))


def op6_source_mixing(spark, folder):
    mixed = mixing.mix(table(spark, folder, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc.doc_id", "size", "source_size", "target", "taken")


def op7_language_id(spark, folder):
    docs = table(spark, folder, "documents")
    return langid.identify(docs, langid.train(docs))


def op8_main_text(spark, folder):
    pages = table(spark, folder, "pages")
    return html.main_text(pages, html.train(pages)).drop("n_kept", "n_blocks")


def op9_nearest(spark, folder):
    return neighbours.nearest(table(spark, folder, "embeddings")).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_lm_scores(spark, folder):
    return lm.interpolated_scores(table(spark, folder, "documents"))


def op11_source_divergence(spark, folder):
    return divergence.divergence(table(spark, folder, "documents"))


def op12_cutting_stock_packing(spark, folder):
    return cutting_stock.cutting_stock_packing(table(spark, folder, "documents"), vocabulary(), 1024)


def op13_phrase_collocations(spark, folder):
    return collocations.collocations(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_best_fit_packing, op2_token_counts, op3_licence_scans, op4_quality_rules, op5_ngram_jaccard,
                            op6_source_mixing, op7_language_id, op8_main_text, op9_nearest, op10_lm_scores,
                            op11_source_divergence, op12_cutting_stock_packing, op13_phrase_collocations)}

#: Where SQL can express a result; the others have brute-force tests.
ORACLES: dict[str, str] = {"op11_source_divergence": divergence.ORACLE, "op13_phrase_collocations": collocations.ORACLE}
