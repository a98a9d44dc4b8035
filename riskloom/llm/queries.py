"""The queries of this subpackage, one per operator, over the whole given tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import bottomk, collocations, decontam, html_extract, langid, licenses, line_dedup, mixing, projections, quality, sharding, variants, warc
from riskloom.llm.collocations import COLLOCATION_SQL
from riskloom.llm.common import table
from riskloom.llm.sql import LINE_SQL, MIX_SQL, NEAR_SQL, SHARD_SQL, VECTOR_SQL, WARC_SQL
from riskloom.llm.variants import VARIANT_SQL

SHARD_BYTES = 1 << 20
NEAR_PERCENT = 85


def op1_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return line_dedup.deduplicated(table(spark, sf, "documents").select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_removed", "longest_run", F.char_length("text").alias("n_chars_kept"),
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op2_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf, "pages"))


def op3_minhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return bottomk.near_duplicates(table(spark, sf, "documents"), NEAR_PERCENT).drop("text_key")


def op4_warc(spark: SparkSession, sf: str) -> DataFrame:
    return warc.page_digests(table(spark, sf, "pages"))


def op5_embedding_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return projections.near_duplicates(table(spark, sf, "embeddings"))


def op6_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    return quality.scores(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op7_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontam.annotate(table(spark, sf, "documents"), table(spark, sf, "benchmark"), keep=["doc_id"])


def op8_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.shard(table(spark, sf, "documents").select("doc_id", "text"), SHARD_BYTES).drop("text")


def op9_language_id(spark: SparkSession, sf: str) -> DataFrame:
    return langid.predictions(table(spark, sf, "documents"))


def op10_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents").select("doc_id", "source", "text")).drop("text", "source")


def op11_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan(table(spark, sf, "documents"))


def op12_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.collocations(table(spark, sf, "documents"))


def op13_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return variants.spelling_groups(table(spark, sf, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_line_dedup, op2_html_extraction, op3_minhash_near_dedup, op4_warc, op5_embedding_near_dedup, op6_quality_classifier, op7_decontamination,
    op8_sharding, op9_language_id, op10_mixing, op11_license_scan, op12_collocations, op13_spelling_variants)}
SQL = {"op1_line_dedup": LINE_SQL, "op3_minhash_near_dedup": NEAR_SQL, "op4_warc": WARC_SQL, "op5_embedding_near_dedup": VECTOR_SQL,
       "op8_sharding": SHARD_SQL.format(limit=SHARD_BYTES), "op10_mixing": MIX_SQL, "op11_license_scan": licenses.scan_sql(),
       "op12_collocations": COLLOCATION_SQL, "op13_spelling_variants": VARIANT_SQL}
