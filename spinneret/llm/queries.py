"""The registered queries: each operator over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spinneret.llm import (
    ball_codes,
    centroid_clusters,
    decontaminate,
    flat_graph,
    html_text,
    licences,
    line_dedup,
    mixing,
    near_dup,
    pii,
    quality_crf,
    quality_rules,
    token_files,
)

TOKENIZER = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that leak into any document."""
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, likelihood ratio and verdict of every document."""
    trusted = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"), trusted)


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract_text(_table(spark, sf_dir, "pages"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    return mixing.mix_counts(_table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and digest in the token files, read back from them."""
    return token_files.encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest, licence and licence notices of every document."""
    return licences.licence_scan(_table(spark, sf_dir, "documents"), licences.known_licences(spark))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data found in every document."""
    return pii.digested(pii.find_pii(_table(spark, sf_dir, "documents")))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every document."""
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line dedup removes from every document, and a digest of what it leaves."""
    found = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_lines", "n_removed", "removed", F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )


def op10_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = _table(spark, sf_dir, "documents")
    return quality_crf.score_documents(docs, quality_crf.train(docs, _table(spark, sf_dir, "labels")))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, distance and inertia of every vector."""
    return centroid_clusters.centroid_clusters(_table(spark, sf_dir, "embeddings"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and quantisation error of every vector."""
    return ball_codes.ball_codes(_table(spark, sf_dir, "embeddings"))


def op13_near_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of links and near-duplicate group of every vector."""
    return flat_graph.near_embeddings(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontaminate,
        op2_quality_rules,
        op3_html_text,
        op4_mix_sources,
        op5_token_files,
        op6_licence_scan,
        op7_pii,
        op8_minhash,
        op9_line_dedup,
        op10_quality_crf,
        op11_centroid_clusters,
        op12_vector_codes,
        op13_near_embeddings,
    )
}
