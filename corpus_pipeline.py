"""From raw documents to token files: five stages, each over all that the one before kept.

All stages take documents as they come: null and empty texts, null and repeated ids,
repeated rows and further columns of any names, and empty tables, which give empty ones.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from spinneret.llm import decontaminate, mixing, near_dup, quality_crf, token_files
from spinneret.session import written

# Words in a shingle of the near-duplicate stage.
SHINGLE = 5


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject.

    Null and empty texts have a score as well; a document at the threshold stays; each
    of repeated rows is judged alike.
    """
    model = quality_crf.train(docs, _table(spark, sf_dir, "labels"))
    score = "_".join(["score", *docs.columns])  # a name that no column has
    scored = quality_crf.with_quality(docs, model, score)
    return scored.where(scored[score] >= quality_crf.THRESHOLD).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, by shingles of five words.

    That with the smallest id stays, then with the smallest digest of its text; texts
    without words are in no group.
    """
    return near_dup.without_near_duplicates(docs, SHINGLE)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item leaks into; null and empty texts stay."""
    return decontaminate.without_leaks(docs, _table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: every document as often as its source's target takes it.

    Documents without words have no size and come as often as their source's epochs and
    its cut say; rows equal in source, id and text are taken alike.
    """
    return mixing.mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place and digest of every document in the token files, read back from them.

    Null and empty texts have the end id alone; rows without an id come first.
    """
    return token_files.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", source_mixing),
    ("token-ID / binary output", token_output),
]

# Model, sketches and tokenizer are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.split()[0].lower()}")
    return STAGES[-1][1](spark, docs, sf_dir)
