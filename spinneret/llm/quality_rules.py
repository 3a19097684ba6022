"""Quality rules: base counts and a hashed n-gram likelihood ratio, DataFrame functions only.

Words and word pairs are hashed into a fixed number of buckets. Two multinomials over
the buckets are counted from whole tables: the raw corpus (all documents) and the
trusted target (documents that ``labels.quality`` marks 1). A document's score is the
mean over its words and pairs of log p_target - log p_raw, so that its length does not
matter, and it is kept when the score reaches a fixed threshold.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spinneret.llm.common import NOT_SPACE, text_of, words

BUCKETS = 1 << 14
# Mean log-likelihood ratio from which a document is kept.
THRESHOLD = -0.08
MIN_WORDS = 50


def _bucket(buckets: int, *parts: Column) -> Column:
    """The bucket of a word, or of a pair of words, each given by its hash."""
    return F.pmod(parts[0] if len(parts) == 1 else F.xxhash64(*parts), F.lit(buckets)).cast("int")


def _word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda x: F.xxhash64(x))


def ngram_counts(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, raw, target``: how often words and pairs of each bucket occur.

    ``raw`` counts all documents, ``target`` those whose ``doc_id`` is in ``trusted``.
    Counts are combined in each task, so that what is shuffled is at most ``buckets``
    rows a task, besides the texts that meet their label once.
    """
    ids = trusted.select(F.col("doc_id").alias("_id")).where("_id IS NOT NULL").distinct()
    marked = docs.select(F.col("doc_id").alias("_id"), text_of("text").alias("_text")).join(
        # A shuffle at every size: labels grow with the documents, so they are never broadcast.
        ids.withColumn("_trusted", F.lit(1)).hint("merge"), "_id", "left"
    )
    w = F.col("_words")
    following = F.slice(w, 2, F.greatest(F.size(w), F.lit(1)))
    neighbours = marked.select("_trusted", _word_hashes(F.col("_text")).alias("_words")).select(
        "_trusted", F.inline(F.arrays_zip(w.alias("_one"), following.alias("_next")))
    )
    both = F.array(_bucket(buckets, F.col("_one")), F.when(
        F.col("_next").isNotNull(), _bucket(buckets, F.col("_one"), F.col("_next"))
    ))
    return (
        neighbours.select("_trusted", F.explode(both).alias("bucket"))
        .where("bucket IS NOT NULL")
        .groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("raw"), F.count("_trusted").alias("target"))
    )


def ngram_weights(counts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """log p_target - log p_raw of each bucket, with one count added to every bucket.

    ``counts`` has at most ``buckets`` rows, which is all that reaches the driver.
    Without any trusted text all weights are 0. Weights are rounded to four places.
    """
    raw, target = np.ones(buckets), np.ones(buckets)
    for row in counts.collect():
        raw[row["bucket"]] += row["raw"]
        target[row["bucket"]] += row["target"]
    if target.sum() == buckets:
        return np.zeros(buckets)
    return np.round(np.log(target / target.sum()) - np.log(raw / raw.sum()), 4)


def quality_rules(
    docs: DataFrame,
    trusted: DataFrame,
    buckets: int = BUCKETS,
    threshold: float = THRESHOLD,
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """One row per row of ``docs``: its counts, score and verdict.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored, whatever their
    names. A null text counts as empty. An empty text fails the base rule and has score
    0. Documents with equal texts get equal results; a null ``doc_id`` is carried and
    never trusted. Empty tables give no rows.
    """
    weights = F.lit(ngram_weights(ngram_counts(docs, trusted, buckets), buckets))
    w, h = F.col("_words"), F.col("_hashes")
    n = F.size(h)
    base = docs.select("doc_id", text_of("text").alias("_text")).select(
        "doc_id",
        words(F.col("_text")).alias("_words"),
        (F.length("_text") - F.length(F.regexp_replace("_text", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(NOT_SPACE)).alias("_lines"),
    )
    hashed = base.select(
        "doc_id",
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform(w, lambda x: F.xxhash64(x)).alias("_hashes"),
    )
    scored = hashed.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        # Three-word windows by hash, in the order of the text.
        F.transform(
            F.slice(h, 3, F.greatest(n - 2, F.lit(0))),
            lambda x, i: F.xxhash64(F.get(h, i), F.get(h, i + 1), x),
        ).alias("_windows"),
        F.aggregate(
            F.transform(
                h,
                lambda x, i: F.get(weights, _bucket(buckets, x))
                + F.when(i < n - 1, F.get(weights, _bucket(buckets, x, F.get(h, i + 1)))).otherwise(F.lit(0.0)),
            ),
            F.lit(0.0),
            lambda total, x: total + x,
        ).alias("_sum"),
    )
    # Most texts repeat no window: only the others look for where the repeats stand.
    placed = scored.withColumn(
        "_placed",
        F.when(
            F.size(F.array_distinct("_windows")) < F.size("_windows"),
            F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    ).drop("_windows")
    size = F.size("_placed")
    starts = F.col("_starts")
    p = F.col("_placed")
    found = placed.withColumn(
        "_starts",
        F.transform(
            F.filter(
                F.transform(
                    p,
                    lambda x, k: F.struct(
                        x["i"].alias("i"),
                        (
                            ((k > 0) & (F.get(p, k - 1)["h"] == x["h"]))
                            | ((k < size - 1) & (F.get(p, k + 1)["h"] == x["h"]))
                        ).alias("again"),
                    ),
                ),
                lambda x: x["again"],
            ),
            lambda x: x["i"],
        ),
    ).drop("_placed")
    covered = F.array_union(
        F.array_union(starts, F.transform(starts, lambda i: i + 1)), F.transform(starts, lambda i: i + 2)
    )
    counted = found.withColumn("n_repeat_words", F.coalesce(F.size(covered), F.lit(0)).cast("long")).drop("_starts")
    grams = F.col("n_words") + F.greatest(F.col("n_words") - 1, F.lit(0))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        counted.withColumn("base_failed", failed)
        .withColumn("score", F.when(grams > 0, F.col("_sum") / grams).otherwise(F.lit(0.0)))
        .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "base_failed", "kept", "score",
        )
    )
