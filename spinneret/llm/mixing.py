"""Mixing sources to target weights by weighted sampling without replacement.

Every document gets an exponential key, -ln(u) / weight, with u from a hash of its id and
text and a weight from its text's quality (Efraimidis and Spirakis: the smallest keys are a
weighted sample). A source takes whole epochs first; for the rest its documents are
taken in the order of their keys until the words taken reach the budget.

The order is never made in one task. The key line is cut into 1024 parts, the words of
each part and source are added up, and the part in which the budget ends is cut again;
after three levels a few documents remain, which are sorted. What comes out is a cut
for each source, so documents themselves are not moved: each is compared with its cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spinneret.llm.common import count_words, text_of
from spinneret.session import written

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
# Weight of a text without any letter; that of letters only is 1.
LEAST_WEIGHT = 0.25

_BITS = 10
_LEVELS = 3
_NO_ID = -(1 << 63)


def quality_weight(text: Column) -> Column:
    """From 0.25 to 1, by the share of letters among the characters that are not space."""
    visible = F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    share = F.when(visible > 0, letters / visible).otherwise(F.lit(0.0))
    return LEAST_WEIGHT + (1 - LEAST_WEIGHT) * share


def _keyed(docs: DataFrame, seed: int, *carried: Column) -> DataFrame:
    """``doc_id, source, size``, the key ``_key`` and its place ``_at`` on the key line."""
    # Rows that share an id, or have none, have keys of their own by their texts.
    named = F.concat_ws(
        ":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5("_text")
    )
    u = (F.conv(F.substring(F.md5(named), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    places = 1 << (_BITS * _LEVELS)
    place = F.floor((1 - F.exp(-F.col("_key") * LEAST_WEIGHT)) * float(places))
    text = F.col("_text")
    kept = [name for name in ("_row",) if carried]
    return (
        docs.select("doc_id", F.col("source").cast("string").alias("source"), text_of("text").alias("_text"), *carried)
        .select(
            "doc_id", "source", count_words(text).alias("size"), (-F.log(u) / quality_weight(text)).alias("_key"), *kept
        )
        .withColumn("_at", F.least(place, F.lit(places - 1)).cast("long"))
        .withColumn("_id", F.coalesce("doc_id", F.lit(_NO_ID)))
    )


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source, source_size, target`` from ``source, size``, one row per source.

    Sources in code point order, null last, weigh ``weights`` in turn and share the sum
    of all sizes. No target exceeds ``max_epochs`` times its source; what is above is
    shared by weight among the others. The level at which targets settle is read off
    the sources in order of how soon they reach their bound.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    position = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(position, F.lit(len(weights))))
    bound = total.withColumn("_weight", weight).withColumn("_bound", F.col("source_size") * float(max_epochs))
    bound = bound.withColumn("_reach", F.col("_bound") / F.col("_weight"))
    every = Window.partitionBy()
    order = Window.orderBy("_reach", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("_bound").over(before), F.lit(0.0))) / (
        F.sum("_weight").over(every) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))
    )
    levels = bound.withColumn("_level", level)
    # The first source in the order that does not reach its bound sets the level.
    settles = F.when(F.col("_reach") >= F.col("_level"), F.col("_level"))
    settled = F.first(settles, ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    target = F.least(F.col("_bound"), F.coalesce(settled * F.col("_weight"), F.col("_bound")))
    return levels.select("source", "source_size", target.alias("target"))


def _cuts(keyed: DataFrame, targets: DataFrame) -> DataFrame:
    """For each source: epochs, and the last document that the rest of the budget takes."""
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    goal = targets.withColumn("_epochs", epochs.cast("long")).withColumn(
        "_rest", F.col("target") - F.col("_epochs") * F.col("source_size")
    )
    cut = goal.where("_rest > 0").select(
        F.col("source").alias("_of"), "_rest", F.lit(0).cast("long").alias("_part"), F.lit(0.0).alias("_before")
    )
    same = F.col("source").eqNullSafe(F.col("_of"))
    for step in range(1, _LEVELS + 1):
        shift = _BITS * (_LEVELS - step)
        part = F.shiftright("_at", shift)
        inside = keyed.join(cut, same).where(F.shiftright("_at", shift + _BITS) == F.col("_part"))
        sums = inside.groupBy("_of", "_rest", "_before", part.alias("_next")).agg(F.sum("size").alias("_size"))
        upto = F.sum("_size").over(Window.partitionBy("_of").orderBy("_next"))
        ends = sums.withColumn("_upto", F.col("_before") + upto)
        cut = written(
            ends.where((F.col("_upto") >= F.col("_rest")) & (F.col("_upto") - F.col("_size") < F.col("_rest"))).select(
                "_of", "_rest", F.col("_next").alias("_part"), (F.col("_upto") - F.col("_size")).alias("_before")
            ),
            "mix-cut",
        )
    last = (
        keyed.join(cut, same)
        .where(F.col("_at") == F.col("_part"))
        .groupBy("_of", "_rest", "_before", "_key", "_id", "size")
        .agg(F.sum("size").alias("_size"))
    )
    order = Window.partitionBy("_of").orderBy("_key", "_id", "size")
    upto = F.col("_before") + F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    # The document in which the budget ends is taken if at least half of it fits.
    fits = (F.col("_upto") - F.col("_size") < F.col("_rest")) & (
        F.col("_upto") - F.col("_size") / 2 <= F.col("_rest")
    )
    taken = (
        last.withColumn("_upto", upto)
        .where(fits)
        .groupBy("_of")
        .agg(F.max(F.struct("_key", "_id", "size")).alias("_last"))
    )
    return written(
        goal.join(cut.select("_of", "_part"), same, "left")
        .drop("_of")
        .join(taken, same, "left")
        .drop("_of")
        .select(F.col("source").alias("_of"), "source_size", "target", "_epochs", "_part", "_last"),
        "mix-cuts",
    )


def _copies() -> Column:
    """How often the mix takes a document, given the cut of its source."""
    within = (F.col("_at") < F.col("_part")) | (
        (F.col("_at") == F.col("_part")) & (F.struct("_key", "_id", "size") <= F.col("_last"))
    )
    return F.col("_epochs") + F.when(F.coalesce(within, F.lit(False)), F.lit(1)).otherwise(F.lit(0))


def mixing_plan(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 0
) -> tuple[DataFrame, DataFrame]:
    """The documents with their keys, and the cut of each source, both in shared tables."""
    keyed = written(_keyed(docs, seed), "mix-keys")
    targets = written(source_targets(keyed, weights, max_epochs), "mix-targets")
    return keyed, _cuts(keyed, targets)


def mix_counts(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 0
) -> DataFrame:
    """``doc_id, size, source_size, target, taken, source`` for every row of ``docs``.

    ``docs`` has ``doc_id, text, source``; other columns are ignored, whatever their
    names. Size is the number of words, 0 for null and empty texts. A null source is a
    source of its own, the last; null ids are one id below all others. Rows that agree
    in source, id and text are taken alike. A source's taken words differ from its
    target by at most half a document (or half of the words of such equal rows). A
    document taken in part of an epoch is taken whole. Empty tables give no rows.
    """
    keyed, cuts = mixing_plan(docs, weights, max_epochs, seed)
    return keyed.join(cuts, F.col("source").eqNullSafe(F.col("_of"))).select(
        "doc_id", "size", "source_size", "target", (_copies() * F.col("size")).alias("taken"), "source"
    )


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 0
) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, all columns kept.

    Only the cuts, one row a source, are joined to the documents.
    """
    _, cuts = mixing_plan(docs, weights, max_epochs, seed)
    rows = _keyed(docs, seed, F.struct("*").alias("_row"))
    taken = rows.join(cuts, F.col("source").eqNullSafe(F.col("_of"))).select("_row", _copies().alias("_n"))
    return (
        taken.where("_n > 0")
        .select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
        .select("_row.*")
    )
