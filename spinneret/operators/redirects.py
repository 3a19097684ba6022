"""Where a URL ends after its redirects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spinneret.functions.messages import too_many_redirects
from spinneret.session import pinned_counted, written_counted

# The usual and the highest number of requests per URL.
MAX_REDIRECTS = 5
HARD_MAX_REDIRECTS = 50


def request_limit(max_redirects: int) -> int:
    """Requests allowed per URL; out-of-range settings mean the hard limit."""
    return max_redirects if 0 < max_redirects <= HARD_MAX_REDIRECTS else HARD_MAX_REDIRECTS


def resolved(url: Column, location: Column) -> Column:
    """Where ``location`` leads from ``url``, both as text; absolute ones stay as they are.

    A ``url`` without a scheme and authority cannot be a base: its location stays too.
    """
    base = r"^([A-Za-z][A-Za-z0-9+.-]*:)(//[^/?#]*)([^?#]*)"
    scheme, host, path = (F.regexp_extract(url, base, i) for i in (1, 2, 3))
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    own = F.regexp_extract(location, r"^([^?#]*)", 1)
    rest = F.regexp_extract(location, r"^[^?#]*(.*)$", 1)
    joined = F.when(own.startswith("/"), own).otherwise(
        F.concat(F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, r"[^/]*$", "")), own)
    )
    # Dot segments go, each ".." with the segment before it.
    parts = F.split(F.substring(joined, 2, 1 << 30), "/")
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda out, x: F.when(x == ".", out)
        .when(x == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))))
        .otherwise(F.array_append(out, x)),
    )
    ends_in_folder = joined.rlike(r"/\.\.?$") & (F.size(kept) > 0)
    clean = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(ends_in_folder, F.lit("/")).otherwise(F.lit("")))
    place = (
        F.when(own != "", F.concat(clean, rest))
        .when(rest.startswith("?"), F.concat(path, rest))
        .otherwise(F.concat(path, query, rest))
    )
    return (
        F.when(~url.rlike(base) | location.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), location)
        .when(location.startswith("//"), F.concat(scheme, location))
        .otherwise(F.concat(scheme, host, place))
    )


def known_hops(hops: DataFrame) -> DataFrame:
    """``url, target``: where each redirecting URL of ``hops`` leads.

    A URL captured more than once counts once, with its first location by
    ``capture_id`` where there is one, else the smallest. Locations are resolved
    against their URL.
    """
    if "capture_id" in hops.columns:
        first = F.min_by("location", F.when(F.col("location").isNotNull(), F.col("capture_id")))
    else:
        first = F.min("location")
    known = hops.groupBy("url").agg(first.alias("location")).where("location IS NOT NULL")
    return known.select("url", resolved(F.col("url"), F.col("location")).alias("target"))


def reached_hops(urls: DataFrame, hops: DataFrame, limit: int) -> DataFrame:
    """``known_hops`` of only those URLs that ``urls (url)`` lead to in ``limit`` steps.

    The frontier holds addresses, each once: a target that many URLs share is one row,
    and an address whose hop is known is not asked for again, so loops end.
    """
    frontier, found = urls.select("url").where("url IS NOT NULL").distinct(), known_hops(hops.limit(0))
    for _ in range(limit):
        step, size = written_counted(known_hops(hops.join(frontier, "url", "left_semi")), "reached-hops")
        if not size:
            break
        found = found.unionByName(step)
        onward = step.select(F.col("target").alias("url")).distinct()
        frontier = onward.join(found.select("url"), "url", "left_anti")
    return found


def redirect_chains(hops: DataFrame, limit: int) -> DataFrame:
    """``url, target, steps`` for each redirecting URL of ``hops``."""
    return chains_of(known_hops(hops), limit)


def chains_of(known: DataFrame, limit: int) -> DataFrame:
    """``url, target, steps`` for each row of ``known (url, target)``.

    Each round joins the table with itself and doubles how far a row can see, so
    few rounds do. ``steps`` is exact below ``limit``; at ``limit`` or more the chain
    is too long (or a loop).
    """
    chains = known.withColumn("steps", F.lit(1))
    reach = 1
    while reach < limit:
        chains, size = pinned_counted(chains)
        if not size:
            break
        onward = chains.select(
            F.col("url").alias("target"), F.col("target").alias("_next"), F.col("steps").alias("_more")
        )
        chains = chains.join(onward, "target", "left").select(
            "url",
            F.coalesce("_next", "target").alias("target"),
            (F.col("steps") + F.coalesce("_more", F.lit(0))).alias("steps"),
        )
        reach *= 2
    return chains


def resolve_redirects(
    urls: DataFrame, hops: DataFrame, max_redirects: int = MAX_REDIRECTS, only_reached: bool = False
) -> DataFrame:
    """Add ``final_url, requests, redirect_error`` to rows with a ``url``.

    ``hops`` may repeat a URL; a null or absent location is an end. A URL that
    needs more than ``max_redirects`` requests has an error and no final URL.
    ``only_reached`` leaves out hops that no row leads to: worth its extra rounds where
    ``urls`` are few beside ``hops``. Give stored ``urls`` then: they are read twice.
    """
    limit = request_limit(max_redirects)
    known = reached_hops(urls, hops, limit) if only_reached else known_hops(hops)
    found = urls.join(chains_of(known, limit), "url", "left")
    stopped = F.coalesce(F.col("steps") >= limit, F.lit(False))
    return (
        found.withColumn("final_url", F.when(~stopped, F.coalesce("target", "url")))
        .withColumn("requests", F.when(stopped, limit).otherwise(F.coalesce("steps", F.lit(0)) + 1))
        .withColumn("redirect_error", F.when(stopped, too_many_redirects(limit)))
        .drop("target", "steps")
    )
