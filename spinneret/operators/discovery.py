"""From websites to the ordered page URLs their sitemaps list.

Every place a sitemap is reached at is a *visit* with a place: the position of its
root, then of each entry on the way. Places compare position by position, so their
order is the order of a depth-first walk.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spinneret.functions import encodings, messages, sitemaps
from spinneret.functions.predicates import body_accepted
from spinneret.functions.urls import on_host
from spinneret.operators.joins import lookup, rows_per_task, without
from spinneret.operators.ordering import first_per_key
from spinneret.operators.places import places
from spinneret.session import pinned_counted, written

# The deepest level that is read, and where robots files are.
MAX_DEPTH = 5
ROBOTS_PATH = "/robots.txt"

# Numbers of visits grow with the power of the depth.
_TIMES = "decimal(38,0)"


class Discovery(NamedTuple):
    urls: DataFrame  # crawl_id, url, path: each URL once, at its first place
    errors: DataFrame  # crawl_id, sitemap_url, depth, error: one row per visit
    stats: DataFrame  # crawl_id, urls_found, sitemaps_found, errors
    failures: DataFrame  # the errors with ``times``, one row for all alike


def first_documents(documents: DataFrame) -> DataFrame:
    """One document per address: the one with the lowest ``capture_id``.

    Tables without that column are taken to hold each address once.
    """
    if "capture_id" not in documents.columns:
        return documents
    narrow = documents.select("url", "capture_id")
    first = first_per_key(narrow, ["url"], "capture_id")
    later = narrow.join(first, ["url", "capture_id"], "left_anti")
    return without(documents, later, "capture_id").drop("capture_id")


def sitemap_roots(sites: DataFrame, documents: DataFrame) -> DataFrame:
    """``crawl_id, sitemap_url, path`` for sites ``crawl_id, website``.

    The sitemaps robots.txt declares, else the two common addresses. A declared
    sitemap rules the common ones out even if it turns out to be broken.
    """
    body = F.col("body").cast("string")
    readable = F.col("url").endswith(ROBOTS_PATH) & body_accepted(F.col("status_code"), body)
    robots = documents.where(readable).select(
        F.col("url").alias("robots_url"), sitemaps.declared_sitemaps(body).alias("declared")
    )
    asked = sites.withColumn("robots_url", on_host(F.col("website"), ROBOTS_PATH))
    guessed = F.array(*[on_host(F.col("website"), path) for path in sitemaps.COMMON_PATHS])
    listed = F.when(F.size(F.coalesce("declared", F.array())) > 0, F.col("declared")).otherwise(guessed)
    return (
        asked.join(robots, "robots_url", "left")
        .select("crawl_id", F.posexplode(listed).alias("pos", "sitemap_url"))
        .select("crawl_id", "sitemap_url", F.array("pos").alias("path"))
    )


def parse_sitemaps(documents: DataFrame, decode: bool = False) -> DataFrame:
    """``sitemap_url, kind, entries, error``: one row per captured document.

    Documents that were refused or do not parse have an error and no kind. ``body`` is a
    string or the bytes as they came. A document that declares another encoding than
    UTF-8, or bytes that are not in it, cannot be read. With ``decode``, bytes are read in
    the encoding that they declare, if it is known, and strings are taken as decoded.
    """
    url, status = F.col("url"), F.col("status_code")
    raw = isinstance(documents.schema["body"].dataType, T.BinaryType)
    bytes_ = F.col("body")
    documents = documents.select(
        "url",
        "status_code",
        (encodings.foreign_encoding(bytes_, raw) if raw or not decode else F.lit(None).cast("string")).alias("encoding"),
        encodings.foreign_version(bytes_).alias("version"),
        (encodings.valid_text(bytes_) if raw else F.lit(True)).alias("valid"),
        "body",
    )
    if decode and raw:
        # Bytes in another encoding: null text if they cannot be read.
        text = encodings.decoded(F.col("body"), F.col("encoding"))
        documents = documents.withColumn("body", text).withColumn(
            "valid", F.col("valid") | F.col("encoding").isNotNull()
        ).withColumn("encoding", F.when(F.col("body").isNull(), F.col("encoding")))
    body = F.col("body").cast("string")
    unread = F.when(
        F.col("encoding").isNotNull(), F.concat(F.lit('encoding "'), "encoding", F.lit('" is not read'))
    ).when(F.col("version").isNotNull(), F.concat(F.lit('version "'), "version", F.lit('" is not read')))
    read = (
        documents.withColumn("unread", unread)
        .withColumn("ok", body_accepted(status, F.when(F.col("unread").isNull(), body).otherwise("unread")))
        .withColumn("root", F.when(F.col("ok") & F.col("unread").isNull(), sitemaps.root_name(body)))
        .withColumn("kind", sitemaps.sitemap_kind(F.col("root")))
        # robots files and error pages are not worth an XML parse
        .withColumn("record", F.when((F.col("kind") != sitemaps.UNKNOWN) & F.col("valid"), sitemaps.xml_record(body)))
    )
    reason = (
        F.when(F.col("unread").isNotNull(), F.concat(F.lit("detecting sitemap type: "), "unread"))
        .when(F.col("root") == "", "detecting sitemap type: no root element")
        .when(
            F.col("kind") == sitemaps.UNKNOWN,
            F.concat(F.lit("detecting sitemap type: unexpected root element <"), "root", F.lit(">")),
        )
        .when(
            ~F.col("valid") | F.col("record._bad").isNotNull(),
            F.concat(
                F.lit("parsing "),
                F.when(F.col("kind") == sitemaps.INDEX, "siteindex").otherwise("urlset"),
                F.lit(" xml: "),
                F.when(F.col("valid"), "malformed document").otherwise("invalid UTF-8"),
            ),
        )
    )
    error = F.when(~F.col("ok"), messages.fetch_refused(url, status)).when(
        reason.isNotNull(), messages.parse_failed(url, reason)
    )
    return read.withColumn("error", error).select(
        url.alias("sitemap_url"),
        F.when(F.col("error").isNull(), F.col("kind")).alias("kind"),
        F.when(F.col("error").isNull(), sitemaps.entries(F.col("record"), F.col("kind"))).alias("entries"),
        "error",
    )


def sitemap_entries(parsed: DataFrame) -> DataFrame:
    """One row per entry of every readable sitemap, with its optional fields."""
    return parsed.select("sitemap_url", "kind", F.inline("entries"))


def _places() -> Column:
    """Position and address of each entry; the scan reads no other field."""
    return F.arrays_zip(F.col("entries.pos"), F.col("entries.loc"))


def _largest(parsed: DataFrame) -> tuple[int, int]:
    """The most entries that a document lists, and the largest position of one."""
    found = parsed.where(F.col("kind").isNotNull()).agg(
        F.max(F.size("entries")).alias("n"), F.max(F.array_max("entries.pos")).alias("pos")
    ).first()
    return found["n"] or 0, found["pos"] or 0


class Visits(NamedTuple):
    """Sitemaps reached from the roots, one row for all visits of a crawl to a sitemap at
    one depth: how many there are, and the place of the first."""

    rows: DataFrame  # crawl_id, sitemap_url, depth, times, place
    count: int
    too_deep: DataFrame  # the same columns: one level past the deepest allowed
    places: type  # how places are written
    longest: int  # the most entries that a sitemap lists


def visits(roots: DataFrame, parsed: DataFrame, max_depth: int = MAX_DEPTH) -> Visits:
    """Every sitemap reached from the roots.

    Sitemaps already visited are visited again, so a loop ends by depth. Visits are not
    listed but counted: those of a level that share crawl and sitemap go on alike, as
    often as they are, and of their places only the first can be the first of anything
    below them. So a sitemap has at most one row for each depth, whatever loops.
    """
    longest, position = _largest(parsed)
    roots, _ = pinned_counted(roots)
    position = max(position, roots.agg(F.max(F.col("path")[0])).first()[0] or 0)
    walk = places(position, max_depth + 2)
    entries = parsed.where(F.col("kind") == sitemaps.INDEX).select("sitemap_url", F.inline(_places()))
    # An index may list the same sitemap often.
    listed = entries.groupBy("sitemap_url", "loc").agg(F.count(F.lit(1)).alias("often"), F.min("pos").alias("pos"))
    children = written(
        listed.groupBy("sitemap_url").agg(F.collect_list(F.struct("loc", "often", "pos")).alias("children")), "children"
    )
    fan_out = children.agg(F.max(F.size("children"))).first()[0] or 0

    def merged(rows: DataFrame, depth: int) -> DataFrame:
        return rows.groupBy("crawl_id", "sitemap_url").agg(
            F.sum("times").cast(_TIMES).alias("times"), F.min("place").alias("place")
        ).withColumn("depth", F.lit(depth))

    start = walk.start(F.col("path")[0]).alias("place")
    below = merged(roots.select("crawl_id", "sitemap_url", F.lit(1).cast(_TIMES).alias("times"), start), 0)
    levels, total = [], 0
    for depth in range(max_depth + 1):
        level, size = pinned_counted(below)
        if size or not levels:
            levels.append(level)
        total += size
        below = merged(
            lookup(
                level, children, "sitemap_url", ["crawl_id"], "inner", rows=size, per_task=rows_per_task(fan_out)
            )
            .select("crawl_id", F.col("times").alias("_times"), F.col("place").alias("_place"), F.inline("children"))
            .select(
                "crawl_id",
                F.col("loc").alias("sitemap_url"),
                (F.col("_times") * F.col("often").cast("decimal(20,0)")).cast(_TIMES).alias("times"),
                walk.below(F.col("_place"), F.lit(depth + 1), F.col("pos")).alias("place"),
            ),
            depth + 1,
        )
        if not size:
            break
    return Visits(reduce(DataFrame.unionByName, levels), total, below, walk, longest)


def visit_outcomes(visited: Visits, parsed: DataFrame) -> DataFrame:
    """``crawl_id, sitemap_url, depth, times, kind, error``; kind or error is set."""
    url = F.col("sitemap_url")
    known = parsed.select("sitemap_url", "kind", "error")
    reached = visited.rows.join(known, "sitemap_url", "left").withColumn(
        "error",
        F.when(F.col("error").isNotNull(), F.col("error")).when(
            F.col("kind").isNull(), messages.fetch_refused(url, F.lit(None).cast("int"))
        ),
    )
    no_kind = F.lit(None).cast("string")
    stopped = visited.too_deep.withColumn("kind", no_kind).withColumn("error", messages.too_deep(url))
    columns = ["crawl_id", "sitemap_url", "depth", "times", "kind", "error"]
    return reached.select(*columns).unionByName(stopped.select(*columns))


def repeated(rows: DataFrame, times: str = "times", part: int = 10_000) -> DataFrame:
    """Each row as often as its column ``times`` says, without that column.

    In two steps, so that no row makes a longer array than ``part``.
    """
    whole = F.floor((F.col(times) - 1) / part).cast("long")
    split = rows.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), whole)))
    rest = F.least(F.lit(part).cast(_TIMES), F.col(times) - F.col("_part") * part).cast("int")
    return split.withColumn("_copy", F.explode(F.sequence(F.lit(1), rest))).drop("_part", "_copy", times)


def listed_urls(visited: Visits, parsed: DataFrame) -> DataFrame:
    """Each page URL of a crawl once, with the path it is first reached by."""
    pages = parsed.where(F.col("kind") == sitemaps.URLSET).select(
        "sitemap_url", _places().alias("listed")
    )
    split = {"rows": visited.count, "per_task": rows_per_task(visited.longest)}
    every = (
        lookup(visited.rows, pages, "sitemap_url", ["crawl_id", "depth"], "inner", **split)
        .select("crawl_id", "place", "depth", F.inline("listed"))
        .select(
            "crawl_id",
            F.col("loc").alias("url"),
            visited.places.below(F.col("place"), F.col("depth") + 1, F.col("pos")).alias("place"),
        )
    )
    first = first_per_key(every, ["crawl_id", "url"], "place")
    return first.select("crawl_id", "url", visited.places.path(F.col("place")).alias("path"))


def discovery_stats(sites: DataFrame, outcomes: DataFrame, urls: DataFrame) -> DataFrame:
    """``crawl_id, urls_found, sitemaps_found, errors`` for every site.

    Counts of visits past the largest 64-bit number stay there.
    """
    none, one = F.lit(0).cast(_TIMES), F.lit(1).cast(_TIMES)

    def counted(rows: DataFrame, url, sitemap, error) -> DataFrame:
        return rows.select(
            "crawl_id", url.alias("urls_found"), sitemap.alias("sitemaps_found"), error.alias("errors")
        )

    found, failed = (F.when(F.col(c).isNotNull(), F.col("times")).otherwise(none) for c in ("kind", "error"))
    parts = [
        counted(sites, none, none, none),
        counted(urls, one, none, none),
        counted(outcomes, none, found, failed),
    ]
    most = F.lit(Decimal(2**63 - 1)).cast(_TIMES)
    return reduce(DataFrame.unionByName, parts).groupBy("crawl_id").agg(
        *[F.least(F.sum(c), most).cast("long").alias(c) for c in ("urls_found", "sitemaps_found", "errors")]
    )


def discover(
    sites: DataFrame, documents: DataFrame, max_depth: int = MAX_DEPTH, decode: bool = False
) -> Discovery:
    """Expand the sitemaps of all ``sites (crawl_id, website)`` at once.

    ``documents`` may hold an address more than once if it has ``capture_id``. Bodies
    and ``decode`` are as in ``parse_sitemaps``.
    """
    documents = first_documents(documents)
    # by kind, so that following an index does not read the URL lists
    parsed = written(parse_sitemaps(documents, decode), "sitemaps", partition_by="kind")
    visited = visits(sitemap_roots(sites, documents), parsed, max_depth)
    outcomes = visit_outcomes(visited, parsed)
    urls = listed_urls(visited, parsed)
    failed = outcomes.where(F.col("error").isNotNull()).select("crawl_id", "sitemap_url", "depth", "error", "times")
    return Discovery(urls, repeated(failed), discovery_stats(sites, outcomes, urls), failed)
