"""From a crawl plan and captured responses to page rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spinneret.functions.measures import byte_length, whole_millis
from spinneret.functions.messages import NOT_CAPTURED, request_failed
from spinneret.functions.predicates import counts_as_success, is_html
from spinneret.functions.titles import html_title, plain_title
from spinneret.operators.joins import BODIES_PER_SALT, MAX_BROADCAST_ROWS, hot_keys, lookup
from spinneret.operators.ordering import first_per_key
from spinneret.operators.redirects import MAX_REDIRECTS, resolve_redirects
from spinneret.schemas import PAGE_COLUMNS
from spinneret.session import pinned_counted

# Page ids are crawl_id * 2^32 + position: unique, and rising within a crawl,
# without numbering the table.
ID_SHIFT = 32
# Larger ids have no room beside a position.
MAX_CRAWL_ID = (1 << (63 - ID_SHIFT)) - 1

_RESPONSE = ("status_code", "content_type", "body", "response_time_us")


def _with_targets(plan: DataFrame) -> DataFrame:
    """The plan with ``final_url`` and ``redirect_error``, if it has none yet."""
    if "final_url" in plan.columns:
        return plan
    return plan.withColumn("final_url", F.col("url")).withColumn("redirect_error", F.lit(None).cast("string"))


def _result_error(fetch_error: Column) -> Column:
    """Why a result failed, or null: redirects, then the fetch, then no capture."""
    return (
        F.when(F.col("redirect_error").isNotNull(), request_failed(F.col("redirect_error")))
        .when(fetch_error.isNotNull(), fetch_error)
        .when(F.col("status_code").isNull(), NOT_CAPTURED)
    )


def page_results(plan: DataFrame, captures: DataFrame, rows: int | None = None) -> DataFrame:
    """Exactly one result per planned URL, from its first capture.

    ``plan`` has ``crawl_id, position, url``, and may have ``final_url`` and
    ``redirect_error`` from ``resolve_redirects``; the capture is then that of the
    final URL. A URL without a capture becomes a failed result. ``rows`` is the
    size of the plan where that is known. Give a stored plan: it is read for its hot
    URLs as well.

    The first capture of each URL is found on two narrow columns. Bodies then
    move once, joined on the capture's id, so copies of a URL do not pile up.
    """
    plan = _with_targets(plan)
    first = first_per_key(captures.select("url", "capture_id"), ["url"], "capture_id")
    first = first.withColumnRenamed("url", "final_url")
    spread = ["crawl_id", "url"]
    # Bodies are heavy, so a URL is hot from far fewer rows on than a narrow key.
    hot_urls = hot_keys(plan, "final_url", BODIES_PER_SALT)
    split = {"rows": rows, "per_task": BODIES_PER_SALT}
    placed = lookup(plan, first, "final_url", spread, hot=hot_urls, **split)
    hot_captures = first.join(hot_urls, "final_url").select("capture_id", "_parts")
    bodies = captures.select("capture_id", *_RESPONSE, F.col("error").alias("_fetch_error"))
    # Hash the narrow plan side, so that bodies stream by without a sort.
    return _as_results(lookup(placed, bodies, "capture_id", spread, hot=hot_captures, strategy="shuffle_hash", **split))


def stored_results(plan: DataFrame, captures: DataFrame) -> DataFrame:
    """``page_results`` from captures that are laid out by URL and hold each URL once.

    The plan is hashed as the captures are laid out, so their bodies are joined where
    they lie. URLs that very many planned rows end at take the salted join, with only
    the few bodies of these; rows without a final URL are not joined at all.
    """
    plan = _with_targets(plan)
    bodies = captures.select(F.col("url").alias("final_url"), *_RESPONSE, F.col("error").alias("_fetch_error"))
    hot, some = pinned_counted(hot_keys(plan, "final_url", BODIES_PER_SALT))
    ends = plan.where(F.col("final_url").isNotNull())
    hot_urls = F.broadcast(hot.select("final_url")) if some <= MAX_BROADCAST_ROWS else hot.select("final_url")
    cold = ends.join(hot_urls, "final_url", "left_anti") if some else ends
    # Hash the narrow plan side, so that bodies stream by without a sort.
    joined = cold.hint("shuffle_hash").join(bodies, "final_url", "left")
    if some:
        few = bodies.join(hot_urls, "final_url", "left_semi")
        busy = ends.join(hot_urls, "final_url", "left_semi")
        split = {"hot": hot, "per_task": BODIES_PER_SALT, "strategy": "shuffle_hash"}
        joined = joined.unionByName(lookup(busy, few, "final_url", ["crawl_id", "url"], **split))
    lost = plan.where(F.col("final_url").isNull())
    return _as_results(joined.unionByName(lost, allowMissingColumns=True))


def _as_results(joined: DataFrame) -> DataFrame:
    return joined.withColumn("error", _result_error(F.col("_fetch_error"))).select(
        "crawl_id",
        "position",
        "url",
        "final_url",
        *[F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in _RESPONSE],
        "error",
    )


def fetch_outcomes(plan: DataFrame, captures: DataFrame) -> DataFrame:
    """``crawl_id, position, url, status_code, error`` of ``page_results``.

    All that the counters need. Without bodies, status and error travel with the
    first capture of each URL, and one narrow join does.
    """
    first = captures.groupBy(F.col("url").alias("final_url")).agg(
        F.min(F.struct("capture_id", "status_code", "error")).alias("_first")
    )
    joined = (
        _with_targets(plan)
        .join(first, "final_url", "left")
        .withColumn("status_code", F.when(F.col("redirect_error").isNull(), F.col("_first.status_code")))
    )
    return joined.withColumn("error", _result_error(F.col("_first.error"))).select(
        "crawl_id",
        "position",
        "url",
        F.when(F.col("error").isNull(), F.col("status_code")).alias("status_code"),
        "error",
    )


def page_rows(results: DataFrame, now: Column | None = None) -> DataFrame:
    """Rows of the pages table, with ``position`` beside them.

    A failed fetch has an error and nothing else. Title and html are set only
    for HTML responses, whatever their status. A crawl whose id leaves no room for page
    ids is an error.
    """
    now = F.current_timestamp() if now is None else now
    fetched = F.col("error").isNull()
    body = F.col("body")
    # The body goes on only as html, so that it is carried once past the title parser.
    crawl = F.col("crawl_id")
    fits = F.coalesce(crawl.between(-MAX_CRAWL_ID - 1, MAX_CRAWL_ID), F.lit(True))
    too_large = F.raise_error(F.concat(F.lit("no page ids for crawl "), crawl.cast("string"))).cast("long")
    rows = results.select(
        F.when(fits, F.shiftleft(crawl, ID_SHIFT) + F.col("position")).otherwise(too_large).alias("id"),
        "crawl_id",
        "position",
        "url",
        F.when(fetched, F.col("status_code")).alias("status_code"),
        F.when(fetched, F.coalesce("content_type", F.lit(""))).alias("content_type"),
        F.when(fetched, F.coalesce(byte_length(body), F.lit(0))).alias("content_length"),
        F.when(fetched, whole_millis(F.col("response_time_us"))).alias("response_time_ms"),
        F.when(fetched & is_html(F.col("content_type")), F.coalesce(body, F.lit(""))).alias("html"),
        "error",
        now.cast("timestamp").alias("created_at"),
    )
    titled = rows.withColumn("_plain", plain_title(F.col("html"))).withColumn(
        "title", html_title(F.col("html"), F.col("_plain"))
    )
    return titled.select("position", *PAGE_COLUMNS)


def crawl_pages(
    plan: DataFrame,
    captures: DataFrame,
    hops: DataFrame | None = None,
    max_redirects: int = MAX_REDIRECTS,
    now: Column | None = None,
) -> DataFrame:
    """Pages table rows for a plan: redirects followed, captures joined."""
    if hops is not None:
        plan = resolve_redirects(plan, hops, max_redirects).drop("requests")
    return page_rows(page_results(plan, captures), now).select(*PAGE_COLUMNS)


def with_success(results: DataFrame) -> DataFrame:
    """Add ``is_success``, the rule of the crawl counters."""
    return results.withColumn("is_success", counts_as_success(F.col("status_code"), F.col("error")))


def process_pages(
    jobs: DataFrame, handler: Callable[[pd.DataFrame], pd.DataFrame], schema: StructType | str
) -> DataFrame:
    """Run a handler of your own over batches of jobs: one result row per job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = handler(batch)
            if len(done) != len(batch):
                raise ValueError(f"handler returned {len(done)} results for {len(batch)} jobs")
            yield done

    return jobs.mapInPandas(run, schema)
