"""The whole job: from seeds to finished crawls and their pages."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spinneret.functions.urls import checked_website
from spinneret.operators.changes import finalise
from spinneret.operators.crawl_plan import MAX_PAGES, crawl_plan
from spinneret.operators.discovery import MAX_DEPTH, Discovery, discover
from spinneret.operators.redirects import MAX_REDIRECTS, resolve_redirects
from spinneret.operators.results import fetch_outcomes, page_results, page_rows, stored_results
from spinneret.operators.rollup import failed_rollup, rollup_of
from spinneret.operators.seeds import accepted_seeds, new_crawls
from spinneret.schemas import PAGE_COLUMNS
from spinneret.session import prepare, written, written_counted
from spinneret.sources.captures import CaptureStore


class CrawlRun(NamedTuple):
    crawls: DataFrame  # the new crawls, finished
    pages: DataFrame  # rows for the pages table
    discovery: Discovery


def totals_of(crawls: DataFrame, results: DataFrame) -> DataFrame:
    """Rollup of every crawl; one whose website cannot be parsed has failed."""
    broken = checked_website(F.col("website"))["reject_reason"].isNotNull()
    return rollup_of(crawls.where(~broken), results).unionByName(failed_rollup(crawls.where(broken)))


def run_crawls(
    seeds: DataFrame,
    crawls: DataFrame,
    documents: DataFrame,
    captures: DataFrame | CaptureStore,
    hops: DataFrame,
    max_pages: int = MAX_PAGES,
    max_depth: int = MAX_DEPTH,
    max_redirects: int = MAX_REDIRECTS,
    now: Column | None = None,
    decode: bool = False,
) -> CrawlRun:
    """Start a crawl for every new website and compute what it finds.

    ``captures`` may be a store of captures by URL: their bodies are then joined where
    they lie. ``now`` is one point in time for all rows. New crawls and the plan, with its
    redirects followed, are written to the shared folder, since several later steps
    read them. With ``decode``, sitemaps kept as bytes are read in the encoding they declare.
    """
    prepare(seeds.sparkSession)
    started = written(new_crawls(accepted_seeds(seeds), crawls, now), "crawls")
    sites = started.select(F.col("id").alias("crawl_id"), "website")
    found = discover(sites, documents, max_depth, decode)
    plan = written(crawl_plan(sites, found.urls, max_pages), "plan")
    resolved = resolve_redirects(plan, hops, max_redirects, only_reached=True)
    targets, size = written_counted(resolved.drop("requests"), "targets")
    if isinstance(captures, CaptureStore):
        responses = captures.read()
        results = stored_results(targets, responses)
    else:
        responses = captures
        results = page_results(targets, captures, rows=size)
    outcomes = fetch_outcomes(targets, responses)
    return CrawlRun(
        crawls=finalise(started, totals_of(started, outcomes), now),
        pages=page_rows(results, now).select(*PAGE_COLUMNS),
        discovery=found,
    )
