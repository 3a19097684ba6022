"""The registered queries: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spinneret.functions import predicates
from spinneret.operators import audit as audits
from spinneret.operators import changes, listing
from spinneret.operators.crawl_plan import MAX_PAGES
from spinneret.operators.crawl_plan import crawl_plan as plan_crawls
from spinneret.operators.discovery import Discovery, discover, parse_sitemaps
from spinneret.operators.discovery import sitemap_entries as entries_of
from spinneret.operators.discovery import sitemap_roots as roots_of
from spinneret.operators.ordering import numbered
from spinneret.operators.redirects import resolve_redirects
from spinneret.operators.report import run_report, truncated
from spinneret.operators.results import fetch_outcomes, page_results, process_pages, stored_results, with_success
from spinneret.operators.results import page_rows as rows_of
from spinneret.operators.rollup import rollup
from spinneret.operators.seeds import accepted_seeds, check_seeds, new_crawls, rejected_seeds, reused_crawls
from spinneret.plans.crawl import CrawlRun, run_crawls, totals_of
from spinneret.schemas import SEEDS
from spinneret.session import fresh_path, written
from spinneret.sources import export, store, tables
from spinneret.sources.captures import CaptureStore
from spinneret.sources.page_table import PageTable
from spinneret.sources.tables import read_pages
from spinneret.streaming.counters import count_pages_live, latest_counters
from spinneret.streaming.ingest import ingest_into, ingest_pages
from spinneret.workload import inputs

URL_CAP = 12
_NARROW = ("crawl_id", "position", "url", "status_code", "error")


# results and counters


def crawl_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = fetch_outcomes(inputs.plan(spark, sf_dir), inputs.captures(spark, sf_dir))
    return rollup(outcomes)


def captured_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = page_results(inputs.plan(spark, sf_dir), inputs.repeated_captures(spark, sf_dir))
    return joined.select(*_NARROW)


def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_of(inputs.results(spark, sf_dir), inputs.now())


def page_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, error = F.col("status_code"), F.col("error")
    return with_success(inputs.results(spark, sf_dir)).select(
        "crawl_id",
        "position",
        predicates.fetch_succeeded(status, error).cast("int").alias("fetched"),
        predicates.page_succeeded(status).cast("int").alias("page_ok"),
        F.col("is_success").cast("int").alias("counted_ok"),
    )


def failed_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw seeds as crawls, unchecked: those that cannot be parsed have failed."""
    seeds = inputs.seeds(spark, sf_dir)
    asked = seeds.select((F.col("seed_id") + 1).alias("id"), F.col("website_raw").alias("website"))
    found = inputs.captures(spark, sf_dir).withColumn("crawl_id", F.col("capture_id") + 1)
    return totals_of(asked, found)


def redirect_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    hops = inputs.hops(spark, sf_dir)
    return resolve_redirects(hops.select("url"), hops)


def udf_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A handler of one's own: count the links of each captured page."""

    def count_links(batch: pd.DataFrame) -> pd.DataFrame:
        links = batch["body"].str.count("<a href=").astype("int64")
        return batch[["crawl_id", "url"]].assign(links=links)

    jobs = inputs.results(spark, sf_dir).select("crawl_id", "url", "body")
    return process_pages(jobs, count_links, "crawl_id long, url string, links long")


# seeds


def seed_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check_seeds(inputs.seeds(spark, sf_dir)).select("seed_id", "website", "reject_reason")


def seed_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejected_seeds(inputs.seeds(spark, sf_dir))


def seed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawls that answer the seeds: those in flight, and new ones."""
    accepted = accepted_seeds(inputs.site_seeds(spark, sf_dir))
    crawls = inputs.crawls(spark, sf_dir)
    running = reused_crawls(accepted, crawls).withColumn("origin", F.lit("in flight"))
    started = new_crawls(accepted, crawls, inputs.now()).withColumn("origin", F.lit("new"))
    return running.unionByName(started).select("id", "website", "status", "started_at", "origin")


# discovery


def sitemap_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = roots_of(inputs.sites(spark, sf_dir), inputs.documents(spark, sf_dir))
    return roots.select("crawl_id", "sitemap_url", F.col("path")[0].alias("root"))


def sitemap_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = entries_of(parse_sitemaps(inputs.documents(spark, sf_dir)))
    return entries.select("sitemap_url", "kind", "pos", "loc")


def sitemap_charsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sitemaps in several encodings: read as UTF-8 only, and decoded as they declare."""
    documents = inputs.charset_documents(spark, sf_dir)

    def read(decode: bool, how: str) -> DataFrame:
        return parse_sitemaps(documents, decode).select(
            "sitemap_url", F.lit(how).alias("how"), "kind", F.explode_outer("entries.loc").alias("loc"), "error"
        )

    return read(False, "as it is").unionByName(read(True, "decoded"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(inputs.documents(spark, sf_dir), "documents")


def _discovered(spark: SparkSession, sf_dir: str) -> Discovery:
    return discover(inputs.sites(spark, sf_dir), _documents(spark, sf_dir))


def sitemap_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _discovered(spark, sf_dir).urls.select("crawl_id", "url", F.concat_ws(".", "path").alias("path"))


def sitemap_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _discovered(spark, sf_dir).errors


def discovery_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _discovered(spark, sf_dir).stats


def crawl_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_crawls(inputs.sites(spark, sf_dir), _discovered(spark, sf_dir).urls, URL_CAP)


def crawl_plan_uncapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_crawls(inputs.sites(spark, sf_dir), _discovered(spark, sf_dir).urls, 0)


def crawl_plan_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crawls that the cap cuts, and by how many URLs."""
    return truncated(_discovered(spark, sf_dir).stats, URL_CAP)


def _files(df: DataFrame, label: str, fmt: str = "parquet") -> str:
    path = fresh_path(df.sparkSession, label)
    df.write.format(fmt).save(path)
    return path


def _run(spark: SparkSession, sf_dir: str, stored: bool, max_pages: int = MAX_PAGES) -> CrawlRun:
    """The whole job over files that the typed readers read.

    Crawls in flight, redirect chains, relative locations and loops included.
    """
    sites = inputs.sites(spark, sf_dir)
    seeds = sites.select(F.col("crawl_id").alias("seed_id"), F.col("website").alias("website_raw"))
    captures = tables.read_captures(spark, _files(inputs.captures(spark, sf_dir), "captures"))
    if stored:
        kept = CaptureStore(spark, fresh_path(spark, "capture-store"), 8)
        kept.append(captures)
        captures = kept
    return run_crawls(
        tables.read_seeds(spark, _files(seeds, "seeds", "json"), "json"),
        tables.read_crawls(spark, _files(inputs.crawls(spark, sf_dir), "crawls")),
        tables.read_documents(spark, _files(inputs.documents(spark, sf_dir), "documents"), repeated=False),
        captures,
        tables.read_hops(spark, _files(inputs.run_hops(spark, sf_dir), "hops")),
        max_pages,
        now=inputs.now(),
    )


def crawl_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The new crawls of the whole job, finished."""
    return _run(spark, sf_dir, stored=False).crawls


def crawl_run_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of the whole job, stored and read back, with digests of their bodies."""
    rows = _page_table(spark, written(_run(spark, sf_dir, stored=True).pages, "run-pages")).read()
    return rows.select(
        "id", "crawl_id", "url", "status_code", "content_type", "title", F.md5("html").alias("html_md5"), "error"
    )


def crawl_run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job under a small cap, its pages stored in two batches, the second with
    the first's again, and what came of each crawl."""
    run = _run(spark, sf_dir, stored=True, max_pages=URL_CAP)
    rows = written(run.pages, "run-pages")
    table = _page_table(spark, rows.where(F.col("id") % 3 == 0))
    table.insert_new(rows)
    return run_report(run.crawls, run.discovery.stats, table.read(), URL_CAP)


def stored_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page rows from captures that are stored by URL, in two batches; digests of bodies."""
    captures = written(inputs.repeated_captures(spark, sf_dir), "captures")
    kept = CaptureStore(spark, fresh_path(spark, "capture-store"), 8)
    page = F.floor(F.col("capture_id") / 2)
    for turn in (0, 1):  # of every third URL the later capture is sent again
        again = (page % 3 == 0) & (F.col("capture_id") % 2 == 1)
        kept.append(captures.where((page % 2 == turn) | (again if turn else F.lit(False))))
    rows = rows_of(stored_results(inputs.plan(spark, sf_dir), kept.read()), inputs.now())
    return rows.select(
        "id", "crawl_id", "position", "url", "status_code", "content_type", "content_length", "title",
        F.md5("html").alias("html_md5"), "error",
    )


def seed_file_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a JSON file of seeds holds besides seeds."""
    path = _files(inputs.seed_lines(spark, sf_dir), "seed-lines", "text")
    return tables.read_checked(spark, path, SEEDS, "json").rejects


def seed_file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seeds that the file holds."""
    path = _files(inputs.seed_lines(spark, sf_dir), "seed-lines", "text")
    return tables.read_checked(spark, path, SEEDS, "json").rows


def _requested_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth crawl, and as many ids that no crawl has."""
    chosen = inputs.crawls(spark, sf_dir).where(F.col("id") % 5 == 0)
    return chosen.select(F.explode(F.array(F.col("id"), -F.col("id"))).alias("id"))


# lookups and listings


def crawl_terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    ended = predicates.is_terminal(F.col("status")).cast("int")
    return inputs.crawls(spark, sf_dir).select("id", "status", ended.alias("terminal"))


def crawls_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.crawls_by_status(inputs.crawls(spark, sf_dir), "completed")


def recent_crawls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.recent_crawls(inputs.crawls(spark, sf_dir), 5)


def crawl_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.crawl_by_id(inputs.crawls(spark, sf_dir), 3)


def page_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.page_by_id(inputs.stored_pages(spark, sf_dir), (2 << 32) + 17)


def list_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.list_pages(inputs.stored_pages(spark, sf_dir), 1, limit=5, offset=1)


def list_pages_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.list_pages_all(inputs.stored_pages(spark, sf_dir), limit=5, offset=2)


def listing_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked for every crawl, when some are deleted and pending ones have no pages."""
    crawls = inputs.crawls(spark, sf_dir)
    requests = crawls.select(F.col("id").alias("crawl_id"))
    left = changes.delete_crawls(crawls, _requested_ids(spark, sf_dir))
    pending = listing.crawls_by_status(crawls, "pending")
    crawled = changes.delete_pages_of(inputs.results(spark, sf_dir), pending.select("id"))
    totals = listing.listing_totals(requests, left, crawled)
    return totals.withColumn("crawl_found", F.col("crawl_found").cast("int"))


def page_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's place in its crawl, however large the crawl is."""
    return numbered(inputs.plan(spark, sf_dir).select("crawl_id", "url"), ["url"], ["crawl_id"], "place")


# changes


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page twice; the first of the two has the lower order."""
    status = F.when(F.col("copy") == 1, 503).otherwise(F.col("status_code"))
    return (
        inputs.results(spark, sf_dir)
        .withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
        .withColumn("seq", F.col("crawl_id") * 10_000 + F.col("position") * 2 + F.col("copy"))
        .select("crawl_id", "url", "seq", status.alias("status_code"))
    )


def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing = inputs.plan(spark, sf_dir).where(F.col("position") % 3 == 0)
    return changes.insert_ignore(_batch(spark, sf_dir), existing, "seq")


def finalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crawls that run are done: their totals are written in."""
    crawls = inputs.crawls(spark, sf_dir)
    running = listing.crawls_by_status(crawls, "running").select(F.col("id").alias("crawl_id"))
    totals = rollup(inputs.results(spark, sf_dir)).join(running, "crawl_id", "left_semi")
    return changes.finalise(crawls, totals, inputs.now())


def status_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    crawls = inputs.crawls(spark, sf_dir)
    requests = _requested_ids(spark, sf_dir).withColumn("status", F.lit("running"))
    unknown = changes.not_found(requests, crawls).withColumn("status", F.lit("not found"))
    return changes.set_status(crawls, requests).select("id", "status").unionByName(unknown)


def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left after a delete: crawls, their page counts, and unknown ids."""
    ids, crawls = _requested_ids(spark, sf_dir), inputs.crawls(spark, sf_dir)
    left_crawls = changes.delete_crawls(crawls, ids).select("id", F.lit("crawl").alias("what"), F.lit(1).alias("n"))
    left_pages = (
        changes.delete_pages_of(inputs.results(spark, sf_dir), ids)
        .groupBy(F.col("crawl_id").alias("id"))
        .agg(F.count("*").cast("int").alias("n"))
        .select("id", F.lit("pages").alias("what"), "n")
    )
    unknown = changes.not_found(ids, crawls).select("id", F.lit("not found").alias("what"), F.lit(0).alias("n"))
    return left_crawls.unionByName(left_pages).unionByName(unknown)


# the pages table on disk

_STORED = ("id", "crawl_id", "url", "status_code", "title")


def _page_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(inputs.stored_pages(spark, sf_dir), "batch")


def stored_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third page appended as a batch, then all inserted, twice."""
    path, batch = fresh_path(spark, "pages"), _page_batch(spark, sf_dir)
    store.append_batch(batch.where(F.col("id") % 3 == 0), path)
    for _ in range(2):
        store.insert_new(batch.withColumn("title", F.lit("late")), path)
    return read_pages(spark, path).select(*_STORED)


def stored_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the table holds after crawls were deleted from it."""
    path = fresh_path(spark, "pages")
    store.insert_new(_page_batch(spark, sf_dir), path)
    store.delete_stored_pages(spark, path, _requested_ids(spark, sf_dir))
    return read_pages(spark, path).select(*_STORED)


def _page_table(spark: SparkSession, rows: DataFrame) -> PageTable:
    table = PageTable(spark, fresh_path(spark, "page-table"))
    table.insert_new(rows)
    return table


def table_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawls deleted from a table, then folded in, then every page sent again."""
    batch = _page_batch(spark, sf_dir)
    table = _page_table(spark, batch.where(F.col("id") % 3 == 0))
    table.delete(_requested_ids(spark, sf_dir))
    table.insert_new(batch.withColumn("title", F.lit("late")))
    table.compact()
    return table.read().select(*_STORED)


def table_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page and its crawl's neighbours looked up in the stored table, bodies included."""
    page = (2 << 32) + 17
    rows = _page_table(spark, _page_batch(spark, sf_dir)).read()
    return listing.page_by_id(rows, page).select(*_STORED, F.length("html").alias("html_length"))


def table_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of a crawl's listing, with bodies, from the last id of the first."""
    table = _page_table(spark, _page_batch(spark, sf_dir))
    first = table.list_after(1, limit=5)
    second = table.list_after(1, first.agg(F.max("id")).first()[0], limit=7, with_html=True)
    return second.select(*_STORED, F.md5("html").alias("html_md5"))


# audits


def bulk_append_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that would make an append of the batch fail."""
    stored = inputs.plan(spark, sf_dir).where(F.col("position") % 3 == 0).select("crawl_id", "url")
    repeated = inputs.plan(spark, sf_dir).where(F.col("position") % 2 == 0).select("crawl_id", "url")
    return audits.duplicate_pages(stored.unionByName(repeated))


def pages_with_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = changes.delete_crawls(inputs.crawls(spark, sf_dir), _requested_ids(spark, sf_dir))
    return audits.pages_with_crawl(inputs.plan(spark, sf_dir), known)


def constraint_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables with known faults: repeated pages, a page of no crawl, a page
    without URL, and a crawl with a status of its own."""
    pages = inputs.stored_pages(spark, sf_dir)
    place = F.col("id") % (1 << 32)
    again = pages.where(F.col("crawl_id") == 1)
    lost = pages.where(place == 0).withColumn("id", -F.col("crawl_id")).withColumn(
        "crawl_id", F.lit(inputs.NOT_A_CRAWL).cast("long")
    )
    nameless = pages.where(place == 1).withColumn("id", -F.col("id")).withColumn("url", F.lit(None).cast("string"))
    crawls = inputs.crawls(spark, sf_dir)
    last = crawls.where(F.col("id") % inputs.SITES == 0)
    paused = last.withColumn("id", -F.col("id")).withColumn("status", F.lit("paused"))
    return audits.audit(
        crawls.unionByName(paused), pages.unionByName(again).unionByName(lost).unionByName(nameless)
    )


# export


def page_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.page_json(inputs.stored_pages(spark, sf_dir))


def page_json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON read back: its keys in order, and some of its values."""
    text = F.col("json")
    return export.page_json(inputs.stored_pages(spark, sf_dir)).select(
        "id",
        F.array_join(F.json_object_keys(text), ",").alias("keys"),
        F.get_json_object(text, "$.title").alias("title"),
        F.get_json_object(text, "$.html").alias("html"),
        F.get_json_object(text, "$.error").alias("error"),
        F.get_json_object(text, "$.status_code").cast("int").alias("status_code"),
    )


def crawl_json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("json")
    return export.crawl_json(inputs.crawls(spark, sf_dir)).select(
        "id",
        F.array_join(F.json_object_keys(text), ",").alias("keys"),
        F.get_json_object(text, "$.status").alias("status"),
        F.get_json_object(text, "$.total_pages").cast("int").alias("total_pages"),
    )


# streams


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "stream-pages")
    stream = inputs.event_stream(spark, sf_dir)
    ingest_pages(stream, path, fresh_path(spark, "stream-pages-state")).awaitTermination()
    return read_pages(spark, path).select("id", "crawl_id", "url", "status_code", "response_time_ms", "error")


def stream_into_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results streamed file by file into a table that holds some already."""
    table = _page_table(spark, written(inputs.early_events(spark, sf_dir), "early"))
    stream = inputs.arriving_events(spark, sf_dir)
    ingest_into(stream, table, fresh_path(spark, "arrivals-state")).awaitTermination()
    return table.read().select("id", "crawl_id", "url", "status_code", "response_time_ms", "error")


def stream_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "stream-counters")
    stream = inputs.event_stream(spark, sf_dir)
    count_pages_live(stream, path, fresh_path(spark, "stream-counters-state")).awaitTermination()
    return latest_counters(spark, path)


def stream_counters_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters after several micro-batches: a snapshot of three, and what came since."""
    path = fresh_path(spark, "folded-counters")
    stream = inputs.arriving_events(spark, sf_dir)
    count_pages_live(stream, path, fresh_path(spark, "folded-counters-state"), fold_every=3).awaitTermination()
    return latest_counters(spark, path)


QUERIES = {
    query.__name__: query
    for query in (
        crawl_rollup,
        captured_results,
        page_rows,
        page_success,
        failed_discovery,
        redirect_final,
        udf_surface,
        seed_normalise,
        seed_rejects,
        seed_dedup,
        sitemap_roots,
        sitemap_entries,
        sitemap_charsets,
        sitemap_urls,
        sitemap_errors,
        discovery_stats,
        crawl_plan,
        crawl_plan_uncapped,
        crawl_plan_cut,
        crawl_run,
        crawl_run_pages,
        crawl_run_report,
        stored_captures,
        seed_file_rejects,
        seed_file_rows,
        crawl_terminal,
        crawls_by_status,
        recent_crawls,
        crawl_lookup,
        page_lookup,
        list_pages,
        list_pages_all,
        listing_totals,
        page_positions,
        insert_ignore,
        finalise,
        status_update,
        delete_cascade,
        stored_append,
        stored_delete,
        table_delete,
        table_page,
        table_listing,
        bulk_append_audit,
        pages_with_crawl,
        constraint_audit,
        page_json,
        page_json_fields,
        crawl_json_fields,
        stream_ingest,
        stream_into_table,
        stream_counters,
        stream_counters_folded,
    )
}
