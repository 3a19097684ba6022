"""Crawl inputs derived from the ``pages`` and ``events`` tables.

Every rule is arithmetic on a key, so that SQL can derive the same rows, and each
site has at most 250 pages, so that more pages mean more sites. FIXTURES.md lists
the rules; ``oracle.py`` states them again in SQL.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spinneret.operators.results import page_rows
from spinneret.operators.rollup import counters
from spinneret.schemas import CRAWL_COLUMNS, CRAWL_STATUSES
from spinneret.session import fresh_path, prepare
from spinneret.sources.store import is_folder

SITES = 16
CHILD_SITEMAPS = 3
PAGES_PER_GROUP = 4000  # pages that share 16 sites
BARE_SITES = 900_000_000  # crawl ids of sites without any sitemap
NOT_A_CRAWL = -999

NOW = "2024-02-01 00:00:00"


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _group() -> Column:
    return F.floor(F.col("page_id") / PAGES_PER_GROUP)


def crawl_id() -> Column:
    return (F.col("page_id") % SITES + 1 + SITES * _group()).cast("long")


def position() -> Column:
    return (F.col("page_id") % PAGES_PER_GROUP).cast("int")


def child_sitemap() -> Column:
    return (F.floor(F.col("page_id") / SITES) % CHILD_SITEMAPS).cast("int")


def website(crawl: Column) -> Column:
    return F.concat(F.lit("https://site"), crawl.cast("string"), F.lit(".test"))


def pages_by_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").withColumn("crawl_id", crawl_id()).withColumn("position", position())


def _response(page: Column) -> list[Column]:
    timed_out = page % 10 == 9
    kind = page % 4
    return [
        F.when(timed_out, None)
        .when(page % 16 == 15, 500)
        .when(page % 10 == 8, 404)
        .when(page % 10 == 7, 301)
        .otherwise(200)
        .alias("status_code"),
        F.when(timed_out, None)
        .when(kind == 0, "text/html; charset=utf-8")
        .when(kind == 1, "TEXT/HTML")
        .when(kind == 2, "application/xhtml+xml")
        .otherwise("application/json")
        .alias("content_type"),
        F.col("html").alias("body"),
        F.when(~timed_out, page * 7919 % 2_000_000).alias("response_time_us"),
        F.when(timed_out, "performing request: timeout").alias("error"),
    ]


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One captured response per page."""
    pages = table(spark, sf_dir, "pages")
    return pages.select(F.col("page_id").alias("capture_id"), "url", *_response(F.col("page_id")))


def repeated_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two captures per page, the later one a 503; none for every sixth page."""
    return (
        captures(spark, sf_dir)
        .where(F.col("capture_id") % 6 != 0)
        .withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
        .withColumn("capture_id", F.col("capture_id") * 2 + F.col("copy"))
        .withColumn("status_code", F.when(F.col("copy") == 1, 503).otherwise(F.col("status_code")))
        .drop("copy")
    )


def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page planned for its crawl."""
    return pages_by_crawl(spark, sf_dir).select("crawl_id", "position", "url")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page results as the join of plan and captures gives them."""
    return pages_by_crawl(spark, sf_dir).select(
        "crawl_id", "position", "url", F.col("url").alias("final_url"), *_response(F.col("page_id"))
    )


def stored_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages table that the results give."""
    return page_rows(results(spark, sf_dir), now()).drop("position")


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page URLs as people type websites, some of them wrong."""
    page, url = F.col("page_id"), F.col("url")
    rest = F.regexp_replace(url, "^https?://", "")
    raw = (
        F.when(page % 13 == 0, "")
        .when(page % 11 == 0, F.concat(F.lit("ftp://"), rest))
        .when(page % 7 == 0, F.concat(F.lit("  "), url, F.lit("  ")))
        .when(page % 5 == 0, rest)
        .otherwise(url)
    )
    return table(spark, sf_dir, "pages").select(page.alias("seed_id"), raw.alias("website_raw"))


def site_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many seeds for each site, and a few for websites not crawled before."""
    page = F.col("page_id")
    raw = F.when(page % 97 == 5, F.concat(F.lit("new"), page.cast("string"), F.lit(".test"))).otherwise(
        F.concat(website(F.col("crawl_id")), F.lit("/p"), page.cast("string"))
    )
    return pages_by_crawl(spark, sf_dir).select(page.alias("seed_id"), raw.alias("website_raw"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``crawl_id, website``: a site per crawl, and one per group without sitemaps."""
    pages = table(spark, sf_dir, "pages")
    with_map = pages.select(crawl_id().alias("crawl_id")).distinct()
    bare = pages.select((BARE_SITES + _group()).cast("long").alias("crawl_id")).distinct()
    return with_map.unionByName(bare).select("crawl_id", website(F.col("crawl_id")).alias("website"))


def _root_path(crawl: Column) -> Column:
    return F.when((crawl % 4).isin(1, 2), "/index.xml").otherwise("/sitemap.xml")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured robots.txt files, sitemap indexes and child sitemaps."""
    crawl, home = F.col("crawl_id"), website(F.col("crawl_id"))
    pages = pages_by_crawl(spark, sf_dir).withColumn("child", child_sitemap())
    crawls = pages.select("crawl_id").distinct()

    def document(rows: DataFrame, path: Column, status: Column, body: Column) -> DataFrame:
        return rows.select(F.concat(home, path).alias("url"), status.alias("status_code"), body.alias("body"))

    robots_body = (
        F.when(crawl % 4 == 0, "not here")
        .when(crawl % 4 == 1, F.concat(F.lit("User-agent: *\nDisallow: /tmp\nSitemap: "), home, F.lit("/index.xml\n")))
        .when(
            crawl % 4 == 2,
            F.concat(
                F.lit("sItEmAp: "), home, F.lit("/index.xml\r\n  SITEMAP :"), home, F.lit("/missing.xml # old\r\n")
            ),
        )
        .otherwise("User-agent: *\nDisallow:\n")
    )
    robots = document(crawls, F.lit("/robots.txt"), F.when(crawl % 4 == 0, 404).otherwise(200), robots_body)

    def entry(element: str, address: Column) -> Column:
        return F.concat(F.lit(f"<{element}><loc>"), address, F.lit(f"</loc></{element}>"))

    head = '<?xml version="1.0" encoding="UTF-8"?>\n<{} xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'
    listed = [entry("sitemap", F.concat(home, F.lit(f"/s{k}.xml"))) for k in range(CHILD_SITEMAPS)]
    itself = F.when(crawl % 8 == 1, entry("sitemap", F.concat(home, _root_path(crawl)))).otherwise("")
    roots = document(
        crawls,
        _root_path(crawl),
        F.lit(200),
        F.concat(F.lit(head.format("sitemapindex")), *listed, itself, F.lit("</sitemapindex>")),
    )
    # Refused bodies: an error status and an empty file.
    missing = document(crawls.where(crawl % 8 == 2), F.lit("/missing.xml"), F.lit(404), F.lit("<urlset/>"))
    empty = document(crawls.where(crawl % 8 == 3), F.lit("/sitemap_index.xml"), F.lit(200), F.lit(""))

    escaped = F.replace(F.col("url"), F.lit("&"), F.lit("&amp;"))
    broken = F.when((crawl % SITES == 0) & (F.col("child") == 1), "&").otherwise("")
    children = (
        pages.select("crawl_id", "child", "page_id", entry("url", F.concat(escaped, broken)).alias("entry"))
        .groupBy("crawl_id", "child")
        # at most 84 pages of a site share a child
        .agg(F.sort_array(F.collect_list(F.struct("page_id", "entry"))).alias("listed"))
    )
    child_documents = document(
        children,
        F.concat(F.lit("/s"), F.col("child").cast("string"), F.lit(".xml")),
        F.lit(200),
        F.concat(
            F.lit(head.format("urlset")),
            F.array_join("listed.entry", "\n"),
            entry("url", F.lit("")),
            entry("url", F.concat(home, F.lit("/dup"))),
            F.lit("</urlset>"),
        ),
    )
    return robots.unionByName(roots).unionByName(missing).unionByName(empty).unionByName(child_documents)


def hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of up to seven redirects, and some loops; URLs are page numbers."""
    page = F.col("page_id")
    pages = table(spark, sf_dir, "pages")
    chained = pages.select(
        page.cast("string").alias("url"),
        F.when(page % 50 == 13, page).when(page % 7 == 0, None).otherwise(page + 1).cast("string").alias("location"),
    )
    end = pages.agg((F.max(page) + 1).cast("string").alias("url")).withColumn("location", F.lit(None).cast("string"))
    return chained.unionByName(end)


def crawls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crawls table: one per site, in every status; counters once terminal."""
    counted = results(spark, sf_dir).groupBy("crawl_id").agg(*counters())
    crawl = F.col("crawl_id")
    started = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp")) + crawl * 3600)
    ended = (crawl % 4).isin(2, 3)
    return counted.select(
        crawl.alias("id"),
        website(crawl).alias("website"),
        F.array(*map(F.lit, CRAWL_STATUSES))[(crawl % 4).cast("int")].alias("status"),
        *[F.when(ended, F.col(c)).otherwise(0).alias(c) for c in ("total_pages", "success_pages", "failed_pages")],
        started.alias("started_at"),
        F.when(ended, F.timestamp_seconds(F.unix_timestamp(started) + 1800)).alias("finished_at"),
    ).select(*CRAWL_COLUMNS)


def event_results(events: DataFrame) -> DataFrame:
    """Page results of a busy crawler from ``events``: URLs of a user repeat."""
    failed = F.col("event_type") == "error"
    return events.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("crawl_id"),
        F.concat(F.lit("https://r.test/"), (F.col("event_id") % 5000).cast("string")).alias("url"),
        F.when(failed, None).when(F.col("event_type") == "signup", 404).otherwise(200).alias("status_code"),
        F.when(failed, None).otherwise("text/plain").alias("content_type"),
        F.lit(None).cast("long").alias("content_length"),
        F.when(~failed, F.floor("value").cast("int")).alias("response_time_ms"),
        F.lit(None).cast("string").alias("title"),
        F.lit(None).cast("string").alias("html"),
        F.when(failed, "performing request: timeout").alias("error"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same results, as a stream over the table's files."""
    path = os.path.join(sf_dir, "events.parquet")
    files = spark.readStream.schema(table(spark, sf_dir, "events").schema)
    if is_folder(spark, path):
        return event_results(files.parquet(path))
    # a stream reads folders: take the one file out of its folder
    return event_results(files.option("pathGlobFilter", "events.parquet").parquet(sf_dir))


# Parts that the events arrive in, one after the other.
ARRIVALS = 4


def early_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that are stored before the stream starts: every third event."""
    return event_results(table(spark, sf_dir, "events").where(F.col("event_id") % 3 == 0))


def arriving_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other events as a stream of files, one a micro-batch, in the order of their ids."""
    events = table(spark, sf_dir, "events")
    path = fresh_path(spark, "arrivals")
    end = events.agg(F.max("event_id")).first()[0] or 0
    part = F.floor(F.col("event_id") * ARRIVALS / (end + 1))
    for number in range(ARRIVALS):  # files are streamed in the order of writing
        late = events.where((F.col("event_id") % 3 != 0) & (part == number))
        late.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return event_results(stream)


def run_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redirects between page URLs: chains, some too long; relative locations; loops."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    page, url = F.col("page_id"), F.col("url")
    following = pages.select((page - 1).alias("page_id"), url.alias("_next"))
    own_path = F.regexp_replace(url, "^https?://[^/]*", "")
    return (
        pages.join(following, "page_id", "left")
        .where((page % 10 == 7) | (page % 40).between(30, 37))
        .select(
            "url",
            F.when(page % 50 == 27, own_path).when(page % 50 == 7, "moved").otherwise(F.col("_next")).alias("location"),
        )
    )


def seed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a JSON file of seeds, some cut off, some of a wrong type, some incomplete."""
    page, raw = F.col("seed_id"), F.regexp_replace("website_raw", '"', "'")
    number, name = F.concat(F.lit('"seed_id":'), page.cast("string")), F.concat(F.lit('"website_raw":"'), raw, F.lit('"'))
    return seeds(spark, sf_dir).select(
        F.when(page % 9 == 4, F.concat(F.lit("{"), number, F.lit(","), F.substring(name, 1, 16)))
        .when(page % 9 == 5, F.concat(F.lit("{"), name, F.lit("}")))
        .when(page % 9 == 6, F.concat(F.lit('{"seed_id":"no '), page.cast("string"), F.lit('",'), name, F.lit("}")))
        .otherwise(F.concat(F.lit("{"), number, F.lit(","), name, F.lit("}")))
        .alias("value")
    )


def charset_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sitemap for each page, as bytes in one of several encodings, some not as declared."""
    page = F.col("page_id")
    kind = page % 8
    declared = {0: "", 1: "UTF-8", 2: "ISO-8859-1", 3: "UTF-16", 4: "windows-1252", 5: "utf-8", 6: "UTF-8", 7: "x-unknown"}
    head = F.lit("")
    for k, name in declared.items():
        if name:
            head = F.when(kind == k, f'<?xml version="1.0" encoding="{name}"?>').otherwise(head)
    address = F.concat(F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("#\u00e9"))
    text = F.concat(head, F.lit("<urlset><url><loc>"), address, F.lit("</loc></url></urlset>"))
    body = (
        F.when(kind.isin(2, 4, 5), F.encode(text, "ISO-8859-1"))
        .when(kind == 3, F.encode(text, "UTF-16"))
        .when(kind == 6, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(text, "UTF-8")))
        .otherwise(F.encode(text, "UTF-8"))
    )
    return table(spark, sf_dir, "pages").select(
        F.concat(F.lit("https://c.test/"), page.cast("string"), F.lit(".xml")).alias("url"),
        F.lit(200).alias("status_code"),
        body.alias("body"),
    )
