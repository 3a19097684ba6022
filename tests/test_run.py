"""The whole job on little or no input."""

import pytest
from pyspark.sql import functions as F

from spinneret.operators import report
from spinneret.operators.changes import insert_ignore
from spinneret.operators.redirects import resolve_redirects
from spinneret.plans.crawl import run_crawls
from spinneret.schemas import CAPTURES, CRAWLS, DOCUMENTS, HOPS, PAGES, SEEDS
from spinneret.session import pinned_counted, shared_dir


@pytest.fixture
def nothing(spark):
    return {schema: spark.createDataFrame([], schema) for schema in (CAPTURES, CRAWLS, DOCUMENTS, HOPS, PAGES, SEEDS)}


def run(spark, nothing, seeds=(), documents=(), captures=(), hops=()):
    def table(rows, schema):
        return spark.createDataFrame(list(rows), schema) if rows else nothing[schema]

    return run_crawls(
        table(seeds, SEEDS),
        nothing[CRAWLS],
        table(documents, DOCUMENTS),
        table(captures, CAPTURES),
        table(hops, HOPS),
        now=F.lit("2024-02-01 00:00:00").cast("timestamp"),
    )


def test_no_seeds(spark, nothing):
    done = run(spark, nothing)
    assert done.crawls.isEmpty() and done.pages.isEmpty() and done.discovery.stats.isEmpty()


def test_a_website_nobody_captured(spark, nothing):
    done = run(spark, nothing, seeds=[(1, "a.test")])
    (crawl,) = done.crawls.collect()
    assert (crawl["id"], crawl["status"], crawl["total_pages"], crawl["failed_pages"]) == (1, "failed", 1, 1)
    (page,) = done.pages.collect()
    assert (page["url"], page["error"]) == ("https://a.test", "no captured response")


def test_from_seeds_to_pages(spark, nothing):
    site = "https://a.test"
    done = run(
        spark,
        nothing,
        seeds=[(5, "a.test/start"), (6, "a.test"), (7, "ftp://b.test")],
        documents=[(f"{site}/sitemap.xml", 200, f"<urlset><url><loc>{site}/1</loc></url><url><loc>{site}/2</loc></url></urlset>")],
        captures=[
            (1, f"{site}/1", 200, "text/html", "<title>One</title>", 1500, None),
            (2, f"{site}/two", 200, "text/html", "<title>Two</title>", 2500, None),
        ],
        hops=[(f"{site}/2", f"{site}/two")],
    )
    (crawl,) = done.crawls.collect()
    assert tuple(crawl)[:6] == (1, site, "completed", 2, 2, 0)
    pages = done.pages.orderBy("id").collect()
    assert [(p["id"], p["url"], p["title"], p["response_time_ms"]) for p in pages] == [
        ((1 << 32) + 1, f"{site}/1", "One", 1),
        ((1 << 32) + 2, f"{site}/2", "Two", 2),
    ]
    # one sitemap found, the other common address failed
    assert [tuple(r) for r in done.discovery.stats.collect()] == [(1, 2, 1, 1)]


def test_counting_nothing(spark, nothing):
    assert pinned_counted(spark.range(5).join(nothing[SEEDS], F.col("id") == F.col("seed_id")))[1] == 0
    assert insert_ignore(nothing[PAGES], nothing[PAGES], "id").isEmpty()
    urls = spark.createDataFrame([("a",)], "url string")
    assert resolve_redirects(urls, nothing[HOPS]).first()["final_url"] == "a"


def test_shared_folder_is_the_configured_one(spark):
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        assert shared_dir(spark) == named
    assert spark.sparkContext.getCheckpointDir()


def test_report_of_a_run(spark):
    crawls = spark.createDataFrame(
        [(1, "completed", 3, 2, 1), (2, "failed", 1, 0, 1), (3, "completed", 1, 1, 0), (4, "completed", 0, 0, 0)],
        "id long, status string, total_pages int, success_pages int, failed_pages int",
    )
    stats = spark.createDataFrame(
        [(1, 7, 2, 0), (2, 0, 0, 2), (3, 3, 1, 1)], "crawl_id long, urls_found long, sitemaps_found long, errors long"
    )
    pages = spark.createDataFrame(
        [(1, 200, None), (1, 204, None), (1, 404, None), (3, 200, None), (3, 200, None), (9, 200, None)],
        "crawl_id long, status_code int, error string",
    )
    found = {r["crawl_id"]: r for r in report.run_report(crawls, stats, pages, 3).collect()}
    assert set(found) == {1, 2, 3, 4}
    shape = ("urls_found", "urls_planned", "urls_cut", "stored_pages", "counters_agree")
    # crawl 2 lost its page, crawl 3 stored one twice, crawl 4 has neither statistics nor pages
    assert [found[1][c] for c in shape] == [7, 3, 4, 3, True]
    assert [found[2][c] for c in shape] == [0, 1, 0, 0, False]
    assert [found[3][c] for c in shape] == [3, 3, 0, 2, False]
    assert [found[4][c] for c in shape] == [0, 1, 0, 0, True]
    assert [tuple(r) for r in report.truncated(stats, 3).collect()] == [(1, 7, 4)]
    assert report.truncated(stats, 0).isEmpty()
    assert report.run_report(crawls.limit(0), stats, pages).isEmpty()


def test_report_joins_counts_alone(spark):
    crawls = spark.createDataFrame([], CRAWLS)
    stats = spark.createDataFrame([], "crawl_id long, urls_found long, sitemaps_found long, errors long")
    plan = report.run_report(crawls, stats, spark.createDataFrame([], PAGES))._jdf.queryExecution().optimizedPlan().toString()
    assert "html" not in plan.split("Join")[0] and plan.count("Aggregate") == 1
