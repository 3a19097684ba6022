"""Listings, changes, audits, storage and export."""

import json

import pytest
from pyspark.sql import functions as F

from spinneret.operators import audit, changes, listing
from spinneret.schemas import CRAWLS, PAGES
from spinneret.sources import export, store, tables
from spinneret.sources.layout import PAGE_BUCKETS

from datetime import datetime

T0 = datetime(2024, 1, 1)


def page(crawl, position, url=None, **values):
    row = {"id": (crawl << 32) + position, "crawl_id": crawl, "url": url or f"u{position}", "created_at": T0, **values}
    return tuple(row.get(c) for c in PAGES.fieldNames())


def pages_df(spark, rows):
    return spark.createDataFrame(rows, PAGES)


def crawls_df(spark, *rows):
    return spark.createDataFrame(
        [(i, f"https://{i}.test", status, 0, 0, 0, T0.replace(hour=i % 24), None) for i, status in rows], CRAWLS
    )


@pytest.fixture
def pages(spark):
    return pages_df(spark, [page(c, p, html="<p>") for c in (1, 2, 3) for p in range(1, 8 * c)])


def positions(df):
    return [r["id"] & 0xFFFFFFFF for r in df.collect()]


def test_lookups(spark, pages):
    crawls = crawls_df(spark, (1, "running"), (2, "completed"))
    assert [r["id"] for r in listing.crawl_by_id(crawls, 2).collect()] == [2]
    assert listing.crawl_by_id(crawls, 9).isEmpty()
    assert [r["url"] for r in listing.page_by_id(pages, (2 << 32) + 3).collect()] == ["u3"]
    assert listing.page_by_id(pages, 5).isEmpty()
    assert [r["id"] for r in listing.crawls_by_status(crawls, "running").collect()] == [1]
    assert [r["id"] for r in listing.recent_crawls(crawls, 1).collect()] == [2]


def test_list_pages(pages, monkeypatch):
    assert positions(listing.list_pages(pages, 2, limit=4, offset=3)) == [4, 5, 6, 7]
    assert positions(listing.list_pages(pages, 1, limit=50, offset=5)) == [6, 7]
    assert listing.list_pages(pages, 1, offset=100).isEmpty()
    assert "html" not in listing.list_pages(pages, 1).columns
    assert listing.list_pages(pages, 1, with_html=True).first()["html"] == "<p>"
    monkeypatch.setattr(listing, "MAX_SALTED", 2)  # the way of deep pages
    assert positions(listing.list_pages(pages, 2, limit=4, offset=3)) == [4, 5, 6, 7]
    assert positions(listing.list_pages(pages, 3, limit=2, offset=21, with_html=True)) == [22, 23]


def test_list_pages_of_every_crawl(pages):
    got = {(r["crawl_id"], r["position"], r["id"] & 0xFFFFFFFF) for r in listing.list_pages_all(pages, 3, 5).collect()}
    assert got == {(1, 6, 6), (1, 7, 7)} | {(c, p, p) for c in (2, 3) for p in (6, 7, 8)}


def test_listing_totals(spark, pages):
    crawls = crawls_df(spark, (1, "running"), (8, "completed"))
    requests = spark.createDataFrame([(1,), (8,), (99,)], "crawl_id long")
    got = {tuple(r) for r in listing.listing_totals(requests, crawls, pages).collect()}
    assert got == {(1, True, 7), (8, True, 0), (99, False, None)}


@pytest.mark.parametrize("limit,offset", [(0, 0), (501, 0), (50, -1), (50, 1_000_001)])
def test_paging_out_of_range(limit, offset):
    with pytest.raises(ValueError):
        listing.check_paging(limit, offset)


@pytest.mark.parametrize("raw,want", [("", 50), ("25", 25), ("abc", None), ("-1", None), ("9999", None)])
def test_paging_texts(raw, want):
    if want is None:
        with pytest.raises(ValueError):
            listing.parse_bounded(raw, 50, 1, 500)
    else:
        assert listing.parse_bounded(raw, 50, 1, 500) == want


def test_status_updates(spark):
    crawls = crawls_df(spark, (1, "pending"), (2, "pending"))
    requests = spark.createDataFrame([(1, "running"), (7, "running")], "id long, status string")
    assert {(r["id"], r["status"]) for r in changes.set_status(crawls, requests).collect()} == {(1, "running"), (2, "pending")}
    assert [r["id"] for r in changes.not_found(requests, crawls).collect()] == [7]


def test_finalise(spark):
    crawls = crawls_df(spark, (1, "running"), (2, "running"))
    totals = spark.createDataFrame(
        [(1, 5, 3, 2, "completed")], "crawl_id long, total_pages int, success_pages int, failed_pages int, status string"
    )
    done = changes.finalise(crawls, totals, F.lit(T0))
    assert done.schema.fieldNames() == CRAWLS.fieldNames()
    got = {r["id"]: (r["status"], r["total_pages"], r["success_pages"], r["failed_pages"], r["finished_at"]) for r in done.collect()}
    assert got == {1: ("completed", 5, 3, 2, T0), 2: ("running", 0, 0, 0, None)}


def test_insert_ignore_keeps_the_first(spark):
    batch = pages_df(spark, [page(1, 3, "a", title="third"), page(1, 1, "a", title="first"), page(1, 2, "b"), page(2, 1, "b")])
    existing = pages_df(spark, [page(1, 9, "b")])
    got = {(r["crawl_id"], r["url"], r["title"]) for r in changes.insert_ignore(batch, existing, "id").collect()}
    assert got == {(1, "a", "first"), (2, "b", None)}


def read_all(spark, path):
    return {(r["crawl_id"], r["url"], r["title"]) for r in tables.read_pages(spark, path).collect()}


def test_insert_new_twice_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "pages")
    first = pages_df(spark, [page(c, p, title="old") for c in range(1, 6) for p in range(1, 4)])
    store.insert_new(first, path)
    once = read_all(spark, path)
    assert len(once) == 15
    store.insert_new(first, path)
    assert tables.read_pages(spark, path).count() == 15
    store.insert_new(pages_df(spark, [page(1, 7, "u1", title="new"), page(1, 8, "u8", title="new")]), path)
    assert read_all(spark, path) == once | {(1, "u8", "new")}


def test_append_is_all_or_nothing(spark, tmp_path):
    path = str(tmp_path / "pages")
    store.append_batch(pages_df(spark, [page(1, 1), page(1, 2)]), path)
    for bad in ([page(1, 3), page(1, 4, "u3")], [page(2, 1), page(1, 9, "u2")]):
        with pytest.raises(store.DuplicatePages):
            store.append_batch(pages_df(spark, bad), path)
        assert tables.read_pages(spark, path).count() == 2
    store.append_batch(pages_df(spark, [page(1, 3)]), path)
    assert tables.read_pages(spark, path).count() == 3


def test_stored_pages_are_found_by_bucket(spark, tmp_path):
    path = str(tmp_path / "pages")
    store.insert_new(pages_df(spark, [page(c, 1) for c in range(1, 200)]), path)
    stored = tables.read_pages(spark, path)
    plan = listing.pages_of(stored, 7)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(crawl_bucket" in plan
    assert [r["crawl_id"] for r in listing.pages_of(stored, 7).collect()] == [7]
    assert [r["crawl_id"] for r in listing.page_by_id(stored, (150 << 32) + 1).collect()] == [150]
    assert listing.list_pages(stored, 3).count() == 1


def test_stored_pages_are_deleted(spark, tmp_path):
    path = str(tmp_path / "pages")
    same_bucket = 1 + PAGE_BUCKETS
    store.insert_new(pages_df(spark, [page(c, p) for c in (1, 2, 3, same_bucket) for p in (1, 2)]), path)
    ids = spark.createDataFrame([(1,), (2,), (999,)], "id long")
    store.delete_stored_pages(spark, path, ids)  # bucket 1 keeps a crawl, bucket 2 is emptied
    spark.catalog.refreshByPath(path)
    assert {r[:2] for r in read_all(spark, path)} == {(c, u) for c in (3, same_bucket) for u in ("u1", "u2")}
    store.delete_stored_pages(spark, path, spark.createDataFrame([(3,), (same_bucket,)], "id long"))
    spark.catalog.refreshByPath(path)
    assert read_all(spark, path) == set()
    store.insert_new(pages_df(spark, [page(1, 1)]), path)
    assert len(read_all(spark, path)) == 1


def test_cascade(spark, pages):
    crawls = crawls_df(spark, (1, "running"), (2, "completed"))
    ids = spark.createDataFrame([(2,), (5,)], "id long")
    assert [r["id"] for r in changes.delete_crawls(crawls, ids).collect()] == [1]
    assert {r["crawl_id"] for r in changes.delete_pages_of(pages, ids).collect()} == {1, 3}


def test_crawl_versions_never_overwrite(spark, tmp_path):
    path = str(tmp_path / "crawls")
    crawls = crawls_df(spark, (1, "running"))
    store.write_crawls(crawls, path)
    assert [r["id"] for r in tables.read_crawls(spark, path).collect()] == [1]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        store.write_crawls(crawls, path)


def test_audit(spark):
    crawls = crawls_df(spark, (1, "running"), (2, "paused"), (3, "failed"))
    good = [page(1, 1), page(1, 2), page(3, 1)]
    assert audit.audit(crawls.where("id <> 2"), pages_df(spark, good)).isEmpty()
    bad = pages_df(spark, [*good, page(1, 5, "u1"), page(9, 1), page(9, 2), page(3, 1, "other")])
    got = {tuple(r) for r in audit.audit(crawls, bad).collect()}
    assert got == {
        ("crawls.status", "2", 1),
        ("pages.url_per_crawl", "1 u1", 2),
        ("pages.crawl_exists", "9", 2),
        ("pages.id_unique", str((3 << 32) + 1), 2),
    }
    assert {r["crawl_id"] for r in audit.pages_with_crawl(bad, crawls).collect()} == {1, 3}


def test_json(spark):
    rows = pages_df(spark, [page(1, 1, 'a"b', status_code=200, title="", html="<p>"), page(1, 2, error="x")])
    first, second = (json.loads(r["json"]) for r in export.page_json(rows).orderBy("id").collect())
    assert list(first) == [c for c in PAGES.fieldNames() if c != "error"]
    assert (first["url"], first["content_type"], first["html"]) == ('a"b', None, "<p>")
    assert list(second) == [c for c in PAGES.fieldNames() if c != "html"]
    (crawl,) = (json.loads(r["json"]) for r in export.crawl_json(crawls_df(spark, (1, "running"))).collect())
    assert list(crawl) == [c for c in CRAWLS.fieldNames() if c != "finished_at"]


def test_json_of_a_row_with_braces(spark):
    (row,) = export.page_json(pages_df(spark, [page(1, 1, html="{}", error="}")])).collect()
    got = json.loads(row["json"])
    assert (got["html"], got["error"]) == ("{}", "}")


def test_json_files(spark, tmp_path, pages):
    path = str(tmp_path / "json")
    export.write_json(export.page_json(pages), path)
    assert spark.read.json(path).count() == pages.count()


def test_reader_of_repeated_documents(spark, tmp_path):
    path = str(tmp_path / "documents")
    spark.createDataFrame([(7, "u", 200, "b")], "capture_id long, url string, status_code int, body string").write.json(path)
    assert tables.read_documents(spark, path, "json", repeated=False).columns == ["url", "status_code", "body"]
    assert tuple(tables.read_documents(spark, path, "json").first()) == (7, "u", 200, "b")


@pytest.mark.parametrize("fmt", ["json", "csv", "parquet"])
def test_readers(spark, tmp_path, fmt):
    path = str(tmp_path / fmt)
    spark.createDataFrame([(1, "a.test"), (2, None)], "seed_id long, website_raw string").write.format(fmt).save(path)
    assert {tuple(r) for r in tables.read_seeds(spark, path, fmt).collect()} == {(1, "a.test"), (2, None)}
