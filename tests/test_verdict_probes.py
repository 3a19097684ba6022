"""Cases in which rows were once lost or doubled."""

import datetime

import pytest
from pyspark.sql import functions as F

from spinneret.functions.titles import first_title
from spinneret.operators.changes import insert_ignore, set_status
from spinneret.operators.ordering import first_n
from spinneret.operators.redirects import resolve_redirects, resolved
from spinneret.sources.export import page_json


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_insert_ignore_with_a_shared_order(spark):
    batch = spark.createDataFrame([(1, "a", 5), (1, "a", 7), (2, "b", 7)], "crawl_id long, url string, at long")
    assert rows(insert_ignore(batch, batch.limit(0), "at")) == [(1, "a", 5), (2, "b", 7)]


def test_insert_ignore_takes_a_repeated_row_once(spark):
    batch = spark.createDataFrame(
        [(1, "a", 1), (1, "a", 1), (1, "b", 2), (1, "b", 2), (1, "c", 3)], "crawl_id long, url string, id long"
    )
    stored = spark.createDataFrame([(1, "c")], "crawl_id long, url string")
    assert rows(insert_ignore(batch, stored, "id")) == [(1, "a", 1), (1, "b", 2)]


@pytest.mark.parametrize("n", [0, 2, 10, 20_000])
def test_numbering_keeps_rows_without_a_group(spark, n):
    df = spark.createDataFrame([(None, 1), (None, 2), ("g", 3)], "g string, at long")
    found = first_n(df, "g", "at", n)
    assert sorted(found.collect(), key=str) == sorted([(None, 1, 1), (None, 2, 2), ("g", 3, 1)], key=str)
    assert dict(found.dtypes)["position"] == "bigint"


def test_a_redirect_captured_twice_counts_once(spark):
    hops = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", None)], "url string, location string")
    found = resolve_redirects(spark.createDataFrame([("a",)], "url string"), hops)
    assert [tuple(r) for r in found.select("url", "final_url").collect()] == [("a", "b")]


@pytest.mark.parametrize(
    "location, target",
    [
        ("/login", "https://h.example/login"),
        ("next", "https://h.example/d/next"),
        ("../up?x=1", "https://h.example/up?x=1"),
        ("./", "https://h.example/d/"),
        ("//other.example/p", "https://other.example/p"),
        ("http://other.example", "http://other.example"),
        ("?q=2", "https://h.example/d/page?q=2"),
        ("../../../deep/./x", "https://h.example/deep/x"),
    ],
)
def test_redirect_targets_are_resolved(spark, location, target):
    df = spark.createDataFrame([("https://h.example/d/page?q=1", location)], "u string, l string")
    assert df.select(resolved(F.col("u"), F.col("l"))).first()[0] == target


def test_two_requests_leave_one_crawl(spark):
    crawl = (1, "w", "pending", 0, 0, 0, None, None)
    schema = (
        "id long, website string, status string, total_pages int, success_pages int, failed_pages int, "
        "started_at timestamp, finished_at timestamp"
    )
    asked = spark.createDataFrame([(1, "completed"), (1, "failed")], "id long, status string")
    assert [r["status"] for r in set_status(spark.createDataFrame([crawl], schema), asked).collect()] == ["failed"]


def test_json_keeps_microseconds(spark):
    from spinneret import schemas

    at = datetime.datetime(2024, 1, 1, 10, 20, 0, 123456)
    values = {f.name: None for f in schemas.PAGES.fields} | {"id": 1, "crawl_id": 1, "url": "u", "created_at": at}
    page = spark.createDataFrame([tuple(values.values())], schemas.PAGES)
    assert '"created_at":"2024-01-01T10:20:00.123456Z"' in page_json(page).first()["json"]


def test_unclosed_tags_are_read_once():
    assert first_title('<a b="' * 200_000) == ""
