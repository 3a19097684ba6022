import pandas as pd
import pytest
from pyspark.sql import functions as F

from spinneret.operators.redirects import request_limit, resolve_redirects
from spinneret.operators.results import crawl_pages, fetch_outcomes, page_results, page_rows, process_pages, with_success
from spinneret.operators.rollup import rollup, rollup_of
from spinneret.schemas import CAPTURES, HOPS, PAGE_COLUMNS, PAGES

PLAN = "crawl_id long, position int, url string"
HTML = "<html><title> T </title></html>"


def now():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


def captures(spark, *rows):
    return spark.createDataFrame(list(rows), CAPTURES)


@pytest.fixture
def crawled(spark):
    plan = spark.createDataFrame(
        [(1, 1, "ok"), (1, 2, "json"), (1, 3, "untitled"), (1, 4, "timeout"), (1, 5, "uncaptured"), (2, 1, "ok"), (2, 2, "missing")],
        PLAN,
    )
    seen = captures(
        spark,
        (20, "ok", 503, "text/html", "later", 1, None),
        (10, "ok", 200, "Text/HTML; charset=utf-8", HTML + "é", 1999, None),
        (11, "json", 200, "application/json", "{}", 2000, None),
        (12, "untitled", 200, "application/xhtml+xml", "<p>", 0, None),
        (13, "timeout", None, None, None, None, "performing request: timeout"),
        (14, "missing", 404, "text/html", HTML, 5000, None),
        (15, "unplanned", 200, "text/html", HTML, 5000, None),
    )
    return plan, seen


def by_key(rows):
    return {(r["crawl_id"], r["url"]): r for r in rows}


def check_rows(rows):
    got = by_key(rows)
    assert len(rows) == len(got) == 7  # one result per planned URL
    ok = got[1, "ok"]
    assert ok["id"] == (1 << 32) + 1
    assert (ok["status_code"], ok["title"], ok["html"], ok["error"]) == (200, "T", HTML + "é", None)
    assert (ok["content_length"], ok["response_time_ms"]) == (len(HTML) + 2, 1)
    json = got[1, "json"]
    assert (json["title"], json["html"], json["content_length"], json["response_time_ms"]) == (None, None, 2, 2)
    untitled = got[1, "untitled"]
    assert (untitled["title"], untitled["html"]) == ("", "<p>")
    for url, error in (("timeout", "performing request: timeout"), ("uncaptured", "no captured response")):
        failed = got[1, url]
        assert failed["error"] == error
        assert all(failed[c] is None for c in PAGE_COLUMNS[3:9])
    # an error status is a response: its title and body are kept
    assert (got[2, "missing"]["status_code"], got[2, "missing"]["title"]) == (404, "T")
    assert got[2, "ok"]["html"] == ok["html"]


def test_page_rows(crawled):
    plan, seen = crawled
    rows = crawl_pages(plan, seen, now=now())
    assert rows.schema.fieldNames() == PAGES.fieldNames()
    assert [f.dataType for f in rows.schema] == [f.dataType for f in PAGES]
    check_rows(rows.collect())


def test_page_rows_with_hot_urls(spark, tiny_salts):
    plan = spark.createDataFrame([(c, 1, "hot") for c in range(50)] + [(c, 2, f"u{c}") for c in range(50)], PLAN)
    seen = captures(
        spark,
        *[(n, "hot", 200 if n == 3 else 500, "text/html", f"{n}", 1, None) for n in range(3, 40)],
        *[(1000 + c, f"u{c}", 200, "text/plain", "", 1, None) for c in range(0, 50, 2)],
    )
    rows = page_results(plan, seen).collect()
    assert len(rows) == 100
    got = by_key(rows)
    assert all(got[c, "hot"]["body"] == "3" for c in range(50))
    assert [c for c in range(50) if got[c, f"u{c}"]["error"] is None] == list(range(0, 50, 2))


def test_an_empty_plan_has_no_results(spark, crawled):
    _, seen = crawled
    assert page_results(spark.createDataFrame([], PLAN), seen).isEmpty()


def test_rollup(crawled):
    plan, seen = crawled
    results = page_results(plan, seen)
    got = {r["crawl_id"]: tuple(r)[1:] for r in rollup(results).collect()}
    assert got == {1: (5, 3, 2, "completed"), 2: (2, 1, 1, "completed")}
    assert {r["crawl_id"]: r["is_success"] for r in with_success(results).where("url = 'missing'").collect()} == {2: False}


def test_outcomes_agree_with_results(spark, crawled):
    plan, seen = crawled
    hops = spark.createDataFrame([("json", "ok"), ("untitled", "untitled")], HOPS)
    for planned in (plan, resolve_redirects(plan, hops)):
        outcomes = fetch_outcomes(planned, seen)
        same = page_results(planned, seen).select(*outcomes.columns)
        assert sorted(map(tuple, outcomes.collect()), key=repr) == sorted(map(tuple, same.collect()), key=repr)


def test_rollup_reads_no_bodies(spark, crawled, tmp_path):
    plan, seen = crawled
    seen.write.parquet(str(tmp_path / "captures"))
    stored = spark.read.schema(CAPTURES).parquet(str(tmp_path / "captures"))
    for results in (page_results(plan, stored), fetch_outcomes(plan, stored)):
        text = rollup(results)._jdf.queryExecution().executedPlan().toString()
        assert "status_code" in text and "body" not in text


def test_final_status(spark):
    crawls = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    results = spark.createDataFrame(
        [(1, 500, None), (1, None, "x"), (2, 500, None), (2, 204, None)], "crawl_id long, status_code int, error string"
    )
    got = {r["crawl_id"]: tuple(r)[1:] for r in rollup_of(crawls, results).collect()}
    assert got == {1: (2, 0, 2, "failed"), 2: (2, 1, 1, "completed"), 3: (0, 0, 0, "completed")}


def followed(hops, start, limit):
    """One request at a time."""
    here, requests = start, 1
    while hops.get(here) is not None:
        if requests >= limit:
            return None, limit, f"stopped after {limit} redirects"
        here, requests = hops[here], requests + 1
    return here, requests, None


@pytest.mark.parametrize("cap", [1, 2, 3, 5, 8, 50, 0, -1, 99])
def test_redirects(spark, cap):
    hops = {f"n{i}": f"n{i + 1}" for i in range(60)}
    hops |= {"n60": None, "loop": "loop", "a": "b", "b": "a", "out": "elsewhere", "plain": None}
    hops |= {f"to-hot{i}": "n58" for i in range(40)}
    table = spark.createDataFrame(list(hops.items()), HOPS)
    starts = table.select("url").unionByName(spark.createDataFrame([("unknown",)], "url string"))
    got = {r["url"]: tuple(r)[1:] for r in resolve_redirects(starts, table, cap).collect()}
    limit = request_limit(cap)
    assert limit == (cap if 0 < cap <= 50 else 50)
    assert got == {u: followed(hops, u, limit) for u in [*hops, "unknown"]}


def test_redirects_with_hot_targets(spark, tiny_salts):
    hops = {f"u{i}": "login" for i in range(30)} | {"login": "home", "home": None}
    table = spark.createDataFrame(list(hops.items()), HOPS)
    starts = spark.createDataFrame([(c, "u1") for c in range(20)] + [(c, "home") for c in range(20)], "c int, url string")
    got = [(r["c"], r["url"], r["final_url"], r["requests"]) for r in resolve_redirects(starts, table).collect()]
    want = [(c, "u1", "home", 3) for c in range(20)] + [(c, "home", "home", 1) for c in range(20)]
    assert sorted(got) == sorted(want)


def test_results_follow_redirects(spark):
    plan = spark.createDataFrame([(1, 1, "old"), (1, 2, "loop"), (1, 3, "new")], PLAN)
    hops = spark.createDataFrame([("old", "new"), ("loop", "loop")], HOPS)
    seen = captures(spark, (1, "new", 200, "text/html", HTML, 1, None), (2, "loop", 302, "", "", 1, None))
    got = by_key(crawl_pages(plan, seen, hops, max_redirects=3, now=now()).collect())
    assert got[1, "old"]["title"] == "T" and got[1, "new"]["title"] == "T"
    assert got[1, "loop"]["error"] == "performing request: stopped after 3 redirects"
    assert got[1, "loop"]["status_code"] is None


def test_one_result_per_job(spark):
    jobs = spark.createDataFrame([(42, f"u{i}") for i in range(8)], "crawl_id long, url string").repartition(3)

    def lengths(batch: pd.DataFrame) -> pd.DataFrame:
        return batch.assign(length=batch["url"].str.len().astype("int64"))

    rows = process_pages(jobs, lengths, "crawl_id long, url string, length long").collect()
    assert sorted(r["url"] for r in rows) == [f"u{i}" for i in range(8)]
    assert {r["crawl_id"] for r in rows} == {42} and {r["length"] for r in rows} == {2}
    assert process_pages(jobs.limit(0), lengths, "crawl_id long, url string, length long").isEmpty()

    def loses_one(batch: pd.DataFrame) -> pd.DataFrame:
        return batch.iloc[1:]

    with pytest.raises(Exception, match="results for"):
        process_pages(jobs, loses_one, jobs.schema).collect()


def test_row_per_job_for_every_page_row_input(spark, crawled):
    plan, seen = crawled
    results = page_results(plan, seen)
    assert page_rows(results, now()).count() == plan.count()
