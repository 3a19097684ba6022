"""Captures stored by URL, redirects of reached URLs only, files with bad records."""

import pytest
from pyspark.sql import functions as F

from spinneret.operators import redirects
from spinneret.operators.results import MAX_CRAWL_ID, page_results, page_rows, stored_results
from spinneret.schemas import CAPTURES, HOPS, SEEDS
from spinneret.sources.captures import CaptureStore
from spinneret.sources.tables import read_checked


def captures(spark, *rows):
    return spark.createDataFrame([(i, u, 200, "text/html", f"<p>{i}", 5, None) for i, u in rows], CAPTURES)


def results(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture
def store(spark, tmp_path):
    kept = CaptureStore(spark, str(tmp_path / "captures"), 4)
    yield kept
    kept.close()


PLAN = "crawl_id long, position int, url string, final_url string, redirect_error string"


def plan(spark):
    rows = [(c, p, f"u{p}", f"u{p}", None) for c in (1, 2) for p in range(8)]
    rows += [(3, i, f"x{i}", "u1", None) for i in range(20)]  # a target many share
    rows += [(4, i, f"y{i}", None, "stopped after 5 redirects") for i in range(5)]
    return spark.createDataFrame(rows, PLAN)


def test_an_empty_store(spark, store):
    assert store.read().isEmpty()
    assert {r["error"] for r in stored_results(plan(spark).limit(3), store.read()).collect()} == {"no captured response"}


@pytest.mark.parametrize("hot", [False, True])
def test_same_results_as_from_any_captures(spark, store, monkeypatch, hot):
    if hot:
        from spinneret.operators import results as module

        monkeypatch.setattr(module, "BODIES_PER_SALT", 3)
    every = captures(spark, *[(10 * k + i, f"u{i}") for k in range(3) for i in range(6)])
    store.append(every)
    store.append(every.withColumn("body", F.lit("late")))
    assert store.read().count() == 6
    assert results(stored_results(plan(spark), store.read())) == results(page_results(plan(spark), every))


def test_a_store_is_found_again(spark, store, tmp_path):
    store.append(captures(spark, (1, "a"), (2, "b"), (3, "a")))
    again = CaptureStore(spark, str(tmp_path / "captures"), 99)
    assert again.buckets == 4
    again.append(captures(spark, (0, "a"), (4, "c")))
    assert {(r["url"], r["capture_id"]) for r in again.read().collect()} == {("a", 1), ("b", 2), ("c", 4)}
    again.close()


def test_bodies_are_not_shuffled(spark, store):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        store.append(captures(spark, *[(i, f"u{i}") for i in range(50)]))
        found = stored_results(plan(spark).where("final_url IS NOT NULL"), store.read())
        plan_text = found._jdf.queryExecution().executedPlan().toString()
        found.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Bucketed: true" in plan_text
    join = plan_text[plan_text.index("ShuffledHashJoin") :]
    left, scan = join[: join.index("FileScan")], join[join.index("FileScan") :]
    # The only exchange is that of the plan, above its own rows.
    assert join.count("Exchange") == 1 and "body" in scan and "position" in left[left.index("Exchange") :]


HOPS_ROWS = [("a", "b"), ("b", "c"), ("c", "d"), ("loop", "loop"), ("p", "q"), ("q", "p"), ("far", "away"), ("b", "zzz"), ("d", None)]


def test_only_reached_hops_are_resolved(spark):
    hops = spark.createDataFrame(HOPS_ROWS, HOPS)
    urls = spark.createDataFrame([("a",), ("a",), ("x",), ("loop",), ("q",), (None,)], "url string")
    reached = {tuple(r) for r in redirects.reached_hops(urls, hops, 5).collect()}
    assert reached == {("a", "b"), ("b", "c"), ("c", "d"), ("loop", "loop"), ("p", "q"), ("q", "p")}
    assert {r["url"] for r in redirects.reached_hops(urls, hops, 2).collect()} == {"a", "b", "loop", "p", "q"}
    for most in (1, 2, 3, 5, 50):
        every, few = (
            sorted(map(repr, redirects.resolve_redirects(urls, hops, most, only_reached=o).collect())) for o in (False, True)
        )
        assert every == few


def test_no_hop_is_reached(spark):
    urls = spark.createDataFrame([("x",)], "url string")
    found = redirects.resolve_redirects(urls, spark.createDataFrame(HOPS_ROWS, HOPS), only_reached=True)
    assert found.first()["final_url"] == "x"


def test_crawl_ids_without_room_for_page_ids(spark):
    every = page_results(plan(spark).limit(1).withColumn("crawl_id", F.lit(MAX_CRAWL_ID).cast("long")), captures(spark))
    assert page_rows(every).first()["id"] > 0
    with pytest.raises(Exception, match="no page ids for crawl"):
        page_rows(every.withColumn("crawl_id", F.col("crawl_id") + 1)).collect()


def test_bad_records_of_csv_and_json(spark, tmp_path):
    for fmt, lines in (
        ("csv", ["1,a.test", "x,b.test", ",c.test", "4", "5,"]),
        ("json", ['{"seed_id":1,"website_raw":"a.test"}', '{"seed_id":"x"}', '{"website_raw":"c.test"}', "{", '{"seed_id":5}']),
    ):
        path = str(tmp_path / fmt)
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
        read = read_checked(spark, path, SEEDS, fmt)
        assert {tuple(r) for r in read.rows.collect()} == {(1, "a.test"), (5, None)}
        bad = {r["record"] for r in read.rejects.where("reason = 'malformed'").collect()}
        assert bad == {lines[1], lines[3]}
        assert [r["record"] for r in read.rejects.where("reason = 'incomplete'").collect()] == ['{"website_raw":"c.test"}']
        assert read.rejects.count() + read.rows.count() == 5
