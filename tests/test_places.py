"""Packed and listed places agree, and loops end in few states."""

import random

import pytest
from pyspark.sql import functions as F

from spinneret.operators import discovery, places
from spinneret.operators.places import LEVELS, Listed, Packed
from spinneret.schemas import DOCUMENTS
from test_discovery import WEB, SITES, check, index, urlset, walked


def packed(paths, spark):
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i long, path array<int>")
    place = Packed.start(F.col("path")[0])
    for level in range(1, LEVELS):
        place = F.when(F.size("path") > level, Packed.below(place, F.lit(level), F.get("path", F.lit(level)))).otherwise(place)
    return rows.withColumn("place", place)


def test_packed_places_sort_as_paths(spark):
    pick = random.Random(2)
    paths = [[pick.choice([0, 1, 9, 10, 99_997]) for _ in range(pick.randrange(1, LEVELS + 1))] for _ in range(300)]
    got = packed(paths, spark).select("i", "place", Packed.path(F.col("place")).alias("again")).collect()
    assert all(r["again"] == paths[r["i"]] for r in got)
    assert [paths[r["i"]] for r in sorted(got, key=lambda r: r["place"])] == sorted(paths)


def test_what_fits():
    assert places.places(99_998, LEVELS) is Packed
    assert places.places(99_999, LEVELS) is Listed
    assert places.places(5, LEVELS + 1) is Listed


@pytest.fixture
def web(spark):
    documents = spark.createDataFrame([(u, s, b) for u, (s, b) in WEB.items()], DOCUMENTS)
    return spark.createDataFrame(list(SITES.items()), "crawl_id long, website string"), documents


def test_listed_places_find_the_same(web, monkeypatch):
    monkeypatch.setattr(discovery, "places", lambda *_: Listed)
    check(discovery.discover(*web), walked())


def test_deeper_walks_than_fit(web):
    check(discovery.discover(*web, max_depth=6), walked(max_depth=6))


def test_first_place_is_a_hash_aggregate(web):
    for rows in discovery.discover(*web)[:1]:
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_an_index_that_lists_itself_often(spark):
    site = "https://l.test"
    loop = f"{site}/loop.xml"
    bodies = {
        f"{site}/robots.txt": f"Sitemap: {loop}",
        loop: index(*[loop] * 50, f"{site}/s.xml"),
        f"{site}/s.xml": urlset(f"{site}/1", f"{site}/2"),
    }
    documents = spark.createDataFrame([(u, 200, b) for u, b in bodies.items()], DOCUMENTS)
    sites = spark.createDataFrame([(1, site)], "crawl_id long, website string")
    parsed = discovery.parse_sitemaps(documents)
    visited = discovery.visits(discovery.sitemap_roots(sites, documents), parsed)
    assert visited.count == 6 + 5
    found = discovery.discover(sites, documents)
    assert [(r["url"], r["path"]) for r in found.urls.orderBy("path").collect()] == [
        (f"{site}/1", [0, 0, 0, 0, 0, 50, 0]),
        (f"{site}/2", [0, 0, 0, 0, 0, 50, 1]),
    ]
    loops, leaves = sum(50**d for d in range(6)), sum(50**d for d in range(5))
    assert [tuple(r) for r in found.stats.collect()] == [(1, 2, loops + leaves, 50**6 + 50**5)]
    failed = {(r["sitemap_url"], r["depth"]): int(r["times"]) for r in found.failures.collect()}
    assert failed == {(loop, 6): 50**6, (f"{site}/s.xml", 6): 50**5}


def test_rows_repeat(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 25)], "x string, times int").withColumn("times", F.col("times").cast("decimal(38,0)"))
    assert sorted(r[0] for r in discovery.repeated(rows, part=10).collect()) == ["a"] + ["b"] * 25
