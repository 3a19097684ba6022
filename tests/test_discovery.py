"""Sitemap expansion against a recursive walk over a small web."""

import pytest
from pyspark.sql import functions as F

from spinneret.operators.crawl_plan import crawl_plan
from spinneret.operators.discovery import discover, parse_sitemaps, sitemap_entries, sitemap_roots
from spinneret.schemas import DOCUMENTS


def urlset(*locs):
    return "<urlset>" + "".join(f"<url><loc>{u}</loc></url>" for u in locs) + "</urlset>"


def index(*locs):
    return "<sitemapindex>" + "".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in locs) + "</sitemapindex>"


A, B, C, D = (f"https://{name}.test" for name in "abcd")
LOOP = f"{C}/loop.xml"
WEB = {
    f"{A}/robots.txt": (200, f"Sitemap: {A}/main.xml\nsitemap: {A}/more.xml\n"),
    f"{A}/main.xml": (200, index(f"{A}/s1.xml", "", f"{A}/s2.xml", f"{A}/gone.xml")),
    f"{A}/s1.xml": (200, urlset(f"{A}/1", f"{A}/2", "", f"{A}/1")),
    f"{A}/s2.xml": (200, urlset(f"{A}/3", f"{A}/2", f" {A}/4 ")),
    f"{A}/more.xml": (200, urlset(f"{A}/0", f"{A}/5")),
    f"{A}/gone.xml": (404, "<urlset/>"),
    # robots refused: the common addresses are tried
    f"{B}/robots.txt": (500, f"Sitemap: {B}/never.xml"),
    f"{B}/sitemap.xml": (200, urlset(f"{B}/x")),
    f"{B}/sitemap_index.xml": (200, ""),
    # an index that lists itself twice, and a shared child
    f"{C}/robots.txt": (200, f"Sitemap: {LOOP}"),
    LOOP: (200, index(LOOP, f"{A}/s1.xml", LOOP)),
    # declared and broken: no fallback to the common addresses
    f"{D}/robots.txt": (200, f"Sitemap: {D}/bad.xml\nSitemap: {D}/page.html"),
    f"{D}/bad.xml": (200, "<urlset><url><loc>broken"),
    f"{D}/page.html": (200, "<html><title>no</title></html>"),
    f"{D}/sitemap.xml": (200, urlset(f"{D}/unseen")),
}
SITES = {1: A, 2: B, 3: C, 4: D}
PARSED = {
    f"{A}/main.xml": ("index", [f"{A}/s1.xml", "", f"{A}/s2.xml", f"{A}/gone.xml"]),
    f"{A}/s1.xml": ("urlset", [f"{A}/1", f"{A}/2", "", f"{A}/1"]),
    f"{A}/s2.xml": ("urlset", [f"{A}/3", f"{A}/2", f" {A}/4 "]),
    f"{A}/more.xml": ("urlset", [f"{A}/0", f"{A}/5"]),
    f"{B}/sitemap.xml": ("urlset", [f"{B}/x"]),
    LOOP: ("index", [LOOP, f"{A}/s1.xml", LOOP]),
}
ROOTS = {
    1: [f"{A}/main.xml", f"{A}/more.xml"],
    2: [f"{B}/sitemap.xml", f"{B}/sitemap_index.xml"],
    3: [LOOP],
    4: [f"{D}/bad.xml", f"{D}/page.html"],
}


def walked(max_depth=5):
    """urls in order, sitemaps found, and (address, depth) of errors, per crawl."""
    out = {}
    for crawl, roots in ROOTS.items():
        urls, found, errors = [], 0, []

        def visit(url, depth):
            nonlocal found
            if depth > max_depth or url not in PARSED:
                errors.append((url, depth))
                return
            found += 1
            kind, locs = PARSED[url]
            for loc in filter(None, locs):
                if kind == "index":
                    visit(loc, depth + 1)
                elif loc not in urls:
                    urls.append(loc)

        for root in roots:
            visit(root, 0)
        out[crawl] = (urls, found, errors)
    return out


@pytest.fixture
def web(spark):
    documents = spark.createDataFrame([(u, s, b) for u, (s, b) in WEB.items()], DOCUMENTS)
    sites = spark.createDataFrame(list(SITES.items()), "crawl_id long, website string")
    return sites, documents


def check(found, want):
    stats = {r["crawl_id"]: r for r in found.stats.collect()}
    errors = [(r["crawl_id"], r["sitemap_url"], r["depth"]) for r in found.errors.collect()]
    rows = sorted(found.urls.collect(), key=lambda r: (r["crawl_id"], r["path"]))
    for crawl, (urls, sitemaps_found, failed) in want.items():
        assert [r["url"] for r in rows if r["crawl_id"] == crawl] == urls
        assert stats[crawl]["urls_found"] == len(urls)
        assert stats[crawl]["sitemaps_found"] == sitemaps_found
        assert stats[crawl]["errors"] == len(failed)
        assert sorted(e[1:] for e in errors if e[0] == crawl) == sorted(failed)


def test_walk(web):
    check(discover(*web), walked())


def test_walk_with_hot_sitemaps(web, tiny_salts):
    check(discover(*web), walked())


def test_walk_over_repeated_captures(spark, web):
    """Of several captures of an address the first counts."""
    sites, documents = web
    first = documents.withColumn("capture_id", F.monotonically_increasing_id())
    later = first.withColumn("capture_id", F.col("capture_id") + 2**50).withColumn("body", F.lit("<urlset/>"))
    check(discover(sites, later.unionByName(first)), walked())


def test_shallow_walk(web):
    check(discover(*web, max_depth=1), walked(max_depth=1))


def test_error_texts(web):
    errors = {(r["crawl_id"], r["sitemap_url"]): r["error"] for r in discover(*web).errors.collect()}
    assert errors[1, f"{A}/gone.xml"] == f"fetching {A}/gone.xml: unexpected status 404 for {A}/gone.xml"
    assert errors[2, f"{B}/sitemap_index.xml"] == (
        f"fetching {B}/sitemap_index.xml: empty response body for {B}/sitemap_index.xml"
    )
    assert errors[3, LOOP] == f"max recursion depth exceeded at {LOOP}"
    assert errors[4, f"{D}/bad.xml"].startswith(f"parsing {D}/bad.xml: ")
    assert errors[4, f"{D}/page.html"].endswith("unexpected root element <html>")


def test_roots(web):
    got = {}
    for r in sorted(sitemap_roots(*web).collect(), key=lambda r: r["path"]):
        got.setdefault(r["crawl_id"], []).append(r["sitemap_url"])
    assert got == ROOTS


def test_parsing(spark):
    bodies = {
        "urlset": '<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n'
        "  <url><loc>https://e.test/</loc><lastmod>2024-01-01</lastmod><priority>0.5</priority></url>\n"
        "  <url><loc>https://e.test/a?b=1&amp;c=2</loc></url>\n  <url><loc></loc></url><url/>"
        "  <url><loc><![CDATA[https://e.test/c]]></loc></url>\n</urlset>",
        "index": '<s:sitemapindex xmlns:s="x"><s:sitemap><s:loc>https://e.test/1.xml</s:loc></s:sitemap></s:sitemapindex>',
        "empty urlset": "<urlset/>",
        "text before": "junk <urlset><url><loc>t</loc></url></urlset>",
        "text after": "<urlset><url><loc>t</loc></url></urlset> junk",
        "unknown": "<html><body>not a sitemap</body></html>",
        "cut off": "<urlset><url><loc>broken",
        "bare &": "<urlset><url><loc>a&b</loc></url></urlset>",
        "no xml": "hello",
    }
    parsed = parse_sitemaps(spark.createDataFrame([(k, 200, b) for k, b in bodies.items()], DOCUMENTS))
    kinds = {r["sitemap_url"]: (r["kind"], r["error"] is None) for r in parsed.collect()}
    assert kinds == {
        "urlset": ("urlset", True),
        "index": ("index", True),
        "empty urlset": ("urlset", True),
        "text before": ("urlset", True),
        "text after": ("urlset", True),
        "unknown": (None, False),
        "cut off": (None, False),
        "bare &": (None, False),
        "no xml": (None, False),
    }
    rows = [tuple(r) for r in sitemap_entries(parsed).where("sitemap_url in ('urlset', 'index')").collect()]
    assert sorted(rows, key=lambda r: (r[0], r[2])) == [
        ("index", "index", 0, "https://e.test/1.xml", None, None, None),
        ("urlset", "urlset", 0, "https://e.test/", "2024-01-01", None, "0.5"),
        ("urlset", "urlset", 1, "https://e.test/a?b=1&c=2", None, None, None),
        ("urlset", "urlset", 4, "https://e.test/c", None, None, None),
    ]


@pytest.mark.parametrize("cap", [3, 0, 20_000])
def test_plan(web, cap):
    sites, _ = web
    found = discover(*web)
    got = {}
    for r in sorted(crawl_plan(sites, found.urls, cap).collect(), key=lambda r: r["position"]):
        got.setdefault(r["crawl_id"], []).append((r["position"], r["url"]))
    for crawl, (urls, _, _) in walked().items():
        want = (urls or [SITES[crawl]])[: cap if cap > 0 else None]
        assert got[crawl] == list(enumerate(want, start=1))


def test_plan_keeps_a_website_that_its_sitemap_lists(spark):
    sites = spark.createDataFrame([(1, "https://w.test")], "crawl_id long, website string")
    urls = spark.createDataFrame(
        [(1, "https://w.test/a", [0, 0]), (1, "https://w.test", [0, 1])], "crawl_id long, url string, path array<int>"
    )
    got = sorted((r["position"], r["url"]) for r in crawl_plan(sites, urls).collect())
    assert got == [(1, "https://w.test/a"), (2, "https://w.test")]


def test_bodies_are_not_read_while_following_indexes(spark, tmp_path):
    """The URL lists are partitioned away from the indexes."""
    from spinneret.session import written

    documents = spark.createDataFrame([(u, s, b) for u, (s, b) in WEB.items()], DOCUMENTS)
    parsed = written(parse_sitemaps(documents), "test-sitemaps", partition_by="kind")
    plan = parsed.where(F.col("kind") == "index").select("sitemap_url")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(kind" in plan
