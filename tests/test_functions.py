"""Column expressions against literal cases."""

import random

import pytest
from pyspark.sql import functions as F

from spinneret.functions import measures, predicates, sitemaps, text, titles, urls
from spinneret.schemas import CRAWL_STATUSES


def values(spark, cases, schema, column):
    rows = [(i, *(c if isinstance(c, tuple) else (c,))) for i, c in enumerate(cases)]
    df = spark.createDataFrame(rows, f"n int, {schema}")
    return [r[0] for r in df.select("n", column.alias("out")).orderBy("n").select("out").collect()]


WEBSITES = [
    ("https://example.com", "https://example.com"),
    ("https://example.com/", "https://example.com"),
    ("https://example.com/some/path?q=1", "https://example.com"),
    ("https://EXAMPLE.com", "https://EXAMPLE.com"),
    ("example.com", "https://example.com"),
    ("  https://example.com  ", "https://example.com"),
    ("http://example.com", "http://example.com"),
    (" https://t.test\t\n", "https://t.test"),
    ("HTTP://x.test", "http://x.test"),
    ("http://u:p@h.test:8080/x#top", "http://u:p@h.test:8080#top"),
    ("https://x.test/?", "https://x.test?"),
    ("https://x.test/?a=1", "https://x.test"),
    ("https://x.test#", "https://x.test"),
    ("https://x.test#a b", "https://x.test#a%20b"),
    ("http://exämple.test/ü", "http://ex%C3%A4mple.test"),
    ("http://[::1]:80/x", "http://[::1]:80"),
    ("my_host/path", "https://my_host"),
]
REFUSED = [
    ("", urls.EMPTY),
    ("   ", urls.EMPTY),
    (None, urls.EMPTY),
    ("ftp://example.com", urls.WRONG_SCHEME),
    ("https://", urls.NO_HOST),
    ("http://u@/", urls.NO_HOST),
    ("example.com/go?to=http://y.test", urls.NO_HOST),
    ("://bad-url", urls.UNPARSABLE),
    ("a b.test", urls.UNPARSABLE),
    ("http://h:8x/", urls.UNPARSABLE),
    ("1http://x.test", urls.UNPARSABLE),
    ("http://h.test/%zz", urls.UNPARSABLE),
    ("http://[::1", urls.UNPARSABLE),
    ("http://h.test/a\x01b", urls.UNPARSABLE),
]


def test_websites(spark):
    got = values(spark, [w for w, _ in WEBSITES], "w string", urls.checked_website(F.col("w")))
    assert [tuple(r) for r in got] == [(want, None) for _, want in WEBSITES]


def test_refused_websites(spark):
    got = values(spark, [w for w, _ in REFUSED], "w string", urls.checked_website(F.col("w")))
    assert [tuple(r) for r in got] == [(None, why) for _, why in REFUSED]


URL_BITS = "http|https|HTTP|ftp|://|:|/|//|a.test|B|1|_|-|@|u:p@|:80|:x|?|?q=1|#|#f| |%41|%zz|%E4|é|[::1]|[|\t|\x01|*|&".split("|")


def test_websites_stay_as_they_are_once_normalised(spark):
    rnd = random.Random(5)
    raw = list({"".join(rnd.choice(URL_BITS) for _ in range(rnd.randrange(1, 7))) for _ in range(20_000)})
    checked = values(spark, raw, "w string", urls.checked_website(F.col("w")))
    assert all((r["website"] is None) != (r["reject_reason"] is None) for r in checked)
    accepted = [r["website"] for r in checked if r["website"] is not None]
    assert len(accepted) > 1_000
    again = values(spark, accepted, "w string", urls.checked_website(F.col("w")))
    for before, after in zip(accepted, again):
        assert tuple(after) == (before, None)
        assert before.startswith(("http://", "https://")) and before.isascii()


def test_address_on_host(spark):
    cases = ["http://u:p@h.test:8/x?q#f", "HTTPS://Host.test"]
    got = values(spark, cases, "w string", urls.on_host(F.col("w"), "/robots.txt"))
    assert got == ["http://h.test:8/robots.txt", "https://Host.test/robots.txt"]


def test_trim_space(spark):
    cases = ["  a b \r\n", "　", "x"]
    assert values(spark, cases, "t string", text.trim_space(F.col("t"))) == ["a b", "", "x"]


TITLES = [
    ("<!DOCTYPE html>\n<html>\n<head><title>  Hello World  </title></head>\n<body><h1>Hi</h1></body></html>", "Hello World"),
    ("<!DOCTYPE html><html><body><p>no title here</p></body></html>", ""),
    ("<html><head>\n<title>First Title</title>\n</head><body><title>Body Title</title></body></html>", "First Title"),
    ("", ""),
    (None, None),
    ("<title>  </title>", ""),
    ("<TITLE lang='en'>Up</TITLE >", "Up"),
    ("<title>a &amp; b &lt;c&gt; &quot;d&quot; &#39;e&#39;</title>", "a & b <c> \"d\" 'e'"),
    ("<title>&amp;lt; A & B</title>", "&lt; A & B"),
    ("<title>caf&eacute; &#x4e2d; &copy 1</title>", "café 中 © 1"),
    ("<title>a<b>c</b></title>", "a<b>c</b>"),
    ("<title>unclosed &amp; <b>", "unclosed & <b>"),
    ("<!-- <title>no</title> --><title>yes</title>", "yes"),
    ("<!--[if IE]><title>no</title><![endif]--><title>yes</title>", "yes"),
    ("<script>var a = '<title>no</title>';</script><title>yes</title>", "yes"),
    ("<style>p{}</style><script>var x=1;</script><title>yes</title>", "yes"),
    ("<textarea><title>no</title></textarea><title>yes</title>", "yes"),
    ("<noscript><title>no</title></noscript><title>yes</title>", "yes"),
    ("<meta content='<title>no</title>'><title>yes</title>", "yes"),
    ("<meta content=\"a > b\"><title>yes</title>", "yes"),
    ("<titles>no</titles><title>yes</title>", "yes"),
    ("a < b <title>yes</title>", "yes"),
    ("<body><svg><title>drawing</title></svg>", "drawing"),
    ("<script>never closed <title>no</title>", ""),
    ("<title>one\r\ntwo</title>", "one\ntwo"),
]


def test_titles(spark):
    body = F.col("b")
    got = values(spark, [b for b, _ in TITLES], "b string", titles.html_title(body, titles.plain_title(body)))
    assert got == [want for _, want in TITLES]


MARKUP = (
    "<!DOCTYPE html>|<html>|</html>|<head>|<meta charset=utf-8>|<meta content='a>b'>|<meta content=\"<title>\">|<link href=x>"
    "|<title>|<title>|<title lang='en'>|</title>|</title>|</title >|<TITLE>|</TITLE>|<titles>|<title/>|<!--|-->|<!-- x -->"
    "|<!-->|--!>|<script>|</script>|<style>|</style>|<script src='a'>|<textarea>|</textarea>|<noscript>|<base>|<body>|<p>|<"
    "|>|\"|'|a|B c| |\n|\r\n|&amp;|&lt;|&copy;|&|&#65;|\u00a0|\u4e2d|--|/|="
).split("|")


def test_title_fast_path_agrees_with_the_parser(spark):
    """Random markup: whichever way a title is read, the parser says the same."""
    rnd = random.Random(11)

    def some(most: int) -> str:
        return "".join(rnd.choice(MARKUP) for _ in range(rnd.randrange(most)))

    bodies = [some(7) + "<title>" + some(4) + rnd.choice(["</title>", ""]) + some(4) for _ in range(20_000)]
    body = F.col("b")
    got = values(spark, bodies, "b string", F.struct(titles.html_title(body, titles.plain_title(body)), titles.plain_title(body)))
    answered = 0
    for markup, (title, plain) in zip(bodies, got):
        assert title == titles.first_title(markup).replace("\r\n", "\n").strip(), markup
        answered += plain != ""
    assert answered > 500


def test_content_types(spark):
    cases = [
        ("text/html", True),
        ("text/html; charset=utf-8", True),
        ("TEXT/HTML", True),
        ("application/xhtml+xml", True),
        ("application/json", False),
        ("text/plain", False),
        ("", False),
        ("application/something+text/html; charset=utf-8", True),
        (None, False),
    ]
    got = values(spark, [c for c, _ in cases], "c string", predicates.is_html(F.col("c")))
    assert got == [want for _, want in cases]


def test_page_success(spark):
    cases = [(200, True), (299, True), (301, True), (399, True), (404, False), (500, False), (None, False), (199, False)]
    got = values(spark, [(c,) for c, _ in cases], "c int", predicates.page_succeeded(F.col("c")))
    assert got == [want for _, want in cases]


def test_fetch_and_counter_success(spark):
    cases = [(200, None), (500, None), (None, None), (200, "boom"), (299, None), (300, None)]
    status, error = F.col("s"), F.col("e")
    fetched = values(spark, cases, "s int, e string", predicates.fetch_succeeded(status, error))
    counted = values(spark, cases, "s int, e string", predicates.counts_as_success(status, error))
    assert fetched == [True, True, False, False, True, True]
    assert counted == [True, False, False, False, True, False]


def test_crawl_statuses(spark):
    got = values(spark, list(CRAWL_STATUSES), "s string", predicates.is_terminal(F.col("s")))
    assert dict(zip(CRAWL_STATUSES, got)) == {"pending": False, "running": False, "completed": True, "failed": True}


def test_measures(spark):
    assert values(spark, ["abc", "é中", ""], "b string", measures.byte_length(F.col("b"))) == [3, 5, 0]
    assert values(spark, [(0,), (999,), (1000,), (1999999,)], "u long", measures.whole_millis(F.col("u"))) == [0, 0, 1, 1999]


def test_robots(spark):
    cases = [
        "User-agent: *\nDisallow: /x\nSITEMAP: https://a/1.xml\n  sitemap :https://a/2.xml # main\r\n",
        "Sitemap:\nOther: x",
        "# Sitemap: https://a/no.xml\nSitemap: # none\n",
        "My-sitemap: https://a/no.xml",
        "",
    ]
    got = values(spark, cases, "b string", sitemaps.declared_sitemaps(F.col("b")))
    assert got == [["https://a/1.xml", "https://a/2.xml"], [], [], [], []]


KINDS = [
    ("<urlset/>", "urlset"),
    ('<?xml version="1.0"?><!-- <sitemapindex> -->\n<s:sitemapindex xmlns:s="x"/>', "index"),
    ('<!DOCTYPE urlset [ <!ENTITY a "b"> ]><urlset/>', "urlset"),
    ("﻿<urlset/>", "urlset"),
    ('<?xml version="1.0"?><html><body>not a sitemap</body></html>', "unknown"),
    ("plain", "unknown"),
]


def test_sitemap_kinds(spark):
    got = values(spark, [b for b, _ in KINDS], "b string", sitemaps.sitemap_kind(sitemaps.root_name(F.col("b"))))
    assert got == [want for _, want in KINDS]


def test_percent_encoding_keeps_valid_text(spark):
    got = values(spark, ["a+b", "a b", "\U0001f600"], "t string", text.percent_encoded(F.col("t"), "a-z+"))
    assert got == ["a+b", "a%20b", "%F0%9F%98%80"]


@pytest.mark.parametrize("body", ["<p>", "<", "<!--", "<title", "<title>", "</title>", "<!-->x<title>t"])
def test_parser_takes_anything(body):
    assert titles.first_title(body) == ("t" if body.endswith("t") else "")
