"""Sitemaps in declared encodings, as strings and as bytes."""

import pytest

from spinneret.functions.encodings import decode
from spinneret.operators.discovery import discover, parse_sitemaps
from spinneret.sources.tables import read_documents

TEXT = "<urlset><url><loc>https://h.test/é</loc></url></urlset>"


def head(encoding, version="1.0"):
    return f'<?xml version="{version}" encoding="{encoding}"?>'


BODIES = {
    "plain": TEXT.encode(),
    "own": (head("uTf-8") + TEXT).encode(),
    "mark": b"\xef\xbb\xbf" + TEXT.encode(),
    "latin": (head("ISO-8859-1") + TEXT).encode("latin-1"),
    "quoted": (head("ISO-8859-1").replace('"', "'") + TEXT).encode("latin-1"),
    "wide": (head("UTF-16") + TEXT).encode("utf-16"),
    "wide without mark": (head("UTF-16") + TEXT).encode("utf-16-be"),
    "western": (head("windows-1252") + TEXT).encode("cp1252"),
    "wrong": (head("utf-8") + TEXT).encode("latin-1"),
    "unknown": (head("x-none") + TEXT).encode(),
    "not text": (head("hex") + TEXT).encode(),
    "half": (head("UTF-16") + TEXT).encode("utf-16")[:-1],
    "version": (head("utf-8", "1.1") + TEXT).encode(),
    "in the text": ("<urlset><!-- <?xml encoding=\"x\"?> --><url><loc>https://h.test/é</loc></url></urlset>").encode(),
    "empty": b"",
    "none": None,
}


def found(df, decode):
    return {
        r["sitemap_url"]: (r["kind"] and [e["loc"] for e in r["entries"]], r["error"] and r["error"].split(": ", 1)[1])
        for r in parse_sitemaps(df, decode).collect()
    }


READ = (["https://h.test/é"], None)


def refused(reason):
    return None, f"detecting sitemap type: {reason} is not read"


ALWAYS = {
    **dict.fromkeys(("plain", "own", "mark", "in the text"), READ),
    "wrong": (None, "parsing urlset xml: invalid UTF-8"),
    "unknown": refused('encoding "x-none"'),
    "not text": refused('encoding "hex"'),
    "half": refused('encoding "UTF-16"'),
    "version": refused('version "1.1"'),
    "empty": (None, "empty response body for empty"),
    "none": (None, "empty response body for none"),
}


@pytest.fixture
def raw(spark):
    return spark.createDataFrame([(k, 200, v) for k, v in BODIES.items()], "url string, status_code int, body binary")


def test_bytes_in_other_encodings_are_errors(raw):
    wide = refused('encoding "UTF-16"')
    latin = refused('encoding "ISO-8859-1"')
    assert found(raw, False) == ALWAYS | {
        "latin": latin, "quoted": latin, "wide": wide, "wide without mark": wide, "western": refused('encoding "windows-1252"'),
    }


def test_bytes_are_decoded_as_declared(raw):
    assert found(raw, True) == ALWAYS | dict.fromkeys(("latin", "quoted", "wide", "wide without mark", "western"), READ)


def test_strings(spark):
    rows = [(k, 200, (head(k) + TEXT) if k else TEXT) for k in ("", "utf-8", "ISO-8859-1", "UTF-16")]
    strings = spark.createDataFrame(rows, "url string, status_code int, body string")
    assert found(strings, False) == {
        "": READ, "utf-8": READ, "ISO-8859-1": refused('encoding "ISO-8859-1"'), "UTF-16": refused('encoding "UTF-16"'),
    }
    assert found(strings, True) == dict.fromkeys(("", "utf-8", "ISO-8859-1", "UTF-16"), READ)
    errors = spark.createDataFrame([("a", 404, BODIES["latin"]), ("b", None, BODIES["latin"])], "url string, status_code int, body binary")
    assert {k: v[1].split(" ")[0] for k, v in found(errors, True).items()} == {"a": "unexpected", "b": "no"}


def test_no_python_without_decoding(raw):
    plan = parse_sitemaps(raw)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan
    assert "ArrowEvalPython" in parse_sitemaps(raw, True)._jdf.queryExecution().executedPlan().toString()


def test_discovery_over_bytes(spark, tmp_path):
    rows = [
        ("https://h.test/robots.txt", 200, "Sitemap: https://h.test/l.xml\nSitemap: https://h.test/x.xml".encode()),
        ("https://h.test/l.xml", 200, BODIES["latin"]),
        ("https://h.test/x.xml", 200, BODIES["unknown"]),
    ]
    spark.createDataFrame(rows, "url string, status_code int, body binary").write.parquet(str(tmp_path / "d"))
    documents = read_documents(spark, str(tmp_path / "d"), repeated=False, raw=True)
    sites = spark.createDataFrame([(1, "https://h.test")], "crawl_id long, website string")
    for option, urls, errors in ((False, 0, 2), (True, 1, 1)):
        run = discover(sites, documents, decode=option)
        assert (run.urls.count(), run.errors.count()) == (urls, errors)
        assert [tuple(r) for r in run.stats.collect()] == [(1, urls, urls, errors)]


def test_decode():
    assert decode(b"\0<\0a", "utf-16") == "<a"
    assert decode("日".encode("shift_jis"), "Shift_JIS") == "日"
    assert [decode(b"a", x) for x in ("rot13", "unicode_escape", "", "\0", "idna")] == [None] * 5
