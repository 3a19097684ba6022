"""Reading captured robots.txt and sitemap bodies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INDEX, URLSET, UNKNOWN = "index", "urlset", "unknown"

# Where a sitemap is looked for when robots.txt names none.
COMMON_PATHS = ("/sitemap.xml", "/sitemap_index.xml")

# Root element by sitemap kind.
_KIND_OF_ROOT = {"urlset": URLSET, "sitemapindex": INDEX}

_SITEMAP_LINE = r"(?im)^[ \t]*sitemap[ \t]*:[ \t]*([^\s#]\S*)"
_ROOT = (
    r"(?s)^[^<]*+(?:(?:"
    r"<\?.*?\?>"
    r"|<!--.*?-->"
    r"|<!DOCTYPE[^>\[]*(?:\[.*?\]\s*)?>"
    r")[^<]*+)*+<([A-Za-z_][^\s/>]*)"
)
_BAD = "_bad"
_SCHEMA = (
    "url array<struct<loc string, lastmod string, changefreq string, priority string>>, "
    f"sitemap array<struct<loc string, lastmod string>>, {_BAD} string"
)
_OPTIONS = {
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": _BAD,
    "ignoreSurroundingSpaces": "false",
    "ignoreNamespace": "true",
}


def declared_sitemaps(robots_body: Column) -> Column:
    """Addresses on the ``Sitemap:`` lines of a robots.txt, in order."""
    return F.regexp_extract_all(robots_body, F.lit(_SITEMAP_LINE), F.lit(1))


def root_name(body: Column) -> Column:
    """Local name of the root element; ``''`` when there is none."""
    return F.regexp_extract(F.regexp_extract(body, _ROOT, 1), r"([^:]*)\z", 1)


def sitemap_kind(root: Column) -> Column:
    kind = F.lit(UNKNOWN)
    for name, value in _KIND_OF_ROOT.items():
        kind = F.when(root == name, value).otherwise(kind)
    return kind


def xml_record(body: Column) -> Column:
    """Struct with arrays ``url`` and ``sitemap``, and ``_bad`` if malformed."""
    return F.from_xml(F.regexp_replace(body, r"\A[^<]+", ""), _SCHEMA, _OPTIONS)


def entries(record: Column, kind: Column) -> Column:
    """Entries that name an address, with their place in the document."""
    full = "array<struct<loc:string,lastmod:string,changefreq:string,priority:string>>"
    of_index = F.transform(
        record["sitemap"],
        lambda e: F.struct(
            e["loc"].alias("loc"),
            e["lastmod"].alias("lastmod"),
            F.lit(None).cast("string").alias("changefreq"),
            F.lit(None).cast("string").alias("priority"),
        ),
    )
    listed = F.coalesce(F.when(kind == INDEX, of_index).otherwise(record["url"]), F.array().cast(full))
    return F.filter(
        F.transform(
            listed,
            lambda e, i: F.struct(
                i.alias("pos"),
                e["loc"].alias("loc"),
                e["lastmod"].alias("lastmod"),
                e["changefreq"].alias("changefreq"),
                e["priority"].alias("priority"),
            ),
        ),
        lambda e: F.coalesce(e["loc"], F.lit("")) != "",
    )
