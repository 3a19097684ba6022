"""Yes/no rules on crawl and page columns. None of them returns null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spinneret.schemas import TERMINAL_STATUSES


def fetch_succeeded(status_code: Column, error: Column) -> Column:
    """A response came back, whatever its status."""
    return error.isNull() & status_code.isNotNull()


def page_succeeded(status_code: Column) -> Column:
    """The page itself is good: 2xx or 3xx."""
    return F.coalesce(status_code.between(200, 399), F.lit(False))


def counts_as_success(status_code: Column, error: Column) -> Column:
    """What a crawl's success counter counts: fetched, with a 2xx status."""
    return F.coalesce(fetch_succeeded(status_code, error) & status_code.between(200, 299), F.lit(False))


def is_terminal(status: Column) -> Column:
    return F.coalesce(status.isin(*TERMINAL_STATUSES), F.lit(False))


def is_html(content_type: Column) -> Column:
    kind = F.lower(content_type)
    return F.coalesce(kind.contains("text/html") | kind.contains("application/xhtml+xml"), F.lit(False))


def body_accepted(status_code: Column, body: Column) -> Column:
    """A captured robots or sitemap body that can be used; its type is ignored."""
    return F.coalesce(status_code.between(200, 299) & (body != ""), F.lit(False))
