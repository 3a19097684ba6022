"""Error texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The wording of errors.
NOT_CAPTURED = "no captured response"
_NO_RESPONSE = f"fetching %s: {NOT_CAPTURED}"
_BAD_STATUS = "fetching %1$s: unexpected status %2$d for %1$s"
_EMPTY_BODY = "fetching %1$s: empty response body for %1$s"
_PARSING = "parsing %s: %s"
_TOO_DEEP = "max recursion depth exceeded at %s"
_TOO_MANY_REDIRECTS = "stopped after {} redirects"
_REQUEST_FAILED = "performing request: %s"


def fetch_refused(url: Column, status_code: Column) -> Column:
    """Why a captured body was not accepted: no response, bad status, or empty."""
    return (
        F.when(status_code.isNull(), F.format_string(_NO_RESPONSE, url))
        .when(~status_code.between(200, 299), F.format_string(_BAD_STATUS, url, status_code))
        .otherwise(F.format_string(_EMPTY_BODY, url))
    )


def parse_failed(url: Column, reason: Column) -> Column:
    return F.format_string(_PARSING, url, reason)


def too_deep(url: Column) -> Column:
    return F.format_string(_TOO_DEEP, url)


def too_many_redirects(max_requests: int) -> str:
    return _TOO_MANY_REDIRECTS.format(max_requests)


def request_failed(reason: Column) -> Column:
    return F.format_string(_REQUEST_FAILED, reason)
