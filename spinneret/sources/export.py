"""Rows as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spinneret.schemas import CRAWL_COLUMNS, PAGE_COLUMNS

# Columns left out of the JSON when they are null.
_PAGE_OPTIONAL = ("html", "error")
_CRAWL_OPTIONAL = ("finished_at",)

_PAGE_KEPT = tuple(c for c in PAGE_COLUMNS if c not in (*_PAGE_OPTIONAL, "created_at"))
_CRAWL_KEPT = tuple(c for c in CRAWL_COLUMNS if c not in _CRAWL_OPTIONAL)


def _spliced(*objects: Column) -> Column:
    """One JSON object out of several; empty ones add nothing."""
    inner = [F.substr(o, F.lit(2), F.length(o) - 2) for o in objects]
    filled = F.filter(F.array(*inner), lambda x: x != "")
    return F.concat(F.lit("{"), F.array_join(filled, ","), F.lit("}"))


def _exact_times(df: DataFrame) -> DataFrame:
    """Timestamps as text, with as many digits of the second as they hold."""
    digits = lambda c: F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    times = {
        c: F.concat(F.regexp_replace(digits(c), r"\.?0+$", ""), F.lit("Z")) for c, kind in df.dtypes if kind == "timestamp"
    }
    return df.withColumns(times) if times else df


def _with_nulls(*columns: str) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def _without_nulls(*columns: str) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "true"})


def page_json(pages: DataFrame) -> DataFrame:
    """``id, json``: nulls are written, except for html and error."""
    text = _spliced(_with_nulls(*_PAGE_KEPT), _without_nulls(*_PAGE_OPTIONAL), _with_nulls("created_at"))
    return _exact_times(pages).select("id", text.alias("json"))


def crawl_json(crawls: DataFrame) -> DataFrame:
    """``id, json``: the end time is left out while there is none."""
    text = _spliced(_with_nulls(*_CRAWL_KEPT), _without_nulls(*_CRAWL_OPTIONAL))
    return _exact_times(crawls).select("id", text.alias("json"))


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON object per line."""
    rows.select(F.col("json").alias("value")).write.text(path)
