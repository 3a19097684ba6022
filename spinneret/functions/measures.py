"""Sizes and durations."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_length(body: Column) -> Column:
    """Bytes of the body as read, not a header's claim."""
    return F.octet_length(body).cast("long")


def whole_millis(micros: Column) -> Column:
    """Microseconds to whole milliseconds, fractions dropped."""
    return F.floor(micros / 1000).cast("int")
