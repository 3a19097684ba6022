"""Table schemas. Nothing is inferred at read time."""

from pyspark.sql import types as T

# The states a crawl can be in, and those that end it.
CRAWL_STATUSES = ("pending", "running", "completed", "failed")
TERMINAL_STATUSES = ("completed", "failed")

SEEDS = T.StructType(
    [
        T.StructField("seed_id", T.LongType(), False),
        T.StructField("website_raw", T.StringType()),
    ]
)

CRAWLS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("website", T.StringType(), False),
        T.StructField("status", T.StringType(), False),
        T.StructField("total_pages", T.IntegerType(), False),
        T.StructField("success_pages", T.IntegerType(), False),
        T.StructField("failed_pages", T.IntegerType(), False),
        T.StructField("started_at", T.TimestampType(), False),
        T.StructField("finished_at", T.TimestampType()),
    ]
)

PAGES = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("crawl_id", T.LongType(), False),
        T.StructField("url", T.StringType(), False),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("content_length", T.LongType()),
        T.StructField("response_time_ms", T.IntegerType()),
        T.StructField("title", T.StringType()),
        T.StructField("html", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("created_at", T.TimestampType(), False),
    ]
)

# capture_id is unique and rises in the order of fetching, so "the first
# response of a URL" is well defined.
CAPTURES = T.StructType(
    [
        T.StructField("capture_id", T.LongType(), False),
        T.StructField("url", T.StringType(), False),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("response_time_us", T.LongType()),
        T.StructField("error", T.StringType()),
    ]
)

# Captured robots.txt and sitemap bodies, one row per address (or several, told
# apart by a capture_id of their own).
DOCUMENTS = T.StructType(
    [
        T.StructField("url", T.StringType(), False),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("body", T.StringType()),
    ]
)

HOPS = T.StructType(
    [
        T.StructField("url", T.StringType(), False),
        T.StructField("location", T.StringType()),
    ]
)

CRAWL_COLUMNS = CRAWLS.fieldNames()
PAGE_COLUMNS = PAGES.fieldNames()
# What a listing reads unless the body is asked for.
PAGE_COLUMNS_NO_HTML = [c for c in PAGE_COLUMNS if c != "html"]
