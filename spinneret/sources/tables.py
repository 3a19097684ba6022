"""Typed readers for crawl data."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spinneret import schemas

_STORED_PAGES = T.StructType([*schemas.PAGES.fields, T.StructField("crawl_bucket", T.IntegerType())])

_REPEATED_DOCUMENTS = T.StructType([T.StructField("capture_id", T.LongType()), *schemas.DOCUMENTS.fields])


def read_crawls(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CRAWLS).parquet(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """The stored pages table, with its ``crawl_bucket`` partition column."""
    return spark.read.schema(_STORED_PAGES).parquet(path)


def _read(spark: SparkSession, path: str, schema: T.StructType, fmt: str, options: dict) -> DataFrame:
    return spark.read.schema(schema).format(fmt).options(**options).load(path)


def read_seeds(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Raw websites from Parquet, CSV or JSON files."""
    return _read(spark, path, schemas.SEEDS, fmt, options)


def read_captures(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Captured page responses."""
    return _read(spark, path, schemas.CAPTURES, fmt, options)


def read_documents(
    spark: SparkSession, path: str, fmt: str = "parquet", repeated: bool = True, raw: bool = False, **options
) -> DataFrame:
    """Captured robots.txt and sitemap bodies, with the ``capture_id`` that orders repeats.

    ``repeated=False`` is for tables that hold each body once and have no such column,
    ``raw`` for those that hold bodies as bytes, in whatever encoding they came.
    """
    schema = _REPEATED_DOCUMENTS if repeated else schemas.DOCUMENTS
    if raw:
        schema = T.StructType([T.StructField(f.name, T.BinaryType()) if f.name == "body" else f for f in schema.fields])
    return _read(spark, path, schema, fmt, options)


def read_hops(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Captured redirects."""
    return _read(spark, path, schemas.HOPS, fmt, options)


_RECORD = "_record"


class Read(NamedTuple):
    rows: DataFrame
    rejects: DataFrame  # record, reason


def read_checked(spark: SparkSession, path: str, schema: T.StructType, fmt: str, **options) -> Read:
    """Rows of CSV or JSON files that have a schema, and what the files hold besides.

    A record that cannot be read as the schema says is ``malformed``, and given as it
    stands in the file; one without a value that the schema asks for is ``incomplete``,
    and given as JSON. Every record is in one of the two.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _RECORD, **options}
    loose = [T.StructField(f.name, f.dataType) for f in schema.fields]
    every = _read(spark, path, T.StructType([*loose, T.StructField(_RECORD, T.StringType())]), fmt, options)
    names = [f.name for f in schema.fields]
    bad, missing = F.col(_RECORD).isNotNull(), F.lit(False)
    for field in schema.fields:
        if not field.nullable:
            missing = missing | F.col(field.name).isNull()
    # Readers refuse a query for the record alone, so it takes nothing from each column.
    nothing = F.concat_ws("", *[F.substring(F.col(c).cast("string"), 1, 0) for c in names])
    rejects = every.where(bad | missing).select(
        F.when(bad, F.concat(F.col(_RECORD), nothing)).otherwise(F.to_json(F.struct(*names))).alias("record"),
        F.when(bad, "malformed").otherwise("incomplete").alias("reason"),
    )
    return Read(every.where(~bad & ~missing).select(*names), rejects)
