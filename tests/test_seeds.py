from pyspark.sql import functions as F

from spinneret.operators.seeds import (
    accepted_seeds,
    assign_seeds,
    new_crawls,
    rejected_seeds,
    reused_crawls,
)
from spinneret.schemas import CRAWLS, SEEDS


def now():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


def crawl_rows(spark, *rows):
    """Crawls from (id, website, status)."""
    df = spark.createDataFrame(list(rows), "id long, website string, status string")
    for counter in ("total_pages", "success_pages", "failed_pages"):
        df = df.withColumn(counter, F.lit(0))
    return df.withColumn("started_at", now()).withColumn("finished_at", F.lit(None).cast("timestamp"))


def test_accepted_and_rejected_split_the_seeds(spark):
    seeds = spark.createDataFrame([(1, "a.test"), (2, ""), (3, "ftp://a.test"), (4, None)], SEEDS)
    assert [tuple(r) for r in accepted_seeds(seeds).collect()] == [(1, "https://a.test")]
    assert {r["seed_id"] for r in rejected_seeds(seeds).collect()} == {2, 3, 4}


def test_in_flight_websites_are_reused(spark):
    crawls = crawl_rows(
        spark,
        (1, "https://a.test", "running"),
        (2, "https://b.test", "completed"),
        (3, "https://c.test", "pending"),
        (4, "https://d.test", "running"),
    )
    seeds = spark.createDataFrame(
        [(30, "b.test/x"), (10, "a.test"), (20, "c.test/"), (11, "a.test/again"), (40, "new.test"), (31, "b.test")], SEEDS
    )
    accepted = accepted_seeds(seeds)
    assert {r["id"] for r in reused_crawls(accepted, crawls).collect()} == {1, 3}
    started = new_crawls(accepted, crawls, now())
    assert started.schema.fieldNames() == CRAWLS.fieldNames()
    assert {(r["id"], r["website"], r["status"]) for r in started.collect()} == {
        (5, "https://b.test", "pending"),
        (6, "https://new.test", "pending"),
    }
    first = {r["website"]: (r["seed_id"], r["crawl_id"]) for r in assign_seeds(accepted, crawls).collect()}
    assert first["https://a.test"] == (10, 1) and first["https://b.test"] == (30, None)


def test_first_crawls_of_an_empty_table(spark):
    seeds = spark.createDataFrame([(7, "x.test"), (3, "y.test"), (9, "y.test")], SEEDS)
    started = new_crawls(accepted_seeds(seeds), spark.createDataFrame([], CRAWLS), now())
    assert {(r["id"], r["website"]) for r in started.collect()} == {(1, "https://y.test"), (2, "https://x.test")}
