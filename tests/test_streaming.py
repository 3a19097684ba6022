"""Streams must end where the batch operators do."""

import os
import random
from datetime import datetime, timedelta

import pytest
from conftest import TESTDATA

from spinneret.operators.rollup import rollup
from spinneret.schemas import PAGES
from spinneret.sources.tables import read_pages
from spinneret.sources import files
from spinneret.streaming.counters import count_pages_live, fold, folded_to, latest_counters
from spinneret.streaming.ingest import ingest_pages
from spinneret.workload import inputs
from spinneret.workload.queries import QUERIES


@pytest.fixture
def arrivals(spark, tmp_path):
    """Five files, in order of arrival; keys repeat within and across files."""
    rnd, path, rows = random.Random(3), str(tmp_path / "arrivals"), []
    for day in range(5):
        part = []
        for i in range(40):
            seq = day * 40 + i
            status = rnd.choice([200, 200, 404, None])
            part.append(
                (seq, rnd.choice([1, 1, 1, 2, 3]), f"u{rnd.randrange(30)}", status, "", 0, 1, None, None,
                 None if status else "x", datetime(2024, 1, 1) + timedelta(days=day))
            )
        rows += part
        spark.createDataFrame(part, PAGES).coalesce(1).write.mode("append").parquet(path)
        for name in os.listdir(path):
            file = os.path.join(path, name)
            if name.endswith(".parquet") and not os.path.exists(file + ".seen"):
                os.utime(file, (1_700_000_000 + day, 1_700_000_000 + day))
                open(file + ".seen", "w").close()
    for name in os.listdir(path):
        if name.endswith(".seen"):
            os.remove(os.path.join(path, name))
    return path, rows


def stream(spark, path):
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", 1).parquet(path)


def test_ingest_keeps_the_first(spark, tmp_path, arrivals):
    path, rows = arrivals
    want = {}
    for row in rows:
        want.setdefault((row[1], row[2]), row[0])
    table = str(tmp_path / "pages")
    for run in ("a", "b"):  # the second run replays everything
        ingest_pages(stream(spark, path), table, str(tmp_path / f"state-{run}")).awaitTermination()
        stored = read_pages(spark, table).collect()
        assert len(stored) == len(want)
        assert {(r["crawl_id"], r["url"]): r["id"] for r in stored} == want


def test_tables_of_many_files_are_streamed_whole(spark, tmp_path):
    """The registered stream over a folder of files, as a larger table has."""
    if not os.path.isdir(TESTDATA):
        pytest.skip("no test tables")
    events = spark.read.parquet(f"{TESTDATA}/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    got = {tuple(r) for r in QUERIES["stream_counters"](spark, str(tmp_path)).collect()}
    assert got == {tuple(r) for r in rollup(inputs.event_results(events)).collect()}
    stored = QUERIES["stream_ingest"](spark, str(tmp_path))
    keys = events.select("user_id", (events.event_id % 5000).alias("url")).distinct()
    assert stored.count() == keys.count() == stored.select("crawl_id", "url").distinct().count()


def test_counters_end_like_the_rollup(spark, tmp_path, arrivals):
    path, _ = arrivals
    counted = str(tmp_path / "counters")
    query = count_pages_live(stream(spark, path), counted, str(tmp_path / "state"))
    query.awaitTermination()
    assert len(os.listdir(f"{counted}/updates")) == 5  # one folder per micro-batch
    batch = {tuple(r) for r in rollup(spark.read.schema(PAGES).parquet(path)).collect()}
    assert {tuple(r) for r in latest_counters(spark, counted).collect()} == batch


def test_folded_counters_cost_one_row_a_crawl(spark, tmp_path, arrivals):
    path, _ = arrivals
    counted, state = str(tmp_path / "counters"), str(tmp_path / "state")
    want = {tuple(r) for r in rollup(spark.read.schema(PAGES).parquet(path)).collect()}
    count_pages_live(stream(spark, path), counted, state, fold_every=1).awaitTermination()
    assert folded_to(spark, counted) == 4
    latest = latest_counters(spark, counted)
    assert "Exchange" not in latest._jdf.queryExecution().executedPlan().toString()
    stored = spark.read.parquet(f"{counted}/snapshots/4")
    assert stored.count() == stored.select("crawl_id").distinct().count() == len(want)
    assert {tuple(r) for r in latest.collect()} == want
    # What the snapshot before the last does not need is gone; a reader of it still reads.
    assert sorted(os.listdir(f"{counted}/snapshots")) == ["3", "4"]
    assert {x for x in os.listdir(f"{counted}/updates") if x.startswith("batch")} == {"batch_id=4"}
    # Batches that were counted by a snapshot are not counted again when they are replayed.
    spark.read.parquet(f"{counted}/snapshots/3").write.mode("overwrite").parquet(f"{counted}/updates/batch_id=2")
    assert {tuple(r) for r in latest_counters(spark, counted).collect()} == want


def test_counters_between_folds(spark, tmp_path, arrivals):
    path, _ = arrivals
    counted = str(tmp_path / "counters")
    count_pages_live(stream(spark, path), counted, str(tmp_path / "state"), fold_every=3).awaitTermination()
    assert folded_to(spark, counted) == 2  # batches 3 and 4 came since
    want = {tuple(r) for r in rollup(spark.read.schema(PAGES).parquet(path)).collect()}
    assert {tuple(r) for r in latest_counters(spark, counted).collect()} == want
    # A fold that failed before it was published is written again.
    spark.range(1).write.parquet(f"{counted}/snapshots/4")
    assert {tuple(r) for r in latest_counters(spark, counted).collect()} == want
    fold(spark, counted, 4)
    assert {tuple(r) for r in latest_counters(spark, counted).collect()} == want


def test_counters_of_nothing(spark, tmp_path):
    assert latest_counters(spark, str(tmp_path / "nothing")).count() == 0
    assert files.names(spark, str(tmp_path / "nothing")) == []
