"""The versioned pages table: keys, deletes, folds, failures in between, and its plans."""

import glob
import os
import re
from datetime import datetime

import pytest

from spinneret.schemas import PAGES
from spinneret.sources import page_table
from spinneret.sources.page_table import SPAN, PageTable
from spinneret.streaming.ingest import ingest_into

WHEN = datetime(2024, 1, 1)


def rows_of(spark, *keys, first=0, **more):
    rows = [
        {"id": first + i, "crawl_id": c, "url": u, "created_at": WHEN, "html": "<p>" * 50, **more}
        for i, (c, u) in enumerate(keys)
    ]
    return spark.createDataFrame([tuple(r.get(f) for f in PAGES.fieldNames()) for r in rows], PAGES)


def ids(df):
    return sorted(r["id"] for r in df.collect())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def table(spark, tmp_path):
    return PageTable(spark, str(tmp_path / "table"))


def test_an_empty_table(spark, table):
    assert table.version() == 0 and table.read().isEmpty() and table.list_after(1).isEmpty()
    table.insert_new(rows_of(spark))
    table.delete(spark.createDataFrame([], "id long"))
    table.compact()
    assert table.version() == 1 and table.read().isEmpty()


def test_first_of_a_key_stays(spark, table):
    table.insert_new(rows_of(spark, (1, "a"), (1, "b"), (1, "a"), (2, "a")))
    table.insert_new(rows_of(spark, (1, "b"), (2, "b"), (SPAN * 3, "b"), first=10))
    assert ids(table.read()) == [0, 1, 3, 11, 12]
    table.insert_new(rows_of(spark, (1, "b"), (2, "b"), (SPAN * 3, "b"), first=20))
    assert ids(table.read()) == [0, 1, 3, 11, 12]


def test_only_keys_that_may_collide_are_read(spark, table):
    table.insert_new(rows_of(spark, (1, "a"), (2, "a"), (1 + SPAN, "a"), (1 + 5 * SPAN, "a")))
    batch = rows_of(spark, (1, "a"), (1, "new"), first=50)
    plan = plan_of(table.keys_near(batch))
    assert re.search(r"PartitionFilters: \[[^]]*crawl_bucket[^]]*crawl_span", plan) or re.search(
        r"PartitionFilters: \[[^]]*crawl_span[^]]*crawl_bucket", plan
    )
    assert re.search(r"PushedFilters: \[[^]]*(In|EqualTo)\(crawl_id", plan)
    # Files of other buckets and spans are not even opened: break them.
    for file in glob.glob(f"{table._at('keys')}/*/*/*.parquet"):
        if "crawl_bucket=1/crawl_span=0/" not in file:
            with open(file, "wb") as broken:
                broken.write(b"not a table")
            os.remove(os.path.join(os.path.dirname(file), f".{os.path.basename(file)}.crc"))
    table.insert_new(batch)
    assert ids(table.read()) == [0, 1, 2, 3, 51]


def test_many_crawls_are_not_named(spark, table, monkeypatch):
    monkeypatch.setattr(page_table, "MAX_NAMED", 1)
    table.insert_new(rows_of(spark, (1, "a"), (2, "a")))
    table.insert_new(rows_of(spark, (1, "a"), (2, "a"), (SPAN, "a"), first=10))
    assert ids(table.read()) == [0, 1, 12]


def test_delete_touches_no_page_file(spark, table):
    table.insert_new(rows_of(spark, (1, "a"), (1, "b"), (2, "a"), (65, "a")))
    files = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{table._at('pages')}/**/*.parquet", recursive=True)}
    table.delete(spark.createDataFrame([(1,), (None,), (77,)], "id long"))
    assert {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{table._at('pages')}/**/*.parquet", recursive=True)} == files
    assert ids(table.read()) == [2, 3]
    table.insert_new(rows_of(spark, (1, "late"), (2, "late"), first=10))
    assert ids(table.read()) == [2, 3, 11]


def test_readers_see_one_version_during_a_fold(spark, table):
    table.insert_new(rows_of(spark, (1, "a"), (2, "a")))
    table.delete(spark.createDataFrame([(1,)], "id long"))
    before = table.read()
    following = f"{table.root}/v00000001/pages"
    os.makedirs(following)  # what a fold that failed leaves
    with open(f"{following}/half.parquet", "w") as half:
        half.write("x")
    assert ids(table.read()) == [1]
    table.compact()
    assert table.version() == 1 and table.deleted() is None
    assert ids(before) == [1] and ids(table.read()) == [1]
    table.expire()
    assert [n for n in os.listdir(table.root) if n.startswith("v")] == ["v00000001"]
    table.insert_new(rows_of(spark, (2, "a"), (2, "c"), first=10))
    assert ids(table.read()) == [1, 11]


@pytest.mark.parametrize("where", ["_write_pages", "_write_keys"])
def test_a_failed_insert_is_tried_again(spark, table, monkeypatch, where):
    table.insert_new(rows_of(spark, (1, "a"), (2, "a")))
    batch = rows_of(spark, (1, "a"), (1, "b"), (3, "b"), first=10)

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as broken:
        owner = page_table.store if where == "_write_pages" else PageTable
        broken.setattr(owner, where, fail)
        with pytest.raises(OSError):
            table.insert_new(batch)
    table.insert_new(batch)
    assert ids(table.read()) == [0, 1, 11, 12]
    table.insert_new(batch)
    assert ids(table.read()) == [0, 1, 11, 12]


def test_listing_sorts_no_bodies(spark, table):
    table.insert_new(rows_of(spark, *[(1, f"u{i}") for i in range(30)], (2, "a")))
    seen, after = [], None
    while True:
        rows = table.list_after(1, after, limit=7, with_html=True)
        plan = plan_of(rows)
        assert "TakeOrdered" not in plan
        found = ids(rows)
        if not found:
            break
        assert "crawl_bucket" in plan
        seen, after = seen + found, found[-1]
    assert seen == list(range(30))
    assert "html" not in table.list_after(1).columns
    with pytest.raises(ValueError):
        table.list_after(1, limit=0)


def test_stream_of_files_into_stored_rows(spark, table, tmp_path):
    table.insert_new(rows_of(spark, (1, "u0"), (2, "u1")))
    path = str(tmp_path / "arrivals")
    keys = [[(1, "u0"), (1, "u2"), (1, "u2")], [(1, "u2"), (3, "u3")], [(2, "u1"), (2, "u4")]]
    for i, part in enumerate(keys):
        rows_of(spark, *part, first=10 * (i + 1)).coalesce(1).write.mode("append").parquet(path)
    for state in ("a", "b"):  # the second run replays everything
        stream = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", 1).parquet(path)
        query = ingest_into(stream, table, str(tmp_path / state))
        query.awaitTermination()
        assert len(query.recentProgress) >= 3
        assert ids(table.read()) == [0, 1, 11, 21, 31]


def test_keys_are_not_broadcast(spark, table, monkeypatch):
    from spinneret.operators import changes

    table.insert_new(rows_of(spark, (1, "a"), (2, "a")))
    plans, unwanted, write = [], changes.without, table._write_keys
    monkeypatch.setattr(changes, "without", lambda df, keys, *by: plans.append(plan_of(keys)) or unwanted(df, keys, *by))
    monkeypatch.setattr(table, "_write_keys", lambda keys: plans.append(plan_of(keys)) or write(keys))
    table.insert_new(rows_of(spark, (1, "a"), (1, "new"), (1, "new"), first=10))
    assert ids(table.read()) == [0, 1, 11] and len(plans) == 3
    assert all("SortMergeJoin" in p and "Broadcast" not in p for p in plans)
