"""Ordering and join building blocks, against brute force."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from spinneret.operators import joins, ordering
from spinneret.operators.joins import lookup, without
from spinneret.operators.ordering import first_n, first_per_key, numbered


def skewed_rows(n=600, seed=1):
    """A third of the rows in one group."""
    rnd = random.Random(seed)
    paths = rnd.sample([[a, b] if b % 3 else [a] for a in range(40) for b in range(40)], n)
    unique = list({tuple(p) for p in paths})
    return [(0 if i % 3 == 0 else rnd.randrange(1, 20), list(p), f"u{i}") for i, p in enumerate(unique)]


def brute_positions(rows):
    groups = defaultdict(list)
    for group, path, url in rows:
        groups[group].append((path, url))
    return {(g, url, i) for g, items in groups.items() for i, (_, url) in enumerate(sorted(items), start=1)}


@pytest.mark.parametrize("n", [1, 7, 0, ordering.MAX_SALTED + 1])
def test_first_n(spark, n):
    rows = skewed_rows()
    df = spark.createDataFrame(rows, "g int, path array<int>, url string").repartition(5)
    got = {tuple(r) for r in first_n(df, "g", "path", n).select("g", "url", "position").collect()}
    want = {r for r in brute_positions(rows) if n <= 0 or r[2] <= n}
    assert got == want


def test_first_n_does_not_depend_on_partitions(spark):
    rows = skewed_rows(seed=2)
    df = spark.createDataFrame(rows, "g int, path array<int>, url string")
    seen = set()
    for parts in ("1", "3", "11"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = first_n(df.repartition(int(parts)), "g", "path", 9).select("g", "url", "position")
        seen.add(frozenset(tuple(r) for r in got.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(seen) == 1


def test_numbered_over_the_whole_table(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(7)
    got = {r["x"]: r["position"] for r in numbered(df, ["x"]).collect()}
    assert got == {x: x + 1 for x in range(1000)}


def test_first_per_key(spark):
    rows = [("hot" if i % 3 else f"k{i}", 1000 - i) for i in range(60)]
    want = {}
    for k, seq in rows:
        want[k] = min(seq, want.get(k, seq))
    got = first_per_key(spark.createDataFrame(rows, "k string, seq int"), ["k"], "seq").collect()
    assert {r["k"]: r["seq"] for r in got} == want


@pytest.mark.parametrize("most", [0, 500_000])
def test_without(spark, monkeypatch, most):
    monkeypatch.setattr(joins, "MAX_BROADCAST_ROWS", most)
    df = spark.range(100)
    for unwanted in (set(), {5}, set(range(0, 100, 3))):
        keys = spark.createDataFrame([(i,) for i in unwanted], "id long")
        kept = without(df, keys, "id")
        assert {r["id"] for r in kept.collect()} == set(range(100)) - unwanted
        assert ("strategy=broadcast" in kept._jdf.queryExecution().toString()) == bool(most and unwanted)


def lookup_case(spark):
    left = [(i, "hot" if i % 3 == 0 else (None if i % 3 == 1 else f"k{i}")) for i in range(90)]
    right = [("hot", "H"), *[(f"k{i}", f"v{i}") for i in range(0, 90, 2)]]
    values = dict(right)
    want = {(i, values.get(k)) for i, k in left}
    return (
        spark.createDataFrame(left, "i int, k string"),
        spark.createDataFrame(right, "k string, v string"),
        want,
    )


def test_lookup_with_hot_keys(spark, tiny_salts):
    left, right, want = lookup_case(spark)
    assert joins.hot_keys(left, "k").collect() == [("hot", 15)]
    got = [tuple(r) for r in lookup(left, right, "k", ["i"]).select("i", "v").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    inner = [tuple(r) for r in lookup(left, right, "k", ["i"], "inner").select("i", "v").collect()]
    assert sorted(inner) == sorted(r for r in want if r[1])


def test_lookup_splits_every_hot_key(spark, tiny_salts):
    left = spark.createDataFrame([(i, f"k{i % 4 if i % 4 < 3 else 0}") for i in range(40)], "i int, k string")
    right = spark.createDataFrame([(f"k{i}", i) for i in range(4)], "k string, v int")
    assert sorted(joins.hot_keys(left, "k").collect()) == [("k0", 10), ("k1", 5), ("k2", 5)]
    got = sorted(tuple(r) for r in lookup(left, right, "k", ["i"]).select("i", "v").collect())
    assert got == [(i, i % 4 if i % 4 < 3 else 0) for i in range(40)]


def test_heavy_right_rows_split_a_key_of_few_left_rows(spark):
    left, right, want = lookup_case(spark)
    assert joins.rows_per_task(0) == joins.rows_per_task(1) == joins.ROWS_PER_SALT
    assert joins.rows_per_task(50_000) == 100 and joins.rows_per_task(10**9) == 1
    plans = set()
    for per_task in (1, 29, 30, 89, 90, None):
        joined = lookup(left, right, "k", ["i"], rows=90, per_task=per_task).select("i", "v")
        plans.add("_salt" in joined._jdf.queryExecution().toString())
        got = [tuple(r) for r in joined.collect()]
        assert len(got) == 90 and set(got) == want and joined.dtypes == [("i", "int"), ("v", "string")]
    assert plans == {True, False}


def test_lookup_without_hot_keys(spark):
    left, right, want = lookup_case(spark)
    for rows in (None, 90):
        got = {tuple(r) for r in lookup(left, right, "k", ["i"], rows=rows).select("i", "v").collect()}
        assert got == want


def test_early_group_limit_is_planned(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.createDataFrame(skewed_rows(), "g int, path array<int>, url string").write.parquet(path)
    plan = first_n(spark.read.parquet(path), "g", "path", 5000)._jdf.queryExecution().toString()
    # per salt and per group, each before its shuffle and after it
    assert plan.count("WindowGroupLimit") >= 4
