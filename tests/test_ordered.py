import random

import pytest
from pyspark.sql import functions as F

from triledger.operators import skew
from triledger.operators.ordered import gap_islands, ordered_scan, totals_before
from triledger.operators.skew import hot_keys, salted_join


def hot_rows(seed, n):
    """A third of the rows has one key."""
    rng = random.Random(seed)
    keys = ["hot" if rng.random() < 0.34 else f"k{rng.randrange(12)}" for _ in range(n)]
    rows = [(k, rng.randrange(50), i, rng.choice([None, rng.randrange(-20, 20)])) for i, k in enumerate(keys)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("chunks", [1, 3, 17])
def test_scan_equals_plain_walk(spark, chunks):
    rows = hot_rows(chunks, 400)
    df = spark.createDataFrame(rows, "k string, t int, id int, v int")
    out = ordered_scan(df, ["k"], ["t", "id"], totals={"total": F.col("v")}, previous={"before": F.col("v")}, number="n", chunks=chunks)
    got = {r.id: (r.total, r.before, r.n) for r in out.collect()}
    state, expected = {}, {}
    for k, t, i, v in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        total, before, n = state.get(k, (0, None, 0))
        total, n = total + (v or 0), n + 1
        expected[i] = (total, before, n)
        state[k] = (total, v, n)
    assert got == expected


def test_scan_without_keys(spark):
    rows = [(i, (i * 37) % 101) for i in range(300)]
    out = ordered_scan(spark.createDataFrame(rows, "id int, s int"), [], ["s", "id"], number="n", chunks=7)
    expected = {r[0]: n + 1 for n, r in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    assert {r.id: r.n for r in out.collect()} == expected


@pytest.mark.parametrize("block", [3, 10, 1000])
def test_islands(spark, block):
    rng = random.Random(block)
    rows = [(k, rng.randrange(-60, 120)) for k in ("a", "b") for _ in range(45)] + [("c", 5)]
    out = gap_islands(spark.createDataFrame(rows, "k string, p long"), ["k"], "p", 2, "island", block=block)
    expected = {}
    for k in "abc":
        last = start = None
        for p in sorted({p for kk, p in rows if kk == k}):
            start = p if last is None or p - last > 2 else start
            expected[k, p], last = start, p
    assert {(r.k, r.p): r.island for r in out.collect()} == expected


def test_totals_before_boundary(spark):
    rows = spark.sql("select 'a' k, date'2026-01-01' + i d, 10 * (i + 1) v from (select explode(sequence(0, 4)) i)")
    marks = spark.sql("select * from values ('a', date'2026-01-01'), ('a', date'2026-01-03'), ('a', date'2027-01-01'), ('b', date'2026-01-03') t(k, boundary)")
    out = totals_before(rows, marks, ["k"], "d", "v", "total")
    assert {(r.k, str(r.boundary)): r.total for r in out.collect()} == {
        ("a", "2026-01-01"): 0, ("a", "2026-01-03"): 30, ("a", "2027-01-01"): 150, ("b", "2026-01-03"): 0}


@pytest.mark.parametrize("how", ["left", "inner"])
def test_salted_join_equals_join(spark, how):
    rows = spark.createDataFrame(
        [("hot", i) for i in range(200)] + [(f"k{i % 9}", 1000 + i) for i in range(60)] + [(None, 5000 + i) for i in range(30)], "k string, id int")
    lookup = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), ("absent", 4)], "k string, x int")
    plain = sorted(map(tuple, rows.join(lookup, "k", how).select("k", "id", "x").collect()), key=repr)
    salted = salted_join(rows, lookup, ["k"], hot_rows=20, how=how).select("k", "id", "x")
    assert sorted(map(tuple, salted.collect()), key=repr) == plain
    bounded = salted_join(rows, lookup, ["k"], hot_rows=20, at_most=10, how=how).select("k", "id", "x")
    assert sorted(map(tuple, bounded.collect()), key=repr) == plain


@pytest.mark.parametrize("chunks", [1, 4, 64])
def test_rows_without_a_key_are_one_key(spark, chunks):
    rows = spark.range(40).select("id", F.when(F.col("id") % 4 == 1, 1).alias("key"))
    got = ordered_scan(rows, ["key"], ["id"], totals={"running": F.lit(1)}, previous={"before": F.col("id")}, number="n", chunks=chunks)
    last = {r["key"]: r for r in got.orderBy("id").collect()}
    assert (last[None]["n"], last[None]["running"], last[None]["before"]) == (30, 30, 38)
    assert (last[1]["n"], last[1]["before"]) == (10, 33)


def test_salts_follow_the_size_of_a_key(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") % 10 < 6, "hot").when(F.col("id") % 10 < 9, F.col("id").cast("string")).alias("key"))
    lookup = rows.select("key").distinct().filter("key is not null").withColumn("seen", F.lit(True))
    got = salted_join(rows, lookup, ["key"], hot_rows=7)
    assert got.count() == 1000 and got.filter("key is not null and not coalesce(seen, false)").count() == 0
    assert hot_keys(rows.filter("key is not null"), ["key"], 7).first()["_salts"] == 86


def test_a_small_lookup_is_broadcast(spark):
    """Rows that meet a small lookup are neither shuffled nor counted, however hot a key is."""
    rows = spark.range(300).select("id", F.when(F.col("id") % 10 < 8, "hot").otherwise(F.col("id").cast("string")).alias("key"))
    rows = rows.unionByName(spark.range(3).select("id", F.lit(None).cast("string").alias("key")))
    lookup = spark.createDataFrame([("hot", 1), ("9", 2), (None, 3)], "key string, x int")
    for how in ("left", "inner"):
        got = salted_join(rows, lookup, ["key"], hot_rows=7, how=how, lookup_rows=3)
        assert sorted(got.collect(), key=repr) == sorted(rows.join(lookup, "key", how).collect(), key=repr)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "Aggregate" not in plan


def test_keys_are_counted_only_in_buckets_that_are_hot(spark, monkeypatch):
    rows = spark.range(600).select(F.when(F.col("id") < 200, F.lit("hot")).when(F.col("id") % 7 != 0, F.concat(F.lit("k"), F.col("id"))).alias("key"), "id")
    lookup = rows.filter("key is not null").select("key").distinct().withColumn("x", F.length("key"))
    expected = sorted(rows.join(lookup, "key", "left").collect(), key=lambda r: r.id)
    counted, count = [], skew.hot_keys
    monkeypatch.setattr(skew, "hot_keys", lambda df, *rest: counted.append(df.filter("key is not null").count()) or count(df, *rest))
    got = salted_join(rows, lookup, ["key"], hot_rows=150, at_most=600)
    assert sorted(got.collect(), key=lambda r: r.id) == expected and 200 <= counted[0] < 250
    # No bucket has that many rows, so no key is counted by itself and nothing is salted.
    got = salted_join(rows, lookup, ["key"], hot_rows=300, at_most=600)
    assert len(counted) == 1 and sorted(got.collect(), key=lambda r: r.id) == expected
