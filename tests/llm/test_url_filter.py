import pytest
from pyspark.sql import functions as F

from triledger.llm import url_filter
from triledger.llm.url_filter import cascade, host_and_path, judge

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/")]


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 64])
@pytest.mark.parametrize("n_listed,n_other", [(300, 5_000), (0, 50), (50, 0), (1, 3_000)])
def test_membership_is_exact(spark, broadcast_bytes, n_listed, n_other):
    listed = spark.range(n_listed).select(F.concat(F.lit("bad"), "id").alias("key"))
    other = spark.range(n_other).select(F.concat(F.lit("good"), "id").alias("key"))
    universe = other.unionByName(listed.limit(n_listed // 2)).unionByName(spark.createDataFrame([(None,), ("",), ("",)], "key string"))
    known = cascade(universe, listed, broadcast_bytes=broadcast_bytes)
    assert (known.shards > 1) == (n_listed > 200 and broadcast_bytes == 64)
    rows = known.contains(universe.withColumn("_shard", F.lit("own")).unionByName(listed.withColumn("_shard", F.lit("own"))), "key", "held")
    wrong = rows.filter(F.col("held") != F.coalesce(F.startswith("key", F.lit("bad")), F.lit(False)))
    assert rows.count() == n_other + n_listed // 2 + 3 + n_listed and wrong.count() == 0
    assert rows.columns == ["key", "_shard", "held"]


def test_hosts_paths_and_rules(spark):
    urls = {
        1: ("http://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"),
        2: ("x://net/", "net", "/", "net/", "block"), 3: ("http://net", "net", "", None, "allow"),
        4: ("http://badexample.com/de/", "badexample.com", "/de/", None, "allow"), 5: (None, "", "", None, "allow"),
        6: ("no scheme", "", "", None, "allow"), 7: ("http://EXAMPLE.com/de/?http://x.net/", "example.com", "/de/", "example.com/de/", "block"),
        8: ("http://ÄB.net?x=/en/", "Äb.net", "", None, "allow"), 9: ("http://listed.org/\nfr", "listed.org", "/\nfr", None, "block"),
        10: ("http://listed.org/\nfr", "listed.org", "/\nfr", None, "block"), 11: ("://", "", "", None, "allow"),
    }
    pages = spark.createDataFrame([(k, v[0]) for k, v in urls.items()] + [(None, None)], "page_id long, url string")
    pages = pages.withColumns({"host": F.lit("own"), "rule": F.lit("own"), "verdict": F.lit(1)})
    listed = spark.createDataFrame([("listed.org",), (None,)], "key string")
    got = {r["page_id"]: tuple(r)[1:] for r in judge(pages, RULES, listed).collect()}
    assert got == {k: v[1:] for k, v in urls.items()} | {None: ("", "", None, "allow")}
    assert judge(pages.limit(0), RULES, listed).count() == 0


def test_first_separator_counts(spark):
    row = spark.createDataFrame([("a://b://c/d",)], "u string").select(*host_and_path("u")).first()
    assert tuple(row) == ("b:", "//c/d")


@pytest.mark.parametrize("mistakes", [0.01, 0.0])
def test_a_short_list_over_many_keys(spark, monkeypatch, mistakes):
    """The second level encodes more than the first; no filter of a shard outgrows its bound, expected or not."""
    monkeypatch.setattr(url_filter, "MISTAKES", mistakes)
    keys = spark.range(40_000).selectExpr("concat('host', id) as key")
    names = {"elsewhere", *[f"host{i}" for i in range(0, 400, 10)]}
    listed = spark.createDataFrame([(n,) for n in names], "key string")
    made = url_filter.cascade(keys, listed, broadcast_bytes=64)
    assert made.shards > 1 and all(b <= 8 * 64 for b in made.bits)
    told = made.contains(keys.unionByName(listed), "key", "inside").filter("inside").select("key").distinct().collect()
    assert {r["key"] for r in told} == names
