from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.cases import documents, none, rows
from triledger.llm import mixing
from triledger.llm.queries import TOPICS


def topic():
    return mixing.marked_topic("text", TOPICS, "prose")


def many(spark, n=400):
    part = spark.range(n).select(
        (F.col("id") + 100).alias("doc_id"), F.concat(F.repeat(F.lit("word "), (F.col("id") % 17 + 1).cast("int")), F.when(F.col("id") % 5 == 0, "@").otherwise("")).alias("text"),
        F.when(F.col("id") % 3 == 0, "de").otherwise("en").alias("lang"), F.concat(F.lit("s"), (F.col("id") * F.col("id") % 7).cast("string")).alias("source"),
        F.lit(0).cast("long").alias("n_chars"))
    return part


def expected_tokens(frame, margin):
    out = defaultdict(float)
    for r in frame.collect():
        out[r[margin]] += r["n_tokens"] * r["probability"]
    total = sum(out.values())
    return {k: v / total for k, v in out.items()}


def test_given_shares_are_met(spark):
    aims = {"_lang": {"=de": 0.5, "=en": 0.5}, "_topic": {"=prose": 3.0, "=contacts": 1.0}}
    sources = {f"=s{i}": 1.0 for i in (0, 1, 2, 4)}
    targets = {k: spark.createDataFrame(list(v.items()), f"{k} string, share double") for k, v in (aims | {"_source": sources}).items()}
    got = mixing.mix(many(spark), topic(), targets=targets)
    assert expected_tokens(got, "lang") == pytest.approx({"de": 0.5, "en": 0.5}, abs=1e-4)
    assert expected_tokens(got, "topic") == pytest.approx({"prose": 0.75, "contacts": 0.25}, abs=1e-4)
    assert expected_tokens(got, "source") == pytest.approx({f"s{i}": 0.25 for i in (0, 1, 2, 4)}, abs=1e-4)
    assert max(r["probability"] for r in got.collect()) == 1.0


def test_a_value_without_target_is_left_out(spark):
    targets = {"_lang": spark.createDataFrame([("=de", 1.0)], "_lang string, share double")}
    got = mixing.mix(many(spark), topic(), targets=targets).collect()
    assert {r["lang"] for r in got if r["sampled"]} == {"de"}
    assert all(r["probability"] == (1.0 if r["lang"] == "de" else 0.0) for r in got)


def test_awkward_documents(spark):
    docs = documents(spark)
    got = mixing.mix(docs, topic(), power=0.9).collect()
    assert sorted((repr(r["doc_id"]), r["n_tokens"]) for r in got) == sorted((repr(i), len((t or "").split())) for i, t, *_ in rows())
    assert len({(r["sampled"], r["probability"]) for r in got if r["doc_id"] == 10}) == 1
    kept = mixing.sampled(docs, topic(), power=0.9)
    assert kept.columns == docs.columns
    assert sorted(repr(r["doc_id"]) for r in kept.collect()) == sorted(repr(r["doc_id"]) for r in got if r["sampled"])
    assert mixing.mix(none(spark), topic(), power=0.9).count() == 0 and mixing.sampled(none(spark), topic(), power=0.9).count() == 0
    silent = docs.filter("doc_id in (4, 5, 6)")
    assert not any(r["sampled"] for r in mixing.mix(silent, topic(), power=0.9).collect())


def test_the_sample_follows_the_probabilities(spark):
    got = mixing.mix(many(spark, 20_000), topic(), power=0.5).agg(F.sum("probability"), F.sum(F.col("sampled").cast("int"))).first()
    assert got[1] == pytest.approx(got[0], rel=0.05)


def raked(spark, cells, aims):
    frame = spark.createDataFrame(cells, "_source string, _lang string, tokens long")
    targets = {k: spark.createDataFrame(list(v.items()), f"{k} string, share double") for k, v in aims.items()}
    found = mixing.rake(frame, targets, tolerance=1e-6)
    return {(r["margin"], r["value"]): (r["target"], r["reached"]) for r in mixing.residuals(found, targets).collect()}


def test_slow_raking_goes_on_to_the_targets(spark):
    """A chain of cells in which each round gains little: far more than thirty rounds."""
    n = 3
    cells = [(f"s{i}", f"l{i}", 1) for i in range(n)] + [(f"s{i + 1}", f"l{i}", 1) for i in range(n - 1)]
    aims = {"_source": {f"s{i}": 1.0 + (-0.2 if i == 0 else 0) for i in range(n)}, "_lang": {f"l{i}": 1.0 + (-0.2 if i == n - 1 else 0) for i in range(n)}}
    left = raked(spark, cells, aims)
    assert all(t == pytest.approx(r, abs=1e-5) for t, r in left.values())


def test_targets_out_of_reach_leave_a_residual(spark):
    left = raked(spark, [("a", "x", 5), ("b", "y", 5)], {"_source": {"a": 0.9, "b": 0.1}, "_lang": {"x": 0.5, "y": 0.5}})
    assert left["_lang", "x"] == pytest.approx((0.5, 0.5)) and left["_source", "a"] == pytest.approx((0.9, 0.5))
