import bisect
import math
import random

import pytest
from pyspark.sql import functions as F

from triledger.functions.stats import wilson
from triledger.operators import evaluate, risk
from triledger.operators.durable import recorded


def scored(spark, seed, n, levels):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(levels) / levels, int(rng.random() < 0.3)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id int, s double, y int")


@pytest.mark.parametrize("levels", [4, 1000])
def test_ranking_measures(spark, levels):
    rows, df = scored(spark, levels, 150, levels)
    pos, neg = [r for r in rows if r[2]], [r for r in rows if not r[2]]
    auc = sum((p[1] > q[1]) + 0.5 * (p[1] == q[1]) for p in pos for q in neg) / (len(pos) * len(neg))
    ap, recall = 0.0, 0.0
    for s in sorted({r[1] for r in rows}, reverse=True):
        above = [r for r in rows if r[1] >= s]
        hits = sum(r[2] for r in above)
        ap += (hits / len(pos) - recall) * hits / len(above)
        recall = hits / len(pos)
    assert evaluate.roc_auc(df, "s", "y").first()[0] == pytest.approx(auc)
    assert evaluate.average_precision(df, "s", "y").first()[0] == pytest.approx(ap)
    top = sorted(rows, key=lambda r: (-r[1], r[0]))[:7]
    got = evaluate.at_top(df, "s", "y", "id").first()
    assert got.k == 7 and got.precision_at_top == pytest.approx(sum(r[2] for r in top) / 7)
    assert got.recall_at_top == pytest.approx(sum(r[2] for r in top) / len(pos))


def test_measures_without_positives(spark):
    df = spark.createDataFrame([(1, 0.5, 0), (2, 0.1, 0)], "id int, s double, y int")
    assert evaluate.average_precision(df, "s", "y").first()[0] is None
    assert evaluate.roc_auc(df, "s", "y").first()[0] is None


def test_class_measures(spark):
    pairs = [("OK", "OK")] * 6 + [("OK", "BOT")] * 2 + [("BOT", "BOT")] * 1 + [("BOT", "OK")] * 1 + [("REVIEW", "AGENT")]
    df = spark.createDataFrame(pairs, "label string, predicted string")
    rows = {r["class"]: r for r in evaluate.per_class(evaluate.confusion(df, "label", "predicted")).collect()}
    assert rows["OK"].precision == pytest.approx(6 / 7) and rows["OK"].recall == pytest.approx(6 / 8)
    assert rows["BOT"].f1 == pytest.approx(2 * (1 / 3) * 0.5 / (1 / 3 + 0.5))
    assert rows["STATEMENT"].f1 == 0 and rows["REVIEW"].recall == 0
    s = evaluate.class_summary(evaluate.confusion(df, "label", "predicted")).first()
    assert s.accuracy == pytest.approx(7 / 11) and s.balanced_accuracy == pytest.approx((0.75 + 0.5 + 0) / 3)
    p = 8 / 11
    assert s.macro_f1_majority == pytest.approx(2 * p / (1 + p) / 5)


def test_shuffling_keeps_values(spark):
    rows, df = scored(spark, 9, 80, 1000)
    mixed = evaluate.shuffled_column(df, "s", "id")
    got = {r.id: (r.s, r.y) for r in mixed.collect()}
    assert sorted(v[0] for v in got.values()) == sorted(r[1] for r in rows)
    assert all(got[r[0]][1] == r[2] for r in rows) and any(got[r[0]][0] != r[1] for r in rows)


def test_wilson(spark):
    low, high = wilson(F.lit(5), F.lit(50))
    row = spark.range(1).select(low.alias("low"), high.alias("high"), wilson(F.lit(0), F.lit(0))[0].alias("none")).first()
    p, n, z = 0.1, 50, 1.96
    centre, scale = p + z * z / (2 * n), 1 + z * z / n
    half = z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    assert (row.low, row.high) == pytest.approx(((centre - half) / scale, (centre + half) / scale)) and row.none is None


@pytest.mark.parametrize("counts,statistic,p", [
    ([(10, 100), (20, 100), (30, 100)], 12.5, math.exp(-6.25)),               # two degrees: exp(-x/2)
    ([(10, 100), (20, 100)], 3.1765, 0.074699),                               # corrected for one degree
    ([(0, 10), (0, 20)], None, None),
])
def test_homogeneity(spark, counts, statistic, p):
    df = spark.createDataFrame([(f"e{i}", k, n) for i, (k, n) in enumerate(counts)], "employee string, errors long, rows long")
    row = risk.homogeneity(df).first()
    if statistic is None:
        assert row.statistic is None and row.p_value is None
    else:
        assert row.statistic == pytest.approx(statistic, abs=1e-3) and row.p_value == pytest.approx(p, abs=1e-4)


def test_what_shares_are_counted_from_is_read_once(spark):
    rows = spark.range(600).select(F.concat(F.lit("e"), F.col("id") % 3).alias("employee"), (F.col("id") % 7 < F.col("id") % 3).alias("is_error"))
    with recorded() as made:
        test, risks = risk.homogeneity(risk.error_counts(rows, "employee")), risk.risk_by_employee(rows)
    assert len(made) == 2 and not any("Range" in df._jdf.queryExecution().toString() for df in (test, risks))
    errors = [sum(i % 7 < i % 3 for i in range(e, 600, 3)) for e in range(3)]
    share = sum(errors) / 600
    statistic = sum((k - 200 * share) ** 2 / (200 * share) + (k - 200 * share) ** 2 / (200 * (1 - share)) for k in errors)
    assert test.first().statistic == pytest.approx(statistic)
    assert {r.employee: r.errors for r in risks.collect()} == {f"e{i}": k for i, k in enumerate(errors)}


def test_three_degrees_of_freedom():
    from triledger.functions.stats import _upper_tail

    assert _upper_tail(7.814727903251179, 3) == pytest.approx(0.05, abs=1e-9)
    assert _upper_tail(14.067140449340169, 7) == pytest.approx(0.05, abs=1e-9)
    assert _upper_tail(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9)


@pytest.mark.parametrize("levels", [1, 3, 100_000])
def test_top_share_without_sorting(spark, monkeypatch, levels):
    """All scores equal, few and many different ones; null scores and repeated ids; slices of three."""
    monkeypatch.setattr(evaluate, "SLICES", 3)
    monkeypatch.setattr(evaluate, "SORTED", 5)
    rng = random.Random(levels)
    rows = [(2 ** 60 + i // 2, rng.choice([None, *[rng.randrange(levels) / levels - 0.5 for _ in range(9)]]), int(rng.random() < 0.4)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, s double, y int")
    for share in (0.0, 0.2, 0.97, 1.0):
        k = max(1, int(200 * share))
        ranked = sorted(rows, key=lambda r: (-r[1] if r[1] is not None else math.inf, r[0]))
        # Rows that nothing tells apart may come in any order.
        last = (ranked[k - 1][1], ranked[k - 1][0])
        sure = sum(r[2] for r in ranked[:k] if (r[1], r[0]) != last)
        tied = [r[2] for r in ranked if (r[1], r[0]) == last]
        room = k - sum((r[1], r[0]) != last for r in ranked[:k])
        got = evaluate.at_top(df, "s", "y", "id", share).first()
        hits = round(got.precision_at_top * k)
        assert got.k == k
        assert sure + sum(sorted(tied)[:room]) <= hits <= sure + sum(sorted(tied, reverse=True)[:room])


def test_top_share_of_nothing(spark):
    assert tuple(evaluate.at_top(spark.createDataFrame([], "id long, s double, y int"), "s", "y", "id").first()) == (0, None, None, None)


def test_sketched_quantiles_keep_their_bound(spark):
    rows = spark.range(50_000).selectExpr("id", "cast(case when id % 3 = 0 then 7 else pmod(xxhash64(id), 100000) end as double) as v", "id % 7 as g")
    values = sorted(r.v for r in rows.collect())
    for r in evaluate.sketched_quantiles(rows, "v", [0.01, 0.25, 0.5, 0.95, 1.0], ["g"], 200).collect():
        low, high = bisect.bisect_left(values, r.quantile) / len(values), bisect.bisect_right(values, r.quantile) / len(values)
        assert r.n == 50_000 and max(low - r.share, r.share - high, 0) <= evaluate.rank_error(200)


def test_average_precision_by_key(spark):
    rows, df = scored(spark, 5, 90, 7)
    both = df.selectExpr("*", "'a' as g").unionByName(df.selectExpr("id", "1 - s as s", "y", "'b' as g"))
    each = {r.g: r.average_precision for r in evaluate.average_precision(both, "s", "y", by=["g"]).collect()}
    assert each["a"] == pytest.approx(evaluate.average_precision(df, "s", "y").first()[0])
    assert each["b"] == pytest.approx(evaluate.average_precision(df.selectExpr("1 - s as s", "y"), "s", "y").first()[0])
