import threading

import pytest
from pyspark.sql import functions as F

from triledger.operators import evaluate, model
from triledger.operators.durable import durable
from triledger.operators.features import CATEGORICAL, NUMERIC
from triledger.plans.learn import learn


def features(spark, n=6_000):
    """Errors depend on the kind, the hour and the amount together; months are of unequal size."""
    i = F.col("id")
    h = lambda salt, m: F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(m))
    rows = spark.range(n).select(
        (i + 1).alias("txn_id"), F.concat(F.lit("a"), h(1, 5)).alias("agent"), F.concat(F.lit("2026-0"), F.least(i / (n / 12) + 1, F.lit(9)).cast("int")).alias("month"),
        F.lit(10).cast("decimal(18,2)").alias("amount"), F.concat(F.lit("k"), h(2, 4)).alias("kind"), F.concat(F.lit("c"), h(3, 9)).alias("creator"),
        F.when(h(4, 3) > 0, F.lit("KGS")).alias("currency"), F.lit("e").alias("employee"), h(5, 24).alias("hour"), (h(6, 1000) / 100).alias("log_amount"),
        *[F.lit(0.0).alias(c) for c in NUMERIC if c not in ("hour", "log_amount", "prior_error_rate")], (h(7, 100) / 1000).alias("prior_error_rate"))
    bot = (F.col("kind") == "k1") & (F.col("hour") < 12) & (F.col("log_amount") > 2)
    typed = (F.col("kind") == "k2") & (F.col("log_amount") > 8)
    label = F.when(bot, "BOT").when(typed, "STATEMENT").otherwise("OK")
    return rows.withColumn("label", F.when(F.pmod(F.xxhash64("txn_id"), F.lit(20)) == 0, "REVIEW").otherwise(label)).withColumn(
        "is_err", (F.col("label") != "OK").cast("int"))


@pytest.fixture(scope="module")
def boosted(spark):
    return learn(features(spark), model.Settings(learner=model.BOOSTING, rounds=3, depth=4, step=0.5, test_rows=800))


def test_periods():
    months = {"a": 10, "b": 10, "c": 3, "d": 4, "e": 5}
    assert model.temporal_folds(months) == [(["a", "b", "c", "d"], ["e"]), (["a", "b", "c"], ["d"])]
    assert model.temporal_folds(months, 8) == [(["a", "b", "c"], ["d", "e"]), (["a"], ["b", "c"])]
    assert model.temporal_folds(months, 30) == []
    assert model.temporal_folds({"a": 1}) == []


def test_boosting_beats_the_prior_rate(boosted):
    for r in boosted.metrics.collect():
        assert r.n_test >= 800 and r.n_train >= 1_000
        assert r.pr_auc > 2 * r.pr_auc_prior_rate and r.macro_f1 > 2 * r.macro_f1_majority


def test_probabilities(boosted):
    scored = boosted.folds[0].scored
    assert scored.filter("p_error < 0 or p_error > 1 or (predicted = 'OK') and p_error > 0.8").count() == 0
    assert {r[0] for r in scored.select("predicted").distinct().collect()} >= {"OK", "BOT", "STATEMENT"}


@pytest.mark.parametrize("learner", [model.FOREST, model.BOOSTING])
def test_saved_and_read_again(spark, boosted, tmp_path, learner):
    trained = boosted if learner == model.BOOSTING else learn(features(spark, 1_200), model.Settings(rounds=3))
    fold = trained.folds[0]
    fold.classifier.save(str(tmp_path / "m"))
    fold.classifier.save(str(tmp_path / "m"))
    again = model.Classifier.load(spark, str(tmp_path / "m"))
    assert again.settings == fold.classifier.settings and again.classes == fold.classifier.classes
    raw = fold.scored.drop("p_error", "predicted", *[f"{c}_code" for c in CATEGORICAL])
    differing = again.read(raw).select("txn_id", "p_error", "predicted").exceptAll(fold.scored.select("txn_id", "p_error", "predicted"))
    assert differing.count() == 0
    # A category that was never seen counts as missing.
    new = again.read(raw.withColumn("kind", F.lit("never seen")))
    missing = again.read(raw.withColumn("kind", F.lit(None).cast("string")))
    assert new.select("txn_id", "p_error").exceptAll(missing.select("txn_id", "p_error")).count() == 0


@pytest.mark.parametrize("rows, most", [(1, 1), (20_000, 4)])
def test_classes_that_fit_in_memory_are_trained_side_by_side(spark, boosted, monkeypatch, rows, most):
    """With as many copies of the rows as fit."""
    fit, lock, running, seen = model.GBTClassifier.fit, threading.Lock(), [0], []

    def counted(self, *given):
        with lock:
            running[0] += 1
            seen.append(running[0])
        try:
            return fit(self, *given)
        finally:
            with lock:
                running[0] -= 1

    monkeypatch.setattr(model, "TRAINED_ROWS", rows)
    monkeypatch.setattr(model.GBTClassifier, "fit", counted)
    fold = boosted.folds[0]
    train = durable(model.with_codes(features(spark), fold.classifier.codes).filter(F.col("month").isin(fold.train_months)).withColumn("weight", F.lit(1.0)))
    settings = model.Settings(learner=model.BOOSTING, rounds=1, depth=2)
    classifier = model.fit(train, fold.classifier.codes, settings)
    assert len(seen) == len(classifier.trees) == 4 and max(seen) <= most and (most == 1 or max(seen) > 1)


def test_other_versions_are_refused(spark, boosted, tmp_path, monkeypatch):
    monkeypatch.setattr(model, "VERSION", 0)
    boosted.folds[0].classifier.save(str(tmp_path / "m"))
    monkeypatch.undo()
    with pytest.raises(ValueError, match="version 0"):
        model.Classifier.load(spark, str(tmp_path / "m"))


def test_one_class_only(spark):
    rows = features(spark, 300).withColumn("label", F.lit("OK")).withColumn("is_err", F.lit(0))
    scored = learn(rows, model.Settings(learner=model.BOOSTING, rounds=2)).folds[0].scored
    assert scored.filter("predicted <> 'OK' or p_error <> 0").count() == 0


def test_importance_in_one_pass(boosted):
    fold = boosted.folds[0]
    drops = {r.feature: r.pr_auc_drop for r in model.permutation_importance(fold).collect()}
    assert set(drops) == set(CATEGORICAL + NUMERIC)
    assert max(drops, key=drops.get) in ("kind", "log_amount") and drops["dom"] == 0
    # One column by hand.
    rows = fold.scored.select("txn_id", "is_err", *model.USED.values())
    by_hand = fold.classifier.predict(evaluate.shuffled_column(rows, "hour", "txn_id"))
    base, shuffled = (evaluate.average_precision(x, "p_error", "is_err").first()[0] for x in (fold.scored, by_hand))
    assert drops["hour"] == pytest.approx(base - shuffled)
