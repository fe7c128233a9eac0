"""Training and evaluating the early-warning model on a reconciliation."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triledger.operators import evaluate, model
from triledger.operators.durable import durable
from triledger.operators.risk import risk_by_agent


@dataclass(frozen=True)
class ModelResult:
    folds: list[model.Fold]
    features: DataFrame

    @cached_property
    def metrics(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [model.fold_metrics(f) for f in self.folds])

    @cached_property
    def per_class(self) -> DataFrame:
        parts = [
            evaluate.per_class(evaluate.confusion(f.scored, "label", "predicted")).withColumn("test_month", F.lit(f.test_months[-1]))
            for f in self.folds]
        return reduce(DataFrame.unionByName, parts)

    @cached_property
    def quality(self) -> DataFrame:
        """ROC-AUC of the last month, one cell."""
        return evaluate.roc_auc(self.folds[0].scored, "p_error", "is_err")

    @cached_property
    def last_classes(self) -> DataFrame:
        return evaluate.per_class(evaluate.confusion(self.folds[0].scored, "label", "predicted")).drop("position")

    @cached_property
    def importance(self) -> DataFrame:
        return model.permutation_importance(self.folds[0])

    @cached_property
    def agent_risk(self) -> DataFrame:
        return risk_by_agent(self.folds[0].scored)

    @cached_property
    def label_counts(self) -> DataFrame:
        return self.features.groupBy("label").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"))


def learn(features: DataFrame, settings: model.Settings = model.Settings()) -> ModelResult:
    """Two temporal folds: the last period and the one before."""
    # The list of months is bounded by the calendar.
    months = {r["month"]: r["count"] for r in features.groupBy("month").count().collect()}
    codes = durable(model.category_codes(features))
    coded = durable(model.with_codes(features, codes))
    folds = [model.train_fold(coded, codes, i, tr, te, settings)
             for i, (tr, te) in enumerate(model.temporal_folds(months, settings.test_rows), 1)]
    return ModelResult(folds, features)
