"""A classifier of error sources, trained on earlier months and tested on later ones.

Two learners: boosted trees, one sequence for each class against the rest, and a random forest over all classes.  Both give
probabilities that add up to 1 over the classes: the guess is the likeliest class, and the probability of an error is what is
left beside "OK", so the two cannot contradict each other.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triledger.operators import evaluate
from triledger.operators.durable import durable, known_rows, side_by_side
from triledger.operators.features import CATEGORICAL, NUMERIC, balanced_weights
from triledger.operators.ordered import ordered_scan
from triledger.operators.skew import salted_join
from triledger.vocabulary import CLASSES

ID = "txn_id"
HOT_ROWS = 1_000_000
FOREST, BOOSTING = "forest", "boosting"
USED = {f: f"{f}_code" if f in CATEGORICAL else f for f in CATEGORICAL + NUMERIC}
# Boosted classes are trained side by side as long as the rows that they keep in memory, about 200 bytes each, are no more than these.
TRAINED_ROWS = 25_000_000
# What `Classifier.save` writes; a reader refuses other versions.
VERSION = 1


@dataclass(frozen=True)
class Settings:
    learner: str = FOREST
    rounds: int = 200       # trees; with boosting, of each class
    depth: int = 6
    leaf_rows: int = 5
    step: float = 0.08      # of boosting
    seed: int = 7
    test_rows: int = 1      # a test period takes in earlier months until it has so many rows


@dataclass(frozen=True)
class Classifier:
    """Fitted trees, with the category codes and the order of the classes that they were fitted with.

    `trees` has the forest under "", or boosted trees under the name of each class that the training rows had and not all of
    them were of; other classes have the probability in `constant`.
    """

    settings: Settings
    classes: tuple[str, ...]
    codes: DataFrame
    trees: dict[str, object]
    constant: dict[str, float]

    def predict(self, rows: DataFrame) -> DataFrame:
        """The rows (features with their codes) with the likeliest class and the probability of an error."""
        out = _vector().transform(rows)
        if self.settings.learner == FOREST:
            out = self.trees[""].transform(out).withColumn("_p", vector_to_array("probability"))
        else:
            for i, (_, model) in enumerate(sorted(self.trees.items())):
                out = model.copy({model.probabilityCol: f"_p{i}", model.rawPredictionCol: f"_r{i}", model.predictionCol: f"_g{i}"}).transform(out)
            at = {c: i for i, c in enumerate(sorted(self.trees))}
            own = [vector_to_array(f"_p{at[c]}")[1] if c in at else F.lit(self.constant.get(c, 0.0)) for c in self.classes]
            # The first class is "OK": its trees alone tell errors from the rest, the others share what it leaves.
            rest = reduce(lambda a, b: a + b, own[1:])
            shared = [F.when(rest > 0, (1 - own[0]) * p / rest).otherwise((1 - own[0]) / len(own[1:])) for p in own[1:]]
            out = out.withColumn("_p", F.array(own[0], *shared))
        likeliest = F.array_position("_p", F.array_max("_p")).cast("int")
        return out.withColumn("predicted", F.element_at(F.array(*[F.lit(c) for c in self.classes]), likeliest)).withColumn(
            "p_error", 1 - F.col("_p")[0]).select(*rows.columns, "predicted", "p_error")

    def read(self, features: DataFrame) -> DataFrame:
        """Predictions for new features; a category that the codes do not know counts as missing."""
        return self.predict(with_codes(features, self.codes))

    def save(self, folder: str) -> None:
        """Trees, codes and settings as one unit; its description is written last, so that half a unit cannot be read."""
        spark = self.codes.sparkSession
        for name, model in self.trees.items():
            model.write().overwrite().save(f"{folder}/trees-{name or 'all'}")
        self.codes.write.mode("overwrite").parquet(f"{folder}/codes")
        unit = {"version": VERSION, "settings": asdict(self.settings), "classes": self.classes, "trees": sorted(self.trees),
                "constant": self.constant, "features": list(USED)}
        spark.createDataFrame([(json.dumps(unit),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/unit")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Classifier:
        unit = json.loads(spark.read.text(f"{folder}/unit").first()[0])
        if unit["version"] != VERSION or unit["features"] != list(USED):
            raise ValueError(f"model of version {unit['version']} with the features {unit['features']} cannot be read")
        settings = Settings(**unit["settings"])
        reader = RandomForestClassificationModel if settings.learner == FOREST else GBTClassificationModel
        trees = {name: reader.load(f"{folder}/trees-{name or 'all'}") for name in unit["trees"]}
        return cls(settings, tuple(unit["classes"]), spark.read.parquet(f"{folder}/codes"), trees, unit["constant"])


@dataclass(frozen=True)
class Fold:
    number: int
    train_months: list[str]
    test_months: list[str]
    n_train: int
    classifier: Classifier
    scored: DataFrame       # test rows with the codes, p_error and predicted


def temporal_folds(months: dict[str, int], test_rows: int = 1) -> list[tuple[list[str], list[str]]]:
    """Two test periods: the last months that together have `test_rows` rows, and the ones before; train on all that is earlier."""
    left, out = sorted(months), []
    while len(out) < 2:
        test: list[str] = []
        while left and sum(months[m] for m in test) < max(1, test_rows):
            test.insert(0, left.pop())
        if not left:
            break
        out.append((list(left), test))
    return out


def category_codes(rows: DataFrame) -> DataFrame:
    """column, value, code: the distinct values of every category, numbered from 0 in order.  Nothing is collected."""
    values = [rows.select(F.lit(c).alias("column"), F.col(c).alias("value")).filter("value is not null").distinct() for c in CATEGORICAL]
    numbered = ordered_scan(reduce(DataFrame.unionByName, values), ["column"], ["value"], number="n")
    return numbered.select("column", "value", (F.col("n") - 1).alias("code"))


def with_codes(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """The rows with one code column per category; -1 for a missing value."""
    for c in CATEGORICAL:
        own = codes.filter(F.col("column") == c).select(F.col("value").alias(c), F.col("code").alias(f"{c}_code"))
        rows = salted_join(rows, own, [c], hot_rows=HOT_ROWS, at_most=known_rows(rows), lookup_rows=known_rows(codes)).withColumn(
            f"{c}_code", F.coalesce(f"{c}_code", F.lit(-1)))
    return rows


def _vector() -> VectorAssembler:
    return VectorAssembler(inputCols=list(USED.values()), outputCol="features")


def fit(train: DataFrame, codes: DataFrame, settings: Settings) -> Classifier:
    """`train` has the features with their codes, label and weight."""
    if settings.learner == FOREST:
        position = F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col("label")) - 1
        # All classes are named, whichever of them the earlier months have.
        named = position.cast("double").alias("class", metadata={"ml_attr": {"type": "nominal", "name": "class", "vals": list(CLASSES)}})
        forest = RandomForestClassifier(
            labelCol="class", weightCol="weight", numTrees=settings.rounds, maxDepth=settings.depth,
            minInstancesPerNode=settings.leaf_rows, seed=settings.seed).fit(_vector().transform(train.withColumn("class", named)))
        return Classifier(settings, CLASSES, codes, {"": forest}, {})
    # One row a class.
    sizes = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    rows = durable(_vector().transform(train).select("features", "label", "weight"))

    def boosted(name: str):
        learner = GBTClassifier(
            labelCol="own", weightCol="weight", maxIter=settings.rounds, maxDepth=settings.depth, stepSize=settings.step,
            minInstancesPerNode=settings.leaf_rows, seed=settings.seed)
        return learner.fit(rows.withColumn("own", (F.col("label") == name).cast("double")))

    whole = sum(sizes.values())
    names = [c for c in CLASSES if 0 < sizes.get(c, 0) < whole]
    # Classes are trained side by side; the trees of one follow each other.  Each class has a copy of the rows in memory: where all
    # copies do not fit, they would push each other out to disk, and every level of every tree would read them from there.
    at_once = max(1, TRAINED_ROWS // max(1, whole))
    fitted = side_by_side(train.sparkSession, *[lambda c=c: boosted(c) for c in names], at_once=at_once) if names else []
    constant = {c: float(sizes.get(c, 0) == whole) for c in CLASSES if c not in names}
    return Classifier(settings, CLASSES, codes, dict(zip(names, fitted, strict=True)), constant)


def train_fold(coded: DataFrame, codes: DataFrame, number: int, train_months: list[str], test_months: list[str],
               settings: Settings = Settings()) -> Fold:
    """`coded` are the features with the category codes."""
    train = coded.filter(F.col("month").isin(train_months))
    train = durable(train.join(balanced_weights(train).select("label", "weight"), "label"))
    classifier = fit(train, codes, settings)
    scored = durable(classifier.predict(coded.filter(F.col("month").isin(test_months))))
    return Fold(number, train_months, test_months, known_rows(train), classifier, scored)


def fold_metrics(fold: Fold) -> DataFrame:
    """One row with every measure beside its trivial baseline."""
    return evaluate.measures(fold.scored, "p_error", "is_err", "label", "predicted", "prior_error_rate", ID).withColumns({
        "fold": F.lit(fold.number), "train_months": F.lit(f"{fold.train_months[0]}..{fold.train_months[-1]}"),
        "test_month": F.lit(fold.test_months[-1] if len(fold.test_months) == 1 else f"{fold.test_months[0]}..{fold.test_months[-1]}"),
        "n_train": F.lit(fold.n_train).cast("bigint")})


def permutation_importance(fold: Fold, features: tuple[str, ...] = CATEGORICAL + NUMERIC, seed: int = 7) -> DataFrame:
    """How much average precision is lost when one feature of the test rows is shuffled."""
    rows = fold.scored.select(ID, "is_err", *USED.values())
    return shuffled_loss(rows, {f: USED[f] for f in features}, fold.classifier.predict, "p_error", "is_err", ID, seed)


def shuffled_loss(rows: DataFrame, used: dict[str, str], score: Callable[[DataFrame], DataFrame], scored: str, truth: str,
                  row_id: str, seed: int = 7) -> DataFrame:
    """feature, pr_auc_drop: the average precision of `score` (adds the column `scored`) less that with one column shuffled.

    The rows are numbered once; each comes once for every feature, with that column of its donor, and once as it is.  All are
    scored and ranked in one table keyed by feature.
    """
    columns = [c for c in rows.columns if c not in (row_id, truth)]
    given = rows.select(F.col(row_id).alias("_donor"), *[F.col(c).alias(f"_other_{c}") for c in used.values()])
    paired = rows.join(evaluate.donors(rows, row_id, seed).withColumnRenamed("donor", "_donor"), row_id).join(given, "_donor")

    def version(feature: str, column: str | None) -> Column:
        return F.struct(F.lit(feature).alias("_feature"), *[F.col(f"_other_{c}" if c == column else c).alias(c) for c in columns])

    versions = F.array(version("", None), *[version(f, c) for f, c in used.items()])
    many = paired.select(row_id, truth, F.explode(versions).alias("_v")).select(row_id, truth, "_v.*")
    each = durable(evaluate.average_precision(score(many), scored, truth, by=["_feature"]))
    # The row of the table as it is.
    base = each.filter("_feature = ''").select("average_precision").scalar()
    return each.filter("_feature <> ''").select(F.col("_feature").alias("feature"), (base - F.col("average_precision")).alias("pr_auc_drop")) \
        .orderBy(F.desc("pr_auc_drop"), "feature")

