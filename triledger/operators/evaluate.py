"""Quality of predictions, computed by grouping equal scores first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triledger.operators.durable import durable
from triledger.operators.ordered import ordered_scan
from triledger.vocabulary import CLASSES

# Slices of a range of values, and rows that are few enough to sort.
SLICES, SORTED = 4_096, 10_000
LOWEST = -1.7976931348623157e308


def _by_score(rows: DataFrame, score: str, truth: str, by: list[str]) -> DataFrame:
    """Rows and positives per distinct score, running from the highest score down, for each key of its own."""
    tied = rows.groupBy(*by, F.col(score).cast("double").alias("score")).agg(
        F.count("*").alias("n"), F.sum(F.col(truth).cast("bigint")).alias("positives"))
    tied = tied.withColumn("_down", -F.col("score"))
    return ordered_scan(tied, by, ["_down"], totals={"n_down": F.col("n"), "positives_down": F.col("positives")})


def average_precision(rows: DataFrame, score: str, truth: str, by: list[str] | None = None) -> DataFrame:
    """Sum of precision times gain in recall, equal scores taken together; null without positives.  One row for each key."""
    steps = _by_score(rows, score, truth, by or [])
    gained = F.col("positives") * F.col("positives_down") / F.col("n_down")
    total = F.sum("positives")
    return steps.groupBy(*(by or [])).agg(F.when(total > 0, F.sum(gained) / total).alias("average_precision"))


def roc_auc(rows: DataFrame, score: str, truth: str) -> DataFrame:
    """Probability that a positive scores above a negative, ties counting half."""
    steps = _by_score(rows, score, truth, [])
    negatives = F.col("n") - F.col("positives")
    # Positives scored strictly above these negatives, plus half of those tied with them.
    above = F.col("positives_down") - F.col("positives") / 2
    pairs = F.sum("positives") * F.sum(negatives)
    return steps.agg(F.when(pairs > 0, F.sum(negatives * above) / pairs).alias("roc_auc"))


def _slice(value: str, low: float, high: float) -> Column:
    return F.least(F.floor((F.col(value) - low) / (high - low) * SLICES), F.lit(SLICES - 1)).cast("int")


def _border(rows: DataFrame, value: str, low: float, high: float, wanted: int, truth: str) -> tuple[int, int, int]:
    """The slice of the range that the `wanted`-th value from above is in; rows and positives above it."""
    # At most SLICES rows, whatever the input.
    slices = rows.groupBy(_slice(value, low, high).alias("cell")).agg(F.count("*").alias("n"), F.sum(truth).alias("y"))
    down = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0)
    running = slices.withColumns({"n_down": F.sum("n").over(down), "y_down": F.sum("y").over(down)})
    r = running.filter(F.col("n_down") >= wanted).orderBy("n_down").first()
    return r["cell"], r["n_down"] - r["n"], r["y_down"] - r["y"]


def top_positives(rows: DataFrame, value: str, tie: str, truth: str, wanted: int) -> int:
    """Positives among the `wanted` rows with the largest values; of equal values those with the smallest ties come first.

    Nothing is sorted but the rows of one slice of values: slices are counted, everything above the slice that the border is in
    is in, and that slice is sliced again until it is small.  Where its values are all equal, the ties are sliced.
    """
    found = 0
    tie_used = False
    while True:
        if wanted <= 0:
            return found
        limits = rows.agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("n"), F.sum(truth).alias("y")).first()
        if limits["n"] <= wanted:
            return found + (limits["y"] or 0)
        if limits["n"] <= SORTED:
            order = [F.desc(value)] if tie_used else [F.desc(value), F.asc(tie)]
            # At most SORTED rows.
            return found + (rows.orderBy(*order).limit(wanted).agg(F.sum(truth)).first()[0] or 0)
        if limits["low"] == limits["high"]:
            if tie_used:
                # Rows that nothing tells apart.
                return found + (rows.limit(wanted).agg(F.sum(truth)).first()[0] or 0)
            rows, tie_used = rows.withColumn("_tie", -F.col(tie).cast("decimal(20,0)")), True
            value = "_tie"
            continue
        low, high = float(limits["low"]), float(limits["high"])
        if low < high:
            cell, above, positives = _border(rows, value, low, high, wanted, truth)
            found, wanted = found + positives, wanted - above
            rows = rows.filter(_slice(value, low, high) == cell)
        else:
            # Neighbouring whole numbers that are one as doubles: one distinct value after the other.
            first = rows.groupBy(value).agg(F.count("*").alias("n"), F.sum(truth).alias("y")).orderBy(F.desc(value)).first()
            if first["n"] >= wanted:
                rows = rows.filter(F.col(value) == first[value])
            else:
                found, wanted = found + first["y"], wanted - first["n"]
                rows = rows.filter(F.col(value) < first[value])


def at_top(rows: DataFrame, score: str, truth: str, row_id: str, share: float = 0.05) -> DataFrame:
    """Precision, lift and recall among the best-scored share of the rows (at least one row); rows without a score come last."""
    given = durable(rows.select(F.coalesce(F.col(score).cast("double"), F.lit(LOWEST)).alias("score"), F.col(truth).cast("bigint").alias("y"), row_id))
    whole = given.agg(F.count("*").alias("n"), F.sum("y").alias("y")).first()
    k = max(1, int(whole["n"] * share))
    hits = top_positives(given, "score", row_id, "y", k) if whole["n"] else None
    n, y, k = whole["n"], whole["y"], min(k, whole["n"])
    precision = hits / k if k else None
    base = y / n if n else None
    values = (k, precision, precision / base if base else None, hits / max(1, y) if n else None)
    return rows.sparkSession.createDataFrame([values], "k long, precision_at_top double, lift_at_top double, recall_at_top double")


def measures(rows: DataFrame, score: str, truth: str, label: str, predicted: str, prior: str, row_id: str) -> DataFrame:
    """Every measure of a test period beside its trivial baseline, one row."""
    out = class_summary(confusion(rows, label, predicted))
    parts = [
        average_precision(rows, score, truth).withColumnRenamed("average_precision", "pr_auc"),
        average_precision(rows, prior, truth).withColumnRenamed("average_precision", "pr_auc_prior_rate"),
        rows.agg(F.avg(truth).alias("test_error_rate")),
        roc_auc(rows, score, truth),
        at_top(rows, score, truth, row_id).drop("k"),
    ]
    for part in parts:
        # One-row tables.
        out = out.withColumns({c: part.select(c).scalar() for c in part.columns})
    return out


def sketched_quantiles(rows: DataFrame, value: str, shares: list[float], by: list[str], k: int = 800) -> DataFrame:
    """share, quantile and n from mergeable sketches: one for each key, merged to one; nothing is sorted or gathered.

    The rank of a quantile is off by at most about 2.3 / k ** 0.9 of the rows (99 % of the time), whatever their number.  Null
    values are left out.
    """
    each = rows.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("s"))
    whole = each.agg(F.kll_merge_agg_double("s", F.lit(k)).alias("s"))
    each = [F.struct(F.lit(float(p)).alias("share"), F.kll_sketch_get_quantile_double("s", F.lit(float(p))).alias("quantile"),
                     F.kll_sketch_get_n_double("s").alias("n")) for p in shares]
    return whole.select(F.explode(F.array(*each)).alias("q")).select("q.*")


def rank_error(k: int) -> float:
    """The bound that goes with `sketched_quantiles`."""
    return 2.296 / k ** 0.9021


def confusion(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    return rows.groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def per_class(cells: DataFrame, classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """Precision, recall, F1 and support of each class; 0 where there is nothing to divide by."""
    spark = cells.sparkSession
    listed = spark.createDataFrame([(c, i) for i, c in enumerate(classes)], "class string, position int")
    hit = F.col("label") == F.col("predicted")
    actual = cells.groupBy(F.col("label").alias("class")).agg(
        F.sum("n").alias("support"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("hits"))
    guessed = cells.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("guesses"))
    # An empty divisor gives 0.
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    rows = (
        listed.join(actual, "class", "left").join(guessed, "class", "left").fillna(0, ["support", "hits", "guesses"])
        .withColumn("precision", share("hits", "guesses")).withColumn("recall", share("hits", "support")))
    both = F.col("precision") + F.col("recall")
    f1 = F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0)
    return rows.select("class", "precision", "recall", f1.alias("f1"), "support", "position")


def class_summary(cells: DataFrame, classes: tuple[str, ...] = CLASSES, majority: str = "OK") -> DataFrame:
    """Accuracy, macro F1, balanced accuracy and what always guessing one class would reach."""
    measures = per_class(cells, classes)
    macro = measures.agg(
        F.avg("f1").alias("macro_f1"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"))
    n = F.sum("n")
    same = F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0))
    usual = F.sum(F.when(F.col("label") == majority, F.col("n")).otherwise(0)) / n
    base = cells.agg(n.alias("n_test"), (same / n).alias("accuracy"), usual.alias("accuracy_majority"))
    # Guessing one class always: its precision is its share p, its recall 1, all other F1 are 0.
    p = F.col("accuracy_majority")
    return base.select(
        "n_test", "accuracy", "accuracy_majority",
        macro.select("macro_f1").scalar().alias("macro_f1"),
        (2 * p / (p + 1) / len(classes)).alias("macro_f1_majority"),
        macro.select("balanced_accuracy").scalar().alias("balanced_accuracy"))


def donors(rows: DataFrame, row_id: str, seed: int = 7) -> DataFrame:
    """A permutation of the ids: the row of each rank by id meets the row of that rank by a seeded digest of the id."""
    ids = rows.select(row_id)
    by_id = ordered_scan(ids, [], [row_id], number="_rank")
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.col(row_id).cast("string")).cast("binary"))
    by_digest = ordered_scan(ids.select(F.col(row_id).alias("donor"), digest.alias("_h")), [], ["_h", "donor"], number="_rank")
    return by_id.join(by_digest.select("_rank", "donor"), "_rank").select(row_id, "donor")


def shuffled_column(rows: DataFrame, column: str, row_id: str, seed: int = 7) -> DataFrame:
    """The rows with one column permuted."""
    values = rows.select(F.col(row_id).alias("donor"), column)
    return rows.drop(column).join(donors(rows, row_id, seed), row_id).join(values, "donor").select(*rows.columns)
