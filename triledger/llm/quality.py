"""Quality rules: text statistics and robust multivariate outliers per language and source.

Four statistics of each document are transformed to a common scale.  For each language and source the minimum covariance
determinant estimate is found by concentration steps (Rousseeuw and Van Driessen): the three quarters of the documents with the
smallest Mahalanobis distances give the next mean and covariance, until each group's determinant settles; of two starts (all documents;
medians and quartiles) the smaller determinant wins.  Documents beyond the cutoff distance are rejected.

A step is one pass over a narrow table: sums of products per group and distance bin, added up before the shuffle; running
totals over the bins, a fixed number, then give the sums of the closest three quarters.
"""

from __future__ import annotations

from collections.abc import Callable
from math import exp

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triledger.llm.tables import release, saved

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
SHARE = 0.75
# Deviations below these are never unusual; they also keep the covariance invertible where most documents have no symbols or
# repeats at all.  In the units of `FEATURES`.
FLOORS = (0.15, 0.35, 0.5, 0.8)
# Distance beyond which a document is rejected: the 1 - 1e-6 quantile of chi-square with four degrees of freedom.
CUTOFF = 33.4
STEPS, SETTLED = 25, 1e-6
BINS_PER_OCTAVE, LOWEST, HIGHEST = 4, -40, 120
P = 4
GROUP = ["_lang", "_source"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows of `window` (a power of two) words that occur more than once in the array."""
    def hashed(h: Column, span: int) -> Column:
        if span == window:
            return h
        return let(h, lambda a: hashed(F.transform(a, lambda x, i: F.xxhash64(x, F.get(a, i + span))), 2 * span))

    def covered(h: Column) -> Column:
        in_order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            # Equal hashes are neighbours; their words are compared.
            def same(x, other):
                return (x["h"] == other["h"]) & (F.slice(words_of["w"], x["i"] + 1, window) == F.slice(words_of["w"], other["i"] + 1, window))

            found = F.filter(s, lambda x, k: F.coalesce(same(x, F.get(s, k - 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, k + 1)), F.lit(False)))
            return F.sort_array(F.transform(found, lambda x: x["i"]))

        steps = let(let(in_order, starts), lambda at: F.transform(
            at, lambda p, k: F.least(F.lit(window), F.coalesce(F.get(at, k + 1) - p, F.lit(window)))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x)

    words_of = {}

    def count(w: Column) -> Column:
        words_of["w"] = w
        whole = hashed(F.transform(w, lambda x: F.xxhash64(x)), 1)
        windows = let(whole, lambda h: F.slice(h, 1, F.greatest(F.size(h) - (window - 1), F.lit(0))))
        # Most texts repeat no window.
        return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))

    return let(words, count)


def statistics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of the whole text; a null text has no words."""
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    words = F.regexp_extract_all("_text", F.lit(WORD), F.lit(0))
    lines = F.filter(F.split("_text", "\n", -1), lambda x: F.rlike(x, F.lit(WORD)))
    counts = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    repeated = let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a)))
    return rows.select(
        *keep, counts.alias("_c"),
        F.char_length(F.translate("_text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.char_length("_text") - F.char_length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        repeated.cast("long").alias("n_dup_lines"),
    ).select(*keep, "_c.n_words", "word_chars", "n_symbols", "n_dup_lines", "_c.n_repeat_words")


def features() -> list[Column]:
    """The transformed statistics: log mean word length; log percentages of symbols, repeated lines and repeated words."""
    n = F.greatest("n_words", F.lit(1))
    return [
        F.log(F.greatest("word_chars", F.lit(1)) / n),
        F.log1p(100 * F.col("n_symbols") / F.greatest("word_chars", F.lit(1))),
        F.log1p(100 * F.col("n_dup_lines") / n),
        F.log1p(100 * F.col("n_repeat_words") / n),
    ]


def consistency(share: float = SHARE) -> float:
    """What the covariance of the closest `share` of normal data in four dimensions falls short by."""
    low, high = 0.0, 100.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - exp(-mid / 2) * (1 + mid / 2) < share else (low, mid)
    half = low / 2
    return share / (1 - exp(-half) * (1 + half + half * half / 2))


def _factored(estimates: DataFrame) -> DataFrame:
    """Add the inverse Cholesky factor r_ij of the covariance c_ij, and its log determinant."""
    out = estimates
    for i in range(P):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            out = out.withColumn(f"l{i}{j}", F.sqrt(rest) if i == j else rest / F.col(f"l{j}{j}"))
    for i in range(P):
        for j in range(i + 1):
            value = 1 / F.col(f"l{i}{i}") if i == j else -sum(
                (F.col(f"l{i}{k}") * F.col(f"r{k}{j}") for k in range(j, i)), F.lit(0.0)) / F.col(f"l{i}{i}")
            out = out.withColumn(f"r{i}{j}", value)
    log_det = 2 * sum((F.log(f"l{i}{i}") for i in range(P)), F.lit(0.0))
    return out.withColumn("log_det", log_det).drop(*[f"l{i}{j}" for i in range(P) for j in range(i + 1)],
                                                   *[f"c{i}{j}" for i in range(P) for j in range(i + 1)])


def _distance() -> Column:
    def part(i):
        return sum((F.col(f"r{i}{j}") * (F.col(f"x{j}") - F.col(f"m{j}")) for j in range(i + 1)), F.lit(0.0))

    return sum((part(i) * part(i) for i in range(P)), F.lit(0.0))


def _sums() -> list[Column]:
    return ([F.count(F.lit(1)).alias("n")] + [F.sum(f"x{i}").alias(f"s{i}") for i in range(P)]
            + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i in range(P) for j in range(i + 1)])


def _moments(sums: DataFrame, keys: list[str], scale: float) -> DataFrame:
    """Means and scaled covariances, with the floors on the diagonal."""
    mean = [F.col(f"s{i}") / F.col("n") for i in range(P)]
    cov = [(F.greatest(F.col(f"q{i}{j}") / F.col("n") - mean[i] * mean[j], F.lit(0.0)) if i == j
            else F.col(f"q{i}{j}") / F.col("n") - mean[i] * mean[j]) * scale + (FLOORS[i] ** 2 if i == j else 0.0)
           for i in range(P) for j in range(i + 1)]
    names = [f"c{i}{j}" for i in range(P) for j in range(i + 1)]
    return sums.select(*keys, *[m.alias(f"m{i}") for i, m in enumerate(mean)], *[c.alias(k) for c, k in zip(cov, names, strict=True)])


def _starts(rows: DataFrame) -> DataFrame:
    """Two estimates per group: of all rows, and from medians and quartiles."""
    plain = _moments(rows.groupBy(*GROUP).agg(*_sums()), GROUP, 1.0).withColumn("start", F.lit(0))
    cuts = rows.groupBy(*GROUP).agg(*[F.percentile_approx(f"x{i}", [0.25, 0.5, 0.75], F.lit(1000)).alias(f"p{i}") for i in range(P)])
    middle = cuts.select(
        *GROUP, *[F.get(f"p{i}", F.lit(1)).alias(f"m{i}") for i in range(P)],
        *[(F.pow((F.get(f"p{i}", F.lit(2)) - F.get(f"p{i}", F.lit(0))) / 1.349, F.lit(2)) + FLOORS[i] ** 2 if i == j
           else F.lit(0.0)).alias(f"c{i}{j}") for i in range(P) for j in range(i + 1)], F.lit(1).alias("start"))
    return plain.unionByName(middle)


def _concentrated(rows: DataFrame, estimates: DataFrame, share: float) -> DataFrame:
    """One concentration step for every group and start."""
    keys = [*GROUP, "start"]
    octave = F.floor(BINS_PER_OCTAVE * F.log2(F.greatest(_distance(), F.lit(1e-9)))).cast("int")
    binned = (rows.join(estimates, GROUP).withColumn("bin", F.least(F.greatest(octave, F.lit(LOWEST)), F.lit(HIGHEST)))
              .groupBy(*keys, "bin").agg(*_sums()))
    # At most HIGHEST - LOWEST + 1 bins in a group.
    before = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    inner = (binned.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
             .withColumn("_all", F.sum("n").over(whole)).filter(F.col("_before") < share * F.col("_all")))
    added = ["n", *[f"s{i}" for i in range(P)], *[f"q{i}{j}" for i in range(P) for j in range(i + 1)]]
    return _moments(inner.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in added]), keys, consistency(share))


def mcd(rows: DataFrame, *, share: float = SHARE) -> DataFrame:
    """Per group the mean m_i, inverse factor r_ij and log_det of the minimum covariance determinant estimate."""
    keys = [*GROUP, "start"]
    state = saved(_factored(_starts(rows)).withColumn("moving", F.lit(True)))
    own = [c for c in state.columns if c not in (*keys, "moving")]
    for _ in range(STEPS):
        # A settled estimate would only be stepped to the same again.
        new = _factored(_concentrated(rows, state.filter("moving"), share)).select(*keys, F.struct(*own).alias("_new"))
        # Determinants fall until the closest documents stay the same; distance bins let them rise a little at the end.
        better = F.coalesce(F.col("_new.log_det") < F.col("log_det"), F.lit(False))
        gained = F.col("log_det") - F.col("_new.log_det") > SETTLED * F.greatest(F.abs("log_det"), F.lit(1.0))
        step = saved(
            state.join(new, keys, "left").select(
                *keys, *[F.when(better, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in own], (better & gained).alias("moving")),
            moving=F.count_if("moving"))
        release(state)
        state = step
        if not state.facts["moving"]:
            break
    best = Window.partitionBy(*GROUP).orderBy("log_det", "start")
    return state.withColumn("_best", F.row_number().over(best)).filter("_best = 1").drop("_best", "start", "moving")


def judged(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", source: str = "source", *,
           cutoff: float = CUTOFF, share: float = SHARE) -> DataFrame:
    """doc_id, the five counts, base_failed, distance and kept of every document.

    base_failed: fewer than 20 words, or more than 30 % of the words in repeated windows; such documents are not kept and do
    not count in the estimates.  Null languages and sources are groups of their own; a group of few documents rejects nothing
    that the floors allow; repeated rows count each; a null or empty text fails; other columns are not read.
    """
    named = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("_t"),
        F.coalesce(F.concat(F.lit("="), F.col(lang)), F.lit("null")).alias("_lang"),
        F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("null")).alias("_source"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = statistics(named, "_t", ("doc_id", *GROUP)).withColumn("base_failed", failed)
    rows = saved(rows.withColumns({f"x{i}": f for i, f in enumerate(features())}))
    estimates = saved(mcd(rows.filter("not base_failed"), share=share))
    met = rows.join(estimates, GROUP, "left").withColumn("distance", _distance())
    return met.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.when(~F.col("base_failed"), F.round("distance", 4)).alias("distance"),
        (~F.col("base_failed") & (F.col("distance") <= cutoff)).alias("kept"))
