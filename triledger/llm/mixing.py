"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells (source, language, topic).  The tokens of the cells are raked: in turn, each margin's sums are scaled
to its target shares, until no scale differs from one.  A cell's raked weight over its tokens is the rate of its documents; the
rates, scaled so that the highest is one, are the probabilities of a Bernoulli sample by a hash of the document id.

Only the cells are iterated over: as many rows as there are combinations, summed before the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triledger.llm.tables import packed, release, saved

MARGINS = ("source", "lang", "topic")
WORD = r"[^\x20\x09-\x0D]+"
TOLERANCE = 1e-10
# Rounds between two written tables; raking that has gained less than STALLED in PATIENCE of them cannot reach its targets.
AT_ONCE, STALLED, PATIENCE = 3, 0.999, 5


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def marked_topic(text: str, marks: list[tuple[str, list[str]]], other: str) -> Column:
    """The first topic one of whose marks the text contains, else `other`."""
    topic = F.lit(other)
    for name, found in reversed(marks):
        topic = F.when(reduce(lambda a, b: a | b, (F.contains(F.col(text), F.lit(m)) for m in found)), name).otherwise(topic)
    return topic


def _key(margin: Column | str) -> Column:
    """A text that is never null; a null value is a value of its own."""
    value = F.col(margin) if isinstance(margin, str) else margin
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("null"))


def tempered(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """Target shares in proportion to a power of the tokens: below one, rare values gain."""
    sums = cells.groupBy(margin).agg(F.pow(F.sum("tokens"), F.lit(power)).alias("share"))
    return sums


def rake(cells: DataFrame, targets: dict[str, DataFrame], *, tolerance: float = TOLERANCE) -> DataFrame:
    """`cells` with `weight`: tokens scaled until the sums of each margin are in proportion to its targets (margin, share).

    Raking ends when no scale is off one by more than `tolerance`.  A value without a target gets no weight.  Where zero cells
    make the targets unreachable, it ends when the scales no longer come nearer to one; `residuals` tells what is missing.
    """
    state = cells.withColumn("weight", F.col("tokens").cast("double"))
    for i, (margin, target) in enumerate(targets.items()):
        aim = target.select(margin, F.col("share").cast("double").alias(f"_t{i}"))
        state = state.join(aim, margin, "left")
    # All margins are scaled to a sum of one; shares of values that have no cells cannot be met and do not count.
    there = [f"_t{i}" for i in range(len(targets))]
    sums = [target.join(cells.select(margin).distinct(), margin, "left_semi").agg(F.sum("share").cast("double").alias("s"))
            for margin, target in targets.items()]
    state = saved(state.select(
        *cells.columns, "weight", *[F.coalesce(F.try_divide(F.col(c), s.select("s").scalar()), F.lit(0.0)).alias(c) for c, s in zip(there, sums, strict=True)]))
    best, waited = float("inf"), 0
    while waited < PATIENCE:
        step = state
        for _ in range(AT_ONCE):
            off = F.lit(0.0)
            for c, margin in zip(there, targets, strict=True):
                # Windows see cells, one row for each combination, never documents.
                whole = F.sum("weight").over(Window.partitionBy(margin))
                step = step.withColumn("_scale", F.when((whole > 0) & (F.col(c) > 0), F.col(c) / whole).otherwise(0.0))
                step = step.withColumn("weight", F.col("weight") * F.col("_scale")).withColumn(
                    f"_off{c}", F.when(F.col("weight") > 0, F.abs(F.col("_scale") - 1)).otherwise(0.0))
                off = F.greatest(off, F.col(f"_off{c}"))
        before, state = state, saved(step.select(*cells.columns, "weight", *there, off.alias("off")), off=F.max("off"))
        release(before)
        # How far the scales of the last round were from one.
        left = state.facts["off"] or 0.0
        if left <= tolerance:
            break
        best, waited = (left, 0) if left < STALLED * best else (best, waited + 1)
    return state.select(*cells.columns, "weight")


def residuals(raked: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """margin, value, target and reached share of every value that has cells or a target; shares add up to one where any are met."""
    out = None
    for margin, target in targets.items():
        reached = raked.groupBy(margin).agg(F.sum("weight").alias("w"))
        both = reached.join(target.select(margin, F.col("share").cast("double").alias("t")), margin, "full")
        # One row a value of the margin.
        every = Window.partitionBy(F.lit(0))
        one = both.select(F.lit(margin).alias("margin"), F.col(margin).alias("value"),
                          F.coalesce(F.col("t") / F.sum("t").over(every), F.lit(0.0)).alias("target"),
                          F.coalesce(F.try_divide(F.col("w"), F.sum("w").over(every)), F.lit(0.0)).alias("reached"))
        out = one if out is None else out.unionByName(one)
    return out


def with_probability(docs: DataFrame, cells_of: DataFrame, *, power: float | None = None,
                     targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """`docs`, which has the key columns _source, _lang, _topic, with `_probability`.

    `cells_of` has the same keys and `_tokens` of each document.  Targets are given, or tempered by `power`.
    """
    keys = [f"_{m}" for m in MARGINS]
    cells = saved(cells_of.groupBy(*keys).agg(F.sum("_tokens").alias("tokens")))
    aims = targets or {k: tempered(cells, k, power) for k in keys}
    raked = saved(rake(cells, aims).withColumn("rate", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)),
                  most=F.max("rate"))
    most = float(raked.facts["most"] or 1.0)
    # A document without tokens has no weight in any margin; it takes the probability of its cell.
    rates = raked.select(*keys, F.least(F.lit(1.0), F.col("rate") / F.lit(most)).alias("_probability"))
    # A row per cell; the planner broadcasts it only below its threshold, and splits a busy cell beyond.
    return docs.join(rates, keys)


def chance(doc_id: str, seed: str) -> Column:
    """A number from 0 to 1 by the id: 52 bits of md5."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(2.0 ** 52)


def _keys(topic: Column | str) -> list[Column]:
    return [_key("source").alias("_source"), _key("lang").alias("_lang"), _key(topic).alias("_topic")]


def mix(docs: DataFrame, topic: Column, *, power: float | None = None, targets: dict[str, DataFrame] | None = None,
        seed: str = "mix") -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, probability and sampled of every document.

    `topic` is an expression over the documents; tokens are words.  Null sources, languages and topics are values of their
    own; null and empty texts have no tokens; repeated rows share their fate; a corpus without tokens samples nothing; other
    columns are not read.  `targets` has (_source | _lang | _topic, share) by margin, with values written as `=value`.
    """
    rows = docs.select("doc_id", "source", "lang", topic.alias("topic"), word_count("text").alias("n_tokens"))
    rows = saved(rows.select("*", *_keys("topic")))
    whole = with_probability(rows, rows.withColumnRenamed("n_tokens", "_tokens"), power=power, targets=targets)
    return whole.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("_probability", 5).alias("probability"),
                        (chance("doc_id", seed) < F.col("_probability")).alias("sampled"))


def sampled(docs: DataFrame, topic: Column, *, power: float | None = None, targets: dict[str, DataFrame] | None = None,
            seed: str = "mix") -> DataFrame:
    """The sampled documents with all their columns."""
    own = docs.select("doc_id", *_keys(topic), packed(docs))
    cells_of = docs.select(*_keys(topic), word_count("text").alias("_tokens"))
    whole = with_probability(own, cells_of, power=power, targets=targets)
    return whole.filter(chance("doc_id", seed) < F.col("_probability")).select("_doc.*")
