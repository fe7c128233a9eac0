"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triledger.operators.durable import durable, known_rows

# The list of hot keys is broadcast; where more keys than this could be hot, only hotter ones count as hot.
HOT_KEYS = 100_000
# Rows of a lookup that is broadcast.
SMALL_LOOKUP = 100_000
# Rows are counted by so many buckets of their keys first: a key is hot only in a bucket that is.
BUCKETS = 8_192


def hot_limit(hot_rows: int, at_most: int | None) -> int:
    """Rows from which a key is hot, so that at most HOT_KEYS keys can be."""
    return hot_rows if at_most is None else max(hot_rows, at_most // HOT_KEYS)


def salts_for(rows: Column, hot_rows: int) -> Column:
    """As many salts as leave each with `hot_rows` rows."""
    return F.ceil(rows / F.lit(hot_rows)).cast("int")


def hot_keys(df: DataFrame, on: list[str], hot_rows: int) -> DataFrame:
    """Keys with more than `hot_rows` rows and their number of salts.  There are at most rows / hot_rows of them."""
    return df.groupBy(*on).count().filter(F.col("count") > hot_rows).select(*on, salts_for(F.col("count"), hot_rows).alias("_salts"))


def hot_buckets(df: DataFrame, on: list[str], hot_rows: int, at_most: int | None) -> DataFrame | None:
    """Buckets of keys with more than `hot_rows` rows in all, as a stored table; none where most would have that many.

    A count by bucket leaves each task with few rows to shuffle, a count by key with nearly all of its rows.
    """
    if at_most is None or at_most > hot_rows * BUCKETS // 4:
        return None
    return durable(df.groupBy(bucket_of(on).alias("_bucket")).count().filter(F.col("count") > hot_rows).select("_bucket"))


def bucket_of(on: list[str]) -> Column:
    return F.pmod(F.xxhash64(*on), F.lit(BUCKETS))


def salted_join(
    rows: DataFrame, lookup: DataFrame, on: list[str], *, hot_rows: int, at_most: int | None = None, how: str = "left",
    lookup_rows: int | None = None,
) -> DataFrame:
    """Equi-join of a large table with a lookup that is unique on `on`.

    Rows of a hot key are dealt over as many salts as its count asks for, and the lookup row of that key is repeated for
    each; all other keys join as usual.  When no key is known to have more than `at_most` rows and that is no more than
    `hot_rows`, nothing can be hot and nothing is salted.  Above that, keys are counted by themselves only where their bucket
    has that many rows, and nothing is salted where none has.  A lookup known to have no more than `lookup_rows` rows is
    broadcast if that is few: then the rows stay where they are, however hot a key is, and are not read to count them.
    """
    if at_most is None:
        at_most = known_rows(rows)
    if lookup_rows is not None and lookup_rows <= SMALL_LOOKUP:
        return rows.join(F.broadcast(lookup), on, how)
    if at_most is not None and at_most <= hot_rows:
        return rows.join(lookup, on, how)
    limit, counted = hot_limit(hot_rows, at_most), rows
    if (buckets := hot_buckets(rows, on, limit, at_most)) is not None:
        if known_rows(buckets) == 0:
            return rows.join(lookup, on, how)
        counted = rows.join(F.broadcast(buckets), bucket_of(on) == buckets["_bucket"], "left_semi")
    hot = F.broadcast(hot_keys(counted, on, limit))
    spread_by = F.xxhash64(*[F.col(c) for c in rows.columns if c not in on])
    # Rows without a key match nothing; any salt will do, so each goes anywhere.
    keyless = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in on))
    marked = (
        rows.join(hot, on, "left")
        .withColumn("_salt", F.when(keyless, spread_by).otherwise(
            F.coalesce(F.pmod(spread_by, F.col("_salts").cast("bigint")), F.lit(0).cast("bigint"))))
        .drop("_salts")
    )
    spread = (
        lookup.join(hot, on, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col("_salts") - 1, F.lit(0)).cast("bigint"))))
        .drop("_salts")
    )
    return marked.join(spread, [*on, "_salt"], how).drop("_salt")
