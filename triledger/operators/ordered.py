"""Running totals, predecessors and row numbers without putting a whole key into one task.

A window partitioned by a key sends all rows of that key to one task.  Here the rows are first
range-partitioned by (key, order), so that a key of any size is cut into equal chunks; windows run
inside a chunk, and what precedes a chunk is carried over from small per-chunk summaries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triledger.operators.durable import durable, known_rows

# A chunk is worth a task from so many rows on, and has at most so many.
CHUNK_ROWS, MOST_ROWS = 20_000, 1_000_000
# With so many chunks, the one carried row of each is still small enough to broadcast.
BROADCAST_CHUNKS = 100_000


def chunk_count(spark: SparkSession, rows: int) -> int:
    """Chunks for so many rows: as many as shuffle partitions, fewer for small and more for large inputs."""
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(min(usual, rows // CHUNK_ROWS + 1), -(-rows // MOST_ROWS))


def ordered_scan(
    rows: DataFrame,
    keys: list[str],
    order: list[str],
    *,
    totals: dict[str, Column] | None = None,
    previous: dict[str, Column] | None = None,
    number: str | None = None,
    chunks: int | None = None,
    at_most: int | None = None,
) -> DataFrame:
    """Per key, in ascending `order` (which must be unique within the key), add

    * `totals`: the running sum of an expression, the current row included (nulls count as 0);
    * `previous`: the value of an expression on the preceding row;
    * `number`: the row number, from 1.

    Rows are first written to the checkpoint folder together with their chunk, so the cut is the
    same for the rows and for the summaries.  The chunks grow in number with the rows: `at_most`, a
    known bound, or the count of the rows.  Rows whose key is null are one key.
    """
    totals, previous = totals or {}, previous or {}
    cut = rows.select(
        "*",
        *[F.coalesce(e, F.lit(0)).alias(f"_t_{c}") for c, e in totals.items()],
        *[e.alias(f"_p_{c}") for c, e in previous.items()],
    )
    n = chunks
    if n is None:
        known = known_rows(rows) if at_most is None else at_most
        if known is None:
            cut = durable(cut)
            known = known_rows(cut)
        n = chunk_count(rows.sparkSession, known)
    cut = durable(cut.repartitionByRange(n, *keys, *order).withColumn("_chunk", F.spark_partition_id()))

    inside = Window.partitionBy("_chunk", *keys).orderBy(*order)
    local = cut.select(
        *rows.columns,
        "_chunk",
        F.row_number().over(inside).alias("_number"),
        *[F.sum(f"_t_{c}").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias(c) for c in totals],
        *[F.lag(f"_p_{c}").over(inside).alias(c) for c in previous],
    )

    last = F.struct(*order)
    summary = cut.groupBy("_chunk", *keys).agg(
        F.count("*").alias("_rows"),
        *[F.sum(f"_t_{c}").alias(f"_t_{c}") for c in totals],
        *[F.max_by(F.struct(F.col(f"_p_{c}").alias("v")), last).alias(f"_p_{c}") for c in previous],
    )
    before = Window.partitionBy(*keys).orderBy("_chunk")
    earlier = before.rowsBetween(Window.unboundedPreceding, -1)
    # Only the first key of a chunk can have begun in an earlier one, so this table has at most
    # one row per chunk.
    carried = summary.select(
        F.col("_chunk").alias("_c_chunk"),
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.sum("_rows").over(earlier).alias("_c_number"),
        *[F.sum(f"_t_{c}").over(earlier).alias(f"_c_{c}") for c in totals],
        *[F.lag(f"_p_{c}").over(before).getField("v").alias(f"_c_{c}") for c in previous],
    ).filter(F.col("_c_number").isNotNull())

    same = [F.col("_chunk") == F.col("_c_chunk"), *[F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]]
    joined = local.join(F.broadcast(carried) if n <= BROADCAST_CHUNKS else carried, same, "left")
    return joined.select(
        *rows.columns,
        *[(F.col(c) + F.coalesce(F.col(f"_c_{c}"), F.lit(0))).alias(c) for c in totals],
        *[F.when(F.col("_number") == 1, F.col(f"_c_{c}")).otherwise(F.col(c)).alias(c) for c in previous],
        *([(F.col("_number") + F.coalesce("_c_number", F.lit(0))).alias(number)] if number else []),
    )


def daily_running_total(rows: DataFrame, keys: list[str], day: str, order: list[str], value: str, name: str) -> DataFrame:
    """Running sum of `value` per key: whole days first, then inside each day."""
    per_day = rows.groupBy(*keys, day).agg(F.sum(value).alias("_day_sum"))
    earlier = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    opening = per_day.select(*keys, day, F.coalesce(F.sum("_day_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, day).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumn("_inside", F.sum(value).over(inside))
        .join(opening, [*keys, day])
        .withColumn(name, F.col("_before") + F.col("_inside"))
        .drop("_before", "_inside")
    )


def totals_before(
    rows: DataFrame, boundaries: DataFrame, keys: list[str], day: str, value: str, name: str
) -> DataFrame:
    """Per (key, boundary day): the sum of `value` over rows dated strictly before the boundary.

    Rows are summed per key and day first, so a key contributes at most one row per calendar day
    to the window, however many rows it has.
    """
    per_day = (
        rows.filter(F.col(day).isNotNull()).groupBy(*keys, F.col(day).alias("_day"))
        .agg(F.sum(value).alias("_value")).withColumn("_boundary", F.lit(False))
    )
    marks = boundaries.select(*keys, F.col("boundary").alias("_day")).distinct().select(
        *keys, "_day", F.lit(0).alias("_value"), F.lit(True).alias("_boundary"))
    both = per_day.unionByName(marks.withColumn("_value", F.col("_value").cast(per_day.schema["_value"].dataType)))
    # A boundary sorts before the rows of its own day: "strictly before".
    running = Window.partitionBy(*keys).orderBy("_day", F.col("_boundary").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return (
        both.withColumn(name, F.sum("_value").over(running)).filter("_boundary")
        .select(*keys, F.col("_day").alias("boundary"), name)
    )


def gap_islands(positions: DataFrame, keys: list[str], position: str, max_gap: int, name: str, block: int = 10_000) -> DataFrame:
    """Number the runs of distinct integer positions per key; a gap above `max_gap` starts a new run.

    The island is named by its first position.  Positions are scanned in blocks, so no window sees
    more than `block` positions, and blocks are joined by their first and last positions only.
    """
    inside = Window.partitionBy(*keys, "_block").orderBy(position)
    blocked = positions.select(*keys, position).distinct().withColumn("_block", F.floor(F.col(position) / block))
    gap = F.col(position) - F.lag(position).over(inside)
    blocked = blocked.withColumn("_start", F.when(gap > max_gap, F.col(position)))
    blocked = blocked.withColumn("_start", F.max("_start").over(inside.rowsBetween(Window.unboundedPreceding, 0)))

    ends = blocked.groupBy(*keys, "_block").agg(
        F.min(position).alias("_first"), F.max(position).alias("_last"), F.max("_start").alias("_last_start"))
    across = Window.partitionBy(*keys).orderBy("_block")
    upto = across.rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumn("_lag_last", F.lag("_last").over(across))
    fresh = F.col("_lag_last").isNull() | (F.col("_first") - F.col("_lag_last") > max_gap)
    # The last start known before the first break inside this block.
    ends = ends.withColumn("_opening", F.when(fresh, F.col("_first")))
    ends = ends.withColumn(
        "_known", F.max(F.greatest("_opening", "_last_start")).over(upto.rowsBetween(Window.unboundedPreceding, -1)))
    ends = ends.select(*keys, "_block", F.coalesce("_opening", "_known").alias("_inherited"))
    return blocked.join(ends, [*keys, "_block"]).select(*keys, position, F.coalesce("_start", "_inherited").alias(name))
