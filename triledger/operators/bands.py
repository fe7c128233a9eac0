"""Counting partners within an amount and a day tolerance, without listing the pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triledger.operators.skew import salted_join

CLASS = ["agent", "amount", "day"]


def band_partners(
    left: DataFrame, right: DataFrame, *, tolerance: int, days: int, same_agent: bool, hot_rows: int, at_most: int | None = None
) -> DataFrame:
    """Per left `id`: how many right rows lie within the tolerances, and the smallest day distance.

    Both sides have agent, amount and day.  Equal rows are counted before the join, and a class of
    left rows meets only the amounts and days around it, so a crowd of equal amounts costs one row.
    With `same_agent` false the partners are all agents' rows less the agent's own.
    """
    cell = F.floor(F.col("amount") / max(tolerance, 1)).cast("bigint")
    bucket = F.floor(F.unix_date("day") / (days + 1)).cast("bigint")
    around = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1))
    scope = ["agent"] if same_agent else []

    probes = left.select(*CLASS).distinct().select(*CLASS, cell.alias("c0"), bucket.alias("b0"))
    probes = probes.select(*CLASS, around("c0").alias("cell"), "b0").select(*CLASS, "cell", around("b0").alias("bucket"))
    own = right.groupBy(*CLASS).agg(F.count("*").alias("own"))
    slots = own.groupBy(*scope, "amount", "day").agg(F.sum("own").alias("n")).select(
        *scope, F.col("amount").alias("r_amount"), F.col("day").alias("r_day"), "n", cell.alias("cell"), bucket.alias("bucket"))

    apart = F.abs(F.datediff("day", "r_day"))
    near = probes.join(slots, [*scope, "cell", "bucket"]).filter(
        (F.abs(F.col("amount") - F.col("r_amount")) <= tolerance) & (apart <= days))
    if not same_agent:
        mine = own.select("agent", F.col("amount").alias("r_amount"), F.col("day").alias("r_day"), "own")
        near = near.join(mine, ["agent", "r_amount", "r_day"], "left") \
            .withColumn("n", F.col("n") - F.coalesce("own", F.lit(0))).filter(F.col("n") > 0)
    partners = near.groupBy(*CLASS).agg(F.sum("n").alias("candidates"), F.min(apart).alias("nearest"))
    return salted_join(left, partners, CLASS, how="inner", hot_rows=hot_rows, at_most=at_most).select(
        "id", "candidates", "nearest")
