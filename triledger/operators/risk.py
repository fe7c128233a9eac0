"""Who makes errors, and how sure that is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triledger.config import Config
from triledger.functions.stats import chi_square_p, wilson
from triledger.operators.durable import durable, known_rows
from triledger.operators.skew import salted_join

SIGNIFICANT = 0.05


def journal_errors(journal: DataFrame, groups: DataFrame, config: Config, at_most: int | None = None) -> DataFrame:
    """Sales of known agents with a flag for rows that the employee got wrong."""
    sales = journal.filter((F.col("kind") == config.words.journal_sale) & ~F.col("agent").isin("DIRECT_CLIENT", "UNASSIGNED"))
    status = groups.select("gid", "status")
    if at_most is None:
        at_most = known_rows(journal)
    joined = salted_join(sales, status, ["gid"], hot_rows=config.hot_rows, at_most=at_most)
    wrong = F.col("status").isin("JOURNAL_AMOUNT_DIFF", "TICKET_IN_AMOUNT")
    return joined.select(
        "employee", (F.coalesce(wrong, F.lit(False)) | (F.col("amount_issue") != "") | F.col("is_copy")).alias("is_error"))


def error_counts(rows: DataFrame, by: str) -> DataFrame:
    return rows.filter(F.col(by).isNotNull()).groupBy(by).agg(
        F.count_if("is_error").alias("errors"), F.count("*").alias("rows"))


def homogeneity(counts: DataFrame) -> DataFrame:
    """One row: the chi-square statistic of equal error shares, its degrees of freedom and p-value.

    With a single degree of freedom the usual continuity correction applies.  When nobody or
    everybody has errors there is nothing to compare and the result is null.
    """
    # One row each, read for the totals and again for the parts: what they are counted from is read once.
    counts = counts if hasattr(counts, "_path") else durable(counts)
    totals = counts.agg(
        F.sum("errors").alias("all_errors"), F.sum("rows").alias("all_rows"), F.count("*").alias("groups"))
    every = lambda c: totals.select(c).scalar()
    dof = every("groups") - 1

    def part(observed: Column, share: Column) -> Column:
        expected = F.col("rows") * share
        distance = F.abs(observed - expected)
        distance = F.when(dof == 1, distance - F.least(F.lit(0.5), distance)).otherwise(distance)
        return F.when(expected > 0, distance * distance / expected)

    share = every("all_errors") / every("all_rows")
    out = counts.agg(
        F.sum(part(F.col("errors"), share) + part(F.col("rows") - F.col("errors"), 1 - share)).alias("statistic"),
        (F.count("*") - 1).alias("dof"))
    return out.withColumn("p_value", chi_square_p("statistic", "dof"))


def risk_by_employee(rows: DataFrame) -> DataFrame:
    """Error share per employee with a 95 % interval and the test over all employees."""
    counts = durable(error_counts(rows, "employee"))
    low, high = wilson(F.col("errors"), F.col("rows"))
    test = homogeneity(counts)
    return counts.select(
        "employee", "errors", "rows",
        (F.col("errors") / F.col("rows")).alias("error_rate"),
        low.alias("ci95_low"), high.alias("ci95_high"),
        test.select("p_value").scalar().alias("chi2_p_value"),
    ).withColumn("significant", F.col("chi2_p_value") < SIGNIFICANT).orderBy(F.desc("error_rate"), "employee")


def risk_by_agent(scored: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Agents by their expected errors; needs agent, p_error, is_err and amount per operation."""
    return scored.groupBy("agent").agg(
        F.count("*").alias("operations"),
        F.sum("p_error").alias("expected_errors"),
        F.avg("p_error").alias("mean_p_error"),
        F.sum(F.col("is_err").cast("bigint")).alias("flagged"),
        F.coalesce(F.sum(F.when(F.col("p_error") > threshold, F.abs("amount"))), F.lit(0)).cast("decimal(18,2)").alias("risky_turnover"),
    )
