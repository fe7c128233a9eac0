"""Balances: the ledger chain, the continuity of statements, missing months, monthly identities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triledger.config import Config
from triledger.functions.times import month_of
from triledger.operators.durable import known_rows
from triledger.operators.ordered import ordered_scan, totals_before
from triledger.operators.skew import salted_join

MONEY = "decimal(18,2)"


def opening_balances(ledger: DataFrame) -> DataFrame:
    """Per agent: the balance before its first row, and whether first, total and last fit together."""
    at = F.struct("ts", "txn_id")
    known = lambda c: F.when(F.col(c).isNotNull(), at)
    first_balance, first_amount = F.min_by("balance_after", known("balance_after")), F.min_by("amount", known("amount"))
    return ledger.filter(F.col("agent").isNotNull()).groupBy("agent").agg(
        (first_balance - first_amount).cast(MONEY).alias("opening_balance"),
        F.sum("amount").cast(MONEY).alias("moved"),
        F.max_by("balance_after", known("balance_after")).alias("last_balance"),
    ).withColumn("chain_check", (F.col("opening_balance") + F.col("moved") - F.col("last_balance")).cast(MONEY))


def chain_breaks(ledger: DataFrame, config: Config) -> DataFrame:
    """Ledger rows whose balance does not follow from the row before."""
    rows = ledger.filter(F.col("agent").isNotNull()).select("agent", "ts", "txn_id", "amount", "balance_after")
    scanned = ordered_scan(rows, ["agent"], ["ts", "txn_id"], previous={"previous_balance": F.col("balance_after")}, at_most=known_rows(ledger))
    gap = (F.col("balance_after") - F.col("previous_balance") - F.col("amount")).cast(MONEY)
    return scanned.withColumn("chain_gap", gap).filter(F.abs("chain_gap") > F.expr(config.chain_tolerance))


def act_table(statements: DataFrame, config: Config) -> DataFrame:
    """One row per (agent, period) with its arithmetic and its connection to the period before."""
    known = lambda c: F.when(F.col(c).isNotNull(), F.col("line_no"))
    key = ["agent", "period_start", "period_end"]
    keyed = statements.filter(F.col("agent").isNotNull() & F.col("period_start").isNotNull() & F.col("period_end").isNotNull())
    acts = keyed.groupBy(*key).agg(
        F.min_by("opening", known("opening")).alias("opening"),
        F.min_by("closing", known("closing")).alias("closing"),
        F.sum("mv").cast(MONEY).alias("mv"),
        F.count("*").alias("rows"),
        F.min_by("version", known("version")).alias("version"),
        F.min_by("folder", known("folder")).alias("folder"),
    )
    # One row per agent and period by now: the window holds a few hundred rows per agent at most.
    order = Window.partitionBy("agent").orderBy("period_start", "period_end")
    tolerance = F.expr(config.jump_tolerance)
    acts = acts.select(
        "*",
        (F.col("closing") - F.col("opening") - F.col("mv")).cast(MONEY).alias("internal_delta"),
        F.lag("closing").over(order).alias("previous_closing"),
        F.lag("period_end").over(order).alias("previous_end"),
    )
    acts = acts.withColumn("jump", (F.col("opening") - F.col("previous_closing")).cast(MONEY))
    consecutive = F.coalesce(F.datediff("period_start", "previous_end") == 1, F.lit(False))
    jumped = F.coalesce(F.abs("jump") > tolerance, F.lit(False))
    return acts.select(
        "*", consecutive.alias("consecutive"), (jumped & consecutive).alias("continuity_break"),
        (jumped & ~consecutive).alias("jump_over_missing"))


def agent_windows(statements: DataFrame) -> DataFrame:
    """First and last day covered by any statement of the agent."""
    return statements.filter(F.col("agent").isNotNull()).groupBy("agent").agg(
        F.min("period_start").alias("window_start"), F.max("period_end").alias("window_end"))


def missing_months(statements: DataFrame, windows: DataFrame) -> DataFrame:
    """Months between the first and the last of all agents that an agent has no statement for."""
    span = windows.agg(
        F.trunc(F.min("window_start"), "month").alias("lo"), F.trunc(F.max("window_end"), "month").alias("hi"))
    months = F.sequence(span.select("lo").scalar(), span.select("hi").scalar(), F.expr("interval 1 month"))
    every = windows.select("agent", F.explode(months).alias("month"))
    present = statements.select("agent", F.trunc("period_end", "month").alias("month")).distinct()
    return every.join(present, ["agent", "month"], "left_anti")


def with_month_missing(
    rows: DataFrame, ts: str, missing: DataFrame, config: Config, at_most: int | None = None
) -> DataFrame:
    """Flag rows whose month, or the one after it, has no statement for their agent."""
    flagged = missing.select("agent", F.explode(F.array(F.col("month"), F.add_months("month", -1))).alias("_month")) \
        .distinct().withColumn("_missing", F.lit(True))
    dated = rows.withColumn("_month", F.trunc(F.col(ts), "month"))
    # A missing month flags itself and the one before.
    few = None if known_rows(missing) is None else 2 * known_rows(missing)
    return salted_join(dated, flagged, ["agent", "_month"], hot_rows=config.hot_rows, at_most=at_most, lookup_rows=few) \
        .select(*rows.columns, F.coalesce("_missing", F.lit(False)).alias("month_missing"))


def with_window_flag(ledger: DataFrame, windows: DataFrame, config: Config) -> DataFrame:
    """Flag ledger rows inside their agent's statement window; without a window a row is outside."""
    joined = salted_join(ledger, windows, ["agent"], hot_rows=config.hot_rows, at_most=known_rows(ledger),
                         lookup_rows=known_rows(windows))
    inside = (F.col("day") >= F.col("window_start")) & (F.col("day") <= F.col("window_end"))
    return joined.select(*ledger.columns, F.coalesce(inside, F.lit(False)).alias("in_window"))


def balance_points(ledger: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Ledger balance of each agent right before the boundary days; agents without ledger start at 0."""
    moved = totals_before(ledger, boundaries, ["agent"], "day", "amount", "moved_before")
    openings = opening_balances(ledger).select("agent", "opening_balance")
    return moved.join(openings, "agent", "left").select(
        "agent", "boundary", "moved_before",
        (F.coalesce("opening_balance", F.lit(0)) + F.col("moved_before")).cast(MONEY).alias("balance"),
        F.col("opening_balance").isNotNull().alias("has_ledger"))


def monthly_bridge(acts: DataFrame, ledger: DataFrame) -> DataFrame:
    """Per agent and period: the change of the gap against what the two movements explain."""
    bounds = acts.select("agent", F.col("period_start").alias("s"), F.date_add("period_end", 1).alias("e"))
    points = balance_points(ledger, bounds.select("agent", F.explode(F.array("s", "e")).alias("boundary")))
    at = lambda name, alias: points.select(
        "agent", F.col("boundary").alias(name), F.col("balance").alias(alias))
    rows = (
        acts.withColumn("_e", F.date_add("period_end", 1))
        .join(at("period_start", "ledger_start"), ["agent", "period_start"])
        .join(at("_e", "ledger_end"), ["agent", "_e"]))
    moved = F.col("ledger_end") - F.col("ledger_start")
    gap_start, gap_end = F.col("opening") + F.col("ledger_start"), F.col("closing") + F.col("ledger_end")
    expected = F.col("internal_delta") + F.col("mv") + moved
    zero = F.lit(0).cast(MONEY)
    return rows.select(
        "agent",
        month_of(F.col("period_end")).alias("month"),
        "opening", "closing", F.col("mv").alias("statement_moved"), "internal_delta",
        "ledger_start", "ledger_end", moved.cast(MONEY).alias("ledger_moved"),
        gap_start.cast(MONEY).alias("gap_start"), gap_end.cast(MONEY).alias("gap_end"),
        (gap_end - gap_start).cast(MONEY).alias("gap_change"),
        expected.cast(MONEY).alias("identity_expected"),
        (gap_end - gap_start - expected).cast(MONEY).alias("identity_residual"),
        F.when(F.col("continuity_break") | F.col("jump_over_missing"), F.col("jump")).otherwise(zero).alias("opening_jump"),
        "continuity_break",
    )
