"""The exact balance bridge of every agent and the actions that follow from it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triledger.config import Config
from triledger.functions.text import money
from triledger.operators.ledger import MONEY, balance_points
from triledger.vocabulary import (
    COMPONENTS, GROUP_STATUSES, PAYMENT_STATUSES, ROUNDING_STATUSES,
)

# Components that are the summed gap effect of one status.
BY_GROUP_STATUS = {
    "double_debit": "DOUBLE_DEBIT",
    "statement_only_journal_sale": "STATEMENT_ONLY_JOURNAL_SALE",
    "statement_only": "STATEMENT_ONLY",
    "not_in_statement": "NOT_IN_STATEMENT",
    "void_unbalanced": "VOID_UNBALANCED",
    "ledger_in_missing_month": "LEDGER_IN_MISSING_MONTH",
}
BY_PAYMENT_STATUS = {
    "payment_not_in_statement": "PAYMENT_NOT_IN_STATEMENT",
    "payment_not_in_ledger": "PAYMENT_NOT_IN_LEDGER",
    "repeated_credit": "REPEATED_CREDIT",
    "payment_wrong_agent": "PAYMENT_WRONG_AGENT",
    "payment_in_missing_month": "PAYMENT_IN_MISSING_MONTH",
}


def _add(columns) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c) for c in columns])


def _sum_where(value: str, condition: Column) -> Column:
    return F.sum(F.when(condition, F.col(value))).cast(MONEY)


def agent_bridge(acts: DataFrame, groups: DataFrame, payments: DataFrame, ledger: DataFrame) -> DataFrame:
    """Gap at the end of the window = opening gap + nineteen causes; the rest is `unexplained`."""
    at = F.struct("period_start", "period_end")
    per_act = acts.groupBy("agent").agg(
        F.min("period_start").alias("window_start"),
        F.max("period_end").alias("window_end"),
        F.min_by("opening", at).alias("_opening"),
        F.max_by("closing", at).alias("_closing"),
        _sum_where("jump", F.col("continuity_break")).alias("continuity_breaks"),
        _sum_where("jump", F.col("jump_over_missing")).alias("jumps_over_missing"),
        F.sum("internal_delta").cast(MONEY).alias("statement_arithmetic"),
    ).withColumn("_end", F.date_add("window_end", 1))
    points = balance_points(
        ledger, per_act.select("agent", F.explode(F.array("window_start", "_end")).alias("boundary")))
    point = lambda name, alias: points.select("agent", F.col("boundary").alias(name), F.col("balance").alias(alias))

    residual = F.col("status") == "AMOUNT_RESIDUAL"
    per_group = groups.groupBy("agent").agg(
        _sum_where("gap_effect", F.col("status").isin(*ROUNDING_STATUSES)).alias("rounding"),
        *[_sum_where("gap_effect", residual & (F.col("error_source") == s)).alias(f"residual_{s.lower()}")
          for s in ("STATEMENT", "BOT", "REVIEW")],
        *[_sum_where("gap_effect", F.col("status") == s).alias(c) for c, s in BY_GROUP_STATUS.items()],
    )
    per_payment = payments.groupBy("agent").agg(
        *[_sum_where("gap_effect", F.col("status") == s).alias(c) for c, s in BY_PAYMENT_STATUS.items()])

    rows = (
        per_act.join(point("window_start", "_balance_start"), ["agent", "window_start"])
        .join(point("_end", "_balance_end"), ["agent", "_end"])
        .join(per_group, "agent", "left").join(per_payment, "agent", "left")
        .withColumn("opening_gap", F.col("_opening") + F.col("_balance_start"))
        .withColumn("gap_close", (F.col("_closing") + F.col("_balance_end")).cast(MONEY)))
    rows = rows.select(
        "agent", "window_start", "window_end", "gap_close",
        *[F.coalesce(c, F.lit(0)).cast(MONEY).alias(c) for c in COMPONENTS])
    return rows.withColumn("components_sum", _add(COMPONENTS).cast(MONEY)).withColumn(
        "unexplained", (F.col("gap_close") - F.col("components_sum")).cast(MONEY))


def status_counts(rows: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    """Rows per agent and status, one column n_<status> each."""
    counted = rows.groupBy("agent").pivot("status", list(statuses)).count()
    return counted.select("agent", *[F.coalesce(F.col(s), F.lit(0)).alias(f"n_{s}") for s in statuses])


def agent_actions(bridge: DataFrame, groups: DataFrame, payments: DataFrame, missing: DataFrame) -> DataFrame:
    """What to move, what to correct and what to clarify, largest first."""
    counts = [f"n_{s}" for s in GROUP_STATUSES + PAYMENT_STATUSES]
    months = missing.groupBy("agent").agg(F.count("*").alias("missing_months"))
    # Every verdict names the side to mend; what belongs to whole statements is added by hand.
    sides = groups.select("agent", "fix_side", "gap_effect").unionByName(payments.select("agent", "fix_side", "gap_effect"))
    sides = sides.groupBy("agent").agg(*[
        _sum_where("gap_effect", F.col("fix_side") == s).alias(f"_{s}") for s in ("ledger", "statement", "clarify")])
    rows = (
        bridge.join(sides, "agent", "left").fillna(0, ["_ledger", "_statement", "_clarify"])
        .join(status_counts(groups, GROUP_STATUSES), "agent", "left")
        .join(status_counts(payments, PAYMENT_STATUSES), "agent", "left")
        .join(months, "agent", "left").fillna(0, [*counts, "missing_months"]))
    rows = rows.withColumns({
        "ledger_adjust": (-F.col("_ledger")).cast(MONEY),
        "statement_adjust": (-_add(["_statement", "continuity_breaks", "statement_arithmetic"])).cast(MONEY),
        "to_clarify": _add(["_clarify", "opening_gap", "jumps_over_missing"]).cast(MONEY),
    }).drop("_ledger", "_statement", "_clarify")
    rows = rows.withColumn("gap_after_fixes", _add(["gap_close", "ledger_adjust", "statement_adjust"]).cast(MONEY))
    rows = rows.withColumns({
        "check_after_fixes": (F.col("gap_after_fixes") - _add(["to_clarify", "rounding", "unexplained"])).cast(MONEY),
        "priority": (F.abs("ledger_adjust") + F.abs("statement_adjust") + F.abs("to_clarify")).cast(MONEY),
        "recommended_action": recommendation(),
    })
    return rows.withColumn("status", F.when(F.col("priority") < 1, "OK").otherwise("ACTION_REQUIRED")) \
        .orderBy(F.desc("priority"), "agent")


def recommendation() -> Column:
    """Up to three clauses; a clause is left out when its amount is below one."""
    def counted(labels: dict[str, str]) -> Column:
        parts = F.array_compact(F.array(*[
            F.when(F.col(f"n_{s}") > 0, F.concat(F.lit(f"{label}: "), F.col(f"n_{s}").cast("string")))
            for s, label in labels.items()]))
        return F.when(F.size(parts) > 0, F.concat(F.lit(" ("), F.array_join(parts, "; "), F.lit(")"))).otherwise("")

    def clause(amount: str, lead: str, tail: Column) -> Column:
        return F.when(F.abs(amount) >= 1, F.concat(F.lit(lead), money(F.col(amount), signed=True), tail))

    clauses = F.array_compact(F.array(
        clause("ledger_adjust", "Move the ledger balance by ", counted({
            "DOUBLE_DEBIT": "double debit", "STATEMENT_ONLY_JOURNAL_SALE": "sale not carried over",
            "REPEATED_CREDIT": "repeated payment", "PAYMENT_NOT_IN_LEDGER": "payment not credited",
            "PAYMENT_WRONG_AGENT": "payment to another agent"})),
        clause("statement_adjust", "Correct the statements by ", counted({
            "NOT_IN_STATEMENT": "not invoiced", "PAYMENT_NOT_IN_STATEMENT": "payment not booked"})),
        clause("to_clarify", "First clarify ", F.lit(" (opening gap, missing statements, disputed amounts)")),
    ))
    return F.when(F.size(clauses) > 0, F.array_join(clauses, "; ")).otherwise("Nothing to do")
