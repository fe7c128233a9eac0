"""Ledger payments against statement receipts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triledger.config import Config
from triledger.functions.text import money
from triledger.functions.times import micros
from triledger.operators.durable import durable
from triledger.operators.ledger import with_month_missing
from triledger.operators.matching import NEAREST, OTHER_AGENT, match_one_to_one
from triledger.operators.ordered import ordered_scan
from triledger.operators.rules import Rule, first_match, outcome


@dataclass(frozen=True)
class PaymentMatch:
    payments: DataFrame   # ledger payments with matched_line (null when unmatched)
    receipts: DataFrame   # statement receipts with is_matched


def payment_rows(ledger: DataFrame, config: Config) -> DataFrame:
    return ledger.filter(F.col("kind") == config.words.payment).select("agent", "txn_id", "ts", "day", "amount")


def receipt_rows(statements: DataFrame) -> DataFrame:
    return statements.filter(F.col("line_kind") == "receipt").select(
        "agent", "line_no", "doc_date", "doc", (-F.col("mv")).cast("decimal(18,2)").alias("amount"))


def match_payments(
    payments: DataFrame, receipts: DataFrame, config: Config, at_most: int | None = None
) -> PaymentMatch:
    """Each payment, in order of time, takes the nearest free receipt of its agent."""
    pairs = durable(match_one_to_one(
        payments.select(F.col("txn_id").alias("id"), "agent", "amount", F.to_date("ts").alias("day"),
                        micros(F.col("ts")).alias("o1"), F.col("txn_id").alias("o2")),
        receipts.select(F.col("line_no").alias("id"), "agent", "amount", F.col("doc_date").alias("day"),
                        F.col("line_no").alias("o1")),
        mode=NEAREST, tolerance=config.payment_tolerance, days=config.payment_days,
        turn=["o1", "o2"], place=["o1"], island_rows=config.island_rows, hot_rows=config.hot_rows, at_most=at_most))
    matched = pairs.select(F.col("proposer").alias("txn_id"), F.col("seat").alias("matched_line"))
    used = pairs.select(F.col("seat").alias("line_no"), F.lit(True).alias("is_matched"))
    return PaymentMatch(
        payments.join(matched, "txn_id", "left"),
        receipts.join(used, "line_no", "left").withColumn("is_matched", F.coalesce("is_matched", F.lit(False))))


def with_hours_since_same(payments: DataFrame, at_most: int | None = None) -> DataFrame:
    """Hours since the agent's previous payment of the same amount, matched ones included; null without agent or amount."""
    scanned = ordered_scan(payments, ["agent", "amount"], ["ts", "txn_id"], previous={"_before": F.col("ts")}, at_most=at_most)
    hours = (micros(F.col("ts")) - micros(F.col("_before"))) / 3.6e9
    comparable = F.col("agent").isNotNull() & F.col("amount").isNotNull()
    return scanned.withColumn("hours_since_same", F.when(comparable, hours)).drop("_before")


def unmatched_payments(
    match: PaymentMatch, missing: DataFrame, config: Config, at_most: int | None = None
) -> DataFrame:
    """Why a ledger payment has no receipt: repeated, lost month, or not booked."""
    rows = with_hours_since_same(match.payments, at_most).filter(F.col("matched_line").isNull())
    rows = with_month_missing(rows, "ts", missing, config, at_most)
    amount = money(F.col("amount"))
    rules = [
        Rule(1, F.col("hours_since_same") <= config.repeat_hours, outcome(
            status="REPEATED_CREDIT", error_source="BOT", confidence="A", fix_side="ledger",
            explanation=F.concat(F.lit("Payment of "), amount, F.lit(" was credited again after "),
                                 F.format_string("%.1f", "hours_since_same"), F.lit(" h; one receipt only")))),
        Rule(2, F.col("month_missing"), outcome(
            status="PAYMENT_IN_MISSING_MONTH", error_source="EXPORT", confidence="B", fix_side="clarify",
            explanation="Payment in the ledger, but the statement of that month is missing")),
        Rule(3, F.lit(True), outcome(
            status="PAYMENT_NOT_IN_STATEMENT", error_source="STATEMENT", confidence="B", fix_side="statement",
            explanation=F.concat(F.lit("Payment of "), amount, F.lit(" is in the ledger without a receipt")))),
    ]
    return rows.withColumn("_r", first_match(rules)).select(
        "agent", "ts", "day", "txn_id", "amount",
        "_r.status", "_r.error_source", "_r.confidence", "_r.explanation", "_r.fix_side")


def wrong_agent_pairs(
    unmatched: DataFrame, receipts: DataFrame, config: Config, at_most: int | None = None
) -> DataFrame:
    """Unmatched receipts, in statement order, take an unmatched payment of another agent."""
    free = unmatched.filter(F.col("status").isin("PAYMENT_NOT_IN_STATEMENT", "PAYMENT_IN_MISSING_MONTH"))
    return durable(match_one_to_one(
        receipts.filter(~F.col("is_matched")).select(
            F.col("line_no").alias("id"), "agent", "amount", F.col("doc_date").alias("day"), F.col("line_no").alias("o1")),
        free.select(F.col("txn_id").alias("id"), "agent", "amount", "day",
                    micros(F.col("ts")).alias("o1"), F.col("txn_id").alias("o2")),
        mode=OTHER_AGENT, tolerance=config.payment_tolerance, days=config.wrong_agent_days,
        turn=["o1"], place=["o1", "o2"], island_rows=config.island_rows, hot_rows=config.hot_rows, at_most=at_most,
    )).select(F.col("proposer").alias("line_no"), F.col("seat").alias("txn_id"))


def payment_exceptions(
    match: PaymentMatch, missing: DataFrame, config: Config, at_most: int | None = None
) -> DataFrame:
    """One row per payment or receipt without a partner in its own agent's account."""
    unmatched = durable(unmatched_payments(match, missing, config, at_most))
    pairs = wrong_agent_pairs(unmatched, match.receipts, config, at_most)

    wrong = F.col("_line").isNotNull()
    ledger_side = unmatched.join(pairs.select("txn_id", F.col("line_no").alias("_line")), "txn_id", "left").select(
        "agent", "ts", F.lit("LEDGER").alias("found_in"), F.col("txn_id").cast("string").alias("reference"), "txn_id", "amount",
        F.when(wrong, "PAYMENT_WRONG_AGENT").otherwise(F.col("status")).alias("status"),
        F.when(wrong, "BOT").otherwise(F.col("error_source")).alias("error_source"),
        F.when(wrong, "B").otherwise(F.col("confidence")).alias("confidence"),
        F.when(wrong, F.concat(F.lit("Payment of "), money(F.col("amount")),
                               F.lit(" was credited here, the receipt is booked to another agent")))
        .otherwise(F.col("explanation")).alias("explanation"),
        F.when(wrong, "ledger").otherwise(F.col("fix_side")).alias("fix_side"),
        F.col("amount").alias("gap_effect"))

    others = pairs.join(unmatched.select("txn_id", F.col("agent").alias("_other")), "txn_id").select("line_no", "_other")
    lost = match.receipts.filter(~F.col("is_matched")).join(others, "line_no", "left")
    paired = F.col("_other").isNotNull()
    statement_side = lost.select(
        "agent", F.col("doc_date").cast("timestamp_ntz").alias("ts"), F.lit("STATEMENT").alias("found_in"),
        F.col("doc").alias("reference"), F.lit(None).cast("bigint").alias("txn_id"), "amount",
        F.when(paired, "PAYMENT_WRONG_AGENT").otherwise("PAYMENT_NOT_IN_LEDGER").alias("status"),
        F.lit("BOT").alias("error_source"), F.lit("B").alias("confidence"),
        F.concat(F.lit("Receipt of "), money(F.col("amount")), F.when(
            paired, F.concat(F.lit(" is booked here, the ledger credited "), F.col("_other")))
            .otherwise(F.lit(" never reached the ledger"))).alias("explanation"),
        F.lit("ledger").alias("fix_side"), (-F.col("amount")).cast("decimal(18,2)").alias("gap_effect"))
    return ledger_side.unionByName(statement_side)
