"""Counters that show whether a reconciliation can be trusted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def long_form(row: DataFrame, name: str = "check") -> DataFrame:
    """One row of measures as (name, value) rows."""
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias("value")) for c in row.columns])).alias("_r")).select("_r.*")


def integrity_checks(r) -> DataFrame:
    """The eleven counters, one aggregate per table."""
    no_ticket = F.size("tickets") == 0

    def count(condition: Column, name: str) -> Column:
        return F.count_if(condition).alias(name)

    rows = [
        r.votes.ledger_tickets.agg(F.coalesce(F.sum("conflicts"), F.lit(0)).alias("ticket_agent_conflicts")),
        r.ledger_all.agg(
            count(~F.col("in_window"), "ledger_rows_outside_window"),
            count(F.col("in_window") & no_ticket & (F.col("kind") != r.config.words.payment), "ledger_rows_without_ticket")),
        r.chain_breaks.agg(
            F.count("*").alias("ledger_chain_breaks"), F.count_distinct("agent").alias("ledger_chain_break_agents")),
        r.openings.agg(count(F.abs("chain_check") > F.expr(r.config.chain_tolerance), "ledger_chain_total_mismatches")),
        r.statements.agg(count(no_ticket & (F.col("line_kind") != "receipt"), "statement_rows_without_ticket")),
        r.journal.agg(count(F.col("agent") == "UNASSIGNED", "journal_rows_unassigned")),
        r.bridge.agg(F.max(F.abs("unexplained")).alias("bridge_max_unexplained")),
        r.monthly.agg(F.max(F.abs("identity_residual")).alias("monthly_identity_max")),
        r.actions.agg(F.max(F.abs("check_after_fixes")).alias("actions_max_check")),
    ]
    out = long_form(rows[0])
    for row in rows[1:]:
        out = out.unionByName(long_form(row))
    return out
