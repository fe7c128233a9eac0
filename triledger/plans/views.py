"""Report views: each is a DataFrame, ready to be written or shown."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triledger.functions.text import money
from triledger.functions.times import day_text, month_of
from triledger.operators.checks import long_form
from triledger.operators.durable import known_rows
from triledger.operators.ordered import ordered_scan
from triledger.operators.risk import risk_by_agent
from triledger.vocabulary import (
    CLEAN_STATUSES, COMPONENTS, GROUP_STATUSES, PAYMENT_STATUSES, SEVERITIES, SOURCE_LABELS, SOURCE_OWNERS, STATUS_LABELS,
)

NONE = "-"
MONEY = "decimal(18,2)"


def labelled(df: DataFrame, code: str, labels: dict[str, str], name: str) -> DataFrame:
    """Add the readable name of a code; an unknown code stands for itself."""
    # The label table is a constant of this package, so broadcasting it is safe.
    table = df.sparkSession.createDataFrame(list(labels.items()), "_code string, _label string")
    return df.join(F.broadcast(table), F.col(code) == F.col("_code"), "left") \
        .withColumn(name, F.coalesce("_label", code)).drop("_code", "_label")


def _day(c: Column) -> Column:
    return F.coalesce(day_text(c), F.lit(NONE))


def _or_none(c: str) -> Column:
    return F.when(F.coalesce(F.length(c), F.lit(0)) > 0, F.col(c)).otherwise(NONE)


def numbered_groups(groups: DataFrame) -> DataFrame:
    """gid and a dense running number in gid order."""
    numbered = ordered_scan(groups.select("gid"), [], ["gid"], number="_n", at_most=known_rows(groups))
    digits = (F.col("_n") - 1).cast("string")
    return numbered.select("gid", F.concat(F.lit("G"), F.lpad(digits, F.greatest(F.lit(5), F.length(digits)), F.lit("0"))).alias("group_id"))


def agent_balances(r) -> DataFrame:
    """Closing balances, the gap and who has to move what; settled agents last."""
    closing = r.acts.groupBy("agent").agg(
        F.max_by("closing", F.struct("period_start", "period_end")).alias("statement_closing"))
    settled = F.abs("priority") < 1
    return r.actions.join(closing, "agent", "left").select(
        "agent",
        F.coalesce("statement_closing", F.lit(0)).cast(MONEY).alias("statement_closing"),
        (F.col("gap_close") - F.coalesce("statement_closing", F.lit(0))).cast(MONEY).alias("ledger_closing"),
        F.col("gap_close").alias("gap"),
        "ledger_adjust", "statement_adjust",
        F.col("rounding").alias("journal_errors"),
        "to_clarify",
        (F.col("gap_close") - F.col("to_clarify") - F.col("unexplained")).cast(MONEY).alias("explained"),
        "unexplained",
        F.when(settled, "Settled").otherwise("Needs attention").alias("verdict"),
        F.col("recommended_action").alias("recommendation"),
    ).orderBy(F.col("verdict") == "Settled", F.desc(F.abs("gap")), "agent")


def discrepancies(r) -> DataFrame:
    """Every group and payment that needs a look, largest amount first."""
    seen = F.coalesce(F.col("statement_first").cast("timestamp_ntz"), F.col("ledger_first"))
    groups = r.groups.filter(~F.col("status").isin(*CLEAN_STATUSES)).select(
        "agent", _day(seen).alias("date"), F.coalesce(month_of(seen), F.lit(NONE)).alias("period"),
        _or_none("tickets").alias("ticket"),
        F.abs(F.when(F.col("gap_effect") != 0, F.col("gap_effect")).otherwise(F.col("residual"))).alias("amount"),
        "error_source", "status", _or_none("employees").alias("employee"), F.col("explanation").alias("recommendation"),
        F.when(F.col("ledger_txns") != "", F.col("ledger_txns")).otherwise(F.col("gid")).alias("reference"))
    none = F.lit(NONE)
    payments = r.payments.select(
        "agent", _day(F.col("ts")).alias("date"), F.coalesce(month_of(F.col("ts")), none).alias("period"),
        none.alias("ticket"), F.abs("amount").alias("amount"), "error_source", "status", none.alias("employee"),
        F.col("explanation").alias("recommendation"), "reference")
    rows = labelled(groups.unionByName(payments), "error_source", SOURCE_LABELS, "source")
    rows = labelled(rows, "status", STATUS_LABELS, "error_type")
    return rows.select(
        "agent", "date", "period", "ticket", "amount", "source", "error_type", "employee", "recommendation", "reference",
    ).orderBy(F.desc("amount"), "agent", "reference")


def group_sheet(r) -> DataFrame:
    """Groups to look at, best confirmed first, with the person to ask."""
    bad = r.groups.filter(~F.col("status").isin("OK", "VOID_CLOSED", "DIRECT_CLIENT"))
    rows = labelled(labelled(bad, "error_source", SOURCE_LABELS, "source"), "error_source", SOURCE_OWNERS, "who_checks")
    return labelled(rows, "status", STATUS_LABELS, "error_type").select(
        "gid", "agent", "tickets", "error_type", "source", "confidence", "statement_sum", "ledger_sum",
        F.col("journal_sum").cast(MONEY).alias("journal_sum"), "residual", "ledger_first", "statement_first",
        "amount_pattern", "who_checks", "employees", "explanation", "ledger_txns",
    ).orderBy("confidence", F.desc(F.abs("residual")), "gid")


def payment_sheet(r) -> DataFrame:
    rows = labelled(r.payments, "error_source", SOURCE_LABELS, "source")
    return rows.select(
        "agent", "ts", "found_in", "reference", "amount", "status", "source", "confidence", "explanation", "gap_effect",
    ).orderBy(F.desc(F.abs("gap_effect")), "agent", "reference")


def anomalies(r) -> DataFrame:
    """Five kinds of anomalies, the gravest first."""
    none = F.lit(NONE)
    g, p, a = r.groups, r.payments, r.acts

    def rows(df, day, ticket, kind, severity, amount, details):
        return df.select(
            "agent", _day(day).alias("date"), ticket.alias("ticket"), F.lit(kind).alias("anomaly"),
            (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
            F.abs(amount).cast(MONEY).alias("amount"), details.alias("details"))

    seen = F.coalesce(F.col("ledger_first"), F.col("statement_first").cast("timestamp_ntz"))
    parts = [
        rows(g.filter("status = 'DOUBLE_DEBIT'"), seen, _or_none("tickets"), "Ticket debited twice", "high", F.col("extra_amount"),
             F.concat(F.lit("The ticket was debited "), F.col("extra_rows").cast("string"), F.lit(" time(s) too often, "),
                      money(F.abs("extra_amount")), F.lit(" in all (transactions: "), "ledger_txns", F.lit(")"))),
        rows(p.filter("status = 'REPEATED_CREDIT'"), F.col("ts"), none, "Payment credited again", "critical",
             F.col("amount"), F.col("explanation")),
        rows(p.filter("status = 'PAYMENT_WRONG_AGENT'"), F.col("ts"), none, "Payment to another agent", "high",
             F.col("amount"), F.col("explanation")),
        rows(g.filter("status = 'VOID_UNBALANCED'"), seen, _or_none("tickets"), "Void without full return", "medium",
             F.col("ledger_sum"), F.col("explanation")),
        rows(a.filter("continuity_break"), F.col("period_start"), none, "Balance jump between statements",
             F.when(F.abs("jump") > 50000, "critical").otherwise("high"), F.col("jump"),
             F.concat(F.lit("The statement opens with "), money(F.col("opening")), F.lit(", the one before closed with "),
                      money(F.col("previous_closing")), F.lit(" (jump "), money(F.col("jump"), signed=True), F.lit(")"))),
    ]
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    return reduce(DataFrame.unionByName, parts).orderBy(rank, F.desc("amount"), "agent", "date", "details")


def risk_ranking(scored: DataFrame) -> DataFrame:
    """Agents by mean error probability."""
    ranked = ordered_scan(
        risk_by_agent(scored).withColumn("_down", -F.col("mean_p_error")), [], ["_down", "agent"], number="risk_rank")
    return ranked.select(
        "risk_rank", "agent", "operations", F.round("mean_p_error", 4).alias("mean_p_error"), "flagged", "risky_turnover")


def kpi_card(r, roc_auc: DataFrame | None = None) -> DataFrame:
    """The headline numbers as (name, value); the model quality is null without a model."""
    clean = r.groups.select(
        F.coalesce(F.sum(F.when(F.col("status").isin(*CLEAN_STATUSES), F.col("ledger_rows"))), F.lit(0)).alias("matched_operations"),
        F.count_if(F.col("status") == "OK").alias("groups_ok"),
        F.count_if(~F.col("status").isin(*CLEAN_STATUSES)).alias("_bad"),
        F.count_if(F.col("status").isin("DOUBLE_DEBIT", "VOID_UNBALANCED")).alias("_odd"))
    pay = r.payments.agg(
        F.count("*").alias("_payments"),
        F.count_if(F.col("status").isin("REPEATED_CREDIT", "PAYMENT_WRONG_AGENT")).alias("_odd_payments"))
    adjust = r.actions.agg(
        F.sum(F.abs("ledger_adjust")).alias("ledger_adjust"), F.sum(F.abs("statement_adjust")).alias("statement_adjust"))
    breaks = r.acts.agg(F.count_if("continuity_break").alias("_breaks"))
    # One-row tables, so each is read as a scalar.
    one = clean.select(
        "matched_operations", "groups_ok",
        (F.col("_bad") + pay.select("_payments").scalar()).alias("discrepancies"),
        adjust.select("ledger_adjust").scalar().alias("ledger_adjust"),
        adjust.select("statement_adjust").scalar().alias("statement_adjust"),
        (F.col("_odd") + pay.select("_odd_payments").scalar() + breaks.select("_breaks").scalar()).alias("anomalies"),
        (F.lit(None).cast("double") if roc_auc is None else roc_auc.scalar()).alias("roc_auc"))
    return long_form(one, "name")


def headline(r) -> DataFrame:
    """All headline measures as (measure, value): one pass over each table."""
    c, status = F.col, F.col("status")
    count = lambda condition, name: F.count_if(condition).alias(name)
    both = (c("statement_rows") > 0) & (c("ledger_rows") > 0)
    residual = status == "AMOUNT_RESIDUAL"
    sourced = lambda s, g: residual & (c("error_source") == s) & (c("confidence") == g)
    rows = [
        r.actions.agg(*[F.sum(F.abs(x)).alias(f"abs_{x}") for x in ("ledger_adjust", "statement_adjust", "to_clarify")]),
        r.ledger_inside.agg(F.count("*").alias("ledger_rows")),
        r.statements.agg(F.count("*").alias("statement_rows")),
        r.journal_owned.agg(F.count("*").alias("journal_rows")),
        r.groups.agg(
            F.count("*").alias("groups"),
            count(both, "groups_in_both"),
            (F.count_if(both & (F.abs("residual") <= F.expr(r.config.amount_tolerance))) / F.count_if(both)).alias("matched_share"),
            count(residual, "amount_residual"),
            count(sourced("STATEMENT", "A"), "residual_statement_confirmed"),
            count(sourced("BOT", "A"), "residual_bot_confirmed"),
            count(sourced("STATEMENT", "B"), "residual_typing_error"),
            count(residual & (c("error_source") == "REVIEW"), "residual_undecided"),
            *[count(status == s, s.lower()) for s in (
                "DOUBLE_DEBIT", "STATEMENT_ONLY_JOURNAL_SALE", "NOT_IN_STATEMENT", "LEDGER_IN_MISSING_MONTH",
                "DIRECT_CLIENT", "JOURNAL_DUPLICATE", "JOURNAL_ONLY_SALE")],
            F.percentile(F.when(status == "OK", c("lag_days")), F.lit(0.5)).alias("ok_lag_median"),
            F.percentile(F.when(status == "OK", c("lag_days")), F.lit(0.95)).alias("ok_lag_95"),
        ),
        r.payments.agg(
            count(status == "PAYMENT_NOT_IN_LEDGER", "payment_not_in_ledger"),
            F.coalesce(-F.sum(F.when(status == "PAYMENT_NOT_IN_LEDGER", c("gap_effect"))), F.lit(0)).alias("payment_not_in_ledger_amount"),
            count(status == "REPEATED_CREDIT", "repeated_credit")),
        r.acts.agg(
            count(c("continuity_break"), "continuity_breaks"),
            F.coalesce(F.sum(F.when(c("continuity_break"), F.abs("jump"))), F.lit(0)).alias("continuity_break_amount"),
            count(F.abs("internal_delta") > F.expr("0.02"), "statement_arithmetic_errors")),
        r.missing.agg(F.count("*").alias("missing_agent_months")),
        r.chain_breaks.agg(F.count("*").alias("ledger_chain_breaks")),
        r.bridge.agg(
            count(F.abs("opening_gap") > F.expr(r.config.amount_tolerance), "agents_with_opening_gap"),
            F.sum("opening_gap").alias("opening_gap_net")),
    ]
    return reduce(DataFrame.unionByName, [long_form(row, "measure") for row in rows])


def summary(r) -> DataFrame:
    """Checks, status counts and headline in one long table (section, key, value)."""
    def section(name, df, key):
        return df.select(F.lit(name).alias("section"), F.col(key).alias("key"), F.col("value").cast("double").alias("value"))

    counts = lambda df: df.groupBy("status").agg(F.count("*").alias("value"))
    return section("checks", r.checks, "check").unionByName(section("status", counts(r.groups), "status")).unionByName(
        section("payments", counts(r.payments), "status")).unionByName(section("headline", headline(r), "measure"))


def with_total(df: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """The rows of a table keyed by `key` plus one row of totals."""
    return df.rollup(key).agg(*[F.sum(c).cast(MONEY).alias(c) for c in columns]) \
        .withColumn(key, F.coalesce(key, F.lit("TOTAL")))


def bridge_sheet(r) -> DataFrame:
    return with_total(r.bridge, "agent", ("gap_close", *COMPONENTS, "components_sum", "unexplained"))


PROBLEMS = [f"n_{s}" for s in GROUP_STATUSES + PAYMENT_STATUSES if s not in ("OK", "VOID_CLOSED", "DIRECT_CLIENT")]


def agent_sheet(r) -> DataFrame:
    """Per agent and in total: gap, the three ways to close it, what is left and whether it adds up."""
    counted = r.actions.withColumn("problems", reduce(lambda a, b: a + b, [F.col(c) for c in PROBLEMS]))
    columns = ("opening_gap", "gap_close", "ledger_adjust", "statement_adjust", "to_clarify", "rounding", "unexplained")
    rows = counted.rollup("agent").agg(
        *[F.sum(c).cast(MONEY).alias(c) for c in columns],
        F.sum("problems").alias("problems"), F.sum("missing_months").alias("missing_months"))
    left = F.col("gap_close") + F.col("ledger_adjust") + F.col("statement_adjust")
    return rows.select(
        F.coalesce("agent", F.lit("TOTAL")).alias("agent"), *columns, "problems", "missing_months",
        left.cast(MONEY).alias("left_after_fixes"),
        (left - F.col("to_clarify") - F.col("rounding") - F.col("unexplained")).cast(MONEY).alias("check"))


def break_list(r) -> DataFrame:
    """Jumps between statements, by size."""
    kind = F.when(F.col("continuity_break"), "consecutive months").otherwise("over a missing month")
    return r.acts.filter(F.col("continuity_break") | F.col("jump_over_missing")).select(
        "agent", month_of(F.col("period_start")).alias("period"), "previous_closing", "opening", "jump", kind.alias("kind"),
    ).orderBy(F.desc(F.abs("jump")), "agent", "period")


def transposed(metrics: DataFrame, key: str, keys: list[str]) -> DataFrame:
    """One row per metric, one column per value of `key`."""
    names = [c for c in metrics.columns if c != key]
    doubles = metrics.select(key, *[F.col(c).cast("double").alias(c) for c in names])
    long = doubles.unpivot(key, names, "metric", "value")
    return long.groupBy("metric").pivot(key, keys).agg(F.first("value"))


def exemplars(r) -> DataFrame:
    """The largest confirmed statement error, double debit and repeated payment."""
    def largest(df, case, size, order, what):
        best = F.max_by(F.struct("agent", size.alias("amount"), what.alias("what")), F.struct(F.abs(size), order))
        return df.agg(best.alias("b")).filter(F.col("b").isNotNull()).select(F.lit(case).alias("case"), "b.*")

    g = r.groups
    wrong = g.filter(
        (F.col("status") == "AMOUNT_RESIDUAL") & (F.col("error_source") == "STATEMENT") & (F.col("confidence") == "A")
        & (F.col("journal_rows") > 0) & (F.col("ticket_count") == 1))
    parts = [
        largest(wrong, "wrong statement amount", F.col("residual"), F.col("gid"), F.col("tickets")),
        largest(g.filter("status = 'DOUBLE_DEBIT'"), "ticket debited twice", F.col("extra_amount"), F.col("gid"), F.col("tickets")),
        largest(r.payments.filter("status = 'REPEATED_CREDIT'"), "payment credited again", F.col("amount"),
                F.col("reference"), F.col("reference")),
    ]
    return reduce(DataFrame.unionByName, parts)
