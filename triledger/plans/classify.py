"""The verdict on every ticket group, as one ordered list of rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triledger.config import Config
from triledger.functions.text import agrees, digit_pattern, money
from triledger.operators.ledger import with_month_missing
from triledger.operators.rules import Rule, first_match, outcome
from triledger.vocabulary import NO_BALANCE_STATUSES

OK_TEXT = "The three sources do not contradict each other"


def group_rules(config: Config) -> list[Rule]:
    c = F.col
    tol = F.expr(config.amount_tolerance)
    has_s, has_l, has_j = c("statement_rows") > 0, c("ledger_rows") > 0, c("journal_rows") > 0
    read = has_j & (c("journal_unread") == 0) & c("journal_sum").isNotNull()
    small = F.abs("residual") <= tol
    both = has_s & has_l
    ledger_only, statement_only = has_l & ~has_s, has_s & ~has_l
    confirms = lambda other: agrees(
        c("journal_sum"), c("journal_foreign"), other, config.amount_tolerance, config.fx_tolerance)
    like_s, like_l = confirms(c("statement_sum")), confirms(-c("ledger_sum"))
    off_s = F.abs(c("journal_sum") - c("statement_sum"))
    off_l = F.abs(c("journal_sum") + c("ledger_sum"))
    by_bot = c("by_bot")
    statement, ledger, journal = money(c("statement_sum")), money(-c("ledger_sum")), money(c("journal_sum"))
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    bot_or_review = F.when(by_bot, "BOT").otherwise("REVIEW")
    ledger_or_clarify = F.when(by_bot, "ledger").otherwise("clarify")

    def verdict(status, source, grade, side, why):
        return outcome(status=status, error_source=source, confidence=grade, fix_side=side, explanation=why)

    wrong_ledger = say("The journal (", journal, ") confirms the statement (", statement, "); the ledger has ", ledger)
    wrong_statement = say("The journal (", journal, ") confirms the ledger (", ledger, "); the statement has ", statement)
    wrong_journal = say("Statement and ledger agree (", statement, "), the journal has ", journal)
    residual = "AMOUNT_RESIDUAL"
    return [
        Rule(1, ledger_only & c("has_void") & (F.abs("ledger_sum") <= tol), verdict(
            "VOID_CLOSED", "OK", "A", "none", "Purchase and void cancel out in the ledger")),
        Rule(2, ledger_only & c("has_void"), verdict(
            "VOID_UNBALANCED", "BOT", "B", "ledger",
            say("The void does not return the whole purchase (", money(c("ledger_sum")), " left)"))),
        Rule(3, ledger_only & c("month_missing"), verdict(
            "LEDGER_IN_MISSING_MONTH", "EXPORT", "B", "clarify",
            "The statement of this month or the next is missing; get it first")),
        Rule(4, ledger_only, verdict(
            "NOT_IN_STATEMENT", "STATEMENT", F.when(has_j | ~by_bot, "A").otherwise("B"), "statement",
            say("Debited in the ledger", F.when(has_j, " and sold in the journal").otherwise(""), ", never invoiced"))),
        Rule(5, statement_only & has_j, verdict(
            "STATEMENT_ONLY_JOURNAL_SALE", "BOT", "A", "ledger", "Sold and invoiced, but never debited in the ledger")),
        Rule(6, statement_only, verdict(
            "STATEMENT_ONLY", "REVIEW", "C", "clarify", "Invoiced, but neither in the ledger nor in the journal")),
        Rule(7, both & small & (c("journal_copies") > 0) & read & ~like_s, verdict(
            "JOURNAL_AMOUNT_DIFF", "AGENT", "B", "none",
            say(wrong_journal, " without ", c("journal_copies").cast("string"), " repeated row(s)"))),
        Rule(8, both & small & (c("journal_copies") > 0), verdict(
            "JOURNAL_DUPLICATE", "AGENT", "B", "none",
            say("The journal row is written ", (c("journal_copies") + 1).cast("string"), " times; the amounts agree"))),
        Rule(9, both & small & read & by_bot & ~like_s, verdict(
            "JOURNAL_AMOUNT_DIFF", "AGENT", "B", "none", wrong_journal)),
        Rule(10, both & small, verdict("OK", "OK", "A", "none", OK_TEXT)),
        Rule(11, both & (c("extra_rows") > 0) & (F.abs(c("residual") - c("extra_amount")) <= tol), verdict(
            "DOUBLE_DEBIT", "BOT", "A", "ledger",
            say(c("extra_rows").cast("string"), " extra debit(s) of one ticket, ", money(-c("extra_amount")),
                "; without them the amounts agree"))),
        Rule(12, both & (F.abs("residual") < F.expr(config.review_below)), verdict(
            residual, "REVIEW", "B", "clarify", say("Small difference of ", money(F.abs("residual")), ": fee or rounding"))),
        Rule(13, both & read & (off_s < tol) & (off_l >= tol), verdict(
            residual, bot_or_review, "A", ledger_or_clarify, wrong_ledger)),
        Rule(14, both & read & (off_l < tol) & (off_s >= tol), verdict(
            residual, "STATEMENT", "A", "statement", wrong_statement)),
        Rule(15, both & read & like_l & ~like_s, verdict(residual, "STATEMENT", "A", "statement", wrong_statement)),
        Rule(16, both & read & like_s & ~like_l, verdict(residual, bot_or_review, "A", ledger_or_clarify, wrong_ledger)),
        Rule(17, both & read, verdict(
            residual, "REVIEW", "C", "clarify", "The journal confirms neither statement nor ledger")),
        Rule(18, both & (digit_pattern(c("statement_sum"), c("ledger_sum")) != "") & ~by_bot, verdict(
            residual, "STATEMENT", "B", "statement",
            say("Statement (", statement, ") and ledger (", ledger, ") differ like a typing error"))),
        Rule(19, both, verdict(
            residual, "REVIEW", "C", "clarify",
            F.when(by_bot, "The journal amount is missing or unreadable").otherwise("No journal row to decide by"))),
        Rule(20, c("agent") == "DIRECT_CLIENT", verdict(
            "DIRECT_CLIENT", "OK", "A", "none", "Direct sale to a client; no agent balance is affected")),
        Rule(21, has_j & (c("journal_kinds") == config.words.journal_sale), verdict(
            "JOURNAL_ONLY_SALE", "REVIEW", "C", "none", "The sale is only in the journal")),
        Rule(22, F.lit(True), verdict("JOURNAL_ONLY_OTHER", "REVIEW", "C", "none", "Refund or void only in the journal")),
    ]


def classify_groups(groups: DataFrame, missing: DataFrame, config: Config, at_most: int | None = None) -> DataFrame:
    flagged = with_month_missing(groups, "ledger_first", missing, config, at_most)
    # The rules are ordered, so what they read is computed once, before them.
    judged = flagged.withColumn("_v", first_match(group_rules(config)))
    ticket_typed = (F.col("_v.status") == "OK") & (F.col("journal_issue") == "TICKET_IN_AMOUNT")
    final = lambda name, value: F.when(ticket_typed, value).otherwise(F.col(f"_v.{name}")).alias(name)
    out = judged.select(
        *groups.columns,
        F.when(ticket_typed, 23).otherwise(F.col("_v.rule")).alias("rule"),
        final("status", "TICKET_IN_AMOUNT"),
        final("error_source", "AGENT"),
        final("confidence", "A"),
        final("explanation", "A ticket number stands in the amount column of the journal"),
        final("fix_side", "none"),
    )
    pattern = digit_pattern(F.col("statement_sum"), F.col("ledger_sum"))
    return out.select(
        "*",
        F.when(F.col("status").isin(*NO_BALANCE_STATUSES), F.lit(0)).otherwise(F.col("residual")).cast("decimal(18,2)").alias("gap_effect"),
        F.when(F.col("status") == "AMOUNT_RESIDUAL", pattern).otherwise("").alias("amount_pattern"),
        F.datediff("statement_first", F.to_date("ledger_first")).alias("lag_days"),
    )
