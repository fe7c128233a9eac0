"""Words the engine has to recognise in its input, and the names it gives to its findings."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Vocabulary:
    """Values that mark a row's meaning in the three sources."""

    service_fee_prefixes: tuple[str, ...]
    sale_prefixes: tuple[str, ...]
    refund_prefixes: tuple[str, ...]
    receipt_prefixes: tuple[str, ...]
    reissued: str
    draft: str
    purchase: str
    void: str
    refund: str
    payment: str
    journal_sale: str
    bot: str


# The words found in real exports (Russian accounting documents).
RUSSIAN = Vocabulary(
    service_fee_prefixes=("Реализация сервисный сбор",),
    sale_prefixes=("Реализация",),
    refund_prefixes=("Возврат",),
    receipt_prefixes=("Поступление", "Приход"),
    reissued="переиздан",
    draft="черновик",
    purchase="выкуп",
    void="войд",
    refund="возврат",
    payment="оплата",
    journal_sale="продажа",
    bot="etm-bot",
)

# The same roles in English; the derived test ledgers use these.
ENGLISH = Vocabulary(
    service_fee_prefixes=("Sale service fee",),
    sale_prefixes=("Sale",),
    refund_prefixes=("Refund",),
    receipt_prefixes=("Receipt", "Incoming"),
    reissued="reissued",
    draft="draft",
    purchase="purchase",
    void="void",
    refund="refund",
    payment="payment",
    journal_sale="sale",
    bot="ledger-bot",
)

# How a currency is written in a payment cell, in order of precedence.
# (code, spellings, rate column; None = the base currency)
CURRENCIES = (
    ("KGS", ("KGS", "СОМ"), None),
    ("USD", ("USD", "$"), "rate_usd"),
    ("EUR", ("EUR", "€"), "rate_eur"),
    ("RUB", ("RUB", "РУБ"), "rate_rub"),
    ("KZT", ("KZT", "ТГ", "ТЕНГЕ"), "rate_kzt"),
)

# The spellings that mark a cell as foreign currency.
FOREIGN_MARKS = ("USD", "EUR", "RUB", "KZT", "$", "€")

# Group statuses.
GROUP_STATUSES = (
    "OK", "VOID_CLOSED", "VOID_UNBALANCED", "LEDGER_IN_MISSING_MONTH", "NOT_IN_STATEMENT",
    "STATEMENT_ONLY_JOURNAL_SALE", "STATEMENT_ONLY", "JOURNAL_AMOUNT_DIFF", "JOURNAL_DUPLICATE",
    "DOUBLE_DEBIT", "AMOUNT_RESIDUAL", "DIRECT_CLIENT", "JOURNAL_ONLY_SALE", "JOURNAL_ONLY_OTHER",
    "TICKET_IN_AMOUNT",
)
PAYMENT_STATUSES = (
    "REPEATED_CREDIT", "PAYMENT_IN_MISSING_MONTH", "PAYMENT_NOT_IN_STATEMENT",
    "PAYMENT_WRONG_AGENT", "PAYMENT_NOT_IN_LEDGER",
)
# Statuses whose tiny differences count as rounding.
ROUNDING_STATUSES = ("OK", "VOID_CLOSED", "JOURNAL_AMOUNT_DIFF", "TICKET_IN_AMOUNT", "JOURNAL_DUPLICATE")
# Statuses without any effect on a balance.
NO_BALANCE_STATUSES = ("JOURNAL_ONLY_SALE", "JOURNAL_ONLY_OTHER", "DIRECT_CLIENT")
# Statuses that need nobody's attention.
CLEAN_STATUSES = ("OK", "VOID_CLOSED", "DIRECT_CLIENT", "TICKET_IN_AMOUNT", "JOURNAL_DUPLICATE")

CLASSES = ("OK", "BOT", "STATEMENT", "AGENT", "REVIEW")

# The nineteen parts of an agent's balance bridge, in report order.
COMPONENTS = (
    "opening_gap", "continuity_breaks", "jumps_over_missing", "statement_arithmetic", "rounding",
    "residual_statement", "residual_bot", "residual_review",
    "double_debit", "statement_only_journal_sale", "statement_only", "not_in_statement",
    "void_unbalanced", "ledger_in_missing_month",
    "payment_not_in_statement", "payment_not_in_ledger", "repeated_credit", "payment_wrong_agent",
    "payment_in_missing_month",
)
# Readable names of every status, used by the report views.
STATUS_LABELS = {
    # Groups.
    "OK": "In order",
    "VOID_CLOSED": "Purchase and void cancel out",
    "VOID_UNBALANCED": "Void returns too little or too much",
    "LEDGER_IN_MISSING_MONTH": "Ledger entry, statement of the month missing",
    "NOT_IN_STATEMENT": "Ledger entry never invoiced",
    "STATEMENT_ONLY_JOURNAL_SALE": "Invoiced and sold, no ledger entry",
    "STATEMENT_ONLY": "Invoiced only",
    "JOURNAL_AMOUNT_DIFF": "Journal amount off",
    "JOURNAL_DUPLICATE": "Journal row repeated",
    "DOUBLE_DEBIT": "Debited more than once",
    "AMOUNT_RESIDUAL": "Statement and ledger amounts apart",
    "DIRECT_CLIENT": "Client without an agent",
    "JOURNAL_ONLY_SALE": "Journal sale only",
    "JOURNAL_ONLY_OTHER": "Journal refund or void only",
    "TICKET_IN_AMOUNT": "Ticket number typed as amount",
    # Payments.
    "REPEATED_CREDIT": "Same payment credited twice",
    "PAYMENT_IN_MISSING_MONTH": "Payment, statement of the month missing",
    "PAYMENT_NOT_IN_STATEMENT": "Payment without a receipt",
    "PAYMENT_WRONG_AGENT": "Payment on the wrong agent",
    "PAYMENT_NOT_IN_LEDGER": "Receipt without a payment",
}
SOURCE_LABELS = {
    "OK": "None", "BOT": "Ledger bot", "STATEMENT": "Statement", "AGENT": "Journal", "REVIEW": "Undecided", "EXPORT": "Statement export",
}
# Who mends an error of each source.
SOURCE_OWNERS = {
    "OK": "No one", "BOT": "Operator of the ledger", "STATEMENT": "Issuer of the statements", "AGENT": "Writer of the journal row",
    "REVIEW": "Issuer and agent together", "EXPORT": "Operator of the export",
}
SEVERITIES = ("critical", "high", "medium", "low")
