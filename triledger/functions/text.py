"""Column expressions that read identifiers and amounts out of free text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from triledger.vocabulary import CURRENCIES, FOREIGN_MARKS, Vocabulary

# What a ticket number and a number look like.
TICKET = r"\d{3}-\d{10}|\d{10,13}"
ONLY_TICKET = r"(?U)^\s*\d{10,13}\s*$"
NUMBER = r"(?U)[-+]?\d[\d\s .,]*\d|[-+]?\d"
PART_BREAK = r"(?U)\s\+\s|\+(?=\s*[A-ZА-Я$€\d])"
PART_MARK = "\u0001"
NBSP = "\u00a0"

AMOUNT = "decimal(30,8)"
# Factors whose product is exact; longer numbers and rates cannot be read.
READABLE, RATE = "decimal(24,8)", "decimal(12,6)"


def extract_tickets(text: Column) -> Column:
    """The ten-digit cores of all ticket numbers, in order of appearance, without repeats."""
    numbers = F.regexp_extract_all(text, F.lit(TICKET), F.lit(0))
    cores = F.array_distinct(F.transform(numbers, lambda n: F.right(n, F.lit(10))))
    return F.coalesce(cores, F.array().cast("array<string>"))


def norm_text(text: Column) -> Column:
    """A name in upper case with everything but letters and digits turned into single spaces."""
    upper = F.replace(F.upper(text), F.lit("Ё"), F.lit("Е"))
    return F.coalesce(F.trim(F.regexp_replace(upper, "[^A-ZА-Я0-9]+", " ")), F.lit(""))


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _plain_digits(digits: Column) -> Column:
    """Unsigned digits with the thousands separators gone and a point as decimal sign."""
    commas, points = F.instr(F.reverse(digits), ","), F.instr(F.reverse(digits), ".")
    # Both signs present: the one nearer to the end is the decimal sign.
    mixed = F.when(commas < points, F.replace(F.translate(digits, ".", ""), F.lit(","), F.lit("."))) \
        .otherwise(F.translate(digits, ",", ""))

    # One kind of sign: repeated, or followed by exactly three digits, it separates thousands.
    def single(pieces: Column) -> Column:
        head, tail = F.get(pieces, F.lit(0)), F.get(pieces, F.lit(1))
        thousands = (F.size(pieces) > 2) | ((F.length(tail) == 3) & (F.length(head) <= 3) & (head != "0"))
        return F.when(thousands, F.array_join(pieces, "")).otherwise(F.array_join(pieces, "."))

    return (
        F.when((commas > 0) & (points > 0), mixed)
        .when((commas > 0) | (points > 0), _let(F.split(F.translate(digits, ",", "."), r"\."), single))
        .otherwise(digits)
    )


def parse_number(token: Column) -> Column:
    """A number written with either decimal sign and any thousands separator; null if it is none."""
    squeezed = F.btrim(F.translate(token, " " + NBSP, ""), F.lit(".,"))

    def signed(text: Column) -> Column:
        value = _let(F.ltrim(text, F.lit("+-")), lambda d: _plain_digits(d).try_cast(AMOUNT))
        return value * F.when(F.startswith(text, F.lit("-")), -1).otherwise(1).cast("decimal(1,0)")

    return _let(squeezed, signed).try_cast(AMOUNT)


def _spelled(text: Column, spellings: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(s)) for s in spellings))


def _rate_of(part: Column, rates: dict[str, Column]) -> Column:
    """The rate of the first currency spelled in the text; the base currency when none is."""
    base = F.lit(1).cast(RATE)
    chain = None
    for _, spellings, column in CURRENCIES:
        rate = base if column is None else rates[column].try_cast(RATE)
        chain = F.when(_spelled(part, spellings), rate) if chain is None else chain.when(_spelled(part, spellings), rate)
    return chain.otherwise(base)


def parse_amount(cell: Column, rates: dict[str, Column]) -> Column:
    """The sum of all amounts of a cell in the base currency; null when nothing can be read.

    Remarks in brackets are ignored; a part in a currency without a rate is left out.
    """
    text = F.regexp_replace(F.upper(cell), r"\(.*?\)", " ")
    # Breaks become one plain character first: splitting by a pattern would compile it for every row.
    parts = F.split(F.regexp_replace(text, PART_BREAK, PART_MARK), PART_MARK)
    values = F.transform(
        parts,
        lambda part: parse_number(F.regexp_extract(part, NUMBER, 0)).try_cast(READABLE) * _rate_of(part, rates),
    )

    def total(known: Column) -> Column:
        return F.when(F.size(known) > 0, F.aggregate(
            known, F.lit(0).cast(AMOUNT), lambda acc, v: F.try_add(acc, v).try_cast(AMOUNT)))

    return _let(F.filter(values, lambda v: v.isNotNull()), total)


def is_ticket_cell(cell: Column) -> Column:
    """True when the amount cell holds nothing but a ticket number."""
    return F.coalesce(F.rlike(cell, F.lit(ONLY_TICKET)), F.lit(False))


def is_foreign(cell: Column) -> Column:
    """True when the cell mentions a foreign currency."""
    marks = "(?i)" + "|".join(m.replace("$", r"\$") for m in FOREIGN_MARKS)
    return F.coalesce(F.rlike(cell, F.lit(marks)), F.lit(False))


def amount_issue(cell: Column, amount: Column) -> Column:
    """What is wrong with an amount cell, given the amount read from it."""
    return F.when(is_ticket_cell(cell), "TICKET_IN_AMOUNT").when(amount.isNull(), "UNPARSEABLE").otherwise("")


def digit_pattern(a: Column, b: Column) -> Column:
    """How two amounts differ as typed digits: TRANSPOSITION, ONE_WRONG_DIGIT or nothing."""
    def typed(x: Column) -> Column:
        digits = F.round(F.abs(x) * 100).cast("bigint").cast("string")
        return F.split(F.lpad(digits, F.greatest(F.lit(3), F.length(digits)), F.lit("0")), "")

    def compare(pair: Column) -> Column:
        wrong = F.size(F.filter(F.zip_with(pair["a"], pair["b"], lambda x, y: x != y), lambda d: d))
        return (
            F.when(F.size(pair["a"]) != F.size(pair["b"]), "")
            .when((wrong > 0) & (F.array_sort(pair["a"]) == F.array_sort(pair["b"])), "TRANSPOSITION")
            .when(wrong == 1, "ONE_WRONG_DIGIT")
            .otherwise("")
        )

    return _let(F.struct(typed(a).alias("a"), typed(b).alias("b")), compare)


def document_kind(doc: Column, words: Vocabulary) -> Column:
    """What a statement line is, by the beginning of its document name."""
    begins = lambda prefixes: reduce(
        lambda a, b: a | b, (F.startswith(doc, F.lit(p)) for p in prefixes))
    return (
        F.when(begins(words.service_fee_prefixes), "service_fee")
        .when(begins(words.sale_prefixes), "sale")
        .when(begins(words.refund_prefixes), "refund")
        .when(begins(words.receipt_prefixes), "receipt")
        .otherwise("other")
    )


def agrees(journal: Column, is_foreign: Column, other: Column, tolerance: str, fx_share: str) -> Column:
    """Whether a journal amount confirms another amount; foreign currency gets a relative margin."""
    fixed = F.expr(tolerance).cast("decimal(18,2)")
    margin = F.when(is_foreign, F.greatest(fixed, F.abs(other) * F.expr(fx_share))).otherwise(fixed)
    return F.abs(journal - other) <= margin


def money(amount: Column, signed: bool = False) -> Column:
    """An amount as text with thousands separators and two decimals."""
    shown = F.format_number(amount.cast("decimal(18,2)"), 2)
    return F.concat(F.when(amount >= 0, "+").otherwise(""), shown) if signed else shown


# What a whole number, a number and a day are spelled like, in ASCII digits.
WHOLE = r"^[-+]?[0-9]+$"
DECIMAL = r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]{1,3})?$"
DAY = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


def whole_number(word: Column) -> Column:
    """A whole number of 64 bits, or null for anything else."""
    return F.when(F.rlike(word, F.lit(WHOLE)), word.try_cast("bigint"))


def decimal_number(word: Column) -> Column:
    """A number with at most 16 digits before the point, rounded to two behind it, or null for anything else."""
    return F.when(F.rlike(word, F.lit(DECIMAL)), word.try_cast("decimal(18,2)"))


def calendar_day(word: Column) -> Column:
    """A day spelled year-month-day, or null for anything else."""
    return F.when(F.rlike(word, F.lit(DAY)), F.to_date(F.try_to_timestamp(word, F.lit("yyyy-MM-dd"))))
