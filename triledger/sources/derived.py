"""Three ledgers derived from an `orders` table by arithmetic on the order key.

They give the operators realistic input at any scale: every order becomes a sale or a payment, and
the last two digits of its key decide what went wrong with it (see FIXTURES.md).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triledger.operators.ordered import daily_running_total
from triledger.vocabulary import ENGLISH

AGENTS = 25
DORMANT = AGENTS  # a counterparty known to the statements only

NO_LEDGER = (2, 3, 11, 12, 13)
NO_STATEMENT = (1, 10, 11, 12, 13, 22)
NO_JOURNAL = (3, 8, 17, 21, 23)
HUMAN = (8, 21, 23, 38)
VOIDED = (10, 22)


@dataclass(frozen=True)
class Sources:
    """The three raw tables a reconciliation starts from."""

    statements: DataFrame
    ledger: DataFrame
    journal: DataFrame


def _div(a: Column, n: int) -> Column:
    return F.floor(a / n).cast("bigint")


def _two(i: Column) -> Column:
    return F.lpad(i.cast("string"), 2, "0")


def _agent(i: Column) -> Column:
    return F.concat(F.lit("Agent "), _two(i))


def _money(cents: Column) -> Column:
    return (cents / 100).cast("decimal(18,2)")


def _at(day, seconds: Column) -> Column:
    """A time without zone, some seconds into a day."""
    day = F.col(day) if isinstance(day, str) else day
    return day.cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def _month_index(day: Column) -> Column:
    return ((F.year(day) - 1995) * 12 + F.month(day) - 1).cast("bigint")


def _is(*classes: int) -> Column:
    return F.col("m").isin(*classes)


def base(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    return orders.select(
        k.alias("k"),
        (k % 100).alias("m"),
        _div(k, 100).alias("q"),
        (F.col("o_custkey") % AGENTS).alias("ai"),
        F.col("o_orderdate").cast("date").alias("d"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"),
    ).select(
        "*",
        (F.lit(1_000_000_000) + 2 * F.col("k")).cast("string").alias("t1"),
        F.when(F.col("k") % 3 == 0, (F.lit(1_000_000_001) + 2 * F.col("k")).cast("string")).alias("t2"),
        (F.col("m") % 10 == 9).alias("is_payment"),
        (_div(F.col("cents") + 5000, 10000) * 10000).alias("paid"),
        F.when(F.col("k") % 3 == 0, _div(F.col("cents"), 2)).otherwise(F.col("cents")).alias("first"),
    )


def ledger(orders: DataFrame) -> DataFrame:
    b = base(orders)
    k, two = F.col("k"), F.col("t2").isNotNull()
    second = F.col("cents") - F.col("first")
    overcharge = F.when(_is(6, 38), F.lit(50000)).when(_is(37), _div(F.col("cents"), 20)).otherwise(F.lit(0))
    kept = F.when(_is(10), F.lit(25000)).otherwise(F.lit(0))
    other = F.concat(F.lit("376-"), F.col("t2"))

    def leg(when, number, kind, ticket, cents, seconds, shift=0):
        return F.when(when, F.struct(
            F.lit(number).alias("number"), F.lit(kind).alias("kind"), ticket.alias("ticket_text"),
            cents.cast("bigint").alias("amount_cents"), F.lit(seconds).alias("seconds"), F.lit(shift).alias("shift")))

    w = ENGLISH
    sale = ~F.col("is_payment") & ~_is(*NO_LEDGER)
    pay = F.col("is_payment") & ~_is(49)
    none = F.lit(None).cast("string")
    legs = F.array_compact(F.array(
        leg(sale, 1, w.purchase, F.col("t1"), -(F.col("first") + overcharge), 0),
        leg(sale & two, 2, w.purchase, other, -second, 1),
        leg(sale & _is(4), 3, w.purchase, F.col("t1"), -F.col("first"), 300),
        leg(sale & _is(*VOIDED), 4, w.void, F.col("t1"), F.col("first") - kept, 3600),
        leg(sale & _is(*VOIDED) & two, 5, w.void, other, second - kept, 3601),
        leg(sale & _is(26) & (F.col("q") % 9 == 0), 6, w.purchase, F.col("t1"), F.lit(-1000), 7200, 3),
        leg(sale & _is(28), 7, w.refund, F.col("t1"), _div(F.col("first"), 2), 7300),
        leg(pay, 1, w.payment, none, F.col("paid"), 10800),
        leg(pay & _is(59), 2, w.payment, none, F.col("paid"), 18000),
    ))
    rows = b.select("*", F.explode(legs).alias("leg")).select(
        "k", "m", "q", "d", "leg.*", ((F.col("ai") + F.col("leg.shift")) % AGENTS).alias("owner"))
    rows = rows.select(
        _agent(F.col("owner")).alias("agent"),
        F.concat(_agent(F.col("owner")), F.lit("/"), ((k % 7) % 3).cast("string")).alias("agreement_id"),
        (k * 10 + F.col("number")).alias("txn_id"),
        _at("d", 32400 + k % 18000 + F.col("seconds")).alias("ts"),
        "kind",
        "ticket_text",
        _money(F.col("amount_cents")).alias("amount_orig"),
        F.lit("KGS").alias("currency"),
        _money(F.col("amount_cents")).alias("amount"),
        F.when(_is(*HUMAN), F.concat(F.lit("clerk-"), (k % 3).cast("string"))).otherwise(F.lit(w.bot)).alias("creator"),
        F.lit("").alias("comment"),
        F.col("owner"),
        F.when(_is(21) & (F.col("q") % 10 == 4), _money(F.lit(5000))).otherwise(_money(F.lit(0))).alias("slip"),
        "d",
    )
    rows = daily_running_total(rows, ["agent"], "d", ["ts", "txn_id"], "amount", "running")
    balance = F.col("running") + _money(F.col("owner") * 100000) + F.col("slip")
    return rows.select(
        "agent", "agreement_id", "txn_id", "ts", "kind", "ticket_text", "amount_orig", "currency", "amount",
        balance.cast("decimal(18,2)").alias("balance_after"), "creator", "comment",
    )


def statement_lines(orders: DataFrame) -> DataFrame:
    """Every line ever booked, before months are lost and versions are made."""
    b = base(orders)
    cents = F.col("cents")
    thousands, hundreds = _div(cents, 100000) % 10, _div(cents, 10000) % 10
    booked = (
        F.when(_is(5, 33, 35), cents - 30000)
        .when(_is(7), cents - 4000)
        .when(_is(8), F.when(thousands < 9, cents + 100000).otherwise(cents - 100000))
        .when(_is(17), cents - 77700)
        .when(_is(23), cents + (hundreds - thousands) * 90000)
        .when(_is(27), cents - 10000)
        .when(_is(36), cents - _div(cents, 20))
        .otherwise(cents)
    )
    zero = F.lit(0).cast("bigint")

    def line(when, number, doc, debit, credit):
        return F.when(when, F.struct(
            F.lit(number).alias("number"), F.concat(F.lit(doc), F.col("k").cast("string")).alias("doc"),
            debit.cast("bigint").alias("debit_cents"), credit.cast("bigint").alias("credit_cents")))

    sale = ~F.col("is_payment") & ~_is(*NO_STATEMENT)
    receipt = F.col("is_payment") & ~_is(39)
    lines = F.array_compact(F.array(
        line(sale, 1, "Sale order ", booked, zero),
        line(sale & _is(27), 2, "Sale service fee ", F.lit(10000), zero),
        line(sale & _is(28), 3, "Refund order ", zero, _div(F.col("first"), 2)),
        line(receipt, 1, "Receipt order ", zero, F.col("paid")),
    ))
    owner = (
        F.when(_is(69), (F.col("ai") + 1) % AGENTS)
        .when(_is(3) & (F.col("k") % 7 == 0), F.lit(DORMANT))
        .otherwise(F.col("ai"))
    )
    day = F.when(F.col("is_payment"), F.date_add("d", (F.col("q") % 5).cast("int"))).otherwise(F.col("d"))
    rows = b.select(
        "k", owner.alias("owner"), day.alias("doc_date"), "is_payment",
        F.when(~F.col("is_payment"), F.concat_ws(" ", "t1", "t2")).alias("ticket_text"),
        F.explode(lines).alias("line"))
    folder = (
        F.when(F.col("owner") == DORMANT, F.lit("Dormant Shop"))
        .when(F.col("is_payment") & (F.col("owner") % 5 == 0), F.concat(F.lit("AGENT-"), _two(F.col("owner"))))
        .otherwise(F.concat(F.lit("Counter "), _two(F.col("owner"))))
    )
    return rows.select(
        "k", "owner", folder.alias("folder"), "doc_date", "line.doc", "ticket_text", "line.debit_cents", "line.credit_cents",
        _month_index(F.col("doc_date")).alias("mi"), (F.col("k") * 10 + F.col("line.number")).alias("line_no"))


def statements(orders: DataFrame) -> DataFrame:
    lines = statement_lines(orders)
    mv = F.col("debit_cents") - F.col("credit_cents")
    in_draft = F.col("k") % 10 != 5
    months = lines.groupBy("owner", "mi").agg(
        F.sum(mv).alias("moved"), F.coalesce(F.sum(F.when(in_draft, mv)), F.lit(0)).alias("moved_draft"))
    before = Window.partitionBy("owner").orderBy("mi").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.when((F.col("owner") == 3) & (F.col("mi") >= 30), F.lit(2750000)).otherwise(F.lit(0))
    slip = F.when((F.col("owner") == 4) & (F.col("mi") == 20), F.lit(1000)).otherwise(F.lit(0))
    start = F.coalesce(F.sum("moved").over(before), F.lit(0)) - F.col("owner") * 100000 + (F.col("owner") % 4) * 5000 + shift
    months = months.select(
        "owner", "mi", start.alias("start"), (start + F.col("moved") + slip).alias("end"),
        (start + F.col("moved_draft")).alias("end_draft"),
        ((F.col("owner") + F.col("mi")) % 17 == 0).alias("again"),
        ((F.col("owner") + F.col("mi")) % 19 == 5).alias("unfinished"),
    ).filter((F.col("owner") * 7 + F.col("mi")) % 61 != 0)

    # One row per owner and calendar month, so the lines stay where they are.
    rows = lines.join(F.broadcast(months), ["owner", "mi"])
    versions = F.when(F.col("again") & in_draft, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    rows = rows.withColumn("is_draft", F.explode(versions))
    usual = F.when(F.col("again"), ENGLISH.reissued).when(F.col("unfinished"), ENGLISH.draft)
    rows = rows.withColumns({
        "version": F.when(F.col("is_draft"), ENGLISH.draft).otherwise(usual),
        "end": F.when(F.col("is_draft"), F.col("end_draft")).otherwise(F.col("end")),
        "line_no": F.when(F.col("is_draft"), F.col("line_no") + 5).otherwise(F.col("line_no")),
    })
    return rows.select(
        "folder",
        F.trunc("doc_date", "month").alias("period_start"),
        F.last_day("doc_date").alias("period_end"),
        "version",
        _money(F.col("start")).alias("opening"),
        _money(F.col("end")).alias("closing"),
        "doc_date",
        "doc",
        F.when(F.col("k") % 5 != 0, F.concat(F.lit("INV-"), F.col("k").cast("string"))).alias("invoice"),
        F.concat(F.lit("P"), (F.col("k") % 50).cast("string")).alias("pax"),
        "ticket_text",
        F.when(F.col("debit_cents") != 0, _money(F.col("debit_cents"))).alias("debit"),
        F.when(F.col("credit_cents") != 0, _money(F.col("credit_cents"))).alias("credit"),
        "line_no",
    )


def _styled(cents: Column) -> Column:
    """An amount as people type it, in one of four ways."""
    usual = F.format_number(_money(cents), 2)
    continental = F.translate(usual, ",.", ".,")
    return (
        F.when(F.col("q") % 4 == 0, F.concat(F.replace(usual, F.lit(","), F.lit("")), F.lit(" kgs")))
        .when(F.col("q") % 4 == 1, F.concat(continental, F.lit(" KGS")))
        .when(F.col("q") % 4 == 2, F.concat(F.translate(usual, ",", "\u00a0"), F.lit(" kgs")))
        .otherwise(F.concat(F.format_number(_money(cents - 10000), 2), F.lit(" KGS + 100 kgs sf")))
    )


def journal(orders: DataFrame) -> DataFrame:
    b = base(orders).filter(~F.col("is_payment") & ~_is(*NO_JOURNAL) & ~(_is(1) & (F.col("k") % 3 == 0)))
    # Class 20 rows also name the ticket of the agent's previous class 20 order.
    chain = Window.partitionBy("ai", _div(F.col("k"), 100000)).orderBy("k")
    linked = b.filter(_is(20)).withColumn("t0", F.lag("t1").over(chain))
    b = b.filter(~_is(20)).withColumn("t0", F.lit(None).cast("string")).unionByName(linked)

    cents = F.when(_is(16, 34), F.col("cents") + 100000).when(_is(35), F.col("cents") + 500000).otherwise(F.col("cents"))
    dollars = lambda rate: F.format_number(_money(_div(F.col("cents") * 100 + rate // 2, rate)), 2)
    cell = (
        F.when(_is(15), F.concat(F.lit("376"), F.col("t1")))
        .when(_is(18, 33), F.concat(dollars(8750), F.lit(" USD")))
        .when(_is(36, 37), F.concat(dollars(8780), F.lit(" $")))
        .when(_is(32), F.concat(F.lit("€ "), F.translate(dollars(9410), ",.", ".,")))
        .when(_is(30) & (F.col("q") % 6 == 0), F.lit(None).cast("string"))
        .when(_is(31) & (F.col("q") % 6 == 0), F.lit("paid by card"))
        .otherwise(_styled(cents))
    )
    fine = F.concat(
        F.lit("-"), F.replace(F.format_number(_money(_div(F.col("first"), 2)), 2), F.lit(","), F.lit(" ")), F.lit(" kgs (fine 15%)"))
    row = lambda number, kind, tickets, pay: F.struct(
        F.lit(number).alias("number"), kind.alias("kind"), tickets.alias("ticket_text"), pay.alias("pay_cell"))
    sale, refund = F.lit(ENGLISH.journal_sale), F.lit(ENGLISH.refund)
    tickets = F.concat_ws("|", "t1", "t2", "t0")
    rows = F.array_compact(F.array(
        row(1, F.when(_is(12), refund).otherwise(sale), tickets, cell),
        F.when(_is(14, 34), row(2, sale, tickets, cell)),
        F.when(_is(28), row(3, refund, F.col("t1"), fine)),
    ))
    party = (
        F.when(_is(13), F.concat(F.lit("Client "), (F.col("k") % 5).cast("string")))
        .when(_is(25) | (_is(12) & (F.col("q") % 3 == 1)), F.lit("Shared Desk"))
        .otherwise(F.concat(F.lit("Party "), _two(F.col("ai"))))
    )
    return b.select("*", F.explode(rows).alias("row")).select(
        F.concat_ws(".", _two(F.dayofmonth("d")), _two(F.month("d")), F.year("d").cast("string")).alias("date_text"),
        F.concat(F.lit("E"), (F.col("k") % 7).cast("string")).alias("employee"),
        "row.kind",
        party.alias("party"),
        "row.ticket_text",
        F.concat(F.lit("P"), (F.col("k") % 50).cast("string")).alias("pax"),
        F.concat(F.lit("PNR"), (F.col("k") % 1000).cast("string")).alias("pnr"),
        F.lit("ZZ").alias("airline"),
        F.lit("AAA-BBB").alias("route"),
        "row.pay_cell",
        F.lit("87.50").cast("decimal(18,6)").alias("rate_usd"),
        F.lit("94.10").cast("decimal(18,6)").alias("rate_eur"),
        F.lit("1.05").cast("decimal(18,6)").alias("rate_rub"),
        F.lit("0.17").cast("decimal(18,6)").alias("rate_kzt"),
        (F.col("k") * 10 + F.col("row.number")).alias("row_no"),
    )


def dense_payments(orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Payments and receipts with many competing candidates, for the matching operator."""
    b = base(orders).filter("is_payment")
    day = F.date_add(F.lit("1997-01-01").cast("date"), (_div(F.col("k"), 10) % 60).cast("int"))
    amount = (_div(F.col("cents") + 5_000_000, 10_000_000) * 100_000).cast("decimal(18,2)")
    pay = b.select(
        _agent(F.col("ai")).alias("agent"), (F.col("k") * 10).alias("txn_id"),
        _at(day, F.col("k") % 86400).alias("ts"),
        amount.alias("amount"))
    receipts = b.filter(~_is(39)).select(
        _agent(F.col("ai")).alias("agent"), (F.col("k") * 10).alias("line_no"),
        F.date_add(day, (_div(F.col("k"), 7) % 5 - 1).cast("int")).alias("doc_date"), amount.alias("amount"))
    return pay, receipts


def read_orders(spark: SparkSession, folder: str) -> DataFrame:
    orders = spark.read.parquet(f"{folder}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    cores = spark.sparkContext.defaultParallelism
    # A file too small to be cut would leave all work to one core.
    return orders.repartition(cores, "o_orderkey") if orders.rdd.getNumPartitions() < cores else orders


def derive(spark: SparkSession, folder: str) -> Sources:
    orders = read_orders(spark, folder)
    return Sources(statements(orders), ledger(orders), journal(orders))
