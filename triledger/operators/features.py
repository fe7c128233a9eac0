"""Labels and features per ledger operation, using nothing that was not known when it was posted."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triledger.config import Config
from triledger.functions.times import micros
from triledger.operators.durable import durable, known_rows
from triledger.operators.ordered import ordered_scan
from triledger.operators.skew import salted_join
from triledger.vocabulary import CLASSES

CATEGORICAL = ("kind", "creator", "currency", "employee")
NUMERIC = (
    "log_amount", "hour", "weekday", "dom", "month_end", "n_tickets", "agreements",
    "prior_same_ticket", "hours_since_same", "prior_error_rate", "prior_rows",
)
PRIOR_WEIGHT, PRIOR_RATE = 20, 0.05
NO_EARLIER_PAYMENT = 9999.0


def labelled(ledger: DataFrame, groups: DataFrame, payments: DataFrame, config: Config) -> DataFrame:
    """Ledger rows with the class the rules gave them; rows without a class are left out."""
    is_payment = F.col("kind") == config.words.payment
    exceptions = payments.filter((F.col("found_in") == "LEDGER") & F.col("txn_id").isNotNull()).select(
        "txn_id", F.col("error_source").alias("_payment"))
    # Hot groups are counted in the ledger as it is stored.
    joined = salted_join(
        ledger, groups.select("gid", F.col("error_source").alias("_group")), ["gid"],
        hot_rows=config.hot_rows, at_most=known_rows(ledger)).join(exceptions, "txn_id", "left")
    source = F.when(is_payment, F.coalesce("_payment", F.lit("OK"))).otherwise(F.col("_group"))
    return joined.withColumn("_source", source).filter(F.col("_source") != "EXPORT").select(
        *ledger.columns,
        F.when(F.col("_source").isin(*CLASSES), F.col("_source")).otherwise("REVIEW").alias("label"),
    ).withColumn("is_err", (F.col("label") != "OK").cast("int"))


def first_employee(rows: DataFrame, journal: DataFrame, config: Config) -> DataFrame:
    """txn_id, employee: who wrote the journal row of the first ticket that has one."""
    known = journal.select("agent", "employee", "row_no", F.explode("tickets").alias("ticket")).groupBy("agent", "ticket").agg(
        F.min_by("employee", "row_no").alias("employee"))
    named = rows.select("txn_id", "agent", F.posexplode("tickets").alias("pos", "ticket"))
    found = salted_join(named, known, ["agent", "ticket"], how="inner", hot_rows=config.hot_rows, at_most=known_rows(rows))
    return found.groupBy("txn_id").agg(F.min_by("employee", "pos").alias("employee"))


def error_history(rows: DataFrame) -> DataFrame:
    """Per agent and month: the smoothed error share of all strictly earlier months."""
    months = rows.groupBy("agent", "month").agg(F.sum("is_err").alias("e"), F.count("*").alias("n"))
    earlier = Window.partitionBy("agent").orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    errors, n = (F.coalesce(F.sum(c).over(earlier), F.lit(0)) for c in ("e", "n"))
    return months.select(
        "agent", "month",
        ((errors + PRIOR_RATE * PRIOR_WEIGHT) / (n + PRIOR_WEIGHT)).alias("prior_error_rate"), n.alias("prior_rows"))


def build_features(ledger: DataFrame, groups: DataFrame, payments: DataFrame, journal: DataFrame, config: Config) -> DataFrame:
    rows = durable(labelled(ledger, groups, payments, config).select(
        "txn_id", "agent", "month", "ts", "amount", "gid", "kind", "creator", "currency", "tickets", "ticket_text", "label", "is_err"))
    n = known_rows(rows)
    agreements = durable(ledger.groupBy("agent").agg(F.count_distinct("agreement_id").alias("agreements")))
    history = durable(error_history(rows))
    # Only payments look for the one before, and only rows with a ticket are numbered; the others stay where they are.
    named, paid = (F.coalesce(c, F.lit(False)) for c in (F.size("tickets") > 0, F.col("kind") == config.words.payment))
    marked = rows.withColumn("_paid", paid)
    timed = ordered_scan(marked.filter("_paid"), ["agent", "amount"], ["ts", "txn_id"], previous={"_before": F.col("ts")}, at_most=n) \
        .unionByName(marked.filter("not _paid").withColumn("_before", F.lit(None).cast(rows.schema["ts"].dataType)))
    timed = ordered_scan(timed.filter(named), ["agent", "ticket_text"], ["ts", "txn_id"], number="_seen", at_most=n) \
        .unionByName(timed.filter(~named).withColumn("_seen", F.lit(None).cast("bigint")))
    hours = (micros(F.col("ts")) - micros(F.col("_before"))) / 3.6e9
    out = timed.join(first_employee(rows, journal, config), "txn_id", "left")
    out = salted_join(out, agreements, ["agent"], hot_rows=config.hot_rows, at_most=n, lookup_rows=known_rows(agreements))
    out = salted_join(out, history, ["agent", "month"], hot_rows=config.hot_rows, at_most=n, lookup_rows=known_rows(history))
    tickets = F.size("tickets")
    return out.select(
        "txn_id", "agent", "month", "ts", "amount", "gid", "label", "is_err",
        "kind", "creator", "currency", F.coalesce("employee", F.lit("none")).alias("employee"),
        F.log1p(F.abs("amount").cast("double")).alias("log_amount"),
        F.hour("ts").alias("hour"),
        F.weekday("ts").alias("weekday"),
        F.dayofmonth("ts").alias("dom"),
        (F.dayofmonth("ts") >= 28).cast("int").alias("month_end"),
        tickets.alias("n_tickets"),
        "agreements",
        F.when(tickets > 0, F.col("_seen") - 1).otherwise(0).alias("prior_same_ticket"),
        F.when(F.col("_paid") & F.col("agent").isNotNull() & F.col("amount").isNotNull(), F.coalesce(hours, F.lit(NO_EARLIER_PAYMENT))).otherwise(NO_EARLIER_PAYMENT).alias("hours_since_same"),
        "prior_error_rate", "prior_rows",
    )


def balanced_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """Per class: the square root of n / (classes * rows of the class)."""
    sizes = rows.groupBy(label).agg(F.count("*").alias("class_rows"))
    # One row per class: this window never sees the data itself.
    every = Window.partitionBy(F.lit(0))
    return sizes.select(
        label, "class_rows",
        F.sqrt(F.sum("class_rows").over(every) / (F.count("*").over(every) * F.col("class_rows"))).alias("weight"))
