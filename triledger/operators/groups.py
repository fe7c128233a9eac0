"""One row per ticket group with what each of the three sources says about it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triledger.config import Config

MONEY = "decimal(18,2)"


def first_values(rows: DataFrame, key: str, value: str, order: list[str], n: int, name: str, sep: str) -> DataFrame:
    """The first n values per key as one text.  The limit is applied before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    top = rows.select(key, value, *order).withColumn("_rank", rank).filter(F.col("_rank") <= n)
    listed = F.array_sort(F.collect_list(F.struct("_rank", F.col(value).alias("_value"))))
    return top.groupBy(key).agg(F.array_join(F.transform(listed, lambda s: s["_value"].cast("string")), sep).alias(name))


def statement_facts(statements: DataFrame) -> DataFrame:
    return statements.filter(F.col("gid").isNotNull() & (F.col("line_kind") != "receipt"))


def repeated_debits(ledger: DataFrame, config: Config) -> DataFrame:
    """Purchases of one group with the same ticket text and amount: what the extra copies add up to."""
    same = (
        ledger.filter(F.col("gid").isNotNull() & (F.col("kind") == config.words.purchase))
        # Grouping by a missing ticket or amount would compare nothing with nothing.
        .filter(F.col("ticket_text").isNotNull() & F.col("amount").isNotNull())
        .groupBy("gid", "ticket_text", "amount").agg(F.count("*").alias("n")).filter(F.col("n") > 1))
    return same.groupBy("gid").agg(
        F.sum(F.col("amount") * (F.col("n") - 1)).cast(MONEY).alias("extra_amount"),
        F.sum(F.col("n") - 1).alias("extra_rows"))


def group_tickets(statements: DataFrame, ledger: DataFrame, journal: DataFrame) -> DataFrame:
    """Every ticket of every group: the whole list, one row per ticket."""
    parts = [s.filter(F.col("gid").isNotNull()).select("gid", "agent", F.explode("tickets").alias("ticket"))
             for s in (statements, ledger, journal)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


def _sorted_set(seen: F.Column, src: str, name: str, kept=None) -> F.Column:
    """The values of one source among the combinations that a group has, as one text."""
    own = lambda v: (v["src"] == src) & v[name].isNotNull()
    values = F.transform(F.filter(seen, own if kept is None else lambda v: own(v) & kept(v)), lambda v: v[name])
    return F.array_join(F.array_sort(F.array_distinct(values)), "|")


def source_totals(statements: DataFrame, ledger: DataFrame, journal: DataFrame, config: Config) -> DataFrame:
    """All sums, counts, dates and flags of the three sources in a single grouped pass."""
    words = config.words
    s = statement_facts(statements).select("gid", F.lit("s").alias("src"), F.col("mv").cast("decimal(30,8)").alias("value"), F.col("doc_date").alias("day"))
    e = ledger.filter(F.col("gid").isNotNull()).select(
        "gid", F.lit("l").alias("src"), F.col("amount").cast("decimal(30,8)").alias("value"), "day", "ts", "kind", F.col("creator").alias("person"))
    j = journal.filter(F.col("gid").isNotNull()).select(
        "gid", F.lit("j").alias("src"), F.col("amount").alias("value"), "kind", F.col("employee").alias("person"),
        F.col("amount_issue").alias("issue"), "is_foreign", "is_copy")
    facts = s.unionByName(e, allowMissingColumns=True).unionByName(j, allowMissingColumns=True)
    in_s, in_l = F.col("src") == "s", F.col("src") == "l"
    in_j = (F.col("src") == "j") & ~F.col("is_copy")
    zero = F.lit(0).cast(MONEY)
    # One set of the combinations of all texts: a set for each text makes buffers that are larger than the rows.
    lists = {
        "ledger_kinds": ("l", "kind"), "ledger_creators": ("l", "person"), "journal_kinds": ("j", "kind"), "employees": ("j", "person"),
        "journal_issue": ("j", "issue", lambda v: v["issue"] != ""),
    }
    listed = (F.col("src") == "l") | in_j
    totals = facts.groupBy("gid").agg(
        F.coalesce(F.sum(F.when(in_s, F.col("value"))).cast(MONEY), zero).alias("statement_sum"),
        F.count_if(in_s).alias("statement_rows"),
        F.min(F.when(in_s, F.col("day"))).alias("statement_first"),
        F.max(F.when(in_s, F.col("day"))).alias("statement_last"),
        F.coalesce(F.sum(F.when(in_l, F.col("value"))).cast(MONEY), zero).alias("ledger_sum"),
        F.count_if(in_l).alias("ledger_rows"),
        F.min("ts").alias("ledger_first"),
        F.max("ts").alias("ledger_last"),
        F.collect_set(F.when(listed, F.struct("src", "kind", "person", "issue"))).alias("_seen"),
        F.coalesce(F.bool_or(in_l & (F.col("person") == words.bot)), F.lit(False)).alias("by_bot"),
        F.coalesce(F.bool_or(in_l & (F.col("kind") == words.void)), F.lit(False)).alias("has_void"),
        F.coalesce(F.bool_or(in_l & (F.col("kind") == words.refund)), F.lit(False)).alias("has_refund"),
        F.sum(F.when(in_j, F.col("value"))).alias("journal_sum"),
        F.count_if(in_j).alias("journal_rows"),
        F.count_if(in_j & F.col("value").isNull()).alias("journal_unread"),
        F.coalesce(F.bool_or(in_j & F.col("is_foreign")), F.lit(False)).alias("journal_foreign"),
        F.count_if((F.col("src") == "j") & F.col("is_copy")).alias("journal_copies"),
    )
    texts = {name: _sorted_set(F.col("_seen"), *of).alias(name) for name, of in lists.items()}
    return totals.select(
        "gid", "statement_sum", "statement_rows", "statement_first", "statement_last", "ledger_sum", "ledger_rows", "ledger_first",
        "ledger_last", texts["ledger_kinds"], texts["ledger_creators"], "by_bot", "has_void", "has_refund", "journal_sum", "journal_rows",
        "journal_unread", "journal_foreign", texts["journal_kinds"], texts["employees"], texts["journal_issue"], "journal_copies")


def build_groups(
    statements: DataFrame, ledger: DataFrame, journal: DataFrame, tickets: DataFrame, config: Config
) -> DataFrame:
    """One row per group; `tickets` is the table made by `group_tickets`."""
    # The tickets are distinct already, so this list is what the group is made of, whole.
    counted = tickets.groupBy("gid").agg(
        F.min("agent").alias("agent"), F.count("*").alias("ticket_count"),
        F.array_join(F.array_sort(F.collect_list("ticket")), "|").alias("tickets"))
    facts = statement_facts(statements)
    docs = first_values(
        facts.groupBy("gid", "doc").agg(F.min("line_no").alias("_first")), "gid", "doc", ["_first"],
        config.docs_shown, "statement_docs", " | ")
    txns = first_values(
        ledger.filter(F.col("gid").isNotNull()), "gid", "txn_id", ["ts", "txn_id"], config.txns_shown, "ledger_txns", ",")
    joined = counted
    for part in (source_totals(statements, ledger, journal, config), docs, txns, repeated_debits(ledger, config)):
        joined = joined.join(part, "gid", "left")
    zero, empty = F.lit(0), F.lit("")
    defaults = {
        "statement_sum": zero.cast(MONEY), "ledger_sum": zero.cast(MONEY), "statement_rows": zero, "ledger_rows": zero,
        "journal_rows": zero, "journal_unread": zero, "journal_copies": zero,
        "extra_amount": zero.cast(MONEY), "extra_rows": zero,
        "by_bot": F.lit(False), "has_void": F.lit(False), "has_refund": F.lit(False), "journal_foreign": F.lit(False),
        "ledger_kinds": empty, "ledger_creators": empty, "journal_kinds": empty, "employees": empty, "journal_issue": empty,
        "statement_docs": empty, "ledger_txns": empty,
    }
    joined = joined.withColumns({c: F.coalesce(c, d.cast(joined.schema[c].dataType)) for c, d in defaults.items()})
    return joined.withColumn("residual", (F.col("statement_sum") + F.col("ledger_sum")).cast(MONEY))
