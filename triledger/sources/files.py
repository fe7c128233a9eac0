"""Reading the three sources from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triledger.operators.durable import durable
from triledger.operators.ordered import ordered_scan
from triledger.sources.derived import Sources

# The columns of the three exported files and the names used here.
STATEMENT_FILE = {
    "folder": "folder", "period_start": "period_start", "period_end": "period_end", "act_status": "version",
    "saldo_start": "opening", "saldo_end": "closing", "date": "doc_date", "doc": "doc", "invoice": "invoice",
    "pax": "pax", "ticket_cell": "ticket_text", "debet": "debit", "credit": "credit",
}
LEDGER_FILE = {
    "agent": "agent", "agreement_id": "agreement_id", "txn_id": "txn_id", "date": "ts", "kind": "kind",
    "tickets": "ticket_text", "amount": "amount_orig", "currency": "currency", "amount_kgs": "amount",
    "balance_after": "balance_after", "creator": "creator", "comment": "comment",
}
JOURNAL_FILE = {
    "date": "date_text", "employee": "employee", "kind": "kind", "party": "party", "tickets": "ticket_text",
    "pax": "pax", "pnr": "pnr", "airline": "airline", "route": "route", "pay_cell": "pay_cell",
    "rate_usd": "rate_usd", "rate_eur": "rate_eur", "rate_rub": "rate_rub", "rate_kzt": "rate_kzt",
}

MONEY = {"opening", "closing", "debit", "credit", "amount", "amount_orig", "balance_after"}
RATES = {"rate_usd", "rate_eur", "rate_rub", "rate_kzt"}
DATES = {"period_start", "period_end", "doc_date"}
FILES = {"statements": STATEMENT_FILE, "ledger": LEDGER_FILE, "journal": JOURNAL_FILE}
ORDER = {"statements": "line_no", "journal": "row_no"}


def _typed(name: str, text) -> F.Column:
    """A text cell as its type; what cannot be read becomes null and never stops the run."""
    if name in MONEY:
        return text.try_cast("decimal(18,2)")
    if name in RATES:
        return text.try_cast("decimal(18,6)")
    if name in DATES:
        return F.coalesce(text.try_cast("date"), _local_time(text).cast("date"))
    if name == "ts":
        return F.coalesce(text.try_cast("timestamp_ntz"), _local_time(text))
    if name == "txn_id":
        # A column with gaps is often exported with ".0" behind its whole numbers.
        return F.regexp_replace(text, r"\.0+\s*$", "").try_cast("bigint")
    return text


def _local_time(text) -> F.Column:
    """Day first, with points or slashes, with or without a time."""
    plain = F.translate(text, "/", ".")
    return F.coalesce(*[F.try_to_timestamp(plain, F.lit(p)).cast("timestamp_ntz")
                        for p in ("d.M.yyyy H:m:s", "d.M.yyyy H:m", "d.M.yyyy")])


def read_source(spark: SparkSession, kind: str, path: str, multi_line: bool = False) -> DataFrame:
    """One source from CSV (by its exported column names) or Parquet (by these or our own names).

    Every CSV column is read as text, so ticket numbers never turn into floating point numbers.
    Rows keep their order: a `line_no` / `row_no` column if there is one, else they are numbered by
    file, place in the file and place in the scan.  Journal columns that are not known go into
    `other`, so rows that differ there only are no copies.  `multi_line` is for CSV files with line
    breaks inside quoted cells; such files cannot be split between tasks.
    """
    names = FILES[kind]
    if path.rstrip("/").endswith(".parquet"):
        raw = spark.read.parquet(path)
    else:
        raw = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path)
    order = ORDER.get(kind)
    columns = []
    for source, name in names.items():
        found = source if source in raw.columns else name if name in raw.columns else None
        text = F.lit(None).cast("string") if found is None else F.col(f"`{found}`").cast("string")
        columns.append(_typed(name, text).alias(name))
    known = {*names.keys(), *names.values(), order, "other"}
    unknown = [c for c in raw.columns if c not in known]
    if kind == "journal":
        other = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(unknown)])) if unknown else F.lit(None).cast("string")
        columns.append(F.col("other").cast("string") if "other" in raw.columns else other.alias("other"))
    if order is None:
        return raw.select(*columns)
    if order in raw.columns:
        return raw.select(*columns, F.col(order).cast("bigint").alias(order))
    # Written once by the scan, so the numbers hold whatever is recomputed later.
    place = ["_path", "_block", "_at"]
    scanned = durable(raw.select(
        *columns, F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at")))
    return ordered_scan(scanned, [], place, number=order).drop(*place)


def load_sources(
    spark: SparkSession, paths: dict[str, str], defaults: dict[str, str] | None = None, multi_line: bool = False
) -> Sources:
    """Sources by kind (statements, ledger, journal); a kind without a path falls back to `defaults`."""
    chosen = {**(defaults or {}), **paths}
    return Sources(**{kind: read_source(spark, kind, chosen[kind], multi_line) for kind in FILES})
