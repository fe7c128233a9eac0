"""Every operator as a query over a folder of tables, with plain output types."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triledger.config import DEFAULT, Config
from triledger.functions import text
from triledger.functions.stats import wilson
from triledger.functions.times import micros
from triledger.operators import evaluate, features, ledger, matching, model, risk, voting
from triledger.operators import payments as payment_ops
from triledger.operators.bands import band_partners
from triledger.operators.bridge import status_counts
from triledger.operators.durable import durable, file_states, shared_folder, side_by_side
from triledger.operators.groups import repeated_debits
from triledger.operators.ordered import ordered_scan
from triledger.plans import views
from triledger.plans.learn import ModelResult, learn
from triledger.plans.reconcile import Result, reconcile
from triledger.plans.store import Store
from triledger.sources import derived
from triledger.sources.derived import Sources
from triledger.sources.files import load_sources
from triledger.sources.sinks import FORMATS, content, publish, read_published, result_tables, write_tables
from triledger.vocabulary import CLASSES, GROUP_STATUSES, SOURCE_LABELS, STATUS_LABELS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# What a result was made from, and the result.
_RUNS: dict[tuple[str, str], tuple[object, Result]] = {}
_MODELS: dict[tuple[str, str, str], ModelResult] = {}
# A test period of the queries has at least so many rows, or all but the earliest months of smaller tables.
TEST_ROWS = 1_000
# Trees of each class in the boosted queries; `Settings` has more.
BOOSTING_ROUNDS = 20


def plain(df: DataFrame) -> DataFrame:
    """Doubles, whole numbers and text only, so that two engines' results can be compared."""
    def simple(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            return c.cast("double").alias(f.name)
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            return c.cast("bigint").alias(f.name)
        if isinstance(f.dataType, T.DateType):
            return c.cast("string").alias(f.name)
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            return F.substring(c.cast("string"), 1, 19).alias(f.name)
        if isinstance(f.dataType, T.ArrayType):
            return F.array_join(c, "|").alias(f.name)
        if isinstance(f.dataType, T.DoubleType):
            return F.round(c, 9).alias(f.name)
        return c

    return df.select(*[simple(f) for f in df.schema])


def inputs_of(folder: str) -> list[str]:
    """The tables that the test ledgers are derived from."""
    return [f"{folder}/orders.parquet"]


def run_of(spark: SparkSession, folder: str) -> Result:
    """The reconciliation of a folder; its tables are made once and reused until the folder's files change.

    With `spark.triledger.results` set, they are also found by later sessions.
    """
    key, state = (spark.sparkContext.applicationId, folder), file_states(spark, *inputs_of(folder))
    if key not in _RUNS or _RUNS[key][0] != state:
        kept = spark.conf.get("spark.triledger.results", None)
        _MODELS.clear()
        _RUNS[key] = state, reconcile(stored_sources(spark, folder)) if kept is None else Store(spark, kept).result(
            _slug(folder), inputs_of(folder), DEFAULT, lambda: stored_sources(spark, folder))[0]
    return _RUNS[key][1]


def stored_sources(spark: SparkSession, folder: str) -> Sources:
    """The derived ledgers as tables, the way a real run would find its input."""
    raw = derived.derive(spark, folder)
    return Sources(*side_by_side(spark, *[lambda t=t: durable(t) for t in (raw.statements, raw.ledger, raw.journal)]))


def forced_run_of(spark: SparkSession, folder: str) -> Result:
    """The same reconciliation with nearly every key hot and every island oversized: what large data makes happen."""
    usual = run_of(spark, folder)
    key = (spark.sparkContext.applicationId, f"{folder} forced")
    if key not in _RUNS or _RUNS[key][0] is not usual:
        _RUNS[key] = usual, reconcile(usual.sources, Config(hot_rows=50, island_rows=1))
    return _RUNS[key][1]


def model_of(spark: SparkSession, folder: str, learner: str = model.FOREST) -> ModelResult:
    rows = run_of(spark, folder).features
    key = (spark.sparkContext.applicationId, folder, learner)
    if key not in _MODELS:
        settings = model.Settings(test_rows=min(TEST_ROWS, rows.count() // 4))
        if learner == model.BOOSTING:
            settings = replace(settings, learner=learner, rounds=BOOSTING_ROUNDS, depth=4)
        _MODELS[key] = learn(rows, settings)
    return _MODELS[key]


def forget() -> None:
    """Drop what earlier queries computed (for timing)."""
    _RUNS.clear()
    _MODELS.clear()


def query(name: str):
    def register(build: Query) -> Query:
        QUERIES[name] = lambda spark, folder: plain(build(spark, folder))
        return build

    return register


def of_run(name: str, build: Callable[[Result], DataFrame]) -> None:
    query(name)(lambda spark, folder: build(run_of(spark, folder)))


def _slug(folder: str) -> str:
    return folder.strip("/").replace("/", "-")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# -- sources and sinks ----------------------------------------------------------------------
@query("q01_load_csv")
def _load_csv(spark, folder):
    """Write the three sources as CSV and read them back with explicit types."""
    src = run_of(spark, folder).sources
    where = f"{shared_folder(spark)}/csv-{_slug(folder)}"
    write_tables({"statements": src.statements, "ledger": src.ledger, "journal": src.journal}, where, "csv")
    back = load_sources(spark, {k: f"{where}/{k}" for k in ("statements", "ledger", "journal")})
    return back.statements.agg(
        F.lit("statements").alias("source"), F.count("*").alias("rows"),
        F.sum(F.coalesce("debit", F.lit(0)) - F.coalesce("credit", F.lit(0))).alias("total"),
        F.min("doc_date").alias("first_day")).unionByName(
        back.ledger.agg(F.lit("ledger").alias("source"), F.count("*").alias("rows"), F.sum("amount").alias("total"),
                        F.to_date(F.min("ts")).alias("first_day"))).unionByName(
        back.journal.agg(F.lit("journal").alias("source"), F.count("*").alias("rows"), F.sum("rate_usd").alias("total"),
                         F.min(F.to_date(F.try_to_timestamp("date_text", F.lit("dd.MM.yyyy")))).alias("first_day")))


@query("q02_load_override")
def _load_override(spark, folder):
    """One source given, the others taken from the default set."""
    src = run_of(spark, folder).sources
    where = f"{shared_folder(spark)}/override-{_slug(folder)}"
    tables = {"statements": src.statements, "ledger": src.ledger, "journal": src.journal}
    write_tables({f"{k}.parquet": t for k, t in tables.items()}, where)
    write_tables({"other.parquet": src.ledger.filter("kind = 'payment'")}, where)
    back = load_sources(spark, {"ledger": f"{where}/other.parquet"}, {k: f"{where}/{k}.parquet" for k in tables})
    count = lambda name, df: df.agg(F.lit(name).alias("source"), F.count("*").alias("rows"))
    return count("statements", back.statements).unionByName(count("ledger", back.ledger)).unionByName(count("journal", back.journal))


@query("sink_tables")
def _sinks(spark, folder):
    """Write every result table and count what can be read back."""
    r = run_of(spark, folder).compute()
    where = f"{shared_folder(spark)}/out-{_slug(folder)}"
    tables = result_tables(r)
    write_tables(tables, where)
    out = None
    for name in tables:
        one = spark.read.parquet(f"{where}/{name}").agg(F.lit(name).alias("table_name"), F.count("*").alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out


@query("sink_round_trip")
def _round_trip(spark, folder):
    """Every result table, published in each format and read back: its rows, and whether the contents are the same."""
    planned = result_tables(run_of(spark, folder).compute())
    # Tables that the run has stored are not written a second time.
    stored = side_by_side(spark, *[lambda df=df: df if hasattr(df, "_path") else durable(df) for df in planned.values()])
    tables = dict(zip(planned, stored, strict=True))
    own = dict(zip(tables, side_by_side(spark, *[lambda df=df: durable(content(df)) for df in tables.values()]), strict=True))
    out = None
    for fmt in FORMATS:
        where = f"{shared_folder(spark)}/published-{fmt}-{_slug(folder)}"
        publish(tables, where, fmt, small=True)
        back = read_published(spark, where)
        for name, df in tables.items():
            one = content(back[name]).select(F.lit(name).alias("table_name"), F.lit(fmt).alias("format"), "rows", (
                (F.col("checksum") == own[name].select("checksum").scalar()) & F.lit(back[name].dtypes == df.dtypes)).alias("same"))
            out = one if out is None else out.unionByName(one)
    return out


@query("result_cache")
def _cached(spark, folder):
    """Tables of a stored result, read by another store: whether they were found, and their rows."""
    where = f"{shared_folder(spark)}/results"
    name = _slug(folder)
    Store(spark, where).result(name, inputs_of(folder), DEFAULT, lambda: run_of(spark, folder).sources)
    again, found = Store(spark, where).result(name, inputs_of(folder), DEFAULT, lambda: run_of(spark, folder).sources)
    tables = {"groups": again.groups, "payment_exceptions": again.payments, "agent_bridge": again.bridge, "agent_actions": again.actions,
              "monthly_bridge": again.monthly, "statement_integrity": again.acts, "missing_months": again.missing}
    out = None
    for key, t in tables.items():
        one = t.agg(F.lit(key).alias("table_name"), F.lit(found).alias("found"), F.count("*").alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out


# -- scalar functions -----------------------------------------------------------------------
@query("q03_extract_tickets")
def _tickets(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", text.extract_tickets(F.col("text")).alias("tickets"))
    return rows.select("doc_id", "tickets", F.size("tickets").alias("n"))


@query("q04_norm_text")
def _names(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text.norm_text(F.col("text")).alias("name"))


@query("q05_parse_number")
def _numbers(spark, folder):
    """The first number of every journal cell."""
    rows = run_of(spark, folder).sources.journal.filter(F.col("pay_cell").isNotNull())
    token = F.regexp_extract(F.regexp_replace(F.upper("pay_cell"), r"\(.*?\)", " "), text.NUMBER, 0)
    return rows.select("row_no", text.parse_number(token).alias("value"))


of_run("q06_parse_amount", lambda r: r.journal_prepared.select("row_no", "amount"))
@query("q06_document_amounts")
def _document_amounts(spark, folder):
    """Whole documents as amount cells, with a rate for each currency."""
    rates = {name: F.lit(i).cast("decimal(12,6)") for i, name in enumerate(("rate_usd", "rate_eur", "rate_rub", "rate_kzt"), 2)}
    rows = table(spark, folder, "documents").withColumns(rates)
    return rows.select("doc_id", text.parse_amount(F.col("text"), {c: F.col(c) for c in rates}).alias("amount"))


of_run("q07_amount_issues", lambda r: r.journal_prepared.select("row_no", "pay_cell", "is_foreign", "amount_issue", F.round("amount", 4).alias("amount")))
of_run("q08_digit_pattern", lambda r: r.group_totals.select(
    "gid", "statement_sum", "ledger_sum", text.digit_pattern(F.col("statement_sum"), F.col("ledger_sum")).alias("pattern")))
of_run("q09_document_kind", lambda r: r.statement_versions.groupBy("line_kind").agg(F.count("*").alias("rows"), F.sum("mv").alias("mv")))
of_run("q10_journal_agrees", lambda r: r.group_totals.filter(F.col("journal_sum").isNotNull()).select("gid", *[
    text.agrees(F.col("journal_sum"), F.col("journal_foreign"), other, "5", "0.005").alias(name)
    for name, other in (("like_statement", F.col("statement_sum")), ("like_ledger", -F.col("ledger_sum")))]))
of_run("q11_month_missing", lambda r: ledger.with_month_missing(
    r.ledger_prepared.select("agent", "txn_id", "ts"), "ts", r.missing, r.config).groupBy("agent").agg(
    F.count_if("month_missing").alias("flagged"), F.count("*").alias("rows")))
of_run("date_parts", lambda r: r.ledger_prepared.select(
    "txn_id", F.hour("ts").alias("hour"), F.weekday("ts").alias("weekday"), F.dayofmonth("ts").alias("dom"),
    (F.dayofmonth("ts") >= 28).cast("int").alias("month_end"), "month"))


@query("tolerant_casts")
def _casts(spark, folder):
    """Casts of every word of every document: what cannot be read becomes null."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    rows = table(spark, folder, "documents").select("doc_id", F.explode(words).alias("word"))
    word = F.col("word")
    number = text.decimal_number(word)
    return rows.groupBy("doc_id").agg(
        F.count("*").alias("words"), F.count(text.whole_number(word)).alias("wholes"), F.count(number).alias("numbers"),
        F.coalesce(F.sum(number), F.lit(0)).alias("total"), F.count(text.calendar_day(word)).alias("days"))


of_run("money_text", lambda r: r.ledger_prepared.select(
    "txn_id", text.money(F.col("amount"), signed=True).alias("signed"), F.round(F.log1p(F.abs("amount").cast("double")), 6).alias("log_amount")))
of_run("labels_lookup", lambda r: views.labelled(
    views.labelled(r.groups, "status", STATUS_LABELS, "status_label"), "error_source", SOURCE_LABELS, "source_label")
    .groupBy("status", "status_label", "source_label").agg(F.count("*").alias("groups")))

# -- preparation ----------------------------------------------------------------------------
of_run("q12_latest_statements", lambda r: r.latest.select("folder", "period_start", "version", "line_no", "mv"))
of_run("q13_version_differences", lambda r: r.versions)
of_run("q14_ledger_rows", lambda r: ordered_scan(
    r.ledger_prepared.select("agent", "txn_id", "ts", "day", "month", "amount", "balance_after", "tickets"),
    ["agent"], ["ts", "txn_id"], number="agent_row"))
of_run("q15_exact_duplicates", lambda r: r.journal_prepared.select("row_no", "party", "is_copy", "day", "tickets"))
of_run("q59_duplicated", lambda r: r.journal_prepared.groupBy("party").agg(F.count_if("is_copy").alias("copies"), F.count("*").alias("rows")))
of_run("window_filter", lambda r: r.ledger_all.groupBy("agent", "kind", "in_window").agg(F.count("*").alias("rows"), F.sum("amount").alias("amount")))

# -- joins ----------------------------------------------------------------------------------
of_run("q16_group_totals", lambda r: r.group_totals.drop("statement_docs", "ledger_txns"))
of_run("q17_lookup", lambda r: r.statements.groupBy("agent", "folder").agg(F.count("*").alias("rows"), F.sum("mv").alias("mv")))
of_run("q18_merge_history", lambda r: r.features.select("txn_id", "agent", "month", F.round("prior_error_rate", 9).alias("prior_error_rate"), "prior_rows"))
of_run("q19_merge_counts", lambda r: r.actions.select("agent", "gap_close", "n_OK", "n_AMOUNT_RESIDUAL", "n_REPEATED_CREDIT", "n_PAYMENT_NOT_IN_LEDGER"))
of_run("q20_unmatched_receipts", lambda r: r.payment_match.receipts.filter(~F.col("is_matched")).select("agent", "line_no", "doc_date", "doc", "amount"))


of_run("q21_band_join", lambda r: band_partners(
    payment_ops.payment_rows(r.ledger_inside, r.config).select("agent", "amount", "day", F.col("txn_id").alias("id")),
    payment_ops.receipt_rows(r.statements).withColumnRenamed("doc_date", "day"),
    tolerance=1, days=7, same_agent=True, hot_rows=r.config.hot_rows))
of_run("q22_cross_agent_band_join", lambda r: band_partners(
    r.payment_match.receipts.filter(~F.col("is_matched")).select("agent", "amount", F.col("doc_date").alias("day"), F.col("line_no").alias("id")),
    r.payments.filter("found_in = 'LEDGER' and (status <> 'REPEATED_CREDIT')").select("agent", "amount", F.to_date("ts").alias("day")),
    tolerance=1, days=10, same_agent=False, hot_rows=r.config.hot_rows))
of_run("q23_balance_points", lambda r: ledger.balance_points(
    r.ledger_prepared, r.acts.select("agent", F.explode(F.array("period_start", F.date_add("period_end", 1))).alias("boundary"))
).select("agent", "boundary", "balance"))
of_run("q24_first_employee", lambda r: features.first_employee(r.ledger, r.journal, r.config))

# -- names ----------------------------------------------------------------------------------
of_run("q25_ticket_owners", lambda r: r.votes.ledger_tickets.select("ticket", "agent"))
of_run("q26_ticket_conflicts", lambda r: r.votes.ledger_tickets.agg(F.sum("conflicts").alias("conflicts"), F.count("*").alias("tickets")))
of_run("q27_folder_votes", lambda r: r.votes.folders.withColumn("confidence", F.round("confidence", 9)))
of_run("q28_all_ticket_owners", lambda r: r.votes.ticket_agent)
of_run("q29_party_votes", lambda r: r.votes.parties.withColumn("accepted", F.col("confidence") >= r.config.vote_share))
of_run("q30_name_evidence", lambda r: r.mapping)
of_run("q31_journal_agents", lambda r: r.journal_owned.select("row_no", "party", "agent"))

# -- components -----------------------------------------------------------------------------
of_run("q32_components", lambda r: r.components)
of_run("group_numbers", lambda r: views.numbered_groups(r.groups))

# -- aggregates -----------------------------------------------------------------------------
of_run("q33_statement_aggregate", lambda r: r.group_totals.filter("statement_rows > 0").select(
    "gid", "statement_sum", "statement_rows", "statement_first", "statement_last", "statement_docs"))
of_run("q34_ledger_aggregate", lambda r: r.group_totals.filter("ledger_rows > 0").select(
    "gid", "ledger_sum", "ledger_rows", "ledger_first", "ledger_last", "ledger_kinds", "ledger_creators", "by_bot", "has_void",
    "has_refund", "ledger_txns"))
of_run("q35_repeated_debits", lambda r: repeated_debits(r.ledger, r.config))
of_run("q36_journal_aggregate", lambda r: r.group_totals.filter("journal_rows + journal_copies > 0").select(
    "gid", F.round("journal_sum", 4).alias("journal_sum"), "journal_rows", "journal_unread", "journal_foreign", "journal_kinds",
    "employees", "journal_issue", "journal_copies"))
of_run("q37_group_tickets", lambda r: r.group_tickets.select("gid", "agent", "ticket"))
of_run("q38_residuals", lambda r: r.group_totals.select("gid", "agent", "tickets", "ticket_count", "residual"))
of_run("q39_statement_table", lambda r: r.acts.select("agent", "period_start", "period_end", "opening", "closing", "mv", "rows", "version"))


def _value_counts(r: Result) -> DataFrame:
    # Features come first: they make groups and payments at the same time.
    labels = r.features.groupBy(F.concat(F.lit("label "), "label").alias("status")).agg(F.count("*").alias("n"))
    groups, payments = (t.groupBy("status").agg(F.count("*").alias("n")) for t in (r.groups, r.payments))
    return groups.unionByName(payments).unionByName(labels)


of_run("q40_value_counts", _value_counts)
of_run("q41_status_pivot", lambda r: status_counts(r.groups, GROUP_STATUSES))
of_run("q42_distinct_agreements", lambda r: r.ledger.groupBy("agent").agg(F.count_distinct("agreement_id").alias("agreements")))


def _given_score(r: Result) -> DataFrame:
    """Operations with a score that any engine can compute: a digit-based p_error."""
    return r.features.select("txn_id", "agent", "amount", "is_err", ((F.col("txn_id") % 97) / 97.0).alias("p_error"))


of_run("q43_agent_risk", lambda r: risk.risk_by_agent(_given_score(r)).select(
    "agent", "operations", F.round("expected_errors", 6).alias("expected_errors"), F.round("mean_p_error", 6).alias("mean_p_error"),
    "flagged", "risky_turnover"))
of_run("q44_lag_quantiles", lambda r: r.groups.filter("status = 'OK'").agg(
    F.percentile("lag_days", F.lit(0.5)).alias("median"), F.percentile("lag_days", F.lit(0.95)).alias("p95")))


@query("q44_sketched_quantiles")
def _sketched(spark, folder):
    """Quantiles of amounts from mergeable sketches, and whether their true ranks are within the stated bound."""
    k, rows = 800, table(spark, folder, "lineitem").select("l_extendedprice", "l_suppkey")
    found = evaluate.sketched_quantiles(rows, "l_extendedprice", [0.5, 0.95], ["l_suppkey"], k)
    # Two rows.
    a, b = (found.filter(F.col("share") == p).select("quantile").scalar() for p in (0.5, 0.95))
    ranks = rows.agg(F.avg((F.col("l_extendedprice") < a).cast("double")).alias("a"), F.avg((F.col("l_extendedprice") <= a).cast("double")).alias("a2"),
                     F.avg((F.col("l_extendedprice") < b).cast("double")).alias("b"), F.avg((F.col("l_extendedprice") <= b).cast("double")).alias("b2"))
    each = ranks.select(F.explode(F.array(
        F.struct(F.lit(0.5).alias("share"), F.col("a").alias("low"), F.col("a2").alias("high")),
        F.struct(F.lit(0.95).alias("share"), F.col("b").alias("low"), F.col("b2").alias("high")))).alias("r")).select("r.*")
    off = F.greatest(F.lit(0.0), F.col("low") - F.col("share"), F.col("share") - F.col("high"))
    return found.join(each, "share").select("share", "n", (off <= evaluate.rank_error(k)).alias("within"))


of_run("q45_headline", lambda r: views.headline(r).withColumn("value", F.round("value", 6)))
of_run("q46_totals", lambda r: views.with_total(r.bridge, "agent", ("gap_close", "opening_gap", "unexplained")))


# -- the paths that only large or lopsided data takes --------------------------------------------
for _name, _build in {
    "forced_components": lambda r: r.components,
    "forced_votes": lambda r: r.votes.ticket_agent,
    "forced_groups": lambda r: r.group_totals.drop("statement_docs", "ledger_txns"),
    "forced_payments": lambda r: r.payments,
    "forced_bridge": lambda r: r.bridge,
}.items():
    query(_name)(lambda spark, folder, build=_build: build(forced_run_of(spark, folder)))


# -- payments -------------------------------------------------------------------------------
@query("q47_dense_matching")
def _dense(spark, folder):
    """One-to-one matching on a crowded fixture."""
    pay, receipts = derived.dense_payments(derived.read_orders(spark, folder))
    return matching.match_one_to_one(
        pay.select(F.col("txn_id").alias("id"), "agent", "amount", F.to_date("ts").alias("day"),
                   micros(F.col("ts")).alias("o1"), F.col("txn_id").alias("o2")),
        receipts.select(F.col("line_no").alias("id"), "agent", "amount", F.col("doc_date").alias("day"), F.col("line_no").alias("o1")),
        mode=matching.NEAREST, tolerance="1", days=7, turn=["o1", "o2"], place=["o1"],
        island_rows=DEFAULT.island_rows, hot_rows=DEFAULT.hot_rows)


of_run("q47_payment_matches", lambda r: r.payment_match.payments.filter(F.col("matched_line").isNotNull()).select("txn_id", "matched_line"))
of_run("q48_hours_since_same", lambda r: payment_ops.with_hours_since_same(
    payment_ops.payment_rows(r.ledger_inside, r.config)).select("txn_id", F.round("hours_since_same", 6).alias("hours_since_same")))
of_run("q48_null_amounts", lambda r: payment_ops.with_hours_since_same(
    payment_ops.payment_rows(r.ledger_inside, r.config).withColumn("amount", F.when(F.col("txn_id") % 7 != 0, F.col("amount")))).select(
    "txn_id", F.round("hours_since_same", 6).alias("hours_since_same")))
of_run("q49_unmatched_payments", lambda r: payment_ops.unmatched_payments(r.payment_match, r.missing, r.config).select(
    "agent", "txn_id", "amount", "status"))
of_run("q50_wrong_agent", lambda r: r.payments.filter("status = 'PAYMENT_WRONG_AGENT'").select("agent", "found_in", "reference", "amount", "gap_effect"))
of_run("q51_payment_exceptions", lambda r: r.payments)

# -- balances -------------------------------------------------------------------------------
of_run("q52_chain_breaks", lambda r: r.chain_breaks)
of_run("q52_chain_totals", lambda r: r.openings)
of_run("q53_statement_continuity", lambda r: r.acts)
of_run("q54_missing_months", lambda r: r.missing)
of_run("q54_agent_windows", lambda r: r.windows)
of_run("q55_best_version", lambda r: r.statement_versions.groupBy("folder", "period_start").agg(F.max("version_rank").alias("best")))
of_run("q56_prior_same_ticket", lambda r: r.features.select("txn_id", "prior_same_ticket"))
of_run("q57_hours_since_payment", lambda r: r.features.select("txn_id", F.round("hours_since_same", 6).alias("hours_since_same")))
of_run("q58_error_history", lambda r: features.error_history(r.features).withColumn("prior_error_rate", F.round("prior_error_rate", 9)))


@query("ordered_scan_null_keys")
def _null_keys(spark, folder):
    """Rows without a key are one key of their own, however the rows are cut."""
    rows = table(spark, folder, "events").select(
        "event_id", F.when(F.col("event_id") % 5 != 0, F.col("user_id") % 3).alias("key"), "ts", "value")
    scanned = ordered_scan(rows, ["key"], ["ts", "event_id"], previous={"before": F.col("ts")},
                           totals={"running": F.col("value").cast("decimal(18,2)")}, number="n", chunks=16)
    return scanned.select("event_id", "key", "n", "running", (micros(F.col("ts")) - micros(F.col("before"))).alias("gap_micros"))


@query("chain_on_events")
def _events(spark, folder):
    """Gaps between a user's events: the ordered scan on a stream-like table."""
    rows = table(spark, folder, "events").select("event_id", "user_id", "ts", "value")
    scanned = ordered_scan(rows, ["user_id"], ["ts", "event_id"], previous={"before": F.col("ts")},
                           totals={"running": F.col("value").cast("decimal(18,2)")}, number="n")
    return scanned.select("event_id", "user_id", "n", "running", (micros(F.col("ts")) - micros(F.col("before"))).alias("gap_micros"))


# -- verdicts, bridge, checks ---------------------------------------------------------------
of_run("q60_classify", lambda r: r.groups.select(
    "gid", "agent", "rule", "status", "error_source", "confidence", "fix_side", "gap_effect", "amount_pattern", "lag_days"))
of_run("q61_monthly_identity", lambda r: r.monthly)
of_run("q62_agent_bridge", lambda r: r.bridge)
of_run("q64_agent_actions", lambda r: r.actions.drop("recommended_action"))
of_run("q65_recommendations", lambda r: r.actions.select("agent", "recommended_action"))
of_run("q66_checks", lambda r: r.checks)

# -- learning -------------------------------------------------------------------------------
of_run("q67_labels", lambda r: r.features.select("txn_id", "label", "is_err"))
of_run("q68_features", lambda r: r.features.drop("gid", "label", "is_err").withColumns({
    "log_amount": F.round("log_amount", 6), "hours_since_same": F.round("hours_since_same", 6),
    "prior_error_rate": F.round("prior_error_rate", 9)}))
of_run("q69_balanced_weights", lambda r: features.balanced_weights(r.features).withColumn("weight", F.round("weight", 9)))


@query("q70_category_codes")
def _codes(spark, folder):
    return model.category_codes(run_of(spark, folder).features)


@query("q71_scores")
def _scores(spark, folder):
    return model_of(spark, folder).folds[0].scored.select("txn_id", "agent", "label", "predicted", F.round("p_error", 6).alias("p_error"))


@query("q71_boosted_scores")
def _boosted_scores(spark, folder):
    return model_of(spark, folder, model.BOOSTING).folds[0].scored.select(
        "txn_id", "agent", "label", "predicted", F.round("p_error", 6).alias("p_error"))


@query("q71_saved_model")
def _saved_model(spark, folder):
    """How many scores of a model that was saved and read again differ from its own; none should."""
    out = None
    for learner in (model.FOREST, model.BOOSTING):
        fold = model_of(spark, folder, learner).folds[0]
        where = f"{shared_folder(spark)}/model-{learner}-{_slug(folder)}"
        fold.classifier.save(where)
        own = fold.scored.select("txn_id", F.col("p_error").alias("own"), F.col("predicted").alias("own_class"))
        again = model.Classifier.load(spark, where).read(fold.scored.drop("p_error", "predicted", *[f"{c}_code" for c in features.CATEGORICAL]))
        one = again.join(own, "txn_id", "full").agg(
            F.lit(learner).alias("learner"),
            F.count_if(~(F.col("p_error").eqNullSafe(F.col("own")) & F.col("predicted").eqNullSafe(F.col("own_class")))).alias("different"))
        out = one if out is None else out.unionByName(one)
    return out


@query("q72_fold_metrics")
def _fold_metrics(spark, folder):
    return model_of(spark, folder).metrics


@query("q72_boosted_metrics")
def _boosted_metrics(spark, folder):
    return model_of(spark, folder, model.BOOSTING).metrics


@query("q72_given_predictions")
def _given_predictions(spark, folder):
    """All measures of a test period, for predictions that any engine can compute."""
    return evaluate.measures(_judged(spark, folder), "score", "bad", "label", "guess", "length", "doc_id")


@query("q78_permutation_importance")
def _importance(spark, folder):
    return model.permutation_importance(model_of(spark, folder).folds[0])


@query("q78_given_scores")
def _given_importance(spark, folder):
    """What shuffling each of three columns costs a score that any engine can compute."""
    rows = _judged(spark, folder).select("doc_id", "bad", "score", F.floor("length").alias("length"), (F.col("doc_id") % 13).alias("digit"))
    return model.shuffled_loss(
        rows, {c: c for c in ("score", "length", "digit")}, lambda r: r.withColumn("sum", F.col("score") + F.col("length") + 2 * F.col("digit")),
        "sum", "bad", "doc_id")


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents with two scores and a guess that any engine can compute."""
    docs = table(spark, folder, "documents").select("doc_id", "n_chars", "source")
    rows = table(spark, folder, "labels").join(docs, "doc_id")
    guess = F.element_at(F.array(*[F.lit(c) for c in ("OK", "OK", "BOT", "STATEMENT", "AGENT")]), (F.col("n_chars") % 5 + 1).cast("int"))
    truth = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), F.when(F.col("doc_id") % 11 == 0, "AGENT").otherwise("OK")) \
        .when(F.col("toxic") == 1, "BOT").otherwise("REVIEW")
    return rows.select("doc_id", (1 - F.col("quality")).alias("bad"), (F.col("n_chars") % 50).cast("double").alias("score"),
                       (F.col("n_chars") / 100.0).alias("length"), truth.alias("label"), guess.alias("guess"), "source")


@query("q73_class_metrics")
def _class_metrics(spark, folder):
    return evaluate.per_class(evaluate.confusion(_judged(spark, folder), "label", "guess"))


@query("q73_class_summary")
def _class_summary(spark, folder):
    return evaluate.class_summary(evaluate.confusion(_judged(spark, folder), "label", "guess"))


@query("q74_average_precision")
def _ap(spark, folder):
    return evaluate.average_precision(_judged(spark, folder), "score", "bad")


@query("q75_roc_auc")
def _auc(spark, folder):
    return evaluate.roc_auc(_judged(spark, folder), "score", "bad")


@query("q76_top_share")
def _top(spark, folder):
    return evaluate.at_top(_judged(spark, folder), "score", "bad", "doc_id")


@query("q77_baseline")
def _baseline(spark, folder):
    rows = _judged(spark, folder)
    ap = evaluate.average_precision(rows, "length", "bad")
    return rows.agg(ap.select("average_precision").scalar().alias("baseline"), F.avg("bad").alias("random"))


@query("q78_shuffled_column")
def _shuffled(spark, folder):
    """One column permuted by a digest of the ids."""
    return evaluate.shuffled_column(_judged(spark, folder).select("doc_id", "score", "bad"), "score", "doc_id")


@query("q79_wilson")
def _wilson(spark, folder):
    counts = _judged(spark, folder).groupBy("source").agg(F.sum("bad").alias("k"), F.count("*").alias("n"))
    low, high = wilson(F.col("k"), F.col("n"))
    return counts.select("source", "k", "n", low.alias("low"), high.alias("high"))


of_run("q80_employee_risk", lambda r: r.employee_risk.select(
    "employee", "errors", "rows", "error_rate", "ci95_low", "ci95_high"))
of_run("q81_chi_square", lambda r: risk.homogeneity(risk.error_counts(
    risk.journal_errors(r.journal, r.groups, r.config), "employee")).select("statistic", "dof"))
of_run("q81_significance", lambda r: r.employee_risk.select("employee", "chi2_p_value", "significant"))

# -- views ----------------------------------------------------------------------------------
of_run("q82_agent_balances", views.agent_balances)
of_run("q83_discrepancies", lambda r: views.discrepancies(r).drop("recommendation"))
of_run("q83_group_sheet", lambda r: views.group_sheet(r).drop("explanation"))
of_run("q83_payment_sheet", views.payment_sheet)
of_run("q84_anomalies", lambda r: views.anomalies(r).drop("details"))
of_run("q85_risk_ranking", lambda r: views.risk_ranking(_given_score(r)))
of_run("q86_kpi_card", views.kpi_card)
of_run("q86_kpi_quality", lambda r: views.kpi_card(r, evaluate.roc_auc(_given_score(r), "p_error", "is_err")).filter("name = 'roc_auc'"))
of_run("q87_bridge_sheet", views.bridge_sheet)
of_run("q87_agent_sheet", views.agent_sheet)
of_run("q88_break_list", views.break_list)
of_run("q90_exemplars", views.exemplars)
of_run("summary_table", lambda r: views.summary(r).withColumn("value", F.round("value", 6)))


@query("q89_transposed_metrics")
def _transposed(spark, folder):
    """Per-class measures turned round: one row per measure, one column per class."""
    cells = evaluate.confusion(_judged(spark, folder), "label", "guess")
    return views.transposed(evaluate.per_class(cells).drop("position"), "class", list(CLASSES))
