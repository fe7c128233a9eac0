"""What is stored, scanned and gathered: no more than the results need, and the results of the rules read literally."""

from types import SimpleNamespace

from pyspark.sql import functions as F

from triledger import catalog
from triledger.config import DEFAULT
from triledger.operators import features, groups
from triledger.operators.durable import durable, known_rows, recorded
from triledger.plans.reconcile import reconcile
from triledger.sources import derived
from triledger.sources.derived import Sources


def test_rows_that_a_broadcast_leaves_out_are_not_stored_again(spark):
    orders = spark.range(400).select(
        F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey"), (1_000 + F.col("id")).cast("double").alias("o_totalprice"),
        F.date_add(F.lit("1997-03-01").cast("date"), (F.col("id") % 90).cast("int")).alias("o_orderdate"))
    raw = derived.statements(orders), derived.ledger(orders), derived.journal(orders)
    r = reconcile(Sources(*raw))
    versions = r.statement_versions
    with recorded() as made:
        latest = r.latest
    # The best version of each folder and period, and no copy of the lines.
    assert len(made) == 1 and 0 < latest.count() <= known_rows(latest) == known_rows(versions)
    ledger = r.ledger_prepared
    r.__dict__["windows"] = durable(spark.sql("select 'Agent 01' agent, date'1997-03-10' window_start, date'1997-04-10' window_end"))
    with recorded() as made:
        inside = r.ledger_inside
    own = ledger.filter("agent = 'Agent 01' and day between date'1997-03-10' and date'1997-04-10'")
    assert made == [] and 0 < inside.count() == own.count() and inside.exceptAll(own).isEmpty()


def test_only_payments_and_rows_with_a_ticket_are_scanned(spark, monkeypatch):
    rows = spark.range(240).select(
        F.when(F.col("id") % 11 != 0, F.concat(F.lit("A"), (F.col("id") % 3).cast("string"))).alias("agent"),
        F.lit("x").alias("agreement_id"), F.col("id").alias("txn_id"), F.lit("1997-03").alias("month"),
        F.expr("timestamp_ntz'1997-03-01 00:00:00' + make_dt_interval(0, cast(id / 2 as int))").alias("ts"),
        F.when(F.col("id") % 13 == 0, F.lit(None)).when(F.col("id") % 5 == 0, DEFAULT.words.payment).otherwise(DEFAULT.words.purchase).alias("kind"),
        F.when(F.col("id") % 10 != 1, F.concat(F.lit("T"), (F.col("id") % 4).cast("string"))).alias("ticket_text"),
        F.when(F.col("id") % 7 != 0, (F.col("id") % 2).cast("decimal(18,2)")).alias("amount"),
        F.lit("bot").alias("creator"), F.lit("KGS").alias("currency"), F.lit("g").alias("gid"))
    # Payments have tickets where their number is even: some rows are in both scans, some in none.
    named = F.col("ticket_text").isNotNull() & ~((F.col("txn_id") % 10 == 5))
    rows = rows.withColumn("ticket_text", F.when(named, F.col("ticket_text"))).withColumn(
        "tickets", F.when(named, F.array("ticket_text")).otherwise(F.array().cast("array<string>")))
    ledger = durable(rows)
    seen, whole = [], features.ordered_scan
    monkeypatch.setattr(features, "ordered_scan", lambda r, *a, **k: seen.append(r.count()) or whole(r, *a, **k))
    verdicts = spark.sql("select 'g' gid, 'OK' error_source")
    nothing = spark.sql("select 'LEDGER' found_in, 1L txn_id, 'BOT' error_source").limit(0)
    journal = spark.createDataFrame([], "agent string, employee string, row_no long, tickets array<string>")
    got = {r.txn_id: r for r in features.build_features(ledger, verdicts, nothing, journal, DEFAULT).collect()}
    data = sorted(ledger.collect(), key=lambda r: (r.ts, r.txn_id))
    paid = [r for r in data if r.kind == DEFAULT.words.payment]
    assert seen == [len(paid), sum(bool(r.tickets) for r in data)] and sum(seen) < 1.2 * len(data)
    assert sorted(got) == sorted(r.txn_id for r in data)
    for i, r in enumerate(data):
        earlier = sum((o.agent, o.ticket_text) == (r.agent, r.ticket_text) for o in data[:i]) if r.tickets else 0
        assert got[r.txn_id].prior_same_ticket == earlier
        same = [o.ts for o in data[:i] if r in paid and o in paid and (o.agent, o.amount) == (r.agent, r.amount)]
        known = same and r.agent is not None and r.amount is not None
        assert abs(got[r.txn_id].hours_since_same - ((r.ts - same[-1]).total_seconds() / 3600 if known else features.NO_EARLIER_PAYMENT)) < 1e-9


def test_the_texts_of_a_group_are_gathered_as_one_set(spark):
    statements = spark.sql("select 'g1' gid, 'sale' line_kind, cast(1 as decimal(18,2)) mv, date'1997-03-01' doc_date")
    ledger = spark.createDataFrame(
        [("g1", "sale", "b"), ("g1", "void", "a"), ("g1", "sale", "a"), ("g1", None, "a"), ("g2", "sale", None), ("g2", "", "")],
        "gid string, kind string, creator string").selectExpr(
        "*", "cast(2 as decimal(18,2)) amount", "date'1997-03-01' day", "timestamp_ntz'1997-03-01 00:00:00' ts")
    journal = spark.createDataFrame(
        [("g1", "sale", "z", "", False), ("g1", "sale", "y", "B", False), ("g1", "refund", "y", "A", False), ("g1", "copy", "x", "C", True),
         ("g3", None, None, None, False)],
        "gid string, kind string, employee string, amount_issue string, is_copy boolean").selectExpr(
        "*", "cast(3 as decimal(30,8)) amount", "false is_foreign")
    totals = groups.source_totals(statements, ledger, journal, DEFAULT)
    got = {r.gid: (r.ledger_kinds, r.ledger_creators, r.journal_kinds, r.employees, r.journal_issue) for r in totals.collect()}
    assert got == {"g1": ("sale|void", "a|b", "refund|sale", "y|z", "A|B"), "g2": ("|sale", "", "", "", ""), "g3": ("", "", "", "", "")}
    assert totals.columns[9:12] == ["ledger_kinds", "ledger_creators", "by_bot"] and totals.columns[18:21] == [
        "journal_kinds", "employees", "journal_issue"]
    plan = totals._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_set") == 1


def test_the_round_trip_writes_no_stored_table_again(spark, tmp_path, monkeypatch):
    run = SimpleNamespace(compute=lambda: run)
    tables = {"stored": durable(spark.range(7)), "planned": spark.range(5)}
    given = []
    monkeypatch.setattr(catalog, "run_of", lambda *a: run)
    monkeypatch.setattr(catalog, "result_tables", lambda r: tables)
    monkeypatch.setattr(catalog, "durable", lambda df: given.append(df) or durable(df))
    got = catalog.QUERIES["sink_round_trip"](spark, str(tmp_path)).collect()
    assert not any(df is tables["stored"] for df in given) and any(df is tables["planned"] for df in given)
    assert len(got) == 6 and all(r.same and r.rows == {"stored": 7, "planned": 5}[r.table_name] for r in got)


def test_rows_with_a_group_carry_what_is_read_of_them(spark):
    orders = spark.range(400).select(
        F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey"), (1_000 + F.col("id")).cast("double").alias("o_totalprice"),
        F.date_add(F.lit("1997-03-01").cast("date"), (F.col("id") % 90).cast("int")).alias("o_orderdate"))
    r = reconcile(Sources(derived.statements(orders), derived.ledger(orders), derived.journal(orders)))
    for rows, whole, unread in (
            (r.statements_grouped, r.statements, {"invoice", "pax", "ticket_text", "debit", "credit", "opening", "closing"}),
            (r.ledger, r.ledger_inside, {"balance_after", "amount_orig", "comment"}),
            (r.journal, r.journal_prepared, {"date_text", "ticket_text", "pax", "pnr", "airline", "route", "pay_cell", "rate_usd", "rate_rub"})):
        assert unread <= set(whole.columns) and not unread & set(rows.columns) and known_rows(rows) == whole.count() > 0
