"""Small hand-made cases through the whole reconciliation, from CSV files with exported column names."""

import csv
from decimal import Decimal

import pytest

from pyspark.sql import functions as F

from triledger import Config, reconcile
from triledger.operators.features import NUMERIC
from triledger.plans import views
from triledger.sources.files import JOURNAL_FILE, LEDGER_FILE, STATEMENT_FILE, load_sources
from triledger.sources.sinks import report_tables, result_tables, write_tables
from triledger.vocabulary import COMPONENTS, RUSSIAN

AGENT = "Agent A"


def write(path, columns, rows):
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.DictWriter(f, fieldnames=list(columns))
        out.writeheader()
        out.writerows(rows)
    return str(path)


def statement(date, doc, tickets, debit="", credit="", **other):
    return {"folder": AGENT, "period_start": "2026-03-01", "period_end": "2026-03-31", "act_status": "", "saldo_start": 0, "saldo_end": 700,
            "date": date, "doc": doc, "invoice": doc[-2:], "pax": "", "ticket_cell": tickets, "debet": debit, "credit": credit, **other}


def journal(date, party, tickets, cell, **other):
    return {"date": date, "employee": "e1", "kind": RUSSIAN.journal_sale, "party": party, "tickets": tickets, "pay_cell": cell,
            "rate_usd": 88, "rate_eur": 94, "rate_rub": 1, "rate_kzt": 0.17, **other}


def ledger(entries, agent=AGENT, first=500, balance=0):
    rows = []
    for i, (date, kind, tickets, amount, creator) in enumerate(entries):
        balance += amount
        rows.append({"agent": agent, "agreement_id": "D-1", "txn_id": first + i, "date": date, "kind": kind, "tickets": tickets,
                     "amount": amount, "currency": "KGS", "amount_kgs": amount, "balance_after": balance, "creator": creator, "comment": ""})
    return rows


def base_case():
    w = RUSSIAN
    return {
        "statements": [
            statement("2026-03-04", "Реализация AA", "2000000001 2000000002", debit=4200),
            statement("2026-03-05", "Реализация BB", "2000000003", debit=900),
            statement("2026-03-06", "Реализация CC", "2000000004", debit=600),
            statement("2026-03-12", "Поступление DD", "", credit=5000),
        ],
        "ledger": ledger([
            ("2026-03-04 08:00:00", w.purchase, "2000000001", -2100, w.bot), ("2026-03-04 08:00:01", w.purchase, "376-2000000002", -2100, w.bot),
            ("2026-03-05 09:00:00", w.purchase, "2000000003", -900, w.bot), ("2026-03-05 09:04:00", w.purchase, "2000000003", -900, w.bot),
            ("2026-03-06 10:00:00", w.purchase, "2000000004", -750, w.bot), ("2026-03-11 23:30:00", w.payment, "", 5000, w.bot)]),
        "journal": [
            journal("04.03.2026", AGENT, "2000000001 2000000002", "4 200 kgs"), journal("05.03.2026", AGENT, "2000000003", "900 kgs"),
            journal("06.03.2026", AGENT, "2000000004", "750 kgs"), journal("07.03.2026", "ОсОО Прямой", "8888888888", "640 kgs"),
        ],
    }


COLUMNS = {"statements": STATEMENT_FILE, "ledger": LEDGER_FILE, "journal": JOURNAL_FILE}


def run(spark, folder, case):
    paths = {k: write(folder / f"{k}.csv", COLUMNS[k], rows) for k, rows in case.items()}
    return reconcile(load_sources(spark, paths), Config(words=RUSSIAN))


def by_tickets(r):
    return {g.tickets: g for g in r.groups.collect()}


def test_orders_payments_and_bridge(spark, tmp_path):
    r = run(spark, tmp_path, base_case())
    groups = by_tickets(r)
    assert groups["2000000001|2000000002"].status == "OK"
    assert groups["2000000003"].status == "DOUBLE_DEBIT"
    residual = groups["2000000004"]
    assert (residual.status, residual.error_source, residual.confidence) == ("AMOUNT_RESIDUAL", "STATEMENT", "A")
    assert groups["8888888888"].status == "DIRECT_CLIENT" and groups["8888888888"].agent == "DIRECT_CLIENT"
    assert r.payments.count() == 0
    b = r.bridge.first()
    assert b.gap_close == Decimal("-1050.00")
    assert (b.double_debit, b.residual_statement, b.unexplained) == (Decimal("-900"), Decimal("-150"), 0)
    a = r.actions.first()
    assert (a.ledger_adjust, a.statement_adjust, a.check_after_fixes) == (Decimal("900"), Decimal("150"), 0)
    assert "double debit: 1" in a.recommended_action
    checks = {c.check: c.value for c in r.checks.collect()}
    assert len(checks) == 11 and checks["bridge_max_unexplained"] == 0 and checks["monthly_identity_max"] == 0
    out = tmp_path / "out"
    write_tables(result_tables(r), str(out), "csv")
    write_tables(report_tables(r), str(out / "report"), "json")
    assert spark.read.json(str(out / "report" / "kpi")).count() == 7
    assert spark.read.option("header", True).csv(str(out / "groups")).count() == 4


def test_repeated_journal_row(spark, tmp_path):
    case = base_case()
    case["journal"].append(dict(case["journal"][0]))
    r = run(spark, tmp_path, case)
    g = by_tickets(r)["2000000001|2000000002"]
    assert (g.status, g.journal_sum, g.journal_copies) == ("JOURNAL_DUPLICATE", Decimal("4200"), 1)
    assert r.bridge.first().unexplained == 0


def test_latest_version_and_difference(spark, tmp_path):
    case = base_case()
    fresh = [statement("2026-03-04", "Реализация AA", "2000000001", debit=100, act_status=RUSSIAN.draft, saldo_end=100),
             statement("2026-03-04", "Реализация AA", "2000000001", debit=100, act_status=RUSSIAN.reissued, saldo_end=150),
             statement("2026-03-05", "Реализация ZZ", "2000000001", debit=50, act_status=RUSSIAN.reissued, saldo_end=150)]
    r = run(spark, tmp_path, {**case, "statements": fresh})
    assert [x.version for x in r.latest.collect()] == [RUSSIAN.reissued] * 2
    d = r.versions.first()
    assert (d.closing_delta, d.rows_only_in_reissued, d.rows_only_in_draft) == (50, 1, 0)
    assert (d.draft_check, d.reissued_check) == (0, 0)


def test_payment_distance_and_agents(spark, tmp_path):
    w = RUSSIAN
    case = base_case()
    # A payment to one agent, the receipt booked ten days later to another; both have statements.
    case["ledger"] += ledger([("2026-03-05 12:00:00", w.payment, "", 333, w.bot)], agent="Agent B", first=900)
    case["statements"] += [
        statement("2026-03-15", "Поступление EE", "", credit=333),
        statement("2026-03-02", "Реализация FF", "", debit=1, folder="agent b"),
        statement("2026-03-28", "Поступление GG", "", credit=77),
    ]
    r = run(spark, tmp_path, case)
    found = {(p.agent, p.found_in, p.status) for p in r.payments.collect()}
    assert found == {("Agent B", "LEDGER", "PAYMENT_WRONG_AGENT"), (AGENT, "STATEMENT", "PAYMENT_WRONG_AGENT"),
                     (AGENT, "STATEMENT", "PAYMENT_NOT_IN_LEDGER")}


def test_agent_without_ledger(spark, tmp_path):
    """An unmapped folder has no ledger: its opening balance is 0 and the bridge still closes."""
    case = base_case()
    case["statements"].append(statement("2026-03-20", "Реализация HH", "7777777777", debit=55, folder="Lost & Found", saldo_end=55))
    r = run(spark, tmp_path, case)
    b = {x.agent: x for x in r.bridge.collect()}["UNMAPPED:Lost & Found"]
    assert (b.gap_close, b.statement_only, b.unexplained) == (55, 55, 0)


def test_null_folder_is_left_out(spark, tmp_path):
    case = base_case()
    case["statements"].append(statement("2026-03-20", "Реализация II", "7777777771", debit=5, folder=""))
    assert run(spark, tmp_path, case).latest.count() == 4


def test_nineteen_components():
    assert len(COMPONENTS) == len(set(COMPONENTS)) == 19


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_result_does_not_depend_on_partitioning(spark, tmp_path, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        r = run(spark, tmp_path, base_case())
        assert sorted((g.gid, g.rule) for g in r.groups.collect()) == [
            ("Agent A|2000000001", 10), ("Agent A|2000000003", 11), ("Agent A|2000000004", 14), ("DIRECT_CLIENT|8888888888", 20)]
        assert views.numbered_groups(r.groups).count() == 4
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_command_line(spark, tmp_path):
    from triledger.__main__ import main

    paths = {k: write(tmp_path / f"{k}.csv", COLUMNS[k], rows) for k, rows in base_case().items()}
    main([x for k, v in paths.items() for x in (f"--{k}", v)] + ["--output", str(tmp_path / "out"), "--rounds", "0"])
    rows = spark.read.option("header", True).csv(str(tmp_path / "out" / "agent_actions")).collect()
    assert [(r.agent, r.ledger_adjust, r.status) for r in rows] == [(AGENT, "900.00", "ACTION_REQUIRED")]


def test_everything_at_once_equals_one_by_one(spark, tmp_path):
    r = run(spark, tmp_path, base_case()).compute()
    assert sorted(g.rule for g in r.groups.collect()) == [10, 11, 14, 20]
    assert r.features.filter("label = 'BOT'").count() == 2


def test_exported_ids_dates_and_columns(spark, tmp_path):
    """Ids with .0 behind them, days before months, and a journal column nobody knows."""
    case = base_case()
    for row in case["ledger"]:
        row["txn_id"] = f"{row['txn_id']}.0"
        row["date"] = f"{row['date'][8:10]}.{row['date'][5:7]}.{row['date'][:4]} {row['date'][11:16]}"
    for row in case["statements"]:
        row["date"] = f"{row['date'][8:10]}/{row['date'][5:7]}/{row['date'][:4]}"
    case["journal"].append(dict(case["journal"][0]))
    for i, row in enumerate(case["journal"]):
        row["remark"] = f"written on line {i}"
    paths = {k: write(tmp_path / f"{k}.csv", [*COLUMNS[k], *(["remark"] if k == "journal" else [])], rows) for k, rows in case.items()}
    sources = load_sources(spark, paths)
    assert [r["txn_id"] for r in sources.ledger.orderBy("txn_id").collect()] == list(range(500, 506))
    assert sources.ledger.filter("ts is null").count() == 0 and sources.statements.filter("doc_date is null").count() == 0
    assert [r["row_no"] for r in sources.journal.orderBy("row_no").collect()] == [1, 2, 3, 4, 5]
    r = reconcile(sources, Config(words=RUSSIAN))
    assert r.journal_prepared.filter("is_copy").count() == 0


def test_a_model_fills_the_reports(spark, tmp_path):
    from triledger.operators.model import Settings
    from triledger.plans.learn import learn

    rows = spark.range(400).select(
        (F.col("id") + 1).alias("txn_id"), F.concat(F.lit("a"), F.col("id") % 5).alias("agent"),
        F.concat(F.lit("2026-0"), F.col("id") % 4 + 1).alias("month"), F.lit(10).cast("decimal(18,2)").alias("amount"),
        F.when(F.col("id") % 7 == 0, "BOT").otherwise("OK").alias("label"), (F.col("id") % 7 == 0).cast("int").alias("is_err"),
        F.when(F.col("id") % 7 == 0, "k1").otherwise("k2").alias("kind"), F.lit("c").alias("creator"), F.lit(None).cast("string").alias("currency"),
        F.lit("e").alias("employee"), *[F.lit(1.0).alias(c) for c in NUMERIC])
    trained = learn(rows, Settings(rounds=5, leaf_rows=1))
    assert [(f.number, f.train_months[-1], f.test_months[-1], f.n_train) for f in trained.folds] == [(1, "2026-03", "2026-04", 300), (2, "2026-02", "2026-03", 200)]
    scored = trained.folds[0].scored
    assert scored.filter("p_error < 0 or p_error > 1 or predicted not in ('OK', 'BOT')").count() == 0
    r = run(spark, tmp_path, base_case())
    write_tables(report_tables(r, trained), str(tmp_path / "report"), "json")
    quality = {x["name"]: x.asDict().get("value") for x in spark.read.json(str(tmp_path / "report" / "kpi")).collect()}
    assert 0 <= quality["roc_auc"] <= 1
    assert spark.read.json(str(tmp_path / "report" / "risk")).count() == 5
