import csv
import shutil

import pytest

from tests.test_end_to_end import COLUMNS, base_case, statement, write
from triledger import Config
from triledger.operators import durable
from triledger.operators.durable import exists
from triledger.plans import store as stores
from triledger.plans.store import Store
from triledger.sources.files import load_sources
from triledger.vocabulary import RUSSIAN


class Case:
    def __init__(self, spark, folder):
        self.spark, self.folder, self.built = spark, folder, 0
        self.paths = {k: write(folder / f"{k}.csv", COLUMNS[k], rows) for k, rows in base_case().items()}

    def sources(self):
        self.built += 1
        return load_sources(self.spark, self.paths)

    def result(self, config=Config(words=RUSSIAN)):
        return Store(self.spark, str(self.folder / "kept")).result("case", sorted(self.paths.values()), config, self.sources)


def contents(result):
    tables = {n: getattr(result, n) for n in ("groups", "payments", "bridge", "acts", "missing", "features", "mapping", "actions", "monthly", "employee_risk")}
    return {n: sorted(map(str, t.collect())) for n, t in tables.items()}


@pytest.fixture(scope="module")
def case(spark, tmp_path_factory):
    return Case(spark, tmp_path_factory.mktemp("case"))


def test_a_second_run_reads_what_the_first_has_left(spark, case, monkeypatch):
    first, found = case.result()
    assert not found and case.built == 1
    whole = contents(first)
    monkeypatch.setattr(stores, "reconcile", lambda *a: pytest.fail("computed again"))
    again, found = case.result()
    assert found and case.built == 1
    # The shared tables come from the manifest, with their row counts.
    monkeypatch.setattr(stores, "durable", lambda *a: pytest.fail("written again"))
    assert all(name in again.__dict__ for name in stores.TABLES)
    assert durable.known_rows(again.groups) == len(whole["groups"])
    monkeypatch.undo()
    assert contents(again) == whole


def test_changed_inputs_are_computed_again_and_old_tables_deleted(spark, case):
    before, _ = case.result()
    built = case.built
    rows = [*base_case()["statements"], statement("2026-03-20", "Реализация HH", "7777777777", debit=55, folder="Lost & Found", saldo_end=55)]
    with open(case.paths["statements"], "w", newline="", encoding="utf-8") as f:
        out = csv.DictWriter(f, fieldnames=list(COLUMNS["statements"]))
        out.writeheader()
        out.writerows(rows)
    after, found = case.result()
    assert not found and case.built == built + 1
    assert {r.agent for r in after.bridge.collect()} == {"Agent A", "UNMAPPED:Lost & Found"}
    assert not exists(spark, before.groups._path) and exists(spark, after.groups._path)
    assert case.result()[1]


def test_other_settings_are_another_result(case):
    usual, _ = case.result()
    built = case.built
    other, found = case.result(Config(words=RUSSIAN, amount_tolerance="100000"))
    assert not found and case.built == built + 1
    assert case.result()[1] and case.result(Config(words=RUSSIAN, amount_tolerance="100000"))[1]
    assert {r.status for r in other.groups.collect()} != {r.status for r in usual.groups.collect()}


def test_a_lost_table_is_made_again(case):
    kept, _ = case.result()
    shutil.rmtree(kept.payments._path.removeprefix("file:"))
    again, found = case.result()
    assert not found and again.payments.count() >= 0 and case.result()[1]
