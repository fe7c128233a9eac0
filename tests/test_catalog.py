"""Queries over several tables of a run let it make independent tables at the same time."""

from types import SimpleNamespace

from triledger import catalog


def test_value_counts_ask_for_features_first(spark):
    asked = []

    class Run:
        def __getattr__(self, name):
            asked.append(name)
            return spark.createDataFrame([("x", "OK"), ("x", "BOT")], "status string, label string")

    rows = sorted(tuple(r) for r in catalog._value_counts(Run()).collect())
    assert rows == [("label BOT", 1), ("label OK", 1), ("x", 2), ("x", 2)]
    # `Result.features` makes groups and payments beside each other; the other way round they follow each other.
    assert asked[0] == "features" and set(asked) == {"features", "groups", "payments"}


def test_sink_tables_are_made_side_by_side(spark, tmp_path, monkeypatch):
    computed = []

    def compute():
        computed.append(True)
        return run

    run = SimpleNamespace(compute=compute)
    monkeypatch.setattr(catalog, "run_of", lambda spark, folder: run)
    monkeypatch.setattr(catalog, "result_tables", lambda r: {"a": spark.range(3), "b": spark.range(5)})
    rows = catalog.QUERIES["sink_tables"](spark, str(tmp_path)).collect()
    assert computed == [True] and sorted(tuple(r) for r in rows) == [("a", 3), ("b", 5)]
