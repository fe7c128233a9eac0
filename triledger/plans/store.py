"""Results kept between sessions, and reused while their inputs and settings are unchanged.

A reconciliation leaves its shared tables in the checkpoint folder.  The store keeps a manifest of them: what files they were
made from, with which settings, and where each table is.  A manifest whose inputs and settings are those at hand is read instead
of computing anything; it is written last, so half a result is never found.  When the inputs have changed, the result is computed
again and the tables of the old one are deleted, and so is everything that was only needed on the way.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields, is_dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from triledger.config import Config
from triledger.operators.durable import delete, durable, exists, file_states, known_rows, recorded, subfolders
from triledger.operators.payments import PaymentMatch
from triledger.operators.voting import Votes
from triledger.plans.reconcile import Result, reconcile
from triledger.sources.derived import Sources

# A store refuses what other versions of the rules have left.
VERSION = 2
# Every other table is planned from these.
TABLES = (
    "statement_versions", "ledger_prepared", "journal_prepared", "votes", "statements", "journal_owned", "windows", "missing",
    "components", "statements_grouped", "ledger", "journal", "group_tickets", "groups", "payment_match", "payments",
    "acts", "bridge", "features",
)
_COMPOSED = {"votes": Votes, "payment_match": PaymentMatch, "sources": Sources}


def _kept(table: DataFrame) -> DataFrame:
    return table if hasattr(table, "_path") else durable(table)


def _parts(name: str, value) -> Iterator[tuple[str, DataFrame]]:
    """The table, or the tables that it is composed of."""
    if is_dataclass(value):
        for f in fields(value):
            yield f"{name}.{f.name}", getattr(value, f.name)
    else:
        yield name, value


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    folder: str

    def result(self, name: str, inputs: list[str], config: Config, sources: Callable[[], Sources]) -> tuple[Result, bool]:
        """The reconciliation of the files in `inputs`, which `sources` reads, and whether it was found.

        `name` tells results of different inputs apart; of one name and one set of settings, the newest is kept.
        """
        settings = hashlib.sha256(repr((VERSION, config)).encode()).hexdigest()[:16]
        place, state = f"{self.folder}/{name}-{settings}", file_states(self.spark, *inputs)
        found = self._read(f"{place}/{state}", config)
        if found is not None:
            return found, True
        with recorded() as made:
            result = reconcile(sources(), config).compute()
            tables = {key: _kept(table) for attribute in ("sources", *TABLES)
                      for key, table in _parts(attribute, getattr(result, attribute))}
        # A manifest of the same files whose tables are not all there goes first.
        self.forget(f"{place}/{state}")
        stale = subfolders(self.spark, place)
        entries = {key: {"path": t._path, "rows": known_rows(t), "schema": t.schema.jsonValue()} for key, t in tables.items()}
        self.spark.createDataFrame([(json.dumps(entries),)], "value string").coalesce(1).write.mode("overwrite").text(f"{place}/{state}")
        delete(self.spark, *(set(made) - {e["path"] for e in entries.values()}))
        for old in stale:
            self.forget(old)
        return self._read(f"{place}/{state}", config), False

    def _entries(self, manifest: str) -> dict | None:
        if not exists(self.spark, f"{manifest}/_SUCCESS"):
            return None
        return json.loads(self.spark.read.text(manifest).first()[0])

    def _read(self, manifest: str, config: Config) -> Result | None:
        """The result of a manifest; none where it, or any of its tables, is not there."""
        entries = self._entries(manifest)
        if entries is None or not all(exists(self.spark, f"{e['path']}/_SUCCESS") for e in entries.values()):
            return None
        tables: dict = {}
        for key, e in entries.items():
            table = self.spark.read.schema(StructType.fromJson(e["schema"])).parquet(e["path"])
            table._path, table._known_rows, table._checksum = e["path"], e["rows"], None
            attribute, _, part = key.partition(".")
            if part:
                tables.setdefault(attribute, {})[part] = table
            else:
                tables[attribute] = table
        whole = {k: _COMPOSED[k](**v) if k in _COMPOSED else v for k, v in tables.items()}
        result = Result(whole.pop("sources"), config)
        # What a cached property holds once it has been asked for.
        result.__dict__.update(whole)
        return result

    def forget(self, manifest: str) -> None:
        """Delete a result: the manifest first, so that nobody finds a result without tables."""
        entries = self._entries(manifest) or {}
        delete(self.spark, manifest)
        delete(self.spark, *[e["path"] for e in entries.values()])
