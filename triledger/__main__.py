"""Command line: reconcile three files and write all tables.

    spark-submit --py-files triledger.zip triledger/__main__.py --statements S --ledger L --journal J --output OUT
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from triledger.config import Config
from triledger.operators.model import Settings
from triledger.plans.learn import learn
from triledger.plans.reconcile import reconcile
from triledger.plans.store import Store
from triledger.sources.files import load_sources
from triledger.sources.sinks import model_tables, report_tables, result_tables, write_tables
from triledger.vocabulary import ENGLISH, RUSSIAN


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Reconcile statements, a ledger and a journal.")
    for kind in ("statements", "ledger", "journal", "output"):
        parser.add_argument(f"--{kind}", required=True)
    parser.add_argument("--words", choices=("russian", "english"), default="russian")
    parser.add_argument("--format", choices=("parquet", "csv"), default="csv")
    parser.add_argument("--rounds", type=int, default=Settings().rounds, help="trees of the model; 0 skips it")
    parser.add_argument("--results", help="folder of the results that later runs over the same files reuse")
    args = parser.parse_args(argv)

    spark = SparkSession.builder.appName("triledger").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    files = {k: getattr(args, k) for k in ("statements", "ledger", "journal")}
    config = Config(words=RUSSIAN if args.words == "russian" else ENGLISH)
    if args.results:
        result, _ = Store(spark, args.results).result("files", sorted(files.values()), config, lambda: load_sources(spark, files))
    else:
        result = reconcile(load_sources(spark, files), config)
    write_tables(result_tables(result), args.output, args.format)
    trained = None
    if args.rounds:
        trained = learn(result.features, Settings(rounds=args.rounds))
        write_tables(model_tables(trained), args.output, args.format)
    write_tables(report_tables(result, trained), f"{args.output}/report", "json")


if __name__ == "__main__":
    main()
