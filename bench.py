"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        # A few megabytes are cut finely enough to keep all cores of one machine busy.
        .config("spark.sql.files.openCostInBytes", "262144")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "131072")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from triledger.catalog import QUERIES, forget, run_of

    spark.range(1000).selectExpr("sum(id)").collect()
    forget()
    started = time.perf_counter()
    run = run_of(spark, SF_DIR)
    deriving = time.perf_counter() - started
    parts = {
        # From the three raw tables to the bridge of every agent.
        "reconcile": lambda: run.compute(),
        # What is read off the tables it leaves behind.
        "monthly_identity": lambda: run.monthly.write.format("noop").mode("overwrite").save(),
        "actions": lambda: run.actions.write.format("noop").mode("overwrite").save(),
        "checks": lambda: run.checks.write.format("noop").mode("overwrite").save(),
        "features": lambda: run.features,
    }
    # Queries that stand on their own.
    alone = ["q03_extract_tickets", "q04_norm_text", "q23_balance_points", "q47_dense_matching", "q52_chain_breaks",
             "chain_on_events", "q74_average_precision", "q83_discrepancies", "q45_headline"]
    for name in alone:
        parts[name] = lambda n=name: QUERIES[n](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    seconds = {"derive_sources": round(deriving, 3)}
    for name, part in parts.items():
        started = time.perf_counter()
        part()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({
        "metric": "reconciliation_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
