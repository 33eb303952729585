"""Headline queries, timed: one JSON line on standard output.

The 22 decision-support queries, the scans, filters, aggregates, joins and sorts
in isolation, and the groups and joins of the data-frame benchmark run over the
Parquet files at BENCH_SF_DIR on local[BENCH_CPUS], text to collected rows, with
one engine. What suppliers offer, a base table of the original schema, is derived from the
line items once and stored (prepare_sec). A first round warms the JVM up; a query's time is the median of
three rounds after it. The value is the total of the 22.
"""

import json
import os
import sys
import time
from statistics import median

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from tessera.plans import inventory, tpch

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    engine = inventory.engine(spark, SF_DIR)
    others = {n: q for n, q in inventory.SQL.items() if n.startswith(("micro_", "h2o_"))}
    begun = time.perf_counter()
    engine.query_all(f"CREATE TABLE partsupp (ps_partkey BIGINT, ps_suppkey BIGINT, ps_supplycost DOUBLE, ps_availqty DOUBLE); INSERT INTO partsupp SELECT * FROM {tpch.OFFERS} AS o")
    prepared = round(time.perf_counter() - begun, 3)
    every = {n: q.replace(tpch.OFFERS, "partsupp") for n, q in tpch.QUERIES.items()} | others
    taken: dict[str, list[float]] = {n: [] for n in every}
    for measured in (False, True, True, True):
        for name, sql in every.items():
            begun = time.perf_counter()
            engine.query(sql).collect()
            if measured:
                taken[name].append(time.perf_counter() - begun)
    queries = {n: round(median(t), 4) for n, t in taken.items()}
    print(json.dumps({"metric": "tpch_22_total", "value": round(sum(queries[n] for n in tpch.QUERIES), 3), "unit": "sec", "prepare_sec": prepared, "queries": queries, "sf": os.path.basename(SF_DIR.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
