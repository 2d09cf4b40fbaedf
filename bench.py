"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

NAMES = ["BM2_wide_sheet", "A1_share", "A7_sumif", "A17_sumproduct", "J1_vlookup", "J2_approx", "J10_countif_le", "W2_moving", "W3_expanding", "W7_running", "P9_div_error"]


def main() -> None:
    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from gridspark.queries import QUERIES

    QUERIES["A1_share"](spark, d).write.format("noop").mode("overwrite").save()  # starts the engine
    took = {}
    for name in NAMES:
        best = None
        for _ in range(2):
            t = time.time()
            QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
            best = min(time.time() - t, best or 1e9)
        took[name] = round(best, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(d.rstrip("/"))}))


if __name__ == "__main__":
    main()
