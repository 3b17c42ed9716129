"""Times the headline queries and prints one JSON line."""

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
NAMES = ["d8_plan", "a22_articles", "e2_played", "e21_weekly"]


def main() -> None:
    from readflow.plans.queries import Q

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda name: Q[name](spark, SF).write.format("noop").mode("overwrite").save()
    times = {}
    for name in NAMES:
        run(name)  # warm
        start = time.time()
        run(name)
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline queries, warm", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": SF}))


if __name__ == "__main__":
    main()
