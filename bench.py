"""Times the headline queries once after a warm-up; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from callscape.queries import QUERIES

sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
cpus = os.environ.get("BENCH_CPUS", "8")
spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
HEADLINE = ("dead_code", "in_degree", "hub_set", "callers_of", "complexity_hotspots", "search_functions", "ancestors_of", "reachable_from", "unreachable_from_entrypoints", "blast_radius_batch", "search_constants", "diff_codebases")
took = {}
for name in HEADLINE:
    query = QUERIES[name]
    query(spark, sf).write.format("noop").mode("overwrite").save()
    start = time.time()
    query(spark, sf).write.format("noop").mode("overwrite").save()
    took[name] = round(time.time() - start, 3)
print(json.dumps({"metric": "total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))
