"""Run the catalog against the SQL twins: python tests/run_catalog.py [sf] [name prefix...]"""

import sys
import time
import traceback

sys.path[:0] = ["/root/repo", "/root/repo/tests"]
import oracle  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
prefixes = tuple(sys.argv[2:])
spark = (
    SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
    .config("spark.driver.memory", "16g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
)
spark.sparkContext.setLogLevel("ERROR")
sf_dir = f"/root/testdata/sf{sf}"
con = oracle.connect(sf_dir)
failed = []
for name, fn in entry.queries().items():
    if prefixes and not name.startswith(prefixes):
        continue
    start = time.time()
    try:
        df = fn(spark, sf_dir)
        sql = entry.oracle_sql().get(name)
        verdict = oracle.compare(df, con, sql) if sql else f"rows only: {len(df.collect())}"
    except Exception as error:
        verdict = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        if "-v" in sys.argv:
            traceback.print_exc()
    if verdict and not verdict.startswith("rows only"):
        failed.append(name)
    print(f"{name:45s} {time.time() - start:6.1f}s {verdict or 'ok'}", flush=True)
print("FAILED", failed)
