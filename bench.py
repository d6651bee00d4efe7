"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from cohortry import build_session  # noqa: E402
from cohortry.catalog import QUERIES  # noqa: E402

HEADLINE = [
    "flagship_ratio_comparison",
    "j06_fact_dimension_join",
    "w01_latest_per_key",
    "a05_mean_by_two_keys",
    "a08_global_medians",
    "a10_modes_per_group",
    "w03_equal_frequency_bins",
    "h03_test_per_category",
    "e13_bin_means",
    "f02_population_scaling",
    "c01_prototype_step",
    "c01_c02_kprototypes_fit",
    "c12_a18_aggregated_importance",
    "m01_e02_forest",
    "e08_e09_a20_policy_what_if",
    "e10_tree_attribution",
    "e11_permutation_attribution",
    "study_two_groups_with_policies",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        spark__master=f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__driver__memory="20g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["a11_count_by_key"](spark, sf_dir).collect()  # start the JVM's machinery outside the timings
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    line = {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(sf_dir).name.removeprefix("sf")}
    spark.stop()
    print(json.dumps(line))


if __name__ == "__main__":
    main()
