"""Times the headline queries on the test tables and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = [
    "readmission_overview", "index_episodes", "readmission_windows", "service_days_adult", "merged_eligibility",
    "clean_long_adult", "member_table_adult", "stage_audit_adult", "demographics_table_adult", "los_readmit_table_adult",
    "profile_adult", "service_summary_adult", "after_summary_adult", "after_use_by_loc_adult", "prior_days_by_loc_adult",
    "box_after_year_adult", "eligibility_bands_adult", "eligibility_bands_all_adult", "ip_by_year_adult", "wide_members_adult",
    "model_table_adult", "fast_facts_adult", "km_agecat2_adult", "logrank_agecat2_adult", "cox_los_adult",
    "cox_hazard_ratios_adult", "cox_glance_adult",
    "extract_child", "member_table_child", "wide_members_child", "dhs_days", "box_los_dhs_child", "km_loscat_child", "cox_hazard_ratios_child",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from cohortlib import ADULT
    from cohortlib.plans import registry, study

    queries = {"readmission_overview": registry.readmission_overview, **registry.all_queries()}
    seconds: dict[str, float] = {}

    def timed(name, run):
        start = time.perf_counter()
        run()
        seconds[name] = round(time.perf_counter() - start, 3)

    st = study(spark, sf_dir, ADULT)
    timed("spark_start", lambda: spark.range(1_000_000).selectExpr("sum(id)").collect())
    for stage in ("index", "inputs", "episodes", "days", "start", "members", "wide"):       # tables every report shares, built once
        timed(f"stage_{stage}", lambda: getattr(st, stage))
    for name in HEADLINE:
        timed(name, lambda: queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    total = round(sum(v for k, v in seconds.items() if k != "spark_start"), 3)
    print(json.dumps({"metric": "total_seconds_headline_queries", "value": total, "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
