"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "clean_cells", "parse_dates", "column_profile", "column_roles", "account_totals",
    "blended_rates", "item_panel", "fill_absent", "entity_labels", "flat_entities",
    "seasonal_naive", "weekday_quantile", "trend_weekday", "ensemble_average",
    "quantile_repair", "forecast_accuracy", "accuracy_summary", "known_values", "latest_runs",
    "compare_pivot", "backtest", "pooled_ridge", "store_replace", "closed_days_stream",
    "full_import", "import_scored", "revised_runs",
]


def forecast_one_file(spark) -> float:
    """One model over a fresh file of 180 days and one series, the second time of two."""
    from pyspark.sql import functions as F

    from tidecast.plans.forecast_job import forecast_lines
    from tidecast.session import scratch_path
    from tidecast.sources.exports import read_lines
    from tidecast.sources.store import Store

    took = 0.0
    for _ in range(2):
        folder = scratch_path(spark, "file")
        day = F.date_add(F.lit("2025-01-01").cast("date"), F.col("id").cast("int"))
        rows = spark.range(180).select(F.concat_ws(",", day, F.lit(100) + F.col("id") % 7))
        head = spark.range(1).select(F.lit("date,spend").alias("value"))
        lines = head.union(rows).coalesce(1)
        lines.write.text(f"{folder}/parts")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        part = hadoop.Path(f"{folder}/parts")
        fs = part.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = [f.getPath() for f in fs.listStatus(part) if f.getPath().getName().startswith("part")]
        fs.mkdirs(hadoop.Path(f"{folder}/in"))
        fs.rename(found[0], hadoop.Path(f"{folder}/in/daily.csv"))
        store = Store(spark, f"{folder}/store").create()
        start = time.time()
        forecast_lines(read_lines(spark, f"{folder}/in"), store)
        took = time.time() - start
    return took


def main() -> None:
    from tidecast.plans.queries import all_queries, stored
    from tidecast.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("tidecast-bench", cpus)
    queries = all_queries()
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    stored(spark, sf_dir)  # scoring is timed over a store that is there, not over its making
    took = {"forecast_one_file": round(forecast_one_file(spark), 3)}
    for name in HEADLINE:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")),
            }
        )
    )


if __name__ == "__main__":
    main()
