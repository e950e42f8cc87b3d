"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the threads. Every query is run once to warm up and then
timed; its whole result is computed and thrown away.
"""

import json
import os
import time

from pyspark.sql import SparkSession

from airlattice import registry

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINES = (
    "time_pattern_hours", "time_pattern_day", "time_pattern_season", "time_pattern_all", "spatial_mean",
    "spatial_mean_sparse", "tile_avg", "tile_max", "stats_by_key", "scan_range", "tile_count", "scan_latest", "multi_get",
    "merge_bands", "upsert_tiles", "split_tiles", "hilbert_encode", "raster_roundtrip", "asc_lines", "read_asc_files",
    "raster_import", "named_time_query", "named_heat_map", "box_query", "geohash_query", "station_chain", "station_repair", "add_location", "station_topn",
    "resolve_region", "gcj02_to_wgs84", "rollup_time", "rollup_space", "cube_time_space", "rollup_tiles", "drill_down_time",
)


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("airlattice-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return spark


def run_once(spark, run) -> float:
    begin = time.perf_counter()
    run(spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begin


def main() -> None:
    spark = session()
    queries = registry.queries()
    seconds = {}
    for name in HEADLINES:
        run_once(spark, queries[name])
        seconds[name] = round(run_once(spark, queries[name]), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
