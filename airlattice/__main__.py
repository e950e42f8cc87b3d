"""The three jobs from the command line: ``python -m airlattice stations|rasters|course|heat-map ...``.

For spark-submit, zip the package and give it with --py-files.
"""

import argparse

from pyspark.sql import SparkSession

from airlattice.plans.raster_import import import_rasters
from airlattice.plans.station_etl import run_station_etl
from airlattice.plans.tile_query import heat_map_raster, region_number, region_tiles, time_query
from airlattice.session import pin_time_zone
from airlattice.sources.rasters import write_asc, write_single_csv
from airlattice.sources.tile_store import read_meta


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="airlattice", description=__doc__)
    jobs = parser.add_subparsers(dest="job", required=True)
    stations = jobs.add_parser("stations", help="clean station files into a managed table")
    for name in ("paths", "provinces", "locations", "table"):
        stations.add_argument(name)
    rasters = jobs.add_parser("rasters", help="import raster files into the tile and metadata tables")
    for name in ("paths", "regions", "tiles", "meta", "start", "end"):
        rasters.add_argument(name)
    rasters.add_argument("--zone", default="UTC", help="time zone of the file names")
    for job, what in (("course", "mean over time of a region, as one CSV file"), ("heat-map", "mean per cell of a region, as a raster")):
        question = jobs.add_parser(job, help=what)
        for name in ("regions", "tiles", "meta", "province", "city", "pollutant", "start", "end", "out"):
            question.add_argument(name)
        question.add_argument("--level", default="day")
    return parser


def main(argv=None, spark: SparkSession = None) -> None:
    asked = arguments().parse_args(argv)
    spark = pin_time_zone(spark or SparkSession.builder.appName(f"airlattice-{asked.job}").getOrCreate())
    if asked.job == "stations":
        run_station_etl(spark, asked.paths, asked.provinces, asked.locations, asked.table)
        return
    regions = spark.read.parquet(asked.regions)
    if asked.job == "rasters":
        import_rasters(spark, asked.paths, regions, asked.tiles, asked.meta, asked.start, asked.end, zone=asked.zone)
        return
    tiles = region_tiles(spark, asked.tiles, regions, asked.province, asked.city, asked.pollutant, asked.start, asked.end)
    if asked.job == "course":
        write_single_csv(time_query(tiles, asked.level), asked.out)
    else:
        number = region_number(regions, asked.province, asked.city)
        write_asc(heat_map_raster(tiles, read_meta(spark, asked.meta), [number]), asked.out)


if __name__ == "__main__":
    main()
