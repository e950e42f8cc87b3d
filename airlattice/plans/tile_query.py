"""Questions about one region, pollutant and time range, by name, over the tile table."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airlattice.functions.keys import key_region
from airlattice.operators.boxes import Box, tiles_in_box_ranges
from airlattice.operators.mosaic import tiles_to_asc
from airlattice.operators.olap import spatial_mean, time_pattern
from airlattice.operators.regions import resolve_region
from airlattice.sources.tile_store import read_tiles, scan_tiles


def region_number(region_dim: DataFrame, province: str, city: str) -> int:
    """Number of one region by name (one row to the driver)."""
    asked = region_dim.sparkSession.createDataFrame([(province, city)], "province string, city string")
    number = resolve_region(asked, region_dim).select("region_no").first()["region_no"]
    if number is None:
        raise ValueError(f"unknown region {province}:{city}")
    return number


def region_tiles(
    spark: SparkSession, tiles_path: str, region_dim: DataFrame, province: str, city: str, pollutant: str, start: str, end: str
) -> DataFrame:
    return scan_tiles(
        read_tiles(spark, tiles_path), region_number(region_dim, province, city), start, end, [pollutant]
    )


def box_tiles(spark: SparkSession, tiles_path: str, meta: DataFrame, box: Box, pollutant: str, start: str, end: str) -> DataFrame:
    """Tiles of one pollutant and time range that overlap a box: folders are pruned by pollutant, day and key
    range, files by the intervals of tile keys that the metadata gives for the box."""
    scanned = scan_tiles(read_tiles(spark, tiles_path), start=start, end=end, pollutants=[pollutant])
    return tiles_in_box_ranges(scanned, box, meta)


def time_query(tiles: DataFrame, level: str) -> DataFrame:
    """Course of the mean over time."""
    return time_pattern(tiles, level)


def heat_map(tiles: DataFrame) -> DataFrame:
    """Mean of every cell over the time range, as tiles."""
    return spatial_mean(tiles)


def heat_map_raster(tiles: DataFrame, meta: DataFrame, regions=None) -> DataFrame:
    """The heat map as raster text (region_no, line, value). Give the numbers of the ``regions`` asked
    for, if they are known, or tiles are read a second time to find them."""
    if regions is None:
        wanted = tiles.select(key_region(F.col("tile_key")).alias("region_no"))
    else:
        wanted = meta.where(F.col("region_no").isin(list(regions))).select("region_no")
    return tiles_to_asc(spatial_mean(tiles), meta, rasters=wanted)
