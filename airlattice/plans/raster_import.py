"""Raster files to tile and metadata tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airlattice.functions.timebuckets import epoch_seconds
from airlattice.operators.regions import resolve_region
from airlattice.operators.tiling import split_raster_rows, split_rasters, with_tile_key
from airlattice.schemas import IMPORTED, RASTER_META, TILE_LENGTH, TILES
from airlattice.session import clearing, stage
from airlattice.sources.rasters import (
    MAX_WHOLE_FILE, has_name_parts, list_rasters, read_asc, read_asc_rows, read_headers, with_name_parts,
)
from airlattice.sources.tile_store import keep_last, read_if_present, upsert_meta, upsert_tiles

# Listed rasters that are a lookup in the plan and name the files to open; more are written and joined.
MAX_LISTED_RASTERS = 50_000

# What one import brings for one place in the tables.
VERSION = ["region_no", "pollutant", "ts"]


def listed_rasters(spark: SparkSession, paths, region_dim: DataFrame, start: str, end: str, zone: str = "UTC") -> DataFrame:
    """(path, name, size, in_parts, modified, region_no, pollutant, time, ts) of the rasters named within
    [start, end] (compared as text), from names alone. A name of another form, and an unknown region, are errors."""
    listed = list_rasters(spark, paths)
    odd = F.raise_error(F.concat(F.lit("not the name of a raster: "), F.col("path"))).cast("string")
    named = with_name_parts(listed.withColumn("name", F.when(has_name_parts(), F.col("name")).otherwise(odd)))
    resolved = resolve_region(named.where(F.col("time").between(start, end)), region_dim)
    unknown = F.raise_error(F.concat(F.lit("no region code for "), F.col("path"))).cast("bigint")
    return resolved.select(
        "path", "name", "size", "in_parts", "modified", F.coalesce("region_no", unknown).alias("region_no"), "pollutant", "time",
        F.timestamp_seconds(epoch_seconds(F.col("time"), zone)).alias("ts"),
    )


def raster_tiles(
    spark: SparkSession,
    paths,
    region_dim: DataFrame,
    start: str,
    end: str,
    tile_length: int = TILE_LENGTH,
    max_whole_file: int = MAX_WHOLE_FILE,
    zone: str = "UTC",
    rasters: DataFrame = None,
) -> DataFrame:
    """Tiles of all rasters named within [start, end] (compared as text), with the columns of the tile
    table, the raster metadata and the path.

    ``rasters`` are those of ``listed_rasters`` to read, all of them by default; one row per raster.
    Rasters are cut where they are read, without shuffle; only files too large for one task, and
    rasters in parts, are read in splits and their tiles gathered by a shuffle. The way is chosen
    per raster, and both give the same tiles and the same errors.
    """
    if rasters is None:
        rasters = listed_rasters(spark, paths, region_dim, start, end, zone)
    split = ((F.col("size") > max_whole_file) | F.col("in_parts")).alias("split")
    chosen, rows = _opened(rasters.select("path", split, "region_no", "pollutant", "ts"))
    whole, large = chosen.where("not split").drop("split"), chosen.where("split").drop("split")
    whole_paths = large_paths = None
    if rows is not None:
        whole_paths, large_paths = ([row["path"] for row in rows if row["split"] == way] for way in (False, True))

    def finished(tiles: DataFrame) -> DataFrame:
        keyed = with_tile_key(tiles)
        return keyed.select(*TILES.fieldNames(), *[c for c in RASTER_META.fieldNames() if c != "region_no"], "path")

    texts = read_asc(spark, paths, max_whole_file, whole_paths, whole if whole_paths is None else None)
    tiles = finished(split_rasters(texts.join(whole, "path"), tile_length))
    if large.isEmpty() if rows is None else not large_paths:
        return tiles
    by_rows = read_asc_rows(spark, paths, rasters=large.select("path"), wanted=large_paths).join(large, "path")
    return tiles.unionByName(finished(split_raster_rows(by_rows, tile_length)))


def _opened(rasters: DataFrame) -> tuple[DataFrame, list | None]:
    """A lookup of the rasters to read, and its rows, None if they are too many."""
    rows = rasters.limit(MAX_LISTED_RASTERS + 1).collect()
    if len(rows) > MAX_LISTED_RASTERS:
        return stage(rasters, "rasters"), None
    lookup = F.broadcast(rasters.sparkSession.createDataFrame(rows, rasters.schema))
    return lookup, rows


def raster_meta(spark: SparkSession, paths, rasters: DataFrame, tile_length: int = TILE_LENGTH) -> DataFrame:
    """Metadata of ``rasters`` (path, region_no), one per region, from their headers alone."""
    lookup, rows = _opened(rasters.select("path", "region_no"))
    headers = read_headers(spark, paths, None if rows is None else [row["path"] for row in rows], lookup if rows is None else None)
    return headers.join(lookup, "path").withColumn("tile_length", F.lit(tile_length)).select(*RASTER_META.fieldNames())


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The raster each version was imported from last, None if nothing was imported yet."""
    ledger = read_if_present(spark, path, IMPORTED)
    return None if ledger is None else keep_last(ledger, VERSION, ["imported", "path"])


def import_rasters(
    spark: SparkSession,
    paths,
    region_dim: DataFrame,
    tiles_path: str,
    meta_path: str,
    start: str,
    end: str,
    tile_length: int = TILE_LENGTH,
    max_whole_file: int = MAX_WHOLE_FILE,
    zone: str = "UTC",
    ledger_path: str = None,
    states_path: str = None,
) -> None:
    """Read, cut and number all rasters at once and merge them into both tables; of two rasters for one
    region, time and pollutant the last by path stays, and metadata is that of a region's newest
    raster.

    Rivals are found in the list of names (one row per raster), before any is opened; so files are
    parsed once and their tiles shuffled once, for the write. Stored tiles of an imported raster
    are replaced as a whole. Metadata comes from headers alone.

    With ``ledger_path`` only rasters are opened that are new there or differ from what was imported, by
    path, size or time of change; they are recorded once their tiles and metadata are written, so an
    import that broke off is made up for by the next. ``states_path``: see ``upsert_tiles``.
    """
    with clearing(spark):
        listed = listed_rasters(spark, paths, region_dim, start, end, zone)
        rasters = stage(keep_last(listed, VERSION, ["path"]), "rasters")
        newest = keep_last(rasters, ["region_no"], ["ts", "path"])
        ledger = None if ledger_path is None else read_ledger(spark, ledger_path)
        if ledger is not None:
            seen = [*VERSION, "path", "size", "modified"]
            rasters = stage(rasters.join(ledger.select(*seen), seen, "left_anti"), "rasters")
            if rasters.isEmpty():
                return
            # a region's metadata changes with a raster that is no older than all imported ones
            last = ledger.groupBy("region_no").agg(F.max("ts").alias("last"))
            newest = newest.join(rasters.select("path"), "path", "left_semi").join(last, "region_no", "left")
            newest = newest.where(F.col("last").isNull() | (F.col("ts") >= F.col("last"))).drop("last")
        tiles = raster_tiles(spark, paths, region_dim, start, end, tile_length, max_whole_file, zone, rasters)
        upsert_tiles(tiles, tiles_path, replaces=rasters.select(*VERSION), states_path=states_path)
        upsert_meta(raster_meta(spark, paths, newest, tile_length), meta_path)
        if ledger_path is not None:
            record = rasters.withColumn("imported", F.current_timestamp()).select(*IMPORTED.fieldNames())
            record.write.mode("append").parquet(ledger_path)
