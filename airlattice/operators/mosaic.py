"""Putting tiles back together into rasters."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlattice.functions.hilbert import curve_size, hilbert_xy
from airlattice.functions.keys import key_code, key_region

# Header words of a raster file, in order.
HEADER_WORDS = ("NCOLS", "NROWS", "XLLCENTER", "YLLCENTER", "DX", "DY", "NODATA_VALUE")


def place_tiles(tiles: DataFrame, meta: DataFrame, by=()) -> DataFrame:
    """Add region_no, tile (x, y) and the raster's shape to tiles of (tile_key, ``by``, props, data).

    ``meta`` has one short row per region; Spark broadcasts it while it is below the broadcast
    threshold and shuffles otherwise.
    """
    xy = hilbert_xy(key_code(F.col("tile_key")), curve_size(F.col("props.y_tiles"), F.col("props.x_tiles")))
    decoded = tiles.select(key_region(F.col("tile_key")).alias("region_no"), *by, xy.alias("xy"), "props", "data")
    shape = meta.select("region_no", "ncols", "nrows", "tile_length")
    return decoded.join(shape, "region_no").select(
        "region_no",
        *by,
        F.col("xy.x").cast("int").alias("x"),
        F.col("xy.y").cast("int").alias("y"),
        F.col("props.height").alias("height"),
        F.col("props.width").alias("width"),
        "ncols",
        "nrows",
        "tile_length",
        "data",
    )


def _raster_row(row_in_tile):
    """Row of the raster, 0 = top."""
    return F.col("nrows") - F.col("y") * F.col("tile_length") - F.col("height") + row_in_tile


def tiles_to_grid(tiles: DataFrame, meta: DataFrame, by=()) -> DataFrame:
    """One row per cell: region_no, ``by``, row (0 = top), col, value. No shuffle."""
    cells = place_tiles(tiles, meta, by).select(
        "region_no", *by, "x", "y", "height", "width", "nrows", "tile_length",
        F.posexplode("data").alias("pos", "value"),
    )
    row = _raster_row(F.floor(F.col("pos") / F.col("width")))
    col = F.col("x") * F.col("tile_length") + F.col("pos") % F.col("width")
    return cells.select("region_no", *by, row.cast("int").alias("row"), col.cast("int").alias("col"), "value")


def tiles_to_asc(
    tiles: DataFrame, meta: DataFrame, by=(), rasters: DataFrame = None, header_words=HEADER_WORDS
) -> DataFrame:
    """Text of the rasters: region_no, ``by``, line, value; header first, then row by row.

    Tiles must be unique per (tile_key, ``by``); two tiles for one place are an error. What is
    shuffled are row pieces of a tile, not cells, and a group is one raster row. Missing tiles
    are filled with NODATA. ``rasters`` lists the (region_no, ``by``) to write; give it when the
    tiles are costly to compute, as it is read a second time to find rows without any tile.
    """
    ids = ["region_no", *by]
    placed = place_tiles(tiles, meta, by)
    pieces = placed.select(
        *ids, "x", "y", "height", "nrows", "tile_length",
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0), F.col("height") - 1),
                lambda i: F.slice("data", i * F.col("width") + 1, F.col("width")),
            )
        ).alias("i", "cells"),
    ).select(*ids, _raster_row(F.col("i")).cast("int").alias("row"), F.struct("x", "cells").alias("piece"))

    if rasters is None:
        rasters = tiles.select(key_region(F.col("tile_key")).alias("region_no"), *by)
    # Every line of every raster, header lines as negative rows; pieces of tiles fall into place.
    headed = rasters.select(*ids).distinct().join(meta.select("region_no", "nrows"), "region_no")
    every_row = headed.select(
        *ids,
        F.explode(F.sequence(F.lit(-len(header_words)), F.col("nrows") - 1)).alias("row"),
        F.lit(None).cast(pieces.schema["piece"].dataType).alias("piece"),
    )
    rows = pieces.unionByName(every_row).groupBy(*ids, "row").agg(F.collect_list("piece").alias("pieces"))

    length = F.col("tile_length")
    by_x = F.map_from_entries("pieces")
    cells = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.ceil(F.col("ncols") / length).cast("int") - 1),
            lambda x: F.coalesce(
                F.try_element_at(by_x, x),
                F.array_repeat(F.col("nodata").cast("float"), F.least(length, F.col("ncols") - x * length)),
            ),
        )
    )
    body = F.concat(F.array_join(cells.cast("array<string>"), " "), F.lit(" "))
    numbers = ("ncols", "nrows", "xll", "yll", "cellsize", "cellsize", "nodata")
    header = F.array(
        *[
            F.concat(F.lit(word + " "), F.col(number).cast("string"))
            for word, number in zip(header_words, numbers, strict=True)
        ]
    )
    line = F.col("row") + len(header_words)
    text = F.when(F.col("row") < 0, F.get(header, line)).otherwise(body)
    return rows.join(meta, "region_no").select(*ids, line.alias("line"), text.alias("value"))
