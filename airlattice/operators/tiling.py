"""Cutting rasters into tiles.

Tile (0, 0) is the bottom left one; the top row and the right column of tiles may be smaller;
cells inside a tile run from its top left. Tile counts are ``size div length + 1`` in both
directions, so that curve codes agree with stored ones even where a size is an exact multiple;
the empty tiles this implies are never produced.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlattice.functions.hilbert import curve_size, hilbert_code
from airlattice.functions.keys import MAX_CODE, tile_key
from airlattice.joins import MAX_BROADCAST_KEYS, broadcast_if_small


def tile_count(cells: Column, length: Column) -> Column:
    return (F.floor(cells / length) + 1).cast("int")


def fitting_length(cells: int, least: int) -> int:
    """The least tile length, from ``least`` up, at which a raster with ``cells`` cells along its longer side has tile
    codes that fit a key: larger rasters need larger tiles."""
    side = 2
    while (2 * side) ** 2 <= MAX_CODE + 1:
        side *= 2
    return max(least, cells // side + 1)


def tile_side(cells: Column, length: Column, index: Column) -> Column:
    """Cells of tile ``index`` along one direction."""
    return F.least(length, cells - index * length).cast("int")


def _numbered(tiles: DataFrame) -> DataFrame:
    """Add ``tile_code`` and ``props`` to rows of x, y, ncols, nrows, xll, yll, cellsize, nodata,
    tile_length."""
    length = F.col("tile_length")
    x_tiles, y_tiles = tile_count(F.col("ncols"), length), tile_count(F.col("nrows"), length)
    code = hilbert_code(F.col("x"), F.col("y"), curve_size(y_tiles, x_tiles))
    props = F.struct(
        x_tiles.alias("x_tiles"),
        y_tiles.alias("y_tiles"),
        F.col("xll").alias("lng"),
        F.col("yll").alias("lat"),
        F.col("cellsize").alias("cell_size"),
        tile_side(F.col("nrows"), length, F.col("y")).alias("height"),
        tile_side(F.col("ncols"), length, F.col("x")).alias("width"),
        F.col("nodata"),
    )
    return tiles.withColumn("tile_code", code.cast("int")).withColumn("props", props)


def split_rasters(rasters: DataFrame, tile_length: int) -> DataFrame:
    """Tiles of rasters that come one per row with their text lines (see ``read_asc``).

    No shuffle: a raster is cut where it was read, first into bands of lines, each parsed once,
    then into tiles. All other columns of ``rasters`` are carried along.
    """
    length = F.lit(tile_length)
    short = F.raise_error(F.concat(F.lit("raster does not hold nrows rows: "), F.col("path"))).cast("array<string>")
    rasters = rasters.withColumn("lines", F.when(F.size("lines") == F.col("nrows"), F.col("lines")).otherwise(short))
    bands = F.transform(
        F.sequence(F.lit(0), F.ceil(F.col("nrows") / length).cast("int") - 1),
        lambda y: F.slice(
            "lines",
            F.col("nrows") - y * length - tile_side(F.col("nrows"), length, y) + 1,
            tile_side(F.col("nrows"), length, y),
        ),
    )
    carried = [c for c in rasters.columns if c != "lines"]
    banded = rasters.select(*carried, F.posexplode(bands).alias("y", "band"))

    cells = F.split(F.trim(F.array_join("band", " ")), r"\s+").cast("array<float>")
    parsed = banded.select(*carried, "y", F.size("band").alias("band_rows"), cells.alias("cells"))
    ragged = F.raise_error(
        F.concat(F.lit("raster rows do not hold ncols values: "), F.col("path"))
    ).cast("array<float>")
    checked = parsed.withColumn(
        "cells",
        F.when(F.size("cells") == F.col("band_rows") * F.col("ncols"), F.col("cells")).otherwise(ragged),
    )

    tiles_of_band = F.transform(
        F.sequence(F.lit(0), F.ceil(F.col("ncols") / length).cast("int") - 1),
        lambda x: F.flatten(
            F.transform(
                F.sequence(F.lit(0), F.col("band_rows") - 1),
                lambda i: F.slice(
                    "cells",
                    i * F.col("ncols") + x * length + 1,
                    tile_side(F.col("ncols"), length, x),
                ),
            )
        ),
    )
    tiles = checked.select(*carried, "y", F.posexplode(tiles_of_band).alias("x", "data"))
    return _numbered(tiles.withColumn("tile_length", length))


def split_raster_rows(rows: DataFrame, tile_length: int) -> DataFrame:
    """Tiles of rasters that come one row per raster row (see ``read_asc_rows``), for rasters too
    large for one task. What is shuffled are row pieces one tile wide; a tile gathers at most
    ``tile_length`` of them. The same columns come out as from ``split_rasters``."""
    length = F.lit(tile_length)
    carried = [c for c in rows.columns if c not in ("row", "values")]
    ragged = F.raise_error(F.concat(F.lit("raster rows do not hold ncols values: "), F.col("path")))
    checked = F.when(F.size("values") == F.col("ncols"), F.col("values")).otherwise(ragged.cast("array<float>"))
    up = F.col("nrows") - 1 - F.col("row")
    placed = rows.withColumn("values", checked).withColumn("y", F.floor(up / length).cast("int"))
    numbered = placed.withColumn("i", tile_side(F.col("nrows"), length, F.col("y")) - 1 - up % length)
    pieces = numbered.select(
        *carried, "y", "i",
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0), F.ceil(F.col("ncols") / length).cast("int") - 1),
                lambda x: F.slice("values", x * length + 1, tile_side(F.col("ncols"), length, x)),
            )
        ).alias("x", "cells"),
    )
    gathered = pieces.groupBy(*carried, "x", "y").agg(F.sort_array(F.collect_list(F.struct("i", "cells"))).alias("pieces"))
    short = F.raise_error(F.concat(F.lit("raster does not hold nrows rows: "), F.col("path"))).cast("array<float>")
    whole = F.size("pieces") == tile_side(F.col("nrows"), length, F.col("y"))
    data = F.when(whole, F.flatten("pieces.cells")).otherwise(short)
    return _numbered(gathered.select(*carried, "x", "y", data.alias("data")).withColumn("tile_length", length))


def locate_cells(cells: DataFrame) -> DataFrame:
    """Add tile (x, y), tile height and width and the position inside the tile to cells that
    carry row (0 = top), col, ncols, nrows and tile_length."""
    length = F.col("tile_length")
    up = F.col("nrows") - 1 - F.col("row")
    placed = cells.withColumn("x", F.floor(F.col("col") / length).cast("int")).withColumn(
        "y", F.floor(up / length).cast("int")
    )
    sized = placed.withColumn("height", tile_side(F.col("nrows"), length, F.col("y"))).withColumn(
        "width", tile_side(F.col("ncols"), length, F.col("x"))
    )
    pos = (F.col("height") - 1 - up % length) * F.col("width") + F.col("col") % length
    return sized.withColumn("pos", pos.cast("int"))


# How several different values for one cell are settled.
CLASHES = {"max": F.max, "min": F.min}


def split_cells(cells: DataFrame, meta: DataFrame, by=(), clash: str = "max") -> DataFrame:
    """Tiles of rasters that come one row per cell: region_no, ``by``, row, col, value.

    ``meta`` is the raster metadata by region; cells that carry ncols, nrows and tile_length of
    their own are not joined with it until they are tiles. Repeated copies of a cell collapse before the
    tile is gathered, so a tile never gathers more than ``tile_length`` squared cells; a cell
    that is absent gets NODATA. Of different values for one cell ``clash`` takes the largest or
    smallest; with "error" they are an error. Cells are shuffled once, by tile.
    """
    if clash not in (*CLASHES, "error"):
        raise ValueError(f"unknown rule {clash!r}; use one of {[*CLASHES, 'error']}")
    ids = ["region_no", *by]
    shape = meta.select("region_no", "ncols", "nrows", "tile_length")
    shaped = cells if set(shape.columns) <= set(cells.columns) else cells.join(shape, "region_no")
    located = locate_cells(shaped).repartition(*ids, "x", "y")
    value = CLASHES.get(clash, F.max)("value")
    if clash == "error":
        place = F.concat_ws(" ", *ids, "x", "y", "pos")
        both = F.raise_error(F.concat(F.lit("different values for the cell "), place)).cast("float")
        value = F.when(F.min("value") == F.max("value"), F.max("value")).otherwise(both)
    unique = located.groupBy(*ids, "x", "y", "pos").agg(value.alias("value"))
    gathered = unique.groupBy(*ids, "x", "y").agg(
        F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("found")
    )
    numbered = _numbered(gathered.join(broadcast_if_small(meta, MAX_BROADCAST_KEYS), "region_no"))

    # Runs of NODATA between the cells found, in time proportional to the tile.
    area, nodata = F.col("props.height") * F.col("props.width"), F.col("nodata").cast("float")
    inside = F.filter("found", lambda one: (one["pos"] >= 0) & (one["pos"] < area))
    before = F.slice(F.concat(F.array(F.lit(-1)), inside["pos"]), F.lit(1), F.size(inside))
    runs = F.zip_with(
        inside, before, lambda one, last: F.concat(F.array_repeat(nodata, one["pos"] - last - 1), F.array(F.coalesce(one["value"], nodata)))
    )
    rest = F.array_repeat(nodata, area - 1 - F.coalesce(F.array_max(inside["pos"]), F.lit(-1)))
    filled = F.concat(F.flatten(runs), rest)
    data = F.when(F.size("found") == area, F.col("found.value")).otherwise(filled)
    return numbered.select(*ids, "x", "y", "tile_code", "props", data.cast("array<float>").alias("data"))


def with_tile_key(tiles: DataFrame) -> DataFrame:
    return tiles.withColumn("tile_key", tile_key(F.col("region_no"), F.col("tile_code")))
