"""Tiles by longitude/latitude box.

A box is half open like a tile: west and south edges belong to it, east and north do not.
"""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlattice.functions.geo import geohash_cell_size, geohash_of_cell
from airlattice.functions.hilbert import curve_intervals, curve_size, hilbert_code, hilbert_xy
from airlattice.functions.keys import KEY_SPAN, REGION_STEP, key_code, key_region, tile_key
from airlattice.joins import keep_matching
from airlattice.operators.tiling import tile_count, tile_side


# Most GeoHash cells one box is unfolded into.
MAX_BOX_CELLS = 100_000


class Box(NamedTuple):
    lng_min: float
    lat_min: float
    lng_max: float
    lat_max: float


def _with_extent(df: DataFrame, lng, lat, cell, length, x, y, height, width) -> DataFrame:
    west = lng + x * length * cell
    south = lat + y * length * cell
    return df.withColumns(
        {
            "lng_min": west,
            "lat_min": south,
            "lng_max": west + width * cell,
            "lat_max": south + height * cell,
        }
    )


def tile_extents(tiles: DataFrame, tile_length: int) -> DataFrame:
    """Add lng_min, lat_min, lng_max, lat_max to tiles, from their own properties."""
    n = curve_size(F.col("props.y_tiles"), F.col("props.x_tiles"))
    placed = tiles.withColumn("xy", hilbert_xy(key_code(F.col("tile_key")), n))
    return _with_extent(
        placed,
        F.col("props.lng"),
        F.col("props.lat"),
        F.col("props.cell_size"),
        F.lit(tile_length),
        F.col("xy.x"),
        F.col("xy.y"),
        F.col("props.height"),
        F.col("props.width"),
    ).drop("xy")


def _overlaps(box: Box) -> Column:
    return (
        (F.col("lng_min") < box.lng_max)
        & (F.col("lng_max") > box.lng_min)
        & (F.col("lat_min") < box.lat_max)
        & (F.col("lat_max") > box.lat_min)
    )


def tiles_in_box(tiles: DataFrame, box: Box, tile_length: int, meta: DataFrame = None) -> DataFrame:
    """Tiles that overlap the box.

    With ``meta``, the tile keys are found from the raster metadata, so that the scan of ``tiles``
    gets them as a filter; without it each row is judged by its own extent. No shuffle either way
    while keys are few.
    """
    if meta is not None:
        east, north = F.col("xll") + F.col("ncols") * F.col("cellsize"), F.col("yll") + F.col("nrows") * F.col("cellsize")
        near = (F.col("xll") < box.lng_max) & (east > box.lng_min) & (F.col("yll") < box.lat_max) & (north > box.lat_min)
        return keep_matching(tiles, tile_directory(meta.where(near)).where(_overlaps(box)), "tile_key")
    return tile_extents(tiles, tile_length).where(_overlaps(box)).select(*tiles.columns)


def tile_directory(meta: DataFrame) -> DataFrame:
    """Every non-empty tile of every region with its extent, from the raster metadata alone."""
    length = F.col("tile_length")
    placed = meta.select(
        "*", F.explode(F.sequence(F.lit(0), F.ceil(F.col("ncols") / length).cast("int") - 1)).alias("x")
    ).select(
        "*", F.explode(F.sequence(F.lit(0), F.ceil(F.col("nrows") / length).cast("int") - 1)).alias("y")
    )
    n = curve_size(tile_count(F.col("nrows"), length), tile_count(F.col("ncols"), length))
    coded = placed.withColumn("tile_code", hilbert_code(F.col("x"), F.col("y"), n).cast("int"))
    return _with_extent(
        coded.withColumn("tile_key", tile_key(F.col("region_no"), F.col("tile_code"))),
        F.col("xll"),
        F.col("yll"),
        F.col("cellsize"),
        length,
        F.col("x"),
        F.col("y"),
        tile_side(F.col("nrows"), length, F.col("y")),
        tile_side(F.col("ncols"), length, F.col("x")),
    ).select("region_no", "tile_code", "tile_key", "lng_min", "lat_min", "lng_max", "lat_max")


def _first_cell(edge: Column, origin: float, size: float) -> Column:
    return F.floor((edge + origin) / size)


def geohash_cover(extents: DataFrame, precision: int) -> DataFrame:
    """One row per GeoHash cell that an extent touches, with the cell's column gx, row gy and
    text; the extent's columns are carried along."""
    width, height = geohash_cell_size(precision)

    def cells(low, high, origin, size):
        first = _first_cell(F.col(low), origin, size)
        last = F.ceil((F.col(high) + origin) / size) - 1
        return F.explode(F.sequence(first, F.greatest(first, last)))

    columns = extents.select("*", cells("lng_min", "lng_max", 180.0, width).alias("gx"))
    both = columns.select("*", cells("lat_min", "lat_max", 90.0, height).alias("gy"))
    return both.withColumn("geohash", geohash_of_cell(F.col("gx"), F.col("gy"), precision))


def build_geo_index(meta: DataFrame, precision: int) -> DataFrame:
    """Index table: region_no, geohash, tile_code, tile_key and the tile's extent.

    Choose a precision whose cells are about as large as a tile, so that a cell lists few tiles
    and a tile few cells.
    """
    return geohash_cover(tile_directory(meta), precision).drop("gx", "gy")


def _cells_in(precision: int) -> Column:
    """About how many GeoHash cells a box has."""
    width, height = geohash_cell_size(precision)
    return ((F.col("lng_max") - F.col("lng_min")) / width + 1) * ((F.col("lat_max") - F.col("lat_min")) / height + 1)


def box_tile_keys(index: DataFrame, boxes: DataFrame, precision: int, by=()) -> DataFrame:
    """(box_id, tile_key) of overlapping tiles for boxes of (box_id, lng_min, lat_min, lng_max, lat_max).

    Boxes and tiles meet on equal GeoHash cells (and on ``by``, columns of both), then by their
    extents. A pair that shares many cells is kept only in the most south-western of them, so no
    distinct is needed. A box of more than MAX_BOX_CELLS cells is unfolded into coarser ones, of
    which the whole world has no more.
    """
    coarse = precision
    while coarse > 1 and 32**coarse > MAX_BOX_CELLS:
        coarse -= 1
    edges = ["lng_min", "lat_min", "lng_max", "lat_max"]
    wanted = boxes.select("box_id", *by, *edges)
    if coarse == precision:
        return _box_hits(index, wanted, precision, precision, by)
    small = wanted.where(_cells_in(precision) <= MAX_BOX_CELLS)
    large = wanted.where(_cells_in(precision) > MAX_BOX_CELLS)
    return _box_hits(index, small, precision, precision, by).unionByName(_box_hits(index, large, precision, coarse, by))


def _box_hits(index: DataFrame, boxes: DataFrame, precision: int, level: int, by) -> DataFrame:
    """Hits of boxes unfolded at ``level``, a prefix of the index's cells."""
    width, height = geohash_cell_size(precision)
    edges = ["lng_min", "lat_min", "lng_max", "lat_max"]
    covered = geohash_cover(boxes, level).select(
        "box_id", *by, F.col("geohash").alias("cell"), *[F.col(c).alias(f"box_{c}") for c in edges]
    )
    west, south = F.greatest("lng_min", "box_lng_min"), F.greatest("lat_min", "box_lat_min")
    corner = geohash_of_cell(_first_cell(west, 180.0, width), _first_cell(south, 90.0, height), precision)
    hits = index.withColumn("cell", F.substring("geohash", 1, level)).join(covered, ["cell", *by]).where(
        (F.col("lng_min") < F.col("box_lng_max"))
        & (F.col("lng_max") > F.col("box_lng_min"))
        & (F.col("lat_min") < F.col("box_lat_max"))
        & (F.col("lat_max") > F.col("box_lat_min"))
        & (F.col("geohash") == corner)
    )
    return hits.select("box_id", "tile_key")


def tiles_in_box_indexed(tiles: DataFrame, index: DataFrame, box: Box, precision: int) -> DataFrame:
    """Tiles that overlap the box, found through the index table instead of by reading extents.

    """
    one = tiles.sparkSession.createDataFrame(
        [(0, *[float(v) for v in box])],
        "box_id int, lng_min double, lat_min double, lng_max double, lat_max double",
    )
    return keep_matching(tiles, box_tile_keys(index, one, precision), "tile_key")


# --- boxes as intervals of keys ---------------------------------------------------------------

# Key intervals named in a plan; where a box needs more, neighbours are joined over the smallest gaps, and
# the tiles of those gaps go by an exact check.
MAX_KEY_INTERVALS = 256
# Regions under a box whose intervals may come to the driver.
MAX_BOX_REGIONS = 20_000


def box_key_intervals(meta: DataFrame, box: Box) -> DataFrame:
    """region_no, intervals: the tile keys of each region under the box, as few intervals (low and high
    included) of its curve. Found by quadrant descent, without a list of tiles."""
    length = F.col("tile_length")

    def touched(cells: str, origin: str, low: float, high: float) -> Column:
        """Tile indices along one direction whose extent overlaps the box's."""

        def overlaps(i: Column) -> Column:
            start = F.col(origin) + i * length * F.col("cellsize")
            return (start < high) & (start + tile_side(F.col(cells), length, i) * F.col("cellsize") > low)

        return F.filter(F.sequence(F.lit(0), F.ceil(F.col(cells) / length).cast("int") - 1), overlaps)

    found = meta.select(
        "*", touched("ncols", "xll", box.lng_min, box.lng_max).alias("xs"), touched("nrows", "yll", box.lat_min, box.lat_max).alias("ys")
    ).where((F.size("xs") > 0) & (F.size("ys") > 0))
    n = curve_size(tile_count(F.col("nrows"), length), tile_count(F.col("ncols"), length))
    codes = curve_intervals(n, F.array_min("xs"), F.array_max("xs"), F.array_min("ys"), F.array_max("ys"))
    first = F.col("region_no") * REGION_STEP
    keys = F.transform("codes", lambda one: F.struct((first + one["low"]).alias("low"), (first + one["high"]).alias("high")))
    return found.select("region_no", codes.alias("codes")).select("region_no", keys.alias("intervals"))


def close_gaps(intervals: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """At most ``most`` intervals that cover the given ones (ascending), over the smallest gaps."""
    gaps = sorted(range(1, len(intervals)), key=lambda i: intervals[i - 1][1] - intervals[i][0])
    ends = [0, *sorted(gaps[: most - 1]), len(intervals)]
    return [(intervals[a][0], intervals[b - 1][1]) for a, b in zip(ends, ends[1:])] if intervals else []


def tiles_in_box_ranges(tiles: DataFrame, box: Box, meta: DataFrame) -> DataFrame:
    """Tiles that overlap the box, by intervals of their keys: the scan gets ranges, which prune folders and
    row groups, instead of every key. The same tiles as from ``tiles_in_box`` with ``meta``."""
    listed = box_key_intervals(meta, box).limit(MAX_BOX_REGIONS + 1)
    rows = listed.collect()
    if len(rows) > MAX_BOX_REGIONS:
        return tiles_in_box(tiles, box, None, meta)
    exact = sorted((one["low"], one["high"]) for row in rows for one in row["intervals"])
    if not exact:
        return tiles.where(F.lit(False))
    coarse = close_gaps(exact, MAX_KEY_INTERVALS)
    condition = F.lit(False)
    for low, high in coarse:
        condition = condition | F.col("tile_key").between(low, high)
    found = tiles.where(condition)
    if "key_range" in tiles.columns:
        spans = {span for low, high in coarse for span in range(low // KEY_SPAN, high // KEY_SPAN + 1)}
        found = found.where(F.col("key_range").isin(sorted(spans)))
    if len(coarse) == len(exact):
        return found
    asked = F.broadcast(tiles.sparkSession.createDataFrame(rows, listed.schema).withColumnRenamed("region_no", "asked"))
    key = F.col("tile_key")
    inside = F.exists("intervals", lambda one: key.between(one["low"], one["high"]))
    return found.join(asked, (key_region(key) == F.col("asked")) & inside, "left_semi")
