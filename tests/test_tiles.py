"""Tiling, curve numbering, mosaics, boxes."""

import random

import pytest
from pyspark.sql import functions as F

from airlattice.functions.cells import nodata_of, valid_mean
from airlattice.functions.geo import geohash, gcj02_to_wgs84
from airlattice.functions.hilbert import curve_size, hilbert_code, hilbert_xy
from airlattice.functions.keys import key_code, key_region, tile_key
from airlattice.operators import boxes, mosaic, tiling

META = "region_no bigint, ncols int, nrows int, xll double, yll double, cellsize double, nodata double, tile_length int"

# rows y = 0 .. 3 of the curve on 4 x 4
CURVE_4 = [[0, 1, 14, 15], [3, 2, 13, 12], [4, 7, 8, 11], [5, 6, 9, 10]]

GOLDEN = {
    (0, 0): (0, 2, 2, [6, 7, 1, 2]),
    (1, 0): (1, 2, 2, [8, 9, 3, 4]),
    (2, 0): (14, 2, 1, [10, 5]),
    (0, 1): (3, 2, 2, [16, 17, 11, 12]),
    (1, 1): (2, 2, 2, [18, 19, 13, 14]),
    (2, 1): (13, 2, 1, [20, 15]),
    (0, 2): (4, 1, 2, [21, 22]),
    (1, 2): (7, 1, 2, [23, 24]),
    (2, 2): (8, 1, 1, [25]),
}


def rasters_of(spark, shapes):
    """Rasters with cell value 1000 * row + col, one per (region, ncols, nrows)."""
    rows = []
    for region, ncols, nrows in shapes:
        lines = [" ".join(str(1000.0 * r + c) for c in range(ncols)) for r in range(nrows)]
        rows.append((region, f"r{region}", ncols, nrows, 100.0, 20.0, 0.5, -999.0, lines))
    return spark.createDataFrame(
        rows,
        "region_no bigint, path string, ncols int, nrows int, xll double, yll double, cellsize double, nodata double,"
        " lines array<string>",
    )


def test_hilbert_is_a_walk(spark):
    for n in (2, 4, 8, 64):
        grid = spark.range(n * n).select((F.col("id") % n).alias("x"), F.floor(F.col("id") / n).alias("y"))
        size = F.lit(n).cast("bigint")
        rows = grid.withColumn("code", hilbert_code(F.col("x"), F.col("y"), size)).withColumn(
            "xy", hilbert_xy(F.col("code"), size)
        ).collect()
        assert sorted(r.code for r in rows) == list(range(n * n))
        assert all((r.xy.x, r.xy.y) == (r.x, r.y) for r in rows)
        walk = sorted((r.code, r.x, r.y) for r in rows)
        assert all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in zip(walk, walk[1:]))
        if n == 4:
            assert all(CURVE_4[r.y][r.x] == r.code for r in rows)


def test_curve_size(spark):
    got = spark.range(1, 40).select("id", curve_size(F.lit(1), F.col("id")).alias("n")).collect()
    for row in got:
        want = 2
        while want < row.id:
            want *= 2
        assert row.n == want


def test_tile_key(spark):
    row = spark.range(1).select(tile_key(F.lit(4201), F.lit(99999)).alias("k")).select(
        "k", key_region(F.col("k")).alias("r"), key_code(F.col("k")).alias("c")
    ).first()
    assert (row.k, row.r, row.c) == (420199999, 4201, 99999)
    with pytest.raises(Exception, match="use larger tiles"):
        spark.range(1).select(tile_key(F.lit(1), F.col("id") + 100000)).collect()


def golden_lines(spark):
    lines = [" ".join(str(v) for v in range(5 * r + 1, 5 * r + 6)) for r in (4, 3, 2, 1, 0)]
    return spark.createDataFrame(
        [(1, "g", 5, 5, 0.0, 0.0, 1.0, -9999.0, lines)],
        "region_no bigint, path string, ncols int, nrows int, xll double, yll double, cellsize double, nodata double,"
        " lines array<string>",
    )


def as_golden(tiles):
    return {(r.x, r.y): (r.tile_code, r.props.height, r.props.width, list(r.data)) for r in tiles.collect()}


def test_golden_split(spark):
    tiles = tiling.split_rasters(golden_lines(spark), 2)
    assert as_golden(tiles) == GOLDEN
    assert {(r.props.x_tiles, r.props.y_tiles) for r in tiles.collect()} == {(3, 3)}

    exact = tiling.split_rasters(golden_lines(spark), 5).collect()
    assert [(r.tile_code, r.props.x_tiles, r.props.y_tiles) for r in exact] == [(0, 2, 2)]


def test_golden_split_of_cells(spark):
    cells = spark.range(25).select(
        F.lit(1).cast("bigint").alias("region_no"),
        F.floor(F.col("id") / 5).cast("int").alias("row"),
        (F.col("id") % 5).cast("int").alias("col"),
        (F.lit(21) - 5 * F.floor(F.col("id") / 5) + F.col("id") % 5).cast("float").alias("value"),
    )
    meta = spark.createDataFrame([(1, 5, 5, 0.0, 0.0, 1.0, -9999.0, 2)], META)
    assert as_golden(tiling.split_cells(cells, meta)) == GOLDEN
    # copies of a cell change nothing, an absent cell is NODATA
    copies = cells.unionByName(cells).where("not (row = 4 and col = 1)")
    got = as_golden(tiling.split_cells(copies, meta))
    assert got[(0, 0)] == (0, 2, 2, [6, 7, 1, -9999])
    assert {k: v for k, v in got.items() if k != (0, 0)} == {k: v for k, v in GOLDEN.items() if k != (0, 0)}


def test_round_trip_of_random_shapes(spark):
    rng = random.Random(7)
    shapes = [(i, rng.randint(1, 20), rng.randint(1, 20)) for i in range(1, 12)] + [(12, 8, 8), (13, 4, 9), (14, 1, 1)]
    rasters = rasters_of(spark, shapes)
    for length in (1, 4, 16):
        tiles = tiling.with_tile_key(tiling.split_rasters(rasters, length))
        meta = rasters.drop("path", "lines").withColumn("tile_length", F.lit(length))
        grid = mosaic.tiles_to_grid(tiles, meta).collect()
        assert len(grid) == sum(c * r for _, c, r in shapes)
        assert all(g.value == 1000 * g.row + g.col for g in grid)


def test_asc_text_and_missing_tiles(spark):
    shapes = [(1, 5, 4), (2, 3, 3)]
    rasters = rasters_of(spark, shapes)
    tiles = tiling.with_tile_key(tiling.split_rasters(rasters, 2))
    meta = rasters.drop("path", "lines").withColumn("tile_length", F.lit(2))
    whole = mosaic.tiles_to_asc(tiles, meta).orderBy("region_no", "line").collect()
    first = [r.value for r in whole if r.region_no == 1]
    assert first[:7] == [
        "NCOLS 5", "NROWS 4", "XLLCENTER 100.0", "YLLCENTER 20.0", "DX 0.5", "DY 0.5", "NODATA_VALUE -999.0",
    ]
    assert first[7] == "0.0 1.0 2.0 3.0 4.0 "
    assert first[10] == "3000.0 3001.0 3002.0 3003.0 3004.0 "

    # without the whole top band of region 1 and one tile of region 2
    holes = tiles.where("not (region_no = 1 and y = 1) and not (region_no = 2 and x = 1 and y = 0)")
    rows = mosaic.tiles_to_asc(holes, meta).orderBy("region_no", "line").collect()
    texts = {(r.region_no, r.line): r.value for r in rows}
    assert len(texts) == len(rows) == 7 + 4 + 7 + 3
    assert texts[(1, 7)] == "-999.0 " * 5
    assert texts[(2, 9)] == "2000.0 2001.0 -999.0 "


def test_ragged_raster_is_an_error(spark):
    bad = golden_lines(spark).withColumn("lines", F.expr("transform(lines, (l, i) -> if(i = 2, '1 2', l))"))
    with pytest.raises(Exception, match="ncols"):
        tiling.split_rasters(bad, 2).collect()


def test_no_shuffle_in_raster_split(spark):
    plan = tiling.split_rasters(rasters_of(spark, [(1, 5, 5)]), 2)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_boxes_agree_with_brute_force(spark, monkeypatch):
    shapes = [(1, 40, 33), (2, 17, 20)]
    length = 8
    rasters = rasters_of(spark, shapes).withColumn("xll", F.col("region_no") * 7.0)
    tiles = tiling.with_tile_key(tiling.split_rasters(rasters, length))
    meta = rasters.drop("path", "lines").withColumn("tile_length", F.lit(length))
    index = boxes.build_geo_index(meta, 2)
    placed = boxes.tile_extents(tiles, length).collect()
    for box in (boxes.Box(8.0, 21.0, 15.0, 30.0), boxes.Box(100.0, 0.0, 120.0, 10.0), boxes.Box(11.0, 24.0, 11.1, 24.1)):
        want = {
            r.tile_key
            for r in placed
            if r.lng_min < box.lng_max and r.lng_max > box.lng_min and r.lat_min < box.lat_max and r.lat_max > box.lat_min
        }
        direct = {r.tile_key for r in boxes.tiles_in_box(tiles, box, length).collect()}
        indexed = {r.tile_key for r in boxes.tiles_in_box_indexed(tiles, index, box, 2).collect()}
        assert direct == indexed == want
    monkeypatch.setattr(boxes, "MAX_BOX_CELLS", 1)
    wide = boxes.Box(-170.0, -80.0, 170.0, 80.0)
    assert boxes.tiles_in_box_indexed(tiles, index, wide, 2).count() == tiles.count()


def test_directory_matches_tiles(spark):
    rasters = rasters_of(spark, [(1, 40, 33), (2, 16, 16)])
    tiles = tiling.with_tile_key(tiling.split_rasters(rasters, 8))
    meta = rasters.drop("path", "lines").withColumn("tile_length", F.lit(8))
    edges = ["tile_key", "lng_min", "lat_min", "lng_max", "lat_max"]
    listed = {tuple(r) for r in boxes.tile_directory(meta).select(*edges).collect()}
    assert listed == {tuple(r) for r in boxes.tile_extents(tiles, 8).select(*edges).collect()}


def test_geohash_and_shift(spark):
    lng, lat = gcj02_to_wgs84(F.lit(116.404), F.lit(39.915))
    row = spark.range(1).select(
        geohash(F.lit(-5.6), F.lit(42.6), 5).alias("a"),
        geohash(F.lit(112.5584), F.lit(37.8324), 9).alias("b"),
        lng.alias("lng"),
        lat.alias("lat"),
    ).first()
    assert (row.a, row.b) == ("ezs42", "ww8p1r4t8")
    assert (round(row.lng, 6), round(row.lat, 6)) == (116.397756, 39.913596)


def test_valid_mean(spark):
    data = spark.createDataFrame(
        [(1, [1.0, 3.0, -9.0]), (2, [-9.0]), (3, []), (4, [2.0, -2.0])], "id int, data array<float>"
    )
    got = {r.id: r.m for r in data.select("id", valid_mean(F.col("data"), nodata_of(-9)).alias("m")).collect()}
    assert got == {1: 2.0, 2: None, 3: None, 4: 0.0}
