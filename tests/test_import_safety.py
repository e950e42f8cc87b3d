"""The raster import and the tile store lose nothing: odd files, parts, time zones, copies."""

import datetime

import pytest
from pyspark.sql import functions as F

from airlattice.operators import bands, mosaic, olap, tiling
from airlattice.plans import raster_import, tile_query
from airlattice.schemas import TILES
from airlattice.session import shared_folder, staged
from airlattice.sources import rasters as files
from airlattice.sources import tile_store as store
from test_rasters import GRID, SIX, body, region_dim  # noqa: F401
from test_store import tile

WHOLE, BY_ROWS = 10**9, 0


def tiles_of(spark, folder, dim, limit, start="2016-05-01", end="2016-05-09"):
    found = raster_import.raster_tiles(spark, str(folder), dim, start, end, 2, limit)
    return sorted((r.tile_key, str(r.ts), r.pollutant, tuple(r.data), str(r.props)) for r in found.collect())


def lines(text):
    return text.split("\n")


@pytest.mark.parametrize("limit", [WHOLE, BY_ROWS])
@pytest.mark.parametrize(
    "text",
    [
        "\n".join(lines(SIX + body())[:-1]),  # one row short
        SIX + body() + "\n9 9 9 9 9",  # one row over
        SIX + "\n".join(lines(body())[:2]),  # a whole band of tiles missing
        SIX + body() + "\nncols 5",  # header below the body
        SIX + body().replace("21  22", "21"),  # ragged
        "station 5\n" + SIX + body(),  # not a header key
        body(),  # no header at all
    ],
)
def test_unsound_files_are_errors_either_way(spark, tmp_path, region_dim, limit, text):  # noqa: F811
    (tmp_path / "P%C#2016-05-01H00#pm25.asc").write_text(text, encoding="utf8")
    with pytest.raises(Exception):  # noqa: B017
        tiles_of(spark, tmp_path, region_dim, limit)


def test_rows_that_begin_with_nan_are_rows(spark, tmp_path, region_dim):  # noqa: F811
    (tmp_path / "P%C#2016-05-01H00#pm25.asc").write_text(SIX + body().replace("21", "NaN"), encoding="utf8")
    whole = tiles_of(spark, tmp_path, region_dim, WHOLE)
    assert str(whole) == str(tiles_of(spark, tmp_path, region_dim, BY_ROWS))
    assert len(whole) == 9 and "nan" in str(whole)


def test_names_are_never_skipped_silently(spark, tmp_path, region_dim):  # noqa: F811
    (tmp_path / "P%C#2016-05-01H00#pm2.5.asc").write_text(SIX + body(), encoding="utf8")
    assert {t[2] for t in tiles_of(spark, tmp_path, region_dim, WHOLE)} == {"pm2"}
    for odd in ("P%C#2016-05-01H0#co.asc", "notaname.asc"):
        (tmp_path / odd).write_text(SIX + body(), encoding="utf8")
        with pytest.raises(Exception, match="not the name of a raster"):
            tiles_of(spark, tmp_path, region_dim, WHOLE)
        (tmp_path / odd).unlink()


def test_rasters_in_parts(spark, tmp_path, region_dim):  # noqa: F811
    """Parts are one raster whatever their sizes, with names that hold escaped characters."""
    single = tmp_path / "single"
    single.mkdir()
    (single / "P%C#2016-05-01H00#pm25.asc").write_text(SIX + body(), encoding="utf8")
    want = tiles_of(spark, single, region_dim, WHOLE)
    parts = tmp_path / "parts" / "P%C#2016-05-01H00#pm25"
    parts.mkdir(parents=True)
    all_lines = lines(SIX + body())
    for n, (a, b) in enumerate([(0, 1), (1, 8), (8, 9), (9, 11)]):
        (parts / f"part-0000{n}").write_text("\n".join(all_lines[a:b]) + "\n", encoding="utf8")
    for limit in (WHOLE, BY_ROWS, 30):
        assert tiles_of(spark, tmp_path / "parts", region_dim, limit) == want
    listed = files.list_rasters(spark, str(tmp_path / "parts")).collect()
    assert [(r.name, r.in_parts) for r in listed] == [("P%C#2016-05-01H00#pm25", True)]
    (parts / "part-00000").unlink()
    with pytest.raises(Exception, match="no ncols|nrows rows"):
        tiles_of(spark, tmp_path / "parts", region_dim, WHOLE)


def test_what_write_asc_wrote_is_imported(spark, tmp_path, region_dim):  # noqa: F811
    text = [(n, v) for n, v in enumerate(lines(SIX + body()))]
    frame = spark.createDataFrame(text, "line int, value string").repartition(4)
    files.write_asc(frame, str(tmp_path / "P%C#2016-05-01H00#pm25"))
    found = tiles_of(spark, tmp_path, region_dim, WHOLE)
    assert sorted(v for t in found for v in t[3]) == sorted(float(v) for row in GRID for v in row)


def test_time_zone_of_names_is_an_argument(spark, tmp_path, region_dim):  # noqa: F811
    (tmp_path / "P%C#2016-05-01H20#pm25.asc").write_text(SIX + body(), encoding="utf8")
    seconds = set()
    for session_zone in ("UTC", "Asia/Shanghai"):
        spark.conf.set("spark.sql.session.timeZone", session_zone)
        try:
            for zone in ("UTC", "Asia/Shanghai"):
                found = raster_import.raster_tiles(spark, str(tmp_path), region_dim, "2016-05-01", "2016-05-09", 2, zone=zone)
                seconds.add((zone, found.select(F.unix_seconds("ts")).first()[0]))
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
    utc = int(datetime.datetime(2016, 5, 1, 20, tzinfo=datetime.UTC).timestamp())
    assert seconds == {("UTC", utc), ("Asia/Shanghai", utc - 8 * 3600)}


def test_one_version_whatever_the_session_zone(spark, tmp_path):
    tiles = spark.createDataFrame([tile(101, 0, "2016-05-01 20:00:00", "aqi", 1.0)], TILES)
    path = str(tmp_path / "tiles")
    store.upsert_tiles(tiles, path)
    spark.conf.set("spark.sql.session.timeZone", "Asia/Shanghai")
    try:
        store.upsert_tiles(tiles.withColumn("data", F.transform("data", lambda v: v + F.lit(1).cast("float"))), path)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    rows = store.read_tiles(spark, path).collect()
    assert [(str(r.day), r.data[0]) for r in rows] == [("2016-05-01", 2.0)]


def test_copies_in_one_batch_are_stored_once(spark, tmp_path):
    copies = [tile(101, 0, "2016-05-01 00:00:00", "aqi", v) for v in (1.0, 3.0, 2.0)]
    path = str(tmp_path / "tiles")
    store.upsert_tiles(spark.createDataFrame(copies, TILES), path)
    assert [r.data[0] for r in store.read_tiles(spark, path).collect()] == [3.0]
    row = lambda region, length: (region, 5, 5, 0.0, 0.0, 1.0, -9.0, length)
    store.upsert_meta(spark.createDataFrame([row(1, 16), row(1, 8), row(2, 4)], store.RASTER_META), str(tmp_path / "meta"))
    found = store.read_meta(spark, str(tmp_path / "meta")).collect()
    assert sorted((r.region_no, r.tile_length) for r in found) == [(1, 16), (2, 4)]


def test_metadata_is_that_of_the_newest_raster(spark, tmp_path, region_dim):  # noqa: F811
    for folder, hour, x in (("a", "05", 7), ("b", "01", 9)):
        (tmp_path / "in" / folder).mkdir(parents=True)
        text = SIX.replace("100.5", str(x)) + body()
        (tmp_path / "in" / folder / f"P%C#2016-05-01H{hour}#co.asc").write_text(text, encoding="utf8")
    tiles, meta = str(tmp_path / "tiles"), str(tmp_path / "meta")
    raster_import.import_rasters(spark, str(tmp_path / "in"), region_dim, tiles, meta, "2016-05-01", "2016-05-02", 2)
    assert [r.xll for r in store.read_meta(spark, meta).collect()] == [7.0]


def test_other_bands_are_an_error(spark):
    tiles = spark.createDataFrame([tile(101, 0, "2016-05-01 00:00:00", "o3", 1.0)], TILES)
    with pytest.raises(Exception, match="not among the bands: o3"):
        bands.to_wide(tiles).collect()
    assert bands.to_wide(tiles, ("o3",)).first()["o3"][0] == 1.0


def test_clashing_cells(spark):
    cells = spark.createDataFrame([(1, 0, 0, 1.0), (1, 0, 0, 2.0)], "region_no bigint, row int, col int, value float")
    meta = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 1.0, -9.0, 2)], store.RASTER_META)
    value = lambda rule: tiling.split_cells(cells, meta, clash=rule).first()["data"]
    assert (value("max"), value("min")) == ([2.0], [1.0])
    with pytest.raises(Exception, match="different values"):
        value("error")
    with pytest.raises(ValueError, match="unknown rule"):
        value("first")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_read_and_shuffle_once(spark, tmp_path):
    path = str(tmp_path / "tiles")
    store.upsert_tiles(spark.createDataFrame([tile(101, 0, "2016-05-01 00:00:00", "aqi", 1.0)], TILES), path)
    tiles = store.read_tiles(spark, path)
    plan = plan_of(olap.spatial_mean(tiles))
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan
    meta = spark.createDataFrame([(101, 1, 1, 0.0, 0.0, 1.0, -9.0, 2)], store.RASTER_META)
    assert plan_of(tile_query.heat_map_raster(tiles, meta, [101])).count("FileScan") == 1
    cells = spark.createDataFrame([(101, 0, 0, 1.0)], "region_no bigint, row int, col int, value float")
    plan = plan_of(tiling.split_cells(cells.crossJoin(meta.drop("region_no", "xll", "yll", "cellsize", "nodata")), meta))
    assert plan.count("Exchange hashpartitioning") + plan.count("REPARTITION_BY_COL") - plan.count(", REPARTITION_BY_COL") == 1


def test_staged_folders_go(spark):
    with staged(spark.range(3), "gone") as rows:
        folder = rows.inputFiles()[0].rsplit("/", 1)[0]
        assert rows.count() == 3
    assert not spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).exists(
        spark._jvm.org.apache.hadoop.fs.Path(folder)
    )
    assert shared_folder(spark, "x") != shared_folder(spark, "x")


def test_heat_map_text_is_unchanged_by_known_regions(spark):
    tiles = spark.createDataFrame([tile(101, 0, "2016-05-01 00:00:00", "aqi", 1.0)], TILES)
    shape = tiles.select("props.*").first()
    meta = spark.createDataFrame(
        [(101, shape.width, shape.height, 0.0, 0.0, 1.0, shape.nodata, max(shape.width, shape.height))], store.RASTER_META
    )
    some = sorted(map(str, tile_query.heat_map_raster(tiles, meta).collect()))
    assert some == sorted(map(str, tile_query.heat_map_raster(tiles, meta, [101]).collect()))
    assert len(some) == len(mosaic.HEADER_WORDS) + shape.height
