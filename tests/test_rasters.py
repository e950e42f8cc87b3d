"""Raster files and regions, from file to answer."""

import pytest
from pyspark.sql import functions as F

from airlattice.operators import mosaic, regions, tiling
from airlattice.plans import raster_import, region_load, tile_query
from airlattice.schemas import RASTER_META, REGION_DIM
from airlattice.sources import rasters as files
from airlattice.sources import tile_store as store
from airlattice.sources.regions import read_centres, read_region_list

GRID = [[21, 22, 23, 24, 25], [16, 17, 18, 19, 20], [11, 12, 13, 14, 15], [6, 7, 8, 9, 10], [1, 2, 3, 4, 5]]
SIX = "ncols 5\nnrows 5\nxllcorner 100.5\nyllcorner 20\ncellsize 0.5\nNODATA_value -9999\n"
SEVEN = "NROWS 5\nNCOLS 5\nXLLCENTER 100.5\nYLLCENTER 20.0\nDX 0.5\nDY 0.5\nNODATA_VALUE -999.0\n"


def body(shift=0, sep="  ", end=""):
    return "\n".join(sep.join(str(v + shift) for v in row) + end for row in GRID)


@pytest.fixture
def folder(tmp_path):
    inner = tmp_path / "in" / "deeper"
    inner.mkdir(parents=True)
    for name, text in {
        "P%C#2016-05-01H00#pm25.asc": SIX + body(),
        "P%C#2016-05-01H05#pm25.asc": SIX + body(10),
        "P%C#2016-05-01H05#co.asc": SIX + body(50),
        "P#2016-05-01H00#pm25.asc": SEVEN.replace("-999.0", "7") + body(end=" ", sep=" ") + "\n",
        "P%C#2016-05-03H00#pm25.asc": SIX + body(100),
    }.items():
        (inner / name).write_text(text, encoding="utf8")
    return str(tmp_path / "in")


@pytest.fixture
def region_dim(spark):
    return spark.createDataFrame(
        [("0000", "中国", "中国", "", "country"), ("0100", "P", "P", "", "province"), ("0102", "P", "C市", "", "city")],
        "code string, province string, city string, lnglat string, level string",
    )


def test_reading_both_headers(spark, folder):
    read = files.read_asc(spark, folder)
    got = {r.name: r for r in read.collect()}
    assert len(got) == 5
    six, seven = got["P%C#2016-05-01H00#pm25"], got["P#2016-05-01H00#pm25"]
    assert six[2:8] == (5, 5, 100.5, 20.0, 0.5, -9999.0)
    assert seven[2:8] == (5, 5, 100.5, 20.0, 0.5, 7.0)
    rows = files.raster_rows(read.where("name like 'P#%'")).orderBy("row").collect()
    assert [list(r["values"]) for r in rows] == [[float(v) for v in row] for row in GRID]
    assert {r.name for r in files.list_rasters(spark, folder).collect()} == set(got)


def test_reading_in_splits(spark, folder, tmp_path):
    key = lambda df: sorted(tuple(map(str, r)) for r in df.select("name", "row", "nodata", "xll", "values").collect())
    whole = files.raster_rows(files.read_asc(spark, folder))
    assert key(files.read_asc_rows(spark, folder)) == key(whole)
    settings = {"spark.sql.files.maxPartitionBytes": "40", "spark.sql.files.openCostInBytes": "0"}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        split = files.read_asc_rows(spark, folder)
        assert spark.read.option("recursiveFileLookup", True).text(folder).rdd.getNumPartitions() > 15
        assert key(split) == key(whole)
    finally:
        for name in settings:
            spark.conf.unset(name)
    tile_key = lambda df: sorted((r.name, r.x, r.y, r.tile_code, tuple(r.data), r.props) for r in df.collect())
    cut = tiling.split_rasters(files.read_asc(spark, folder), 2)
    by_rows = tiling.split_raster_rows(split, 2)
    assert sorted(cut.columns) == sorted(by_rows.columns)
    assert tile_key(by_rows) == tile_key(cut)
    with pytest.raises(Exception, match="nrows rows"):
        tiling.split_raster_rows(split.where("row <> 3"), 2).collect()
    assert files.read_asc(spark, folder, max_size=10).count() == 0


def test_large_files_take_the_other_way(spark, folder, region_dim):
    tiles = lambda limit: sorted(
        map(str, raster_import.raster_tiles(spark, folder, region_dim, "2016-05-01", "2016-05-02", 2, limit).collect())
    )
    sizes = {r.size for r in files.list_rasters(spark, folder).collect()}
    assert min(sizes) < max(sizes)
    assert tiles(min(sizes)) == tiles(0) == tiles(10**9)


def test_names(spark):
    names = spark.createDataFrame([("A%B#2016-05-01H07#pm25",), ("A#2016-05-01H07#co",)], "name string")
    got = [tuple(r)[1:] for r in files.with_name_parts(names).orderBy(F.desc("name")).collect()]
    assert got == [("A", "B", "2016-05-01 07:00:00", "pm25"), ("A", "A", "2016-05-01 07:00:00", "co")]


def test_missing_header_key_is_an_error(spark, tmp_path):
    (tmp_path / "x.asc").write_text(SIX.replace("cellsize 0.5\n", "") + body())
    with pytest.raises(Exception, match="no cellsize"):
        files.read_asc(spark, str(tmp_path)).collect()


def test_import_then_ask(spark, folder, tmp_path, region_dim):
    tiles_path, meta_path = str(tmp_path / "tiles"), str(tmp_path / "meta")

    def load():
        raster_import.import_rasters(
            spark, folder, region_dim, tiles_path, meta_path, "2016-05-01", "2016-05-02 00:00:00", tile_length=2
        )

    load()
    once = sorted(map(str, store.read_tiles(spark, tiles_path).collect()))
    load()
    assert sorted(map(str, store.read_tiles(spark, tiles_path).collect())) == once
    assert len(once) == 4 * 9
    meta = store.read_meta(spark, meta_path)
    assert {tuple(r) for r in meta.collect()} == {
        (102, 5, 5, 100.5, 20.0, 0.5, -9999.0, 2), (100, 5, 5, 100.5, 20.0, 0.5, 7.0, 2),
    }

    ask = lambda city, start="2016-05-01 00:00:00": tile_query.region_tiles(
        spark, tiles_path, region_dim, "P", city, "pm25", start, "2016-05-02 00:00:00"
    )
    course = {r.bucket: r["mean"] for r in tile_query.time_query(ask("C"), "hours").collect()}
    by_tile = [[21, 22], [23, 24], [25], [16, 17, 11, 12], [18, 19, 13, 14], [20, 15], [6, 7, 1, 2], [8, 9, 3, 4], [10, 5]]
    expected = sum(sum(t) / len(t) for t in by_tile) / 9
    assert course == pytest.approx({"2016-05-01 00": expected, "2016-05-01 05": expected + 10})
    assert tile_query.time_query(ask("C", "2016-05-01 05:00:00"), "day").first()["mean"] == pytest.approx(expected + 10)

    text = [r.value for r in tile_query.heat_map_raster(ask("C"), meta).orderBy("line").collect()]
    assert text[0] == "NCOLS 5" and text[6] == "NODATA_VALUE -9999.0"
    assert text[7:] == ["".join(f"{v + 5.0} " for v in row) for row in GRID]

    # 7 is the province raster's NODATA
    province = tile_query.heat_map(ask("P"))
    assert sum(7.0 in r.data for r in province.collect()) == 1
    with pytest.raises(ValueError, match="unknown region"):
        ask("D")


def test_unknown_region_stops_the_import(spark, folder, region_dim):
    some = region_dim.where("code <> '0102'")
    with pytest.raises(Exception, match="no region code"):
        raster_import.raster_tiles(spark, folder, some, "2016-05-01", "2016-05-02", 2).collect()


def test_import_does_not_shuffle_rasters(spark, folder, region_dim):
    tiles = raster_import.raster_tiles(spark, folder, region_dim, "2016-05-01", "2016-05-02", 2)
    plan = tiles._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Python" not in plan


def test_written_rasters_read_back(spark, tmp_path, folder):
    read = files.read_asc(spark, folder).where("name like '%pm25'")
    tiles = tiling.with_tile_key(tiling.split_rasters(read.withColumn("region_no", F.lit(1).cast("bigint")), 2))
    meta = spark.createDataFrame([(1, 5, 5, 100.5, 20.0, 0.5, -9999.0, 2)], RASTER_META)
    text = mosaic.tiles_to_asc(tiles.withColumnRenamed("name", "raster"), meta, by=["raster"])
    files.write_asc_files(text, str(tmp_path / "out"))
    again = files.read_asc(spark, str(tmp_path / "out"))
    key = lambda df: sorted((r.name, r.row, tuple(r["values"])) for r in files.raster_rows(df).collect())
    assert key(again) == key(read)

    one = text.where("raster like '%H05%'")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files.write_asc(one, str(tmp_path / "one"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted((tmp_path / "one").glob("part-*"))
    lines = "".join(p.read_text() for p in parts).splitlines()
    assert len(lines) == 12 and lines[0] == "NCOLS 5" and lines[7].startswith("31.0 32.0")
    assert len(parts) > 1
    again = files.read_asc_rows(spark, str(tmp_path / "one")).orderBy("row").collect()
    assert [list(r["values"]) for r in again] == [[v + 10.0 for v in row] for row in GRID]

    files.write_single_csv(spark.createDataFrame([("2016", 1.5)], "bucket string, mean double"), str(tmp_path / "csv"))
    assert [p.read_text() for p in (tmp_path / "csv").glob("part-*")] == ["2016,1.5\n"]


def test_region_table(spark, tmp_path):
    (tmp_path / "list.json").write_text(
        '[{"province": "P", "code": "0100", "cities": [{"name": "C市", "code": "0101"}, {"name": "D", "code": "0102"}]},\n'
        ' {"province": "Q", "code": "0200", "cities": []}]',
        encoding="utf8",
    )
    path = str(tmp_path / "list.json")
    assert [len(r.cities) for r in read_region_list(spark, path).orderBy("code").collect()] == [2, 0]
    provinces = spark.createDataFrame([("P", "[1,2]"), ("Q", "[3,4]")], "name string, cp string")
    provinces.createOrReplaceTempView("province_centres")
    cities = spark.createDataFrame([("C市", "[5,6]")], "name string, cp string")
    dim = region_load.load_region_dim(spark, path, read_centres(spark, "province_centres"), cities, str(tmp_path / "dim"))
    assert dim.columns == REGION_DIM.fieldNames()
    assert {(r.code, r.city, r.lnglat, r.level) for r in dim.collect()} == {
        ("0000", "中国", "[108.5525,34.3227]", "country"),
        ("0100", "P", "[1,2]", "province"),
        ("0200", "Q", "[3,4]", "province"),
        ("0101", "C市", "[5,6]", "city"),
    }
    with pytest.raises(Exception, match="province without a centre: Q"):
        regions.build_region_dim(read_region_list(spark, path), provinces.where("name = 'P'"), cities).collect()

    asked = spark.createDataFrame([("P", "C"), ("P", "C市"), ("P", "P"), ("Q", "C")], "province string, city string")
    got = {(r.province, r.city): (r.code, r.province_no, r.city_no, r.region_no) for r in regions.resolve_region(asked, dim).collect()}
    assert got == {
        ("P", "C"): ("0101", 1, 1, 101), ("P", "C市"): ("0101", 1, 1, 101), ("P", "P"): ("0100", 1, 0, 100),
        ("Q", "C"): (None, None, None, None),
    }
    assert {r.name for r in regions.region_codes(dim).collect()} == {"中国:中国", "P:P", "Q:Q", "P:C市"}
    assert regions.region_names(dim).where("region_no = 101").first().city == "C市"
