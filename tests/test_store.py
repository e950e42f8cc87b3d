"""Tile and metadata tables: scans, gets, upserts, pruning."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from airlattice import joins
from airlattice.operators import bands
from airlattice.schemas import TILES
from airlattice.sources import tile_store as store

PROPS = (4, 4, 100.0, 20.0, 0.5, 2, 2, -999.0)


def tile(region, code, ts, pollutant, value):
    return (region, code, region * 100000 + code, dt.datetime.fromisoformat(ts), pollutant, PROPS, [value] * 4)


@pytest.fixture
def tiles(spark):
    rows = [
        tile(region, code, f"2016-05-0{day} 0{hour}:00:00", pollutant, float(100 * region + 10 * code + day))
        for region in (101, 102)
        for code in (0, 1)
        for day in (1, 2, 3)
        for hour in (0, 5)
        for pollutant in ("aqi", "co")
    ]
    return spark.createDataFrame(rows, TILES)


def contents(df):
    return sorted((r.tile_key, r.pollutant, str(r.ts), r.data[0]) for r in df.collect())


def test_scan_bounds_and_pruning(spark, tiles, tmp_path):
    path = str(tmp_path / "tiles")
    store.write_tiles(tiles, path)
    stored = store.read_tiles(spark, path)
    assert contents(stored) == contents(tiles)

    found = store.scan_tiles(stored, 101, "2016-05-01 05:00:00", "2016-05-03 00:00:00", ["co"])
    got = contents(found)
    assert {k // 100000 for k, *_ in got} == {101}
    assert {t for _, _, t, _ in got} == {"2016-05-01 05:00:00", "2016-05-02 00:00:00", "2016-05-02 05:00:00"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "day#" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    pushed = plan.split("PushedFilters")[1]
    assert "GreaterThanOrEqual(tile_key" in pushed and "LessThan(ts" in pushed
    narrow = store.scan_tiles(stored, 101, columns=["tile_key", "ts"])._jdf.queryExecution().executedPlan().toString()
    assert "data" not in narrow.split("ReadSchema")[1]


def test_gets(spark, tiles):
    assert store.get_tile(tiles, 10100001, "ts").count() == 12
    assert {k for k, *_ in contents(store.get_tiles(tiles, [10100001, 5]))} == {10100001}
    missing = store.get_tiles(tiles, [10100001, 5], keep_missing=True).collect()
    assert [r.ts for r in missing if r.tile_key == 5] == [None] and len(missing) == 13
    keys = spark.createDataFrame([(10100001,), (10100001,), (10200000,)], "tile_key bigint")
    assert store.get_tiles(tiles, keys).count() == 24
    assert store.scan_keys(tiles, 10100001, 10200001).count() == 24
    newest = store.latest_tiles(tiles).collect()
    assert len(newest) == 8 and {str(r.ts) for r in newest} == {"2016-05-03 05:00:00"}


def test_matching_keys_take_the_way_their_number_asks_for(spark, tiles, monkeypatch):
    keys = spark.createDataFrame([(10100001,), (10100001,), (10200000,), (7,)], "tile_key bigint")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    want = contents(tiles.where("tile_key in (10100001, 10200000)"))
    few = joins.keep_matching(tiles, keys, "tile_key")
    assert contents(few) == want and "Join" not in plan(few)
    monkeypatch.setattr(joins, "MAX_LISTED_KEYS", 1)
    more = joins.keep_matching(tiles, keys, "tile_key")
    assert contents(more) == want and "BroadcastHashJoin" in plan(more)
    monkeypatch.setattr(joins, "MAX_BROADCAST_KEYS", 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # the written keys' size is known to Spark
    try:
        most = joins.keep_matching(tiles, keys, "tile_key")
        assert contents(most) == want and "SortMergeJoin" in plan(most)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert joins.keep_matching(tiles, keys.where("false"), "tile_key").count() == 0


def test_files_per_folder(spark, tiles, tmp_path):
    for adaptive in ("true", "false"):
        path = tmp_path / adaptive
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        try:
            store.write_tiles(tiles.repartition(8), str(path))
        finally:
            spark.conf.unset("spark.sql.adaptive.enabled")
        assert len(list(path.rglob("part-*.parquet"))) == len(list(path.glob("pollutant=*/day=*"))) == 6


def test_upsert_last_write_wins(spark, tiles, tmp_path):
    path = str(tmp_path / "tiles")
    store.upsert_tiles(tiles, path)
    changed = spark.createDataFrame(
        [
            tile(101, 0, "2016-05-01 00:00:00", "aqi", 1.0),
            tile(101, 0, "2016-05-01 00:00:00", "aqi", 2.0),
            tile(103, 0, "2016-05-09 00:00:00", "aqi", 3.0),
        ],
        TILES,
    ).withColumn("seq", F.get("data", F.lit(0)))
    untouched = tmp_path / "tiles" / "pollutant=co"
    before = sorted(str(f) for f in untouched.rglob("*.parquet"))
    store.upsert_tiles(changed, path, order_by=["seq"])
    got = contents(store.read_tiles(spark, path))
    want = [r for r in contents(tiles) if r[:3] != (10100000, "aqi", "2016-05-01 00:00:00")]
    want += [(10100000, "aqi", "2016-05-01 00:00:00", 2.0), (10300000, "aqi", "2016-05-09 00:00:00", 3.0)]
    assert got == sorted(want)
    assert sorted(str(f) for f in untouched.rglob("*.parquet")) == before


def test_upsert_beyond_the_listed_partitions(spark, tiles, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "MAX_LISTED_PARTITIONS", 1)
    path = str(tmp_path / "tiles")
    store.upsert_tiles(tiles, path)
    store.upsert_tiles(tiles.withColumn("data", F.transform("data", lambda v: v * F.lit(2).cast("float"))), path)
    assert [r[3] for r in contents(store.read_tiles(spark, path))] == [2 * r[3] for r in contents(tiles)]


def test_copies_of_one_key_are_reduced_before_the_shuffle(tiles):
    plan = store.keep_last(tiles, store.VERSION_KEY, ["tile_code"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_meta_upsert(spark, tmp_path):
    schema = store.RASTER_META
    path = str(tmp_path / "meta")
    row = lambda region, length: (region, 5, 5, 0.0, 0.0, 1.0, -9.0, length)
    store.upsert_meta(spark.createDataFrame([row(1, 16), row(2, 16)], schema), path)
    store.upsert_meta(spark.createDataFrame([row(2, 8), row(3, 8)], schema), path)
    got = {r.region_no: r.tile_length for r in store.read_meta(spark, path).collect()}
    assert got == {1: 16, 2: 8, 3: 8}


def test_create_table(spark):
    store.create_tile_table(spark, "tile_table")
    store.create_tile_table(spark, "tile_table")
    assert spark.table("tile_table").columns == [
        "region_no", "tile_code", "tile_key", "ts", "props", "data", "pollutant", "day", "key_range",
    ]
    store.create_tile_table(spark, "tile_table", replace=True)


def test_bands_and_versions(spark, tiles):
    wide = bands.to_wide(tiles)
    row = wide.where("tile_key = 10100001 and ts = timestamp'2016-05-01 05:00:00'").first()
    assert list(row.aqi) == list(row.co) == [10111.0] * 4 and row.pm25 is None
    cells = bands.result_map(wide).first().cells
    assert set(cells) == {f"{p}:data" for p in ("aqi", "pm25", "pm10", "co", "no2", "so2")}
    assert bands.property_map(tiles).first().cells["properties:cell_size"] == 0.5
    packed = tiles.where("pollutant = 'aqi'").groupBy("tile_key").agg(
        F.collect_list(F.struct("ts", "data")).alias("versions")
    )
    assert sorted((r.tile_key, str(r.ts)) for r in bands.explode_versions(packed).collect()) == sorted(
        (r.tile_key, str(r.ts)) for r in bands.select_pollutant(tiles, "aqi").collect()
    )
    assert bands.select_pollutant(tiles, "aqi", slim=True).columns == ["tile_key", "ts", "height", "width", "data"]
