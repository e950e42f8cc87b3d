"""What late data touches: key ranges, partial states, the import ledger, intervals of keys, Bloom filters."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from airlattice.functions.hilbert import curve_intervals, hilbert_code
from airlattice.operators import boxes, olap
from airlattice.plans import raster_import, tile_query
from airlattice.schemas import RASTER_META, TILES
from airlattice.session import shared_folder
from airlattice.sources import rasters as files
from airlattice.sources import tile_store as store
from test_rasters import SIX, body, region_dim  # noqa: F401
from test_store import contents, tile


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def stored(spark, tmp_path):
    """Tiles and states of three key ranges, two days, two pollutants."""
    rows = [
        tile(region, code, f"2016-05-0{day} 0{hour}:00:00", pollutant, float(region + code + hour))
        for region in (101, 102, 2205, 9999) for code in (0, 3) for day in (1, 2) for hour in (0, 5) for pollutant in ("aqi", "co")
    ]
    tiles, states = str(tmp_path / "tiles"), str(tmp_path / "states")
    store.upsert_tiles(spark.createDataFrame(rows, TILES), tiles, states_path=states)
    return tiles, states


def files_below(path):
    return {os.path.join(folder, n) for folder, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def test_a_late_tile_rewrites_one_range(spark, stored):
    tiles, states = stored
    before = files_below(tiles), files_below(states)
    late = spark.createDataFrame([tile(2205, 3, "2016-05-02 05:00:00", "co", -5.0)], TILES)
    store.upsert_tiles(late, tiles, states_path=states)
    for path, old in zip(stored, before):
        gone = {os.path.relpath(f, path).rsplit("/", 1)[0] for f in old - files_below(path)}
        assert gone == {"pollutant=co/day=2016-05-02/key_range=2"}
    assert [r[3] for r in contents(store.read_tiles(spark, tiles)) if r[3] < 0] == [-5.0]
    assert same_states(spark, tiles, states)


def same_states(spark, tiles, states):
    want = sorted(map(str, store.tile_states(store.read_tiles(spark, tiles)).select(*store.STATES.fieldNames()).collect()))
    return sorted(map(str, store.read_states(spark, states).collect())) == want


def test_scans_prune_key_ranges(spark, stored):
    tiles = store.read_tiles(spark, stored[0])
    for found, ranges in (
        (store.scan_tiles(tiles, 2205), "[2]"), (store.get_tile(tiles, 999900003, "ts"), "[9]"),
        (store.get_tiles(tiles, [10100000, 220500003]), "[0, 2]"), (store.scan_keys(tiles, 0, 200000000), "[0, 1]"),
    ):
        assert "key_range" in plan_of(found).split("PartitionFilters")[1].split("PushedFilters")[0], ranges
        assert found.count() > 0


def test_states_give_what_the_tiles_give(spark, stored):
    tiles, states = store.read_tiles(spark, stored[0]), store.read_states(spark, stored[1])
    for level in ("day", "month", "season", "year", "all"):
        for weighted in (False, True):
            got = olap.state_pattern(states, level, weighted).collect()
            assert got == olap.time_pattern(tiles, level, weighted=weighted).collect()
    row = olap.state_stats(states).first()
    assert (row.tile_avg, row.tile_max, row.tile_min) == tuple(olap.tile_stats(tiles).first())
    with pytest.raises(ValueError, match="by day"):
        olap.state_pattern(states, "hours")
    for asked in (olap.state_pattern(states, "month"), olap.state_stats(states, ["pollutant"])):
        assert "data#" not in plan_of(asked) and stored[1] in plan_of(asked)
    plan = plan_of(store.scan_states(states, 2205, "2016-05-02", "2016-05-02", ["co"]))
    filters = plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert all(c in filters for c in ("pollutant", "day", "key_range"))


def test_states_of_tiles_without_valid_cells(spark, tmp_path):
    tiles, states = str(tmp_path / "t"), str(tmp_path / "s")
    store.upsert_tiles(spark.createDataFrame([tile(101, 0, "2016-05-01 00:00:00", "aqi", -999.0)], TILES), tiles, states_path=states)
    row = store.read_states(spark, states).first()
    assert (row.n_versions, row.n_valid, row.mean_total, row.cell_count, row.low, row.high) == (1, 0, None, 0, None, None)
    assert olap.state_pattern(store.read_states(spark, states), "day").first()["mean"] is None


def test_roll_up_of_states(spark, stored):
    states = store.read_states(spark, stored[1])
    places = spark.createDataFrame([(101, "north"), (102, "north"), (2205, "south")], "region_no bigint, area string")
    levels = olap.roll_up_states(states, [["year", "day"], ["area", "region_no"]], places)
    total = levels.where("grouping_id = 15").first()
    assert total.n == 3 * 2 * 2 * 2 * 2 * 4  # regions, codes, days, hours, pollutants, cells
    north = levels.where("area = 'north' and grouping_id = 13").first()
    assert (north.low, north.high) == (101.0, 110.0)


def test_more_folders_than_are_listed(spark, stored, monkeypatch):
    monkeypatch.setattr(store, "MAX_LISTED_PARTITIONS", 1)
    doubled = store.read_tiles(spark, stored[0]).withColumn("data", F.transform("data", lambda v: v * F.lit(2).cast("float")))
    rows = spark.createDataFrame(doubled.collect(), doubled.schema)
    store.upsert_tiles(rows, stored[0], states_path=stored[1])
    assert same_states(spark, *stored)


def test_bloom_filter_drops_row_groups(spark, stored):
    """A key that lies between a file's least and greatest, but is not in it, reads no row."""
    tiles = store.read_tiles(spark, stored[0])
    found = store.get_tile(tiles.where("pollutant = 'co' and day = date'2016-05-01'"), 10100002, "ts")
    assert found.collect() == []
    assert _rows_scanned(found) == 0
    hit = store.get_tile(tiles.where("pollutant = 'co' and day = date'2016-05-01'"), 10100003, "ts")
    assert len(hit.collect()) == 2 and _rows_scanned(hit) > 0


def _rows_scanned(df):
    plan = df._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().head()
    return plan.metrics().apply("numOutputRows").value()


# --- import ledger ---------------------------------------------------------------------------


def import_all(spark, tmp_path, region_dim):  # noqa: F811
    raster_import.import_rasters(
        spark, str(tmp_path / "in"), region_dim, str(tmp_path / "tiles"), str(tmp_path / "meta"), "2016-05-01", "2016-05-09", 2,
        ledger_path=str(tmp_path / "ledger"), states_path=str(tmp_path / "states"),
    )


def spoil(path):
    """Other bytes of the same number, at the same time: only who opens the file can tell."""
    at = path.stat()
    path.write_bytes(b"x" * at.st_size)
    os.utime(path, ns=(at.st_atime_ns, at.st_mtime_ns))


def later(path, text):
    at = path.stat().st_mtime_ns if path.exists() else 0
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf8")
    os.utime(path, ns=(at + 10**10, at + 10**10))


def test_only_new_and_changed_rasters_are_opened(spark, tmp_path, region_dim):  # noqa: F811
    one, two, three = (tmp_path / "in" / f"P%C#2016-05-0{d}H05#co.asc" for d in (1, 2, 3))
    later(one, SIX + body())
    later(two, SIX + body())
    import_all(spark, tmp_path, region_dim)
    first = contents(store.read_tiles(spark, str(tmp_path / "tiles")))
    spoil(one)
    import_all(spark, tmp_path, region_dim)  # nothing to open
    assert contents(store.read_tiles(spark, str(tmp_path / "tiles"))) == first
    later(two, SIX.replace("100.5", "7") + body().replace("21", "77"))
    later(three, SIX.replace("100.5", "9") + body())
    import_all(spark, tmp_path, region_dim)  # still not the spoiled one
    tiles = contents(store.read_tiles(spark, str(tmp_path / "tiles")))
    assert len(tiles) == len(first) * 3 // 2 and {r for r in first if "05-01" in r[2]} <= set(tiles)
    assert any(77.0 in r.data for r in store.read_tiles(spark, str(tmp_path / "tiles")).where("day = date'2016-05-02'").collect())
    assert [r.xll for r in store.read_meta(spark, str(tmp_path / "meta")).collect()] == [9.0]
    assert same_states(spark, str(tmp_path / "tiles"), str(tmp_path / "states"))


def test_an_older_late_raster_leaves_the_metadata(spark, tmp_path, region_dim):  # noqa: F811
    later(tmp_path / "in" / "P%C#2016-05-03H05#co.asc", SIX.replace("100.5", "9") + body())
    import_all(spark, tmp_path, region_dim)
    later(tmp_path / "in" / "P%C#2016-05-02H05#co.asc", SIX.replace("100.5", "8") + body())
    import_all(spark, tmp_path, region_dim)
    assert [r.xll for r in store.read_meta(spark, str(tmp_path / "meta")).collect()] == [9.0]


def test_a_rival_that_wins_or_leaves_is_noticed(spark, tmp_path, region_dim):  # noqa: F811
    """Two files for one version: the last by path counts, also when it comes later or goes again."""
    mine = lambda: {v for r in store.read_tiles(spark, str(tmp_path / "tiles")).collect() for v in r.data}
    later(tmp_path / "in" / "a" / "P%C#2016-05-01H05#co.asc", SIX + body())
    import_all(spark, tmp_path, region_dim)
    rival = tmp_path / "in" / "b" / "P%C#2016-05-01H05#co.asc"
    later(rival, SIX + body().replace("21", "77"))
    import_all(spark, tmp_path, region_dim)
    assert 77.0 in mine() and 21.0 not in mine()
    rival.unlink()
    import_all(spark, tmp_path, region_dim)
    assert 21.0 in mine() and 77.0 not in mine()


def test_a_failed_import_is_not_recorded_and_leaves_no_folder(spark, tmp_path, region_dim):  # noqa: F811
    base = shared_folder(spark, "x").rsplit("/", 1)[0]
    before = set(os.listdir(base)) if os.path.isdir(base) else set()
    name = tmp_path / "in" / "P%C#2016-05-01H05#co.asc"
    later(name, SIX + "1 2 3")
    with pytest.raises(Exception):  # noqa: B017
        import_all(spark, tmp_path, region_dim)
    assert raster_import.read_ledger(spark, str(tmp_path / "ledger")) is None
    later(name, SIX + body())
    import_all(spark, tmp_path, region_dim)
    assert raster_import.read_ledger(spark, str(tmp_path / "ledger")).count() == 1
    assert store.read_tiles(spark, str(tmp_path / "tiles")).count() > 0
    assert set(os.listdir(base)) == before


def test_large_rasters_leave_no_folder_either(spark, tmp_path, region_dim):  # noqa: F811
    later(tmp_path / "in" / "P%C#2016-05-01H05#co.asc", SIX + body())
    base = shared_folder(spark, "x").rsplit("/", 1)[0]
    before = set(os.listdir(base)) if os.path.isdir(base) else set()
    raster_import.import_rasters(
        spark, str(tmp_path / "in"), region_dim, str(tmp_path / "t"), str(tmp_path / "m"), "2016-05-01", "2016-05-09", 2, max_whole_file=0
    )
    assert store.read_tiles(spark, str(tmp_path / "t")).count() > 0 and set(os.listdir(base)) == before


def test_headers_alone(spark, tmp_path):
    later(tmp_path / "in" / "P%C#2016-05-01H05#co.asc", SIX + body())
    later(tmp_path / "in" / "P%C#2016-05-02H05#co.asc", SIX.replace("100.5", "7") + body())
    columns = ["path", *files.HEADER_KEYS]
    whole = sorted(files.read_asc(spark, str(tmp_path / "in")).select(columns).collect())
    assert sorted(files.read_headers(spark, str(tmp_path / "in")).select(columns).collect()) == whole
    assert files.read_headers(spark, str(tmp_path / "in"), [whole[1].path]).select(columns).collect() == [whole[1]]


# --- intervals of keys -----------------------------------------------------------------------


def test_intervals_of_every_rectangle(spark):
    """All rectangles of small curves, and random ones of larger, against the codes of their positions."""
    rng = random.Random(6)
    rows = [(n, a, b, c, d) for n in (2, 4) for a in range(n) for b in range(a, n) for c in range(n) for d in range(c, n)]
    for n in (8, 16, 32, 64):
        for _ in range(25):
            rows.append((n, *sorted(rng.choices(range(n), k=2)), *sorted(rng.choices(range(n), k=2))))
    frame = spark.createDataFrame(rows, "n long, a long, b long, c long, d long")
    found = frame.select("*", curve_intervals(*[F.col(c) for c in "nabcd"]).alias("found")).collect()
    codes = {}
    for n in {r[0] for r in rows}:
        grid = spark.range(n * n).select((F.col("id") % n).alias("x"), F.floor(F.col("id") / n).alias("y"))
        codes |= {(n, r.x, r.y): r.code for r in grid.select("x", "y", hilbert_code(F.col("x"), F.col("y"), F.lit(n).cast("long")).alias("code")).collect()}
    for r in found:
        want = []
        for code in sorted(codes[r.n, x, y] for x in range(r.a, r.b + 1) for y in range(r.c, r.d + 1)):
            if want and want[-1][1] == code - 1:
                want[-1] = (want[-1][0], code)
            else:
                want.append((code, code))
        assert [tuple(i) for i in r.found] == want


@pytest.mark.parametrize("most", [1, 3, 256])
def test_boxes_by_intervals(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(boxes, "MAX_KEY_INTERVALS", most)
    meta = spark.createDataFrame(
        [(101, 37, 29, 100.0, 20.0, 0.5, -999.0, 2), (102, 5, 5, 300.0, 20.0, 0.5, -999.0, 2), (2205, 64, 64, 105.0, 22.0, 0.25, -999.0, 4)], RASTER_META
    )
    directory = boxes.tile_directory(meta)
    tiles = directory.select(
        "region_no", "tile_code", "tile_key", F.lit(dt.datetime(2016, 5, 1)).alias("ts"), F.lit("co").alias("pollutant"),
        F.lit(None).cast(TILES["props"].dataType).alias("props"), F.array(F.lit(1.0).cast("float")).alias("data"),
    )
    path = str(tmp_path / "tiles")
    store.write_tiles(tiles, path)
    kept = store.read_tiles(spark, path)
    for box in (boxes.Box(103.2, 21.1, 112.9, 30.6), boxes.Box(100.0, 20.0, 101.0, 21.0), boxes.Box(0.0, 0.0, 1.0, 1.0), boxes.Box(0, 0, 400, 80)):
        found = boxes.tiles_in_box_ranges(kept, box, meta)
        want = sorted(r.tile_key for r in directory.where(boxes._overlaps(box)).collect())
        assert sorted(r.tile_key for r in found.collect()) == want
        if want:
            plan = plan_of(found)
            assert "GreaterThanOrEqual(tile_key" in plan and "key_range" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
            pushed = plan.split("== Initial Plan ==")[0].split("PushedFilters")[1]
            assert pushed.count("GreaterThanOrEqual(tile_key") <= most
    monkeypatch.setattr(boxes, "MAX_BOX_REGIONS", 1)
    assert boxes.tiles_in_box_ranges(kept, boxes.Box(0, 0, 400, 80), meta).count() == directory.count()


def test_gaps_are_closed_from_the_smallest():
    intervals = [(0, 3), (5, 5), (20, 30), (32, 40), (90, 91)]
    assert boxes.close_gaps(intervals, 9) == intervals
    assert boxes.close_gaps(intervals, 3) == [(0, 5), (20, 40), (90, 91)]
    assert boxes.close_gaps(intervals, 1) == [(0, 91)] and boxes.close_gaps([], 4) == []


def test_box_questions_use_intervals(spark, tmp_path):
    meta = spark.createDataFrame([(101, 40, 40, 100.0, 20.0, 0.5, -999.0, 2)], RASTER_META)
    rows = [tile(101, code, "2016-05-01 00:00:00", "co", 1.0) for code in range(0, 400, 7)]
    store.write_tiles(spark.createDataFrame(rows, TILES), str(tmp_path / "t"))
    found = tile_query.box_tiles(spark, str(tmp_path / "t"), meta, boxes.Box(102, 22, 109, 28), "co", "2016-05-01 00:00:00", "2016-05-02 00:00:00")
    assert 0 < found.count() < len(rows) and "In(tile_key" not in plan_of(found)


def test_rasters_of_mixed_sizes_in_one_write(spark, tmp_path, region_dim):  # noqa: F811
    """Large rasters become ordered parts, small ones one file; all are imported alike."""
    small, large = "P%C#2016-05-01H00#pm25", "P%C#2016-05-01H01#pm25"
    rng = random.Random(5)
    texts = {}
    for name, rows in ((small, 3), (large, 300)):
        cells = [" ".join(str(rng.randrange(1000)) for _ in range(7)) for _ in range(rows)]
        texts[name] = ["ncols 7", f"nrows {rows}", "xllcorner 1", "yllcorner 2", "cellsize 0.5", "NODATA_value -9", *cells]
    lines = [(name, i, line) for name, own in texts.items() for i, line in enumerate(own)]
    rng.shuffle(lines)
    written = str(tmp_path / "out")
    files.write_asc_files(spark.createDataFrame(lines, "raster string, line int, value string").repartition(5), written, max_file=900)
    listed = {r.name: r for r in files.list_rasters(spark, written).collect()}
    assert {name: r.in_parts for name, r in listed.items()} == {small: False, large: True}
    for name, own in texts.items():
        folder = os.path.normpath(listed[name].path.removeprefix("file:"))
        parts = sorted(n for n in os.listdir(folder) if n.startswith("part-"))
        read = [line for n in parts for line in open(os.path.join(folder, n), encoding="utf8").read().splitlines()]
        assert read == own
    raster_import.import_rasters(spark, written, region_dim, str(tmp_path / "t"), str(tmp_path / "m"), "2016", "2017", 4)
    cells = store.read_tiles(spark, str(tmp_path / "t")).groupBy(F.hour("ts").alias("h")).agg(F.sum(F.size("data")).alias("n"))
    assert sorted(map(tuple, cells.collect())) == [(0, 21), (1, 2100)]


def test_upserts_by_table_name(spark, tmp_path):
    """The table takes the same rows as a folder does, rewrites one partition for a late tile, and keeps its
    setting for overwrites."""
    rows = [
        tile(region, code, f"2016-05-0{day} 00:00:00", pollutant, float(region + code))
        for region in (101, 2205) for code in (0, 3) for day in (1, 2) for pollutant in ("aqi", "co")
    ]
    name = "tiles_by_name"
    store.create_tile_table(spark, name, replace=True)
    late = [tile(2205, 3, "2016-05-02 00:00:00", "co", -5.0)]
    mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    store.upsert_table(spark.createDataFrame(rows, TILES), name)
    before = {r[0] for r in spark.table(name).select(F.input_file_name()).distinct().collect()}
    store.upsert_table(spark.createDataFrame(late, TILES), name)
    after = {r[0] for r in spark.table(name).select(F.input_file_name()).distinct().collect()}
    assert {tuple(f.split("/")[-4:-1]) for f in before - after} == {("pollutant=co", "day=2016-05-02", "key_range=2")}
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == mode
    for batch in (rows, late):
        store.upsert_tiles(spark.createDataFrame(batch, TILES), str(tmp_path / "folder"))
    assert contents(spark.table(name)) == contents(store.read_tiles(spark, str(tmp_path / "folder")))
    found = store.scan_tiles(spark.table(name), 2205, "2016-05-02 00:00:00", "2016-05-03 00:00:00", ["co"])
    assert found.count() == 2 and "key_range" in plan_of(found).split("PartitionFilters")[1].split("PushedFilters")[0]
    stats = store.table_statistics(spark, name).first()
    assert (stats.n_rows, stats.low, stats.high) == (16, 10100000, 220500003)
    spark.sql(f"DROP TABLE {name}")
