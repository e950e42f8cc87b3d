"""Time pattern, heat map, statistics, levels: against plain Python."""

import datetime as dt
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from airlattice.functions.timebuckets import bucket_text, epoch_seconds
from airlattice.operators import olap
from airlattice.schemas import PROPS, TILES

NODATA = -999.0


def props(height, width, mark=100.0):
    return (4, 4, mark, 20.0, 0.5, height, width, NODATA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for i in range(200):
        code = rng.randint(0, 5)
        size = 70 if code < 5 else 3
        ts = dt.datetime(2015, 1, 1) + dt.timedelta(hours=rng.randint(0, 20000), seconds=i)
        data = [NODATA if rng.random() < 0.3 or (code == 1 and p == 2) else float(rng.randint(0, 999)) / 8 for p in range(size)]
        if i % 17 == 0:
            data = [NODATA] * size
        out.append((101, code, 10100000 + code, ts, "aqi", props(1, size, float(i)), data))
    return out


@pytest.fixture
def tiles(spark, rows):
    return spark.createDataFrame(rows, TILES)


def mean(values):
    values = [v for v in values if v is not None]
    return sum(values) / len(values) if values else None


def tile_mean(data):
    return mean([v for v in data if v != NODATA])


FORMATS = {
    "hours": lambda t: t.strftime("%Y-%m-%d %H"),
    "hour": lambda t: t.strftime("%Y-%m-%d %H"),
    "day": lambda t: t.strftime("%Y-%m-%d"),
    "month": lambda t: t.strftime("%Y-%m"),
    "season": lambda t: f"{t.year}*{(t.month - 1) // 3 + 1}",
    "year": lambda t: str(t.year),
    "all": lambda t: "0000",
}


def test_time_pattern(tiles, rows):
    for level, text in FORMATS.items():
        want = defaultdict(list)
        for r in rows:
            want[text(r[3])].append(tile_mean(r[6]))
        got = [(r.bucket, r["mean"]) for r in olap.time_pattern(tiles, level).collect()]
        assert [b for b, _ in got] == sorted(want)
        for bucket, value in got:
            expected = mean(want[bucket])
            assert value is None if expected is None else math.isclose(value, expected, rel_tol=1e-12)


def test_bucket_without_valid_cells(tiles):
    empty = tiles.withColumn("data", F.transform("data", lambda v: F.lit(NODATA).cast("float")))
    assert olap.time_pattern(empty, "all").first()["mean"] is None
    assert math.isnan(olap.time_pattern(empty, "all", compat=True).first()["mean"])
    with pytest.raises(ValueError, match="unknown time level"):
        olap.time_pattern(tiles, "week")


def test_other_nodata_value(tiles):
    shifted = tiles.withColumn("data", F.transform("data", lambda v: F.when(v == NODATA, F.lit(-9999.0).cast("float")).otherwise(v)))
    a = olap.time_pattern(tiles, "year").collect()
    assert olap.time_pattern(shifted, "year", nodata=-9999.0).collect() == a


def test_spatial_mean(tiles, rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    for got in olap.spatial_mean(tiles).collect():
        versions = groups.pop(got.tile_key)
        assert len(got.data) == len(versions[0][6])
        for pos, value in enumerate(got.data):
            expected = mean([v[6][pos] for v in versions if v[6][pos] != NODATA])
            assert math.isclose(value, NODATA if expected is None else expected, rel_tol=1e-6)
        assert got.props.lng == max(versions, key=lambda v: v[3])[5][2]
    assert not groups


def test_spatial_mean_of_ragged_versions(spark, rows):
    short = (101, 0, 10100000, dt.datetime(2020, 1, 1), "aqi", props(1, 2), [1.0, 2.0])
    long = (101, 0, 10100000, dt.datetime(2020, 1, 2), "aqi", props(1, 40), [3.0] * 40)
    got = olap.spatial_mean(spark.createDataFrame([short, long], TILES)).first()
    assert list(got.data) == [2.0, 2.5] + [3.0] * 38


def test_spatial_mean_plan_aggregates_before_the_shuffle(tiles):
    plan = olap.spatial_mean(tiles)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Python" not in plan
    assert "partial_avg" in plan


def test_stats(tiles, rows):
    valid = [v for r in rows for v in r[6] if v != NODATA]
    got = olap.tile_stats(tiles).first()
    assert (got.tile_max, got.tile_min) == (max(valid), min(valid))
    assert math.isclose(got.tile_avg, mean([tile_mean(r[6]) for r in rows]), rel_tol=1e-12)
    negative = tiles.withColumn("data", F.transform("data", lambda v: F.when(v == NODATA, v).otherwise(v - F.lit(20000).cast("float"))))
    assert olap.tile_max(negative).first().tile_max == max(valid) - 20000
    none = tiles.where("false")
    assert list(olap.tile_stats(none).first()) == [None, None, None]


def test_key_stats(spark):
    pairs = spark.createDataFrame([("a", 10), ("b", 4), ("a", 10), ("b", 20)], "k string, v int")
    got = {r.k: (r.total, r.n, r["mean"]) for r in olap.key_stats(pairs, ["k"], "v").collect()}
    assert got == {"a": (20, 2, 10.0), "b": (24, 2, 12.0)}


def test_counts_and_first_properties(tiles, rows):
    assert olap.count_tiles(tiles).first().n_tiles == 6
    first = min(rows, key=lambda r: (r[2], r[3]))
    got = {r.name: r.value for r in olap.first_properties(tiles).collect()}
    assert list(got) == PROPS.fieldNames() and tuple(got.values()) == tuple(map(float, first[5]))


def test_levels(tiles, rows):
    facts = olap.with_time_levels(olap.tile_means(tiles))
    step = {(r.year, r.month): r.n for r in olap.roll_up(facts, "time", "day", "tile_mean").collect()}
    want = defaultdict(int)
    for r in rows:
        want[(str(r[3].year), r[3].strftime("%Y-%m"))] += tile_mean(r[6]) is not None
    assert step == dict(want)
    down = olap.drill_down(facts, "time", "year", "2016", "tile_mean").collect()
    assert {r.month for r in down} == {m for y, m in want if y == "2016"}
    everything = olap.roll_up_all(facts, [["year", "month"]], "tile_mean").collect()
    top = [r for r in everything if r.grouping_id == 3]
    assert len(top) == 1 and top[0].n == sum(want.values())
    assert math.isclose(top[0]["mean"], mean([tile_mean(r[6]) for r in rows]), rel_tol=1e-9)
    assert {(r.year, r.month) for r in everything if r.grouping_id == 0} == set(want)
    for bad in (lambda: olap.roll_up(facts, "time", "year", "tile_mean"), lambda: olap.roll_up(facts, "depth", "x", "tile_mean"),
                lambda: olap.drill_down(facts, "time", "hour", "x", "tile_mean")):
        with pytest.raises(ValueError):
            bad()


def test_epoch_seconds(spark):
    times = spark.createDataFrame([("1970-01-02 00:00:01",), (None,)], "t string")
    assert [r[0] for r in times.select(epoch_seconds(F.col("t"))).collect()] == [86401, None]
    with pytest.raises(Exception, match="not a valid time"):
        spark.range(1).select(epoch_seconds(F.lit("2017-12-32 00:00:00"))).collect()
    assert spark.range(1).select(bucket_text(F.lit("2016-04-01 00:00:00").cast("timestamp"), "season")).first()[0] == "2016*2"
