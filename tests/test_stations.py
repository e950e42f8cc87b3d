"""Station cleaning: ragged rows, both layouts, lookups, strict and compatible number rules."""

import pytest
from pyspark.sql import functions as F

from airlattice.operators import stations as ops
from airlattice.plans.station_etl import preview, read_rejects, read_valid, run_station_etl, sort_out, station_table
from airlattice.schemas import AIR_DATA
from airlattice.sources.text import read_city_provinces, read_lines, read_locations, write_lines

A = "2015-03-04 05:00:00,Wuhan,S1,1.5,2.5,3,4.5,5,6.5,7,8.5,9,11,12,13,14,15,16"
B = "2016-07-01 00:00:00,Wuhan,S1,1.5,x,x,2.5,4.5,15,8.5,11,13,6.5"
LINES = [
    "time,city,site,aqi",
    A,
    B,
    "2015-03-04 05:00:00,Wuhan,S2,105,20.5, ,_,10,1.05,0,0.5,,abc",
    "2015-03-04 05:00:00,Nowhere,S1,7,,,,",
    "2015/01/01,Wuhan,S1,1,2,3,4",
    "2015-03-04 05:00:00,Wuhan",
    ",,,",
    "time,city,site,aqi",
]


@pytest.fixture
def lines(spark):
    return spark.createDataFrame([(line,) for line in LINES], "value string")


@pytest.fixture
def provinces(spark):
    return spark.createDataFrame([("Wuhan", "Hubei")], "city string, province string")


@pytest.fixture
def locations(spark):
    return spark.createDataFrame([("HubeiWuhanS1", "114.3", "30.6")], "address string, lng string, lat string")


def fields(df):
    return [list(r.fields) for r in df.collect()]


def test_split_drops_headers_and_trailing_blanks(lines):
    rows = fields(ops.split_rows(lines))
    assert [len(r) for r in rows] == [18, 13, 13, 4, 7, 2]
    assert rows[2][5] == " " and rows[2][11] == ""
    assert fields(ops.fill_blanks(ops.split_rows(lines)))[2][5] == "0"


def test_lookups_insert_fields(lines, provinces, locations):
    rows = ops.add_province(ops.fill_blanks(ops.split_rows(lines)), provinces)
    assert sorted((r[2], r[1] or "-") for r in fields(rows)) == sorted(
        [("Wuhan", "Hubei")] * 5 + [("Nowhere", "-")]
    )
    full = {(r[0], r[2], r[3], len(r)): r for r in fields(ops.add_location(rows, locations))}
    assert full[("2015-03-04 05:00:00", "Wuhan", "S1", 21)][4:7] == ["114.3", "30.6", "1.5"]
    assert full[("2015-03-04 05:00:00", "Wuhan", "S2", 16)][4:6] == ["", ""]
    # the row of four fields is too short by now
    assert len(full) == 4


def test_repair_pads_and_checks(lines, provinces, locations):
    full = ops.add_location(ops.add_province(ops.fill_blanks(ops.split_rows(lines)), provinces), locations)
    for compat in (False, True):
        rows = {(r[0], r[3]): r for r in fields(ops.repair_rows(full, compat))}
        s2 = rows[("2015-03-04 05:00:00", "S2")]
        assert len(s2) == 20 and s2[4:6] == ["0", "0"]
        # 105 and 10 hold a 0 before the point, which only the compatible pattern refuses
        assert s2[6] == ("0" if compat else "105")
        assert s2[7] == "20.5"
        assert s2[9:16] == ["0", "0" if compat else "10", "1.05", "0", "0.5", "0", "0"]
        assert rows[(ops.BAD_TIME, "S1")][0] == "0-0-0 00:00:00"


def test_typed_rows(lines, provinces, locations):
    rows = ops.clean_station(lines, provinces, locations).collect()
    typed = ops.clean_station(lines, provinces, locations)
    assert [(f.name, f.dataType) for f in typed.schema] == [(f.name, f.dataType) for f in AIR_DATA]
    by = {(r.time, r.site): r for r in rows}
    old, new = by[("2015-03-04 05:00:00", "S1")], by[("2016-07-01 00:00:00", "S1")]
    want = dict(aqi=1.5, pm25=2.5, pm10=4.5, co=15.0, no2=8.5, ozone1hour=11.0, ozone8hour=13.0, so2=6.5)
    assert {k: old[k] for k in want} == want == {k: new[k] for k in want}
    assert (old.province, old.lng, old.lat) == ("Hubei", 114.3, 30.6)
    assert str(new.ts) == "2016-07-01 00:00:00"
    bad = by[(ops.BAD_TIME, "S1")]
    assert bad.ts is None and bad.aqi == 1.0
    assert by[("2015-03-04 05:00:00", "S2")].lng is None
    compat = {(r.time, r.site): r for r in ops.clean_station(lines, provinces, locations, compat=True).collect()}
    assert compat[("2015-03-04 05:00:00", "S2")].lng == 0.0
    assert compat[("2015-03-04 05:00:00", "S2")].aqi == 0.0


def test_short_way_equals_long_way(lines, provinces, locations):
    for compat in (False, True):
        full = ops.add_location(ops.add_province(ops.fill_blanks(ops.split_rows(lines)), provinces), locations, compat)
        long_way = ops.to_air_data(full, compat)
        short_way = ops.clean_station(lines, provinces, locations, compat)
        assert sorted(map(str, long_way.collect())) == sorted(map(str, short_way.collect()))


def test_valid_rows(spark):
    full = A.split(",")[:1] + ["Hubei"] + A.split(",")[1:3] + ["114.3", "30.6"] + A.split(",")[3:]
    rows = [full, full[:19], full[:6] + ["x"] + full[7:], full[:8] + [" "] + full[9:], full[:12] + ["10"] + full[13:]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, fields array<string>")

    def valid(compat):
        return [r.id for r in df.where(ops.is_valid_row(F.col("fields"), compat)).orderBy("id").collect()]

    assert valid(False) == [0, 4]
    assert valid(True) == [0]


def test_projection_rejects_unknown_names(lines):
    rows = ops.split_rows(lines)
    assert ops.project_columns(rows, ["time", "aqi"]).columns == ["time", "aqi"]
    with pytest.raises(ValueError, match="unknown"):
        ops.project_columns(rows, ["time", "ozone"])


def test_top_lines(lines):
    top = [r.value for r in ops.top_lines(ops.split_rows(lines), 2).collect()]
    assert top == sorted((",".join(line) for line in fields(ops.split_rows(lines))), reverse=True)[:2]


def test_addresses(lines, provinces):
    rows = ops.add_province(ops.fill_blanks(ops.split_rows(lines)), provinces).where(F.size("fields") > 3)
    assert {r.address for r in ops.distinct_addresses(rows, compat=True).collect()} == {
        "HubeiWuhanS1", "HubeiWuhanS2", "nullNowhereS1",
    }
    assert None in {r.address for r in ops.distinct_addresses(rows).collect()}


def test_lookups_join_by_broadcast_without_shuffle(spark, tmp_path, lines):
    write_lines(lines, str(tmp_path / "in"))
    (tmp_path / "p.txt").write_text("province city\nHubei Wuhan\nHunan Wuhan\n", encoding="utf8")
    (tmp_path / "l.txt").write_text("address lng lat\nHunanWuhanS1 1 2\n\nHunanWuhanS1 3 4\n", encoding="utf8")
    table = station_table(spark, str(tmp_path / "in"), str(tmp_path / "p.txt"), str(tmp_path / "l.txt"))
    assert {(r.province, r.lng) for r in table.where("site = 'S1' and city = 'Wuhan'").collect()} == {("Hunan", 3.0)}
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2
    assert "SortMergeJoin" not in plan and "Python" not in plan
    assert read_city_provinces(spark, str(tmp_path / "p.txt")).count() == 1
    assert read_locations(spark, str(tmp_path / "l.txt")).first().lat == "4"
    assert read_lines(spark, str(tmp_path / "in")).count() == len(LINES)


def test_managed_table_and_view(spark, tmp_path, lines):
    write_lines(lines, str(tmp_path / "in"))
    (tmp_path / "p.txt").write_text("province city\nHubei Wuhan", encoding="utf8")
    (tmp_path / "l.txt").write_text("address lng lat", encoding="utf8")
    paths = [str(tmp_path / n) for n in ("in", "p.txt", "l.txt")]
    for _ in range(2):
        run_station_etl(spark, *paths, table="etl_air_data")
    assert spark.table("etl_air_data").count() == 4
    assert preview(spark.table("etl_air_data"), "air_view", 3).count() == 3
    assert spark.sql("select count(*) n from air_view").first().n == 4


def test_rejects_with_reasons(spark, tmp_path, lines, provinces, locations):
    """Valid and rejected lines are all data lines; reasons agree with the strict check."""
    more = [A + ",17", A.replace(",5,", ",x,"), A.replace(",3,", ",_,"), "a,b,c,d,e", "x"]
    every = lines.unionByName(spark.createDataFrame([(m,) for m in more], "value string"))
    for compat in (False, True):
        judged = ops.judged_rows(every, provinces, locations, compat)
        reasons = {r.value: r.reasons for r in judged.collect()}
        assert len(reasons) == ops.data_lines(every).distinct().count()
        full = ops.add_location(ops.add_province(ops.fill_blanks(ops.split_rows(every)), provinces), locations, compat)
        valid = sorted(map(tuple, fields(full.where(ops.is_valid_row(F.col("fields"), compat)))))
        assert sorted(map(tuple, fields(judged.where("size(reasons) = 0")))) == valid
        assert sorted(map(tuple, fields(full)), key=str) == sorted(map(tuple, fields(judged.where("not array_contains(reasons, 'few')"))), key=str)
    reasons = {r.value: r.reasons for r in ops.judged_rows(every, provinces, locations).collect()}
    assert reasons["x"] == ["few"] and reasons["2015-03-04 05:00:00,Wuhan"] == ["few"]
    assert reasons["a,b,c,d,e"] == ["province", "location", "short", "number"]
    assert reasons["2015-03-04 05:00:00,Wuhan,S2,105,20.5, ,_,10,1.05,0,0.5,,abc"] == ["location", "short", "blank", "number"]
    assert reasons[A] == []


def test_sorting_out_counts_in_one_pass(spark, tmp_path, lines):
    write_lines(lines, str(tmp_path / "in"))
    (tmp_path / "p.txt").write_text("province city\nHubei Wuhan", encoding="utf8")
    (tmp_path / "l.txt").write_text("address lng lat\nHubeiWuhanS1 114.3 30.6", encoding="utf8")
    paths = [str(tmp_path / n) for n in ("in", "p.txt", "l.txt", "out")]
    counts = sort_out(spark, *paths)
    valid, rejects = read_valid(spark, paths[3]).collect(), read_rejects(spark, paths[3]).collect()
    assert counts["rows"] == len(valid) + len(rejects) == 6 and counts["valid"] == len(valid)
    assert all(counts[r] == sum(r in row.reasons for row in rejects) for r in ops.REASONS)
    assert {r.value for r in rejects} <= set(LINES)


def test_rows_without_a_key_are_spread(spark, monkeypatch):
    """With no broadcast and a third of all rows without an address, no task gets more than its share."""
    rows = [("2015-03-04 05:00:00", "P", f"C{i % 50}", f"S{i}", "1", "2") if i % 3 else ("2015-03-04 05:00:00", None, "C", f"S{i}", "1", "2") for i in range(3000)]
    frame = spark.createDataFrame([(list(r),) for r in rows], "fields array<string>")
    places = spark.createDataFrame([(f"PC{i % 50}S{i}", str(i), "0") for i in range(3000)], "address string, lng string, lat string")
    for key, value in (("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.adaptive.enabled", "false")):
        spark.conf.set(key, value)
    try:
        joined = ops.add_location(frame, places)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        sizes = [r.n for r in joined.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
        found = joined.where("fields[1] is null").collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "SortMergeJoin" in plan and sum(sizes) == 3000 and max(sizes) < 3000 / len(sizes) * 1.3
    assert len(found) == 1000 and all(r.fields[4:6] == ["", ""] for r in found)
