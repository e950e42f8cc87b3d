from airlattice.__main__ import arguments, main
from test_rasters import folder, region_dim  # noqa: F401


def test_import_and_ask_from_the_command_line(spark, folder, region_dim, tmp_path):  # noqa: F811
    at = lambda name: str(tmp_path / name)
    region_dim.write.parquet(at("regions"))
    main(["rasters", folder, at("regions"), at("tiles"), at("meta"), "2016-05-01", "2016-05-02 00:00:00"], spark)
    asked = [at("regions"), at("tiles"), at("meta"), "P", "C", "pm25", "2016-05-01 00:00:00", "2016-05-02 00:00:00"]
    main(["course", *asked, at("course"), "--level", "hours"], spark)
    assert [r.value for r in spark.read.text(at("course")).collect()] == ["2016-05-01 00,13.0", "2016-05-01 05,23.0"]
    main(["heat-map", *asked, at("heat")], spark)
    assert spark.read.text(at("heat")).count() == 7 + 5


def test_station_arguments():
    asked = arguments().parse_args(["stations", "in", "p", "l", "t"])
    assert (asked.job, asked.table) == ("stations", "t")
