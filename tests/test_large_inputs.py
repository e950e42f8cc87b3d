"""Inputs whose size, not whose rows, is out of the ordinary."""

import os

import pytest
from pyspark.sql import functions as F

from airlattice.functions.hilbert import curve_size, hilbert_code
from airlattice.operators import tiling
from airlattice.registry import rasters
from airlattice.schemas import RASTER_META
from airlattice.sources import rasters as files
from compare import connect, differences


@pytest.fixture
def tall(spark, tmp_path):
    """Orders whose keys make one raster of 9,001 rows, most cells of it missing."""
    keys = [*range(0, 3000, 7), 224_999, 225_000, *range(449_000, 450_000, 3), 450_000]
    orders = spark.createDataFrame([(k, 20_000.0 + k % 977) for k in keys], "o_orderkey bigint, o_totalprice double")
    orders.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    return str(tmp_path)


def test_a_tall_raster_gets_larger_tiles(spark, tall):
    query, sql = rasters.QUERIES["import_parts"]
    con = connect("/root/testdata/sf0.001")
    con.sql(f"CREATE OR REPLACE VIEW orders AS SELECT * FROM '{tall}/orders.parquet/*.parquet'")
    extra, missing, n = differences(spark, con, query, sql, tall)
    assert not extra and not missing and n == 9001 * 50


def test_fitting_lengths(spark):
    assert [tiling.fitting_length(n, 16) for n in (50, 3000, 4095, 4096, 1_080_000)] == [16, 16, 16, 17, 4219]
    for cells in (4095, 4096, 18_000, 1_080_000):
        length = tiling.fitting_length(cells, 16)
        last = (cells - 1) // length
        size = curve_size(F.lit(cells // length + 1), F.lit(1))
        codes = spark.range(last + 1).select(hilbert_code(F.lit(0), F.col("id"), size).alias("code"))
        assert codes.agg(F.max("code")).first()[0] <= 99_999


def test_cells_of_a_large_tile_fall_into_place(spark):
    """A tile of 40 x 30 cells with gaps at both ends and a null cell."""
    meta = spark.createDataFrame([(101, 30, 40, 0.0, 0.0, 1.0, -9.0, 64)], RASTER_META)
    cells = {p: float(p) for p in (1, 2, 5, 700, 701, 1197)} | {600: None}
    rows = [(101, p // 30, p % 30, v) for p, v in cells.items()]
    data = tiling.split_cells(spark.createDataFrame(rows, "region_no bigint, row int, col int, value float"), meta).first()["data"]
    assert data == [-9.0 if cells.get(p) is None else cells[p] for p in range(1200)]


def test_many_folders_are_listed_in_few_tasks(spark, tmp_path):
    """A folder for each raster; every reader lists them in tasks that follow from the cores."""
    context = spark.sparkContext
    most = 4 * context.defaultParallelism
    n = most + 60
    for i in range(n):
        (tmp_path / f"raster={i}").mkdir()
        (tmp_path / f"raster={i}" / "part-00000.txt").write_text("NCOLS 1\nNROWS 1\n")
    before = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    readers = {
        "list": lambda: files.list_rasters(spark, str(tmp_path)), "whole": lambda: files.read_asc(spark, str(tmp_path)),
        "headers": lambda: files.read_headers(spark, str(tmp_path)),
    }
    try:
        for name, read in readers.items():
            context.setJobGroup(f"listing-{name}", name)
            frame = read()
            status = context.statusTracker()
            stages = [s for job in status.getJobIdsForGroup(f"listing-{name}") for s in status.getJobInfo(job).stageIds]
            tasks = [status.getStageInfo(s).numTasks for s in stages]
            assert tasks and max(tasks) <= most
            if name == "list":
                assert frame.count() == n
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == before


def test_parts_of_many_rasters_share_tasks(spark, tmp_path):
    """Rasters in two parts each take as many tasks as there are cores for; one in many parts gets a task for each."""
    most = files.WRITERS_PER_CORE * spark.sparkContext.defaultParallelism
    sizes = {f"r{i}": 2 for i in range(most)} | {"large": most + 3}
    rows = [(name, line, f"{name} {line:04d} " + "x" * (93 - len(name))) for name, parts in sizes.items() for line in range(parts)]
    text = spark.createDataFrame(rows, "raster string, line int, value string").repartition(3, "value")
    files.write_asc_files(text, str(tmp_path / "out"), max_file=100)
    tasks = set()
    for name, parts in sizes.items():
        folder = tmp_path / "out" / f"raster={name}"
        found = sorted(n for n in os.listdir(folder) if n.startswith("part-"))
        assert len(found) == parts
        tasks |= {n.split("-")[1] for n in found}
        lines = [line for n in found for line in (folder / n).read_text().splitlines()]
        assert lines == [value for raster, _, value in rows if raster == name]
    assert len(tasks) == most + 3  # not the 3 * most + 3 parts
