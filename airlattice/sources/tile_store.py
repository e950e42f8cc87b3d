"""The tile table: Parquet folders by pollutant, day and key range, files sorted by tile key and time.

Why this layout: a query names pollutants and a time range, which prune folders, and a region or some
keys, which prune folders by their key range and row groups by statistics and Bloom filters inside the
sorted files. A key range is ten provinces (``KEY_SPAN``), so that a late raster rewrites their tiles on its
day, not those of all; folders per region would make many more, tiny, files.
"""

import contextlib

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from airlattice.functions.cells import nodata_of, valid_cells
from airlattice.functions.keys import KEY_SPAN, REGION_STEP, key_span, region_key_range
from airlattice.joins import MAX_BROADCAST_KEYS, broadcast_if_small, keep_matching
from airlattice.schemas import RASTER_META, TILES
from airlattice.session import staged

PARTITION_BY = ("pollutant", "day", "key_range")
VERSION_KEY = ("tile_key", "pollutant", "ts")

# Most partitions an upsert names as constants in its plan; beyond it joins instead.
MAX_LISTED_PARTITIONS = 2_000

# Tile keys a file is expected to hold: the Bloom filter of its keys gets about 10 bits for each.
BLOOM_KEYS = 20_000
BLOOM = {"parquet.bloom.filter.enabled#tile_key": "true", "parquet.bloom.filter.expected.ndv#tile_key": str(BLOOM_KEYS)}

STORED = T.StructType([*TILES.fields, T.StructField("day", T.DateType()), T.StructField("key_range", T.IntegerType())])

STATES = T.StructType(
    [
        T.StructField("tile_key", T.LongType()),
        *[T.StructField(c, T.LongType()) for c in ("n_versions", "n_valid")],
        *[T.StructField(c, T.DoubleType()) for c in ("mean_total", "cell_total")],
        T.StructField("cell_count", T.LongType()),
        *[T.StructField(c, T.DoubleType()) for c in ("low", "high")],
        T.StructField("pollutant", T.StringType()),
        T.StructField("day", T.DateType()),
        T.StructField("key_range", T.IntegerType()),
    ]
)


def _utc_day(ts: Column) -> Column:
    """The day of an instant in UTC, whatever the session's time zone: a version has one folder."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(ts) / 86_400).cast("int"))


def with_folders(tiles: DataFrame) -> DataFrame:
    """Add the folder columns that follow from time and key, or from the region, whose keys lie in one range."""
    key = F.col("tile_key") if "tile_key" in tiles.columns else F.col("region_no") * REGION_STEP
    return tiles.withColumns({"day": _utc_day(F.col("ts")), "key_range": key_span(key)})


def create_tile_table(spark: SparkSession, name: str, replace: bool = False) -> None:
    """Catalog table for tiles, if absent (or new in any case with ``replace``)."""
    if replace:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in STORED.fields)
    options = ", ".join(f"'{key}' '{value}'" for key, value in BLOOM.items())
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet OPTIONS ({options}) PARTITIONED BY ({', '.join(PARTITION_BY)})"
    )


def keep_last(rows: DataFrame, key, order_by) -> DataFrame:
    """Last row per key. Spark limits each key to one row before the shuffle too, so many copies
    of one key do not meet in one task."""
    window = Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order_by])
    return rows.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")


def write_tiles(tiles: DataFrame, path: str, mode: str = "append", partition_by=PARTITION_BY) -> None:
    """Write tiles. One shuffle by folder; adaptive execution splits large folders over several
    files and packs small ones (without it, a folder is written by one task)."""
    stored = with_folders(tiles).select(*[F.col(f.name).cast(f.dataType) for f in STORED.fields])
    _write_folders(stored, path, mode, partition_by, "tile_key", "ts")


def _by_folder(rows: DataFrame, partition_by, *order: str) -> DataFrame:
    """Rows dealt by folder and sorted within, as they are written."""
    adaptive = rows.sparkSession.conf.get("spark.sql.adaptive.enabled") == "true"
    by_folder = rows.hint("rebalance", *partition_by) if adaptive else rows.repartition(*partition_by)
    return by_folder.sortWithinPartitions(*partition_by, *order)


def _write_folders(rows: DataFrame, path: str, mode: str, partition_by, *order: str) -> None:
    (
        _by_folder(rows, partition_by, *order)
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .options(**BLOOM)
        .partitionBy(*partition_by)
        .parquet(path)
    )


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STORED).parquet(path)


def read_if_present(spark: SparkSession, path: str, schema: T.StructType):
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _touched_folders(rows: DataFrame, partition_by) -> list | None:
    """The folders of ``rows``, None if they are too many to be named in a plan."""
    listed = rows.select(*partition_by).distinct().limit(MAX_LISTED_PARTITIONS + 1).collect()
    return listed if len(listed) <= MAX_LISTED_PARTITIONS else None


def _touched_part(existing: DataFrame, touched: list | None, rows: DataFrame, partition_by) -> DataFrame:
    """Rows of ``existing`` in the folders ``touched``, or in those of ``rows`` if these are not listed."""
    if touched is None:
        return existing.join(rows.select(*partition_by).distinct(), list(partition_by), "left_semi")
    if not touched:
        return existing.where(F.lit(False))
    same = [F.struct(*[F.lit(v) for v in row]) for row in touched]
    condition = F.struct(*[F.col(c) for c in partition_by]).isin(same)
    for c in partition_by:
        condition = condition & F.col(c).isin(sorted({row[c] for row in touched}))
    return existing.where(condition)


def upsert_tiles(
    incoming: DataFrame, path: str, order_by=(), partition_by=PARTITION_BY, replaces: DataFrame = None, states_path: str = None
) -> None:
    """Add tile versions; of several for one (tile, pollutant, time) the last one stays.

    Incoming rows win over stored ones; among themselves the greatest ``order_by`` wins, then the
    greatest cells, so a version is stored once whatever comes in. Only folders that get new rows
    are read and rewritten, and stored rows are shuffled once, for the write. ``incoming`` is
    computed once, into a staging folder that goes afterwards.

    ``replaces``: a short table (with region_no, pollutant, ts and other columns of the tiles) of what
    incoming rows stand for, all of it unique. Stored rows that match it go, and ``incoming`` is then
    neither staged nor compared with itself. ``states_path``: a table of partial states (see
    ``tile_states``) whose folders are made anew where tiles were. Not atomic for readers meanwhile.
    """
    names = [F.col(f.name).cast(f.dataType) for f in STORED.fields]
    if replaces is not None:
        _merge_tiles(with_folders(incoming).select(*names), with_folders(replaces), path, partition_by, replaces.columns, states_path)
        return
    fresh = keep_last(with_folders(incoming), VERSION_KEY, [*order_by, "data"])
    with staged(fresh.select(*names), "upsert") as arriving:
        folders = [c for c in STORED.fieldNames() if c in partition_by and c not in VERSION_KEY]
        _merge_tiles(arriving, arriving.select(*VERSION_KEY, *folders), path, partition_by, VERSION_KEY, states_path)


def _merge_tiles(fresh: DataFrame, replaces: DataFrame, path: str, partition_by, key, states_path: str | None) -> None:
    """``replaces``: unique by ``key``, with the folder columns."""
    spark = fresh.sparkSession
    existing = read_if_present(spark, path, STORED)
    touched = _touched_folders(replaces, partition_by)
    if existing is not None:
        fresh = _with_kept(fresh, replaces, existing, touched, partition_by, key)
    write_tiles(fresh, path, mode="overwrite", partition_by=partition_by)
    if states_path is not None:
        changed = _touched_part(read_tiles(spark, path), touched, replaces, partition_by)
        write_states(tile_states(changed), states_path, mode="overwrite")


def _with_kept(fresh: DataFrame, replaces: DataFrame, existing: DataFrame, touched: list | None, partition_by, key) -> DataFrame:
    """``fresh``, and the stored rows of the touched folders that nothing replaces."""
    gone = broadcast_if_small(replaces.select(*key), MAX_BROADCAST_KEYS)
    kept = _touched_part(existing, touched, replaces, partition_by).join(gone, list(key), "left_anti")
    return kept.select(*STORED.fieldNames()).unionByName(fresh)


# --- tiles as a catalog table -----------------------------------------------------------------


def upsert_table(incoming: DataFrame, name: str, order_by=()) -> None:
    """``upsert_tiles`` by the name of a catalog table, which is made if there is none: the folders that get
    new rows are overwritten as partitions of the table, so the catalog knows them. Read it by
    ``scan_tiles(spark.table(name), ...)``."""
    spark = incoming.sparkSession
    create_tile_table(spark, name)
    names = [F.col(f.name).cast(f.dataType) for f in STORED.fields]
    fresh = keep_last(with_folders(incoming), VERSION_KEY, [*order_by, "data"])
    with staged(fresh.select(*names), "upsert") as arriving:
        replaces = arriving.select(*VERSION_KEY, *[c for c in PARTITION_BY if c not in VERSION_KEY])
        touched = _touched_folders(replaces, PARTITION_BY)
        merged = _with_kept(arriving, replaces, spark.table(name), touched, PARTITION_BY, VERSION_KEY)
        stored = _by_folder(merged, PARTITION_BY, "tile_key", "ts").select(*spark.table(name).columns)
        with _overwriting_partitions(spark):
            stored.write.insertInto(name, overwrite=True)


@contextlib.contextmanager
def _overwriting_partitions(spark: SparkSession):
    """Let inserts that overwrite replace only the partitions they bring rows for."""
    setting = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "dynamic")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def table_statistics(spark: SparkSession, name: str) -> DataFrame:
    """One row: n_rows, low and high (keys) and n_keys (an estimate) of a catalog table, from statistics that one
    scan brings into the catalog, where Spark's cost-based planning finds them too."""
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR COLUMNS tile_key")
    of_table = spark.sql(f"DESCRIBE EXTENDED {name}").where("col_name = 'Statistics'")
    n_rows = of_table.select(F.regexp_extract("data_type", r"(\d+) rows", 1).cast("bigint").alias("n_rows"))
    value = lambda key: F.max(F.when(F.col("info_name") == key, F.col("info_value"))).try_cast("bigint")
    of_keys = spark.sql(f"DESCRIBE EXTENDED {name} tile_key").agg(
        value("min").alias("low"), value("max").alias("high"), value("distinct_count").alias("n_keys")
    )
    return n_rows.join(of_keys)


# --- partial states --------------------------------------------------------------------------


def tile_states(tiles: DataFrame) -> DataFrame:
    """Sums, counts and extremes per tile, pollutant and day: a row each, that others can be merged from.

    n_versions; n_valid, of them those with a valid cell; mean_total, the sum of their means;
    cell_total and cell_count of all valid cells; low and high. All versions of a tile on a day lie in
    one folder of the tile table, so the states of a folder follow from that folder alone.
    """
    marker = nodata_of()
    valid = valid_cells(F.col("data"), marker)
    total = F.aggregate("valid", F.lit(0.0), lambda a, v: a + v)
    each = tiles.select("tile_key", "pollutant", "day", "key_range", valid.alias("valid"))
    sums = each.select(
        "tile_key", "pollutant", "day", "key_range", F.size("valid").cast("bigint").alias("n"), total.alias("total"),
        F.array_min("valid").cast("double").alias("low"), F.array_max("valid").cast("double").alias("high"),
    )
    return sums.groupBy("tile_key", "pollutant", "day", "key_range").agg(
        F.count(F.lit(1)).alias("n_versions"),
        F.count_if(F.col("n") > 0).alias("n_valid"),
        F.sum(F.try_divide("total", "n")).alias("mean_total"),
        F.sum("total").alias("cell_total"),
        F.sum("n").alias("cell_count"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
    )


def write_states(states: DataFrame, path: str, mode: str = "append") -> None:
    """Partial states in folders like those of the tiles; those that ``states`` has rows for are replaced
    with mode "overwrite"."""
    _write_folders(states.select(*STATES.fieldNames()), path, mode, PARTITION_BY, "tile_key")


def read_states(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STATES).parquet(path)


def scan_states(states: DataFrame, region_no: int = None, first_day: str = None, last_day: str = None, pollutants=None) -> DataFrame:
    """States of a region, from one day to another (both included), of some pollutants; all three prune
    folders."""
    found = states
    if pollutants is not None:
        found = found.where(F.col("pollutant").isin(list(pollutants)))
    if region_no is not None:
        found = scan_keys(found, *region_key_range(region_no))
    if first_day is not None:
        found = found.where(F.col("day") >= F.lit(first_day).cast("date"))
    if last_day is not None:
        found = found.where(F.col("day") <= F.lit(last_day).cast("date"))
    return found


# --- scans -----------------------------------------------------------------------------------


def scan_tiles(
    tiles: DataFrame, region_no: int = None, start: str = None, end: str = None, pollutants=None, columns=None
) -> DataFrame:
    """Tiles of a region, in a time range (start inclusive, end exclusive), of some pollutants.

    All three reach the files: tile keys and times as Parquet filters, key ranges, pollutants and days
    (of UTC) as folder filters.
    """
    found = tiles
    if pollutants is not None:
        found = found.where(F.col("pollutant").isin(list(pollutants)))
    if region_no is not None:
        found = scan_keys(found, *region_key_range(region_no))
    has_day = "day" in tiles.columns
    if start is not None:
        first = F.lit(start).cast("timestamp")
        found = found.where(F.col("ts") >= first)
        found = found.where(F.col("day") >= _utc_day(first)) if has_day else found
    if end is not None:
        last = F.lit(end).cast("timestamp")
        found = found.where(F.col("ts") < last)
        found = found.where(F.col("day") <= _utc_day(last)) if has_day else found
    return found.select(*columns) if columns else found


def scan_keys(tiles: DataFrame, start_key: int, stop_key: int) -> DataFrame:
    """Tiles in a key range: start inclusive, stop exclusive."""
    found = tiles.where((F.col("tile_key") >= start_key) & (F.col("tile_key") < stop_key))
    if "key_range" in tiles.columns:
        found = found.where(F.col("key_range").between(start_key // KEY_SPAN, max(stop_key - 1, start_key) // KEY_SPAN))
    return found


def _in_ranges_of(tiles: DataFrame, keys) -> DataFrame:
    """Only the folders whose key ranges hold some of the keys."""
    if "key_range" not in tiles.columns:
        return tiles
    return tiles.where(F.col("key_range").isin(sorted({k // KEY_SPAN for k in keys if k is not None})))


def latest_tiles(tiles: DataFrame, by=("tile_key", "pollutant")) -> DataFrame:
    """Newest version of each tile and pollutant."""
    return keep_last(tiles, by, ["ts"])


def get_tile(tiles: DataFrame, key: int, *columns: str) -> DataFrame:
    """Some columns of one tile."""
    return _in_ranges_of(tiles, [key]).where(F.col("tile_key") == key).select(*columns)


def get_tiles(tiles: DataFrame, keys, keep_missing: bool = False) -> DataFrame:
    """Tiles by a list of keys or a DataFrame with ``tile_key``; with ``keep_missing`` a key
    without tiles gives one row of NULLs."""
    if not isinstance(keys, DataFrame):
        tiles = _in_ranges_of(tiles, keys)
        if not keep_missing:
            return tiles.where(F.col("tile_key").isin(list(keys)))
        keys = tiles.sparkSession.createDataFrame([(k,) for k in keys], "tile_key bigint")
    found = keep_matching(tiles, keys, "tile_key")
    if keep_missing:
        return keys.select("tile_key").distinct().join(found, "tile_key", "left").select(*tiles.columns)
    return found


# --- raster metadata ------------------------------------------------------------------------


def merge_meta(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Raster metadata with incoming regions in place of stored ones (incoming must be unique)."""
    names = RASTER_META.fieldNames()
    kept = existing.join(incoming.select("region_no"), "region_no", "left_anti")
    return kept.select(*names).unionByName(incoming.select(*names))


def upsert_meta(incoming: DataFrame, path: str, order_by=()) -> None:
    """Add raster metadata by region, one row each: of several incoming ones the greatest ``order_by``
    wins, then the greatest of the other columns. The merged table is staged first, so that the
    stored one is not overwritten while it is read."""
    names = RASTER_META.fieldNames()
    fresh = keep_last(incoming, ["region_no"], [*order_by, *names[1:]]).select(*names)
    existing = read_if_present(incoming.sparkSession, path, RASTER_META)
    with staged(fresh if existing is None else merge_meta(existing, fresh), "raster-meta") as merged:
        merged.write.mode("overwrite").parquet(path)


# --- GeoHash index ---------------------------------------------------------------------------


def write_geo_index(index: DataFrame, path: str) -> None:
    """An index (see ``build_geo_index``) sorted by cell, so that a cell is found by file statistics."""
    index.repartitionByRange("geohash").sortWithinPartitions("geohash").write.mode("overwrite").parquet(path)


def refresh_geo_index(changed: DataFrame, path: str) -> None:
    """Replace the regions of ``changed``, an index of new or altered regions, in a stored one."""
    existing = read_if_present(changed.sparkSession, path, changed.schema)
    if existing is None:
        return write_geo_index(changed, path)
    kept = existing.join(changed.select("region_no").distinct(), "region_no", "left_anti").select(*changed.columns)
    with staged(kept.unionByName(changed), "geo-index") as merged:
        write_geo_index(merged, path)


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RASTER_META).parquet(path)
