"""Aggregates, scans and bands over tile versions."""

import uuid

from pyspark.sql import functions as F

from airlattice.operators import bands, olap
from airlattice.registry import standins as st
from airlattice.registry.levels import TIE
from airlattice.schemas import PROPS
from airlattice.sources import tile_store as store

# Fixed values of the questions asked: one region, one time range, one tile, some tiles.
REGION = 201
START, END = "2024-01-05 00:00:00", "2024-01-20 12:00:00"
ONE_TILE = 20100003
SOME_TILES = (20100001, 30200004, 40300007, 99999999)
TS_TEXT = "yyyy-MM-dd HH:mm:ss"


def _text(ts="ts"):
    return F.date_format(ts, TS_TEXT).alias("ts")


def _cells(df, *keys):
    return df.select(*keys, F.posexplode("data").alias("pos", "v")).select(
        *keys, F.col("pos").cast("bigint").alias("pos"), F.round(F.col("v").cast("double"), 6).alias("value")
    )


def _time_pattern(make, level, floor=-0.2):
    def run(spark, sf_dir):
        return olap.time_pattern(make(spark, sf_dir, floor), level).select("bucket", F.round("mean", 6).alias("mean"))

    return run


_BUCKET_SQL = {
    "hour": "strftime(ts, '%Y-%m-%d %H')",
    "day": "strftime(ts, '%Y-%m-%d')",
    "month": "strftime(ts, '%Y-%m')",
    "season": "concat(year(ts), '*', quarter(ts))",
    "year": "strftime(ts, '%Y')",
    "all": "'0000'",
}


def _time_pattern_sql(tiles_sql, level):
    return f"""WITH {tiles_sql}, {st.TILE_MEAN_SQL}
SELECT {_BUCKET_SQL[level]} AS bucket, round(avg(tile_mean), 6) AS mean FROM means GROUP BY 1 ORDER BY 1"""


def time_pattern_weighted(spark, sf_dir):
    """Tiles with many missing cells count less."""
    course = olap.time_pattern(st.day_tiles(spark, sf_dir, 0.25), "month", weighted=True)
    return course.select("bucket", F.round("mean", 6).alias("mean"))


def _spatial_mean(floor):
    def run(spark, sf_dir):
        return _cells(olap.spatial_mean(st.day_tiles(spark, sf_dir, floor)), "tile_key")

    return run


def _spatial_mean_sql(floor):
    return f"""WITH {st.day_tiles_sql(floor)},
cells AS (SELECT tile_key, unnest(data) AS v, generate_subscripts(data, 1) - 1 AS pos FROM tiles)
SELECT tile_key, pos, round(coalesce(avg(CASE WHEN v <> -999 THEN v::DOUBLE END)::FLOAT, -999)::DOUBLE, 6) AS value
FROM cells GROUP BY tile_key, pos"""


def spatial_mean_props(spark, sf_dir):
    """Properties that come with the heat map."""
    means = olap.spatial_mean(st.day_tiles(spark, sf_dir))
    return means.select("tile_key", "props.lng", "props.lat", F.size("data").cast("bigint").alias("n_cells"))


def _stat(name):
    def run(spark, sf_dir):
        stat = getattr(olap, name)(st.hour_tiles(spark, sf_dir))
        return stat.select(F.round(name, 6).alias(name))

    return run


def _stat_sql(name, value):
    return f"""WITH {st.hour_tiles_sql()}, {st.TILE_MEAN_SQL}
SELECT round(({value})::DOUBLE, 6) AS {name} FROM means"""


def stats_by_key(spark, sf_dir):
    stats = olap.key_stats(st.table(spark, sf_dir, "events"), ["event_type"], "value")
    return stats.select("event_type", F.round("total", 2).alias("total"), "n", F.round(F.col("mean") + TIE, 4).alias("mean"))


@st.once
def hour_folder(spark, sf_dir) -> str:
    """The hourly tiles as a tile table, written once per application."""
    path = st.scratch(spark, "hour-tiles")
    store.write_tiles(store.keep_last(st.hour_tiles(spark, sf_dir), store.VERSION_KEY, ["seq"]), path)
    return path


def hour_store(spark, sf_dir):
    return store.read_tiles(st.pin_time_zone(spark), hour_folder(spark, sf_dir))


_STORE_SQL = f"""{st.hour_tiles_sql()},
stored AS (
  SELECT * EXCLUDE n FROM (
    SELECT *, row_number() OVER (PARTITION BY tile_key, pollutant, ts ORDER BY seq DESC) AS n FROM tiles)
  WHERE n = 1)"""

_SUM_SQL = "round(list_sum(list_transform(list_filter(data, lambda v: v <> -999), lambda v: v::DOUBLE)), 6)"


def _summed(tiles, *keys):
    """Keys and the sum of the valid cells."""
    kept = F.filter("data", lambda v: v != st.NODATA)
    total = F.aggregate(kept, F.lit(0.0), lambda a, v: a + v)
    return tiles.select(*keys, F.round(F.when(F.size(kept) > 0, total), 6).alias("total"))


def scan_range(spark, sf_dir):
    found = store.scan_tiles(hour_store(spark, sf_dir), REGION, START, END, ["pm25", "co"])
    return _summed(found, "tile_key", "pollutant", _text())


def tile_count(spark, sf_dir):
    return olap.count_tiles(store.scan_tiles(hour_store(spark, sf_dir), REGION, START, END))


def scan_latest(spark, sf_dir):
    newest = store.latest_tiles(store.scan_keys(hour_store(spark, sf_dir), 20000000, 40000000))
    return _summed(newest, "tile_key", "pollutant", _text())


def point_get(spark, sf_dir):
    found = store.get_tile(hour_store(spark, sf_dir), ONE_TILE, "tile_key", "pollutant", "ts", "data")
    return _cells(found.withColumn("ts", _text()), "tile_key", "pollutant", "ts")


def multi_get(spark, sf_dir):
    return _summed(store.get_tiles(hour_store(spark, sf_dir), SOME_TILES), "tile_key", "pollutant", _text())


def multi_get_table(spark, sf_dir):
    """Keys from a table: the tiles that large orders fell on; keys without tiles stay, as NULLs."""
    wanted = st.day_tiles(spark, sf_dir).where("amount > 450000").select((F.col("tile_key") + 300).alias("tile_key"))
    tiles = hour_store(spark, sf_dir)
    everything = wanted.unionByName(st.day_tiles(spark, sf_dir).where("amount > 450000").select("tile_key"))
    found = store.get_tiles(tiles, everything, keep_missing=True)
    return found.groupBy("pollutant").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("tile_key").alias("n_tiles")
    )


def select_pollutant(spark, sf_dir):
    picked = bands.select_pollutant(hour_store(spark, sf_dir), "pm25")
    return _summed(picked, "tile_key", _text(), F.col("props.lng").alias("lng"), F.col("props.lat").alias("lat"))


def select_pollutant_slim(spark, sf_dir):
    picked = bands.select_pollutant(hour_store(spark, sf_dir), "no2", slim=True)
    return _summed(
        picked, "tile_key", _text(), F.col("height").cast("bigint").alias("height"), F.col("width").cast("bigint").alias("width")
    )


def versions_explode(spark, sf_dir):
    """Versions of one day packed into an array (at most 24 hours) and taken apart again."""
    daily = (
        hour_store(spark, sf_dir)
        .groupBy("tile_key", "pollutant", "day")
        .agg(F.collect_list(F.struct("ts", "data")).alias("versions"))
    )
    return _summed(bands.explode_versions(daily).drop("day"), "tile_key", "pollutant", _text())


def merge_bands(spark, sf_dir):
    wide = bands.to_wide(hour_store(spark, sf_dir))
    return wide.select(
        "tile_key",
        _text(),
        *[F.round(F.get(name, F.lit(0)).cast("double"), 6).alias(name) for name in ("aqi", "pm25", "pm10", "co", "no2", "so2")],
    )


def result_map(spark, sf_dir):
    flat = bands.result_map(bands.to_wide(hour_store(spark, sf_dir)))
    return (
        flat.select("tile_key", _text(), F.explode("cells").alias("name", "data"))
        .where(F.col("data").isNotNull())
        .select("tile_key", "ts", "name", F.size("data").cast("bigint").alias("n_cells"),
                F.round(F.get("data", F.lit(63)).cast("double"), 6).alias("last_cell"))
    )


def first_properties(spark, sf_dir):
    return olap.first_properties(hour_store(spark, sf_dir))


def property_map(spark, sf_dir):
    maps = bands.property_map(hour_store(spark, sf_dir), by=("tile_key", "pollutant"))
    pairs = maps.select("tile_key", F.explode("cells").alias("name", "value"))
    return pairs.groupBy("tile_key", "name").agg(F.max("value").alias("value"))


def upsert_tiles(spark, sf_dir):
    """Hourly tiles stored, then those with an amount of 5 or more stored again with doubled cells
    and the same times, and once more a day later."""
    path = st.scratch(spark, "upsert")
    first = st.hour_tiles(spark, sf_dir)
    store.upsert_tiles(first, path, order_by=["seq"])
    doubled = first.where("amount >= 5").withColumn(
        "data", F.transform("data", lambda v: F.when(v == st.NODATA, v).otherwise(v * 2))
    )
    later = doubled.withColumn("ts", F.expr("ts + INTERVAL 1 DAY"))
    store.upsert_tiles(doubled, path, order_by=["seq"])
    store.upsert_tiles(later, path, order_by=["seq"])
    return _summed(store.read_tiles(spark, path), "tile_key", "pollutant", _text())


_UPSERT_SQL = f"""WITH {st.hour_tiles_sql()},
doubled AS (
  SELECT * REPLACE (list_transform(data, lambda v: CASE WHEN v = -999 THEN v ELSE v * 2::FLOAT END) AS data)
  FROM tiles WHERE amount >= 5),
everything AS (
  SELECT 1 AS turn, * FROM tiles UNION ALL SELECT 2, * FROM doubled
  UNION ALL SELECT 3, * REPLACE (ts + INTERVAL 1 DAY AS ts) FROM doubled),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY tile_key, pollutant, ts ORDER BY turn DESC, seq DESC) AS n FROM everything)
SELECT tile_key, pollutant, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, {_SUM_SQL} AS total FROM ranked WHERE n = 1"""

# Late tiles: those of one province on two days come again with doubled cells.
LATE_PROVINCE, LATE_START, LATE_END = 2, "2024-01-10 00:00:00", "2024-01-12 00:00:00"
PATTERN_LEVELS = ("day", "month", "season", "year", "all")


def _late(tiles):
    late = tiles.where(F.floor(F.col("region_no") / 100) == LATE_PROVINCE).where(F.col("ts") >= LATE_START).where(F.col("ts") < LATE_END)
    return late.withColumn("data", F.transform("data", lambda v: F.when(v == st.NODATA, v).otherwise(v * 2)))


@st.once
def late_folder(spark, sf_dir) -> str:
    """The hourly tiles with their partial states, and then the late ones; written once per application."""
    folder = st.scratch(spark, "late")
    first = st.hour_tiles(spark, sf_dir)
    for tiles in (first, _late(first)):
        store.upsert_tiles(tiles, f"{folder}/tiles", order_by=["seq"], states_path=f"{folder}/states")
    return folder


def _late_states(spark, sf_dir):
    return store.read_states(st.pin_time_zone(spark), f"{late_folder(spark, sf_dir)}/states")


def upsert_late(spark, sf_dir):
    """All tiles after the late ones came in."""
    tiles = store.read_tiles(st.pin_time_zone(spark), f"{late_folder(spark, sf_dir)}/tiles")
    return _summed(tiles, "tile_key", "pollutant", _text())


def state_pattern(spark, sf_dir):
    """Courses at every level above the hour, from states."""
    states = _late_states(spark, sf_dir)
    courses = [olap.state_pattern(states, level).withColumn("level", F.lit(level)) for level in PATTERN_LEVELS]
    courses.append(olap.state_pattern(states, "month", weighted=True).withColumn("level", F.lit("weighted")))
    every = courses[0]
    for course in courses[1:]:
        every = every.unionByName(course)
    return every.select("level", "bucket", F.round("mean", 6).alias("mean"))


def state_region(spark, sf_dir):
    """Daily course of one region and two pollutants, from states."""
    found = store.scan_states(_late_states(spark, sf_dir), REGION, START[:10], END[:10], ["pm25", "co"])
    return olap.state_pattern(found, "day").select("bucket", F.round("mean", 6).alias("mean"))


def state_stats(spark, sf_dir):
    stats = olap.state_stats(_late_states(spark, sf_dir), ["pollutant"])
    return stats.select("pollutant", "n_versions", *[F.round(c, 6).alias(c) for c in ("tile_avg", "tile_max", "tile_min")])


def _names_of_provinces(spark, sf_dir):
    """A row per region: its province by name."""
    region = st.table(spark, sf_dir, "region").select((F.col("r_regionkey") + 1).alias("province_no"), F.col("r_name").alias("province"))
    return region.select("province", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("city"), "province_no").select(
        "province", (F.col("province_no") * 100 + F.col("city")).cast("bigint").alias("region_no")
    )


def state_rollup(spark, sf_dir):
    """All levels of time with all levels of space, provinces by name, from states."""
    hierarchies = [["year", "month", "day"], ["province", "region_no"]]
    levels = olap.roll_up_states(_late_states(spark, sf_dir), hierarchies, _names_of_provinces(spark, sf_dir))
    return levels.select(
        "year", "month", "day", "province", "region_no", "grouping_id", "n",
        *[F.round(c, 5).alias(c) for c in ("total", "low", "high", "mean")],
    )


_LATE_SQL = f"""{st.hour_tiles_sql()},
unique_tiles AS (
  SELECT * FROM tiles QUALIFY row_number() OVER (PARTITION BY tile_key, pollutant, tiles.ts ORDER BY seq DESC) = 1),
stored AS (
  SELECT * REPLACE (CASE WHEN region_no // 100 = {LATE_PROVINCE} AND ts >= '{LATE_START}' AND ts < '{LATE_END}'
    THEN list_transform(data, lambda v: CASE WHEN v = -999 THEN v ELSE v * 2::FLOAT END) ELSE data END AS data)
  FROM unique_tiles),
means AS (
  SELECT *, list_avg(list_transform(list_filter(data, lambda v: v <> -999), lambda v: v::DOUBLE)) AS tile_mean FROM stored),
cells AS (
  SELECT pollutant, ts, region_no, unnest(data)::DOUBLE AS v FROM stored)"""


_TS_SQL = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts"
_RANGE_SQL = f"tile_key >= {REGION * 100000} AND tile_key < {(REGION + 1) * 100000} AND ts >= '{START}' AND ts < '{END}'"

def tile_catalog(spark, sf_dir):
    """Hourly tiles through a catalog table: made, made again without effect, filled, read by name."""
    name = f"tiles_{uuid.uuid4().hex}"
    store.create_tile_table(spark, name)
    stored = store.with_folders(hour_store(spark, sf_dir))
    stored.select(*spark.table(name).columns).write.insertInto(name)
    store.create_tile_table(spark, name)
    return _summed(spark.table(name), "tile_key", "pollutant", _text())


@st.once
def late_table(spark, sf_dir) -> str:
    """The hourly tiles and then the late ones, upserted by the name of a catalog table."""
    name = f"tiles_{uuid.uuid4().hex}"
    first = st.hour_tiles(spark, sf_dir)
    for tiles in (first, _late(first)):
        store.upsert_table(tiles, name, order_by=["seq"])
    return name


def catalog_upsert(spark, sf_dir):
    """All tiles of the table after the late ones came in."""
    return _summed(spark.table(late_table(spark, sf_dir)), "tile_key", "pollutant", _text())


def catalog_scan(spark, sf_dir):
    """A region's tiles of some pollutants and times, by the table's name."""
    found = store.scan_tiles(spark.table(late_table(spark, sf_dir)), REGION, START, END, ["pm25", "co"])
    return _summed(found, "tile_key", "pollutant", _text())


def catalog_statistics(spark, sf_dir):
    return store.table_statistics(spark, late_table(spark, sf_dir)).select("n_rows", "low", "high")


QUERIES = {
    "time_pattern_hours": (_time_pattern(st.hour_tiles, "hours"), _time_pattern_sql(st.hour_tiles_sql(), "hour")),
    **{
        f"time_pattern_{level}": (_time_pattern(st.day_tiles, level), _time_pattern_sql(st.day_tiles_sql(), level))
        for level in ("day", "month", "season", "year", "all")
    },
    "time_pattern_sparse": (_time_pattern(st.day_tiles, "day", 0.25), _time_pattern_sql(st.day_tiles_sql(0.25), "day")),
    "time_pattern_weighted": (
        time_pattern_weighted,
        f"""WITH {st.day_tiles_sql(0.25)}, cells AS (SELECT ts, unnest(data)::DOUBLE AS v FROM tiles)
SELECT strftime(ts, '%Y-%m') AS bucket, round(avg(v) FILTER (v <> -999), 6) AS mean FROM cells GROUP BY 1 ORDER BY 1""",
    ),
    "spatial_mean": (_spatial_mean(-0.2), _spatial_mean_sql(-0.2)),
    "spatial_mean_sparse": (_spatial_mean(0.25), _spatial_mean_sql(0.25)),
    "spatial_mean_props": (
        spatial_mean_props,
        f"WITH {st.day_tiles_sql()} SELECT tile_key, max(lng) AS lng, max(lat) AS lat, max(len(data)) AS n_cells "
        "FROM tiles GROUP BY tile_key",
    ),
    "tile_avg": (_stat("tile_avg"), _stat_sql("tile_avg", "avg(tile_mean)")),
    "tile_max": (_stat("tile_max"), _stat_sql("tile_max", "max(list_max(list_filter(data, lambda v: v <> -999)))")),
    "tile_min": (_stat("tile_min"), _stat_sql("tile_min", "min(list_min(list_filter(data, lambda v: v <> -999)))")),
    "stats_by_key": (
        stats_by_key,
        "SELECT event_type, round(sum(value), 2) AS total, count(value) AS n, round(avg(value) + 0.00000037::DOUBLE, 4) AS mean "
        "FROM events GROUP BY event_type",
    ),
    "scan_range": (
        scan_range,
        f"WITH {_STORE_SQL} SELECT tile_key, pollutant, {_TS_SQL}, {_SUM_SQL} AS total FROM stored "
        f"WHERE {_RANGE_SQL} AND pollutant IN ('pm25', 'co')",
    ),
    "tile_catalog": (tile_catalog, f"WITH {_STORE_SQL} SELECT tile_key, pollutant, {_TS_SQL}, {_SUM_SQL} AS total FROM stored"),
    "tile_count": (tile_count, f"WITH {_STORE_SQL} SELECT count(DISTINCT tile_key) AS n_tiles FROM stored WHERE {_RANGE_SQL}"),
    "scan_latest": (
        scan_latest,
        f"WITH {_STORE_SQL} SELECT tile_key, pollutant, {_TS_SQL}, {_SUM_SQL} AS total FROM stored "
        "WHERE tile_key >= 20000000 AND tile_key < 40000000 "
        "QUALIFY row_number() OVER (PARTITION BY tile_key, pollutant ORDER BY stored.ts DESC) = 1",
    ),
    "point_get": (
        point_get,
        f"WITH {_STORE_SQL} SELECT tile_key, pollutant, {_TS_SQL}, generate_subscripts(data, 1) - 1 AS pos, "
        f"round(unnest(data)::DOUBLE, 6) AS value FROM stored WHERE tile_key = {ONE_TILE}",
    ),
    "multi_get": (
        multi_get,
        f"WITH {_STORE_SQL} SELECT tile_key, pollutant, {_TS_SQL}, {_SUM_SQL} AS total FROM stored "
        f"WHERE tile_key IN {SOME_TILES}",
    ),
    "multi_get_table": (
        multi_get_table,
        f"""WITH {_STORE_SQL}, wanted AS (
  SELECT DISTINCT (((o_custkey % 5 + 1) * 100 + (o_custkey // 5) % 5) * 100000 + label) + shift AS tile_key
  FROM orders JOIN embeddings ON vec_id = o_orderkey % (SELECT count(*) FROM embeddings), (VALUES (0), (300)) s(shift)
  WHERE o_totalprice > 450000)
SELECT pollutant, count(*) AS n, count(DISTINCT wanted.tile_key) AS n_tiles FROM wanted
LEFT JOIN stored ON wanted.tile_key = stored.tile_key GROUP BY pollutant""",
    ),
    "select_pollutant": (
        select_pollutant,
        f"WITH {_STORE_SQL} SELECT tile_key, {_TS_SQL}, lng, lat, {_SUM_SQL} AS total FROM stored WHERE pollutant = 'pm25'",
    ),
    "select_pollutant_slim": (
        select_pollutant_slim,
        f"WITH {_STORE_SQL} SELECT tile_key, {_TS_SQL}, 8 AS height, 8 AS width, {_SUM_SQL} AS total FROM stored "
        "WHERE pollutant = 'no2'",
    ),
    "versions_explode": (
        versions_explode,
        f"WITH {_STORE_SQL} SELECT tile_key, pollutant, {_TS_SQL}, {_SUM_SQL} AS total FROM stored",
    ),
    "merge_bands": (
        merge_bands,
        f"WITH {_STORE_SQL} SELECT tile_key, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, "
        + ", ".join(
            f"round(max(CASE WHEN pollutant = '{p}' THEN data[1]::DOUBLE END), 6) AS {p}"
            for p in ("aqi", "pm25", "pm10", "co", "no2", "so2")
        )
        + " FROM stored GROUP BY 1, 2",
    ),
    "result_map": (
        result_map,
        f"WITH {_STORE_SQL} SELECT tile_key, {_TS_SQL}, concat(pollutant, ':data') AS name, len(data) AS n_cells, "
        "round(data[64]::DOUBLE, 6) AS last_cell FROM stored",
    ),
    "first_properties": (
        first_properties,
        f"""WITH {_STORE_SQL}, first AS (SELECT * FROM stored ORDER BY tile_key, ts LIMIT 1)
SELECT unnest({PROPS.fieldNames()}) AS name, unnest([4, 4, lng, lat, 0.05, 8, 8, -999]::DOUBLE[]) AS value FROM first""",
    ),
    "property_map": (
        property_map,
        f"""WITH {_STORE_SQL}, one AS (SELECT tile_key, max(lng) AS lng, max(lat) AS lat FROM stored GROUP BY tile_key)
SELECT tile_key, unnest({[f"properties:{n}" for n in PROPS.fieldNames()]}) AS name,
       unnest([4, 4, lng, lat, 0.05, 8, 8, -999]::DOUBLE[]) AS value FROM one""",
    ),
    "upsert_tiles": (upsert_tiles, _UPSERT_SQL),
    "upsert_late": (upsert_late, f"WITH {_LATE_SQL} SELECT tile_key, pollutant, {_TS_SQL}, {_SUM_SQL} AS total FROM stored"),
    "catalog_upsert": (catalog_upsert, f"WITH {_LATE_SQL} SELECT tile_key, pollutant, {_TS_SQL}, {_SUM_SQL} AS total FROM stored"),
    "catalog_scan": (
        catalog_scan,
        f"WITH {_LATE_SQL} SELECT tile_key, pollutant, {_TS_SQL}, {_SUM_SQL} AS total FROM stored "
        f"WHERE {_RANGE_SQL} AND pollutant IN ('pm25', 'co')",
    ),
    "catalog_statistics": (
        catalog_statistics,
        f"WITH {_LATE_SQL} SELECT count(*) AS n_rows, min(tile_key) AS low, max(tile_key) AS high FROM stored",
    ),
    "state_pattern": (
        state_pattern,
        f"WITH {_LATE_SQL} "
        + " UNION ALL ".join(
            f"SELECT '{level}' AS level, {_BUCKET_SQL[level]} AS bucket, round(avg(tile_mean), 6) AS mean FROM means GROUP BY 2"
            for level in PATTERN_LEVELS
        )
        + " UNION ALL SELECT 'weighted', strftime(ts, '%Y-%m'), round(avg(v) FILTER (v <> -999), 6) FROM cells GROUP BY 2",
    ),
    "state_region": (
        state_region,
        f"WITH {_LATE_SQL} SELECT {_BUCKET_SQL['day']} AS bucket, round(avg(tile_mean), 6) AS mean FROM means "
        f"WHERE region_no = {REGION} AND pollutant IN ('pm25', 'co') AND ts::DATE BETWEEN '{START[:10]}' AND '{END[:10]}' GROUP BY 1",
    ),
    "state_stats": (
        state_stats,
        f"""WITH {_LATE_SQL} SELECT pollutant, count(*) AS n_versions, round(avg(tile_mean), 6) AS tile_avg,
  round(max(list_max(list_filter(data, lambda v: v <> -999)))::DOUBLE, 6) AS tile_max,
  round(min(list_min(list_filter(data, lambda v: v <> -999)))::DOUBLE, 6) AS tile_min FROM means GROUP BY pollutant""",
    ),
    "state_rollup": (
        state_rollup,
        f"""WITH {_LATE_SQL}, facts AS (
  SELECT v, strftime(ts, '%Y') AS year, strftime(ts, '%Y-%m') AS month, strftime(ts, '%Y-%m-%d') AS day,
         r_name AS province, region_no FROM cells JOIN region ON r_regionkey + 1 = region_no // 100 WHERE v <> -999)
SELECT year, month, day, province, region_no, GROUPING(year, month, day, province, region_no)::BIGINT AS grouping_id, count(*) AS n,
       round(sum(v), 5) AS total, round(min(v), 5) AS low, round(max(v), 5) AS high, round(avg(v), 5) AS mean
FROM facts GROUP BY ROLLUP (year, month, day), ROLLUP (province, region_no)""",
    ),
}
