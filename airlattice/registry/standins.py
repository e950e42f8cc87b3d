"""The given tables seen as tiles, rasters and station text, in Spark and (as text) in SQL.

Every order and every event is one version of an 8 x 8 tile whose cells come from an embedding;
every 1,500 orders are the cells of one 50 x 30 raster; every event is one line of a station
file. So all of it grows with the tables.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airlattice.functions.keys import tile_key
from airlattice.session import pin_time_zone, shared_folder
from airlattice.sources.text import read_lines, write_lines

NODATA = -999.0
RASTER_NODATA = -9999.0
RASTER_COLS, RASTER_ROWS, RASTER_LENGTH = 50, 30, 16

POLLUTANT_OF_PRIORITY = {
    "1-URGENT": "aqi", "2-HIGH": "pm25", "3-MEDIUM": "pm10", "4-NOT SPECIFIED": "co", "5-LOW": "no2",
}
POLLUTANT_OF_EVENT = {"click": "pm25", "view": "pm10", "error": "aqi", "purchase": "co", "signup": "no2"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return pin_time_zone(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows that are about to unfold into many cells, over all cores. Only a table of fewer splits
    than cores (one small file) is shuffled for it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def once(build):
    """Remember per application and tables the folder that ``build`` wrote."""
    written = {}

    def folder(spark, sf_dir):
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in written:
            written[key] = build(spark, sf_dir)
        return written[key]

    return folder


def _named(column: str, names: dict):
    chain = None
    for key, value in names.items():
        test = F.col(column) == key
        chain = F.when(test, value) if chain is None else chain.when(test, value)
    return chain


def _sql_named(column: str, names: dict) -> str:
    return "CASE " + column + "".join(f" WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"


# --- tiles ----------------------------------------------------------------------------------


def _tiles(spark, sf_dir, rows: DataFrame, floor: float) -> DataFrame:
    """rows: key, place (a number that gives the region), ts, pollutant, and what else is wanted."""
    embeddings = table(spark, sf_dir, "embeddings")
    size = embeddings.agg(F.count(F.lit(1))).scalar()
    province, city = F.col("place") % 5 + 1, F.floor(F.col("place") / 5) % 5
    marked = F.transform("embedding", lambda v: F.when(v < floor, F.lit(NODATA).cast("float")).otherwise(v))
    joined = spread(rows, "key").withColumn("vec_id", F.col("key") % size).join(embeddings, "vec_id")
    return joined.select(
        (province * 100 + city).cast("bigint").alias("region_no"),
        F.col("label").alias("tile_code"),
        tile_key(province * 100 + city, F.col("label")).alias("tile_key"),
        F.col("ts").cast("timestamp").alias("ts"),
        "pollutant",
        F.struct(
            F.lit(4).alias("x_tiles"),
            F.lit(4).alias("y_tiles"),
            (70.0 + province * 8).alias("lng"),
            (20.0 + city).alias("lat"),
            F.lit(0.05).alias("cell_size"),
            F.lit(8).alias("height"),
            F.lit(8).alias("width"),
            F.lit(NODATA).alias("nodata"),
        ).alias("props"),
        marked.alias("data"),
        F.col("key").alias("seq"),
        "amount",
    )


def day_tiles(spark, sf_dir, floor=-0.2) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("key"),
        F.col("o_custkey").alias("place"),
        F.col("o_orderdate").alias("ts"),
        _named("o_orderpriority", POLLUTANT_OF_PRIORITY).alias("pollutant"),
        F.col("o_totalprice").alias("amount"),
    )
    return _tiles(spark, sf_dir, orders, floor)


def hour_tiles(spark, sf_dir, floor=-0.2) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("key"),
        F.col("user_id").alias("place"),
        F.date_trunc("hour", "ts").alias("ts"),
        _named("event_type", POLLUTANT_OF_EVENT).alias("pollutant"),
        F.col("value").alias("amount"),
    )
    return _tiles(spark, sf_dir, events, floor)


def _tiles_sql(name: str, source: str, key: str, place: str, ts: str, pollutant: str, amount: str, floor: float) -> str:
    region = f"(({place} % 5 + 1) * 100 + ({place} // 5) % 5)"
    return f"""{name} AS (
  SELECT {region} AS region_no, label AS tile_code, {region} * 100000 + label AS tile_key, {ts} AS ts,
         {pollutant} AS pollutant, 70.0::DOUBLE + ({place} % 5 + 1) * 8 AS lng, 20.0::DOUBLE + ({place} // 5) % 5 AS lat,
         list_transform(embedding, lambda v: CASE WHEN v::DOUBLE < {floor}::DOUBLE THEN (-999)::FLOAT ELSE v END) AS data,
         {key} AS seq, {amount} AS amount
  FROM {source} JOIN embeddings ON vec_id = {key} % (SELECT count(*) FROM embeddings))"""


def day_tiles_sql(floor=-0.2) -> str:
    return _tiles_sql(
        "tiles", "orders", "o_orderkey", "o_custkey", "o_orderdate",
        _sql_named("o_orderpriority", POLLUTANT_OF_PRIORITY), "o_totalprice", floor,
    )


def hour_tiles_sql(floor=-0.2) -> str:
    return _tiles_sql(
        "tiles", "events", "event_id", "user_id", "date_trunc('hour', ts)",
        _sql_named("event_type", POLLUTANT_OF_EVENT), "value", floor,
    )


# Mean of valid cells per tile, for a relation ``tiles``.
TILE_MEAN_SQL = """means AS (
  SELECT *, list_avg(list_transform(list_filter(data, lambda v: v <> -999), lambda v: v::DOUBLE)) AS tile_mean
  FROM tiles)"""


# --- rasters --------------------------------------------------------------------------------


def raster_cells(spark, sf_dir) -> DataFrame:
    """region_no, row, col, value and the shape, the same for all."""
    size = RASTER_COLS * RASTER_ROWS
    place = F.col("o_orderkey") % size
    price = F.col("o_totalprice")
    return spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey").select(
        (F.floor(F.col("o_orderkey") / size) + 101).cast("bigint").alias("region_no"),
        F.floor(place / RASTER_COLS).cast("int").alias("row"),
        (place % RASTER_COLS).cast("int").alias("col"),
        F.when(price < 20000, RASTER_NODATA).otherwise(price).cast("float").alias("value"),
        F.lit(RASTER_COLS).alias("ncols"),
        F.lit(RASTER_ROWS).alias("nrows"),
        F.lit(RASTER_LENGTH).alias("tile_length"),
    )


def raster_meta(spark, sf_dir) -> DataFrame:
    size = RASTER_COLS * RASTER_ROWS
    orders = table(spark, sf_dir, "orders")
    regions = orders.select((F.floor(F.col("o_orderkey") / size) + 101).cast("bigint").alias("region_no")).distinct()
    number = F.col("region_no") - 101
    return regions.select(
        "region_no",
        F.lit(RASTER_COLS).alias("ncols"),
        F.lit(RASTER_ROWS).alias("nrows"),
        (70.0 + number % 10 * 5).alias("xll"),
        (18.0 + F.floor(number / 10) % 10 * 3).alias("yll"),
        F.lit(0.125).alias("cellsize"),
        F.lit(RASTER_NODATA).alias("nodata"),
        F.lit(RASTER_LENGTH).alias("tile_length"),
    )


CELLS_SQL = """cells AS (
  SELECT o_orderkey // 1500 + 101 AS region_no, (o_orderkey % 1500) // 50 AS "row", o_orderkey % 50 AS col,
         (CASE WHEN o_totalprice < 20000 THEN -9999 ELSE o_totalprice END)::FLOAT AS value
  FROM orders),
placed AS (
  SELECT *, col // 16 AS x, (29 - "row") // 16 AS y, least(16, 30 - (29 - "row") // 16 * 16) AS height,
         least(16, 50 - col // 16 * 16) AS width
  FROM cells),
located AS (
  SELECT *, (height - 1 - (29 - "row") % 16) * width + col % 16 AS pos,
         CASE WHEN y = 0 THEN [0, 1, 14, 15] ELSE [3, 2, 13, 12] END[x + 1] AS tile_code
  FROM placed),
meta AS (
  SELECT DISTINCT region_no, 70.0::DOUBLE + (region_no - 101) % 10 * 5 AS xll,
         18.0::DOUBLE + ((region_no - 101) // 10) % 10 * 3 AS yll
  FROM cells),
extents AS (
  SELECT m.region_no, tile_code, m.region_no * 100000 + tile_code AS tile_key,
         xll + x * 16 * 0.125::DOUBLE AS lng_min, yll + y * 16 * 0.125::DOUBLE AS lat_min,
         xll + x * 16 * 0.125::DOUBLE + width * 0.125::DOUBLE AS lng_max,
         yll + y * 16 * 0.125::DOUBLE + height * 0.125::DOUBLE AS lat_max
  FROM (SELECT DISTINCT region_no, tile_code, x, y, height, width FROM located) t JOIN meta m USING (region_no))"""


# --- station text ---------------------------------------------------------------------------

SITES = ("click", "view", "error", "purchase", "signup")

# Days from event time to station time: the switch of layouts falls in the middle of the events.
DAYS_BACK = 2754

# The same text in Spark SQL and DuckDB but for ``{div}``; w is the value in hundredths.
_AMOUNTS = [f"concat(cast((w + {k} * 125) {{div}} 100 as varchar(20)), '.', lpad(cast((w + {k} * 125) % 100 as varchar(20)), 2, '0'))" for k in range(15)]
_WHOLE = "cast((w + 500) {div} 100 as varchar(20))"


def _line_expression(div: str) -> str:
    amounts = [a.format(div=div) for a in _AMOUNTS]
    aqi = f"CASE WHEN m = 17 THEN '_' ELSE {_WHOLE.format(div=div)} END"
    first = f"CASE WHEN m = 19 THEN ' ' ELSE {amounts[0]} END"
    third = f"CASE WHEN m = 23 THEN 'abc' ELSE {amounts[2]} END"
    time = "CASE WHEN m = 13 THEN '2015/01/01' ELSE time_text END"
    city = "CASE WHEN m = 41 THEN '' ELSE city END"
    head = f"{time}, {city}, site"
    long_row = f"concat_ws(',', {head}, {aqi}, {first}, {amounts[1]}, {third}, {', '.join(amounts[3:14])})"
    short_row = f"concat_ws(',', {head}, {aqi}, {first}, {amounts[1]}, {third}, {', '.join(amounts[3:9])})"
    return f"""CASE WHEN m = 7 THEN 'time,city,site,aqi'
      WHEN m = 37 THEN ',,,'
      WHEN m = 29 THEN concat_ws(',', time_text, city)
      WHEN m = 31 THEN concat(concat_ws(',', time_text, city, site, {_WHOLE.format(div=div)}), ',,,,')
      WHEN time_text < '2016-07-01' THEN {long_row}
      ELSE {short_row} END"""


def _station_text(spark, sf_dir) -> DataFrame:
    events = spread(table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value"), "event_id").select(
        (F.col("event_id") % 100).alias("m"),
        F.date_format(F.expr(f"ts - INTERVAL {DAYS_BACK} DAYS"), "yyyy-MM-dd HH:mm:ss").alias("time_text"),
        F.concat(F.lit("NATION_"), (F.col("user_id") % 27).cast("string")).alias("city"),
        F.col("event_type").alias("site"),
        F.round(F.col("value") * 100).cast("bigint").alias("w"),
    )
    return events.select(F.expr(_line_expression("div").replace("varchar(20)", "string")).alias("value"))


@once
def station_folder(spark, sf_dir) -> str:
    """The events as station files, written once per application."""
    path = shared_folder(spark, "station")
    write_lines(_station_text(spark, sf_dir), path)
    return path


def station_lines(spark, sf_dir) -> DataFrame:
    return read_lines(pin_time_zone(spark), station_folder(spark, sf_dir))


def _province_name():
    """Lookup files are separated by spaces, so names hold none."""
    return F.replace("r_name", F.lit(" "), F.lit("_"))


def provinces(spark, sf_dir) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("city"), _province_name().alias("province")
    )


def locations(spark, sf_dir) -> DataFrame:
    """Text coordinates of the stations; every fourth city has none."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    cities = nation.where("n_nationkey % 4 <> 3").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    sites = F.posexplode(F.array(*[F.lit(s) for s in SITES])).alias("i", "site")
    return cities.select(_province_name().alias("province"), "n_name", "n_nationkey", sites).select(
        F.concat("province", "n_name", "site").alias("address"),
        F.concat((F.col("n_nationkey") + 80).cast("string"), F.lit(".25")).alias("lng"),
        F.concat((F.col("i") + 20).cast("string"), F.lit(".5")).alias("lat"),
    )


STATION_SQL = f"""source AS (
  SELECT event_id % 100 AS m, strftime(ts - INTERVAL {DAYS_BACK} DAY, '%Y-%m-%d %H:%M:%S') AS time_text,
         concat('NATION_', user_id % 27) AS city, event_type AS site, round(value * 100)::BIGINT AS w
  FROM events),
lines AS (SELECT {_line_expression('//').replace("varchar(20)", "varchar")} AS value FROM source),
split AS (
  SELECT string_split(rtrim(value, ','), ',') AS f FROM lines
  WHERE rtrim(value, ',') <> '' AND NOT starts_with(value, 'time,')),
filled AS (SELECT list_transform(f, lambda v: CASE WHEN trim(v) = '' THEN '0' ELSE v END) AS f FROM split),
provinces AS (SELECT n_name AS city, replace(r_name, ' ', '_') AS province FROM nation JOIN region ON n_regionkey = r_regionkey),
sites AS (SELECT unnest({list(SITES)}) AS site, unnest([0, 1, 2, 3, 4]) AS i),
locations AS (
  SELECT concat(replace(r_name, ' ', '_'), n_name, site) AS address, concat(n_nationkey + 80, '.25') AS lng, concat(i + 20, '.5') AS lat
  FROM nation JOIN region ON n_regionkey = r_regionkey, sites WHERE n_nationkey % 4 <> 3)"""


def station_full_sql(compat: bool) -> str:
    """Rows with province and location inserted, as list f; an unknown province is NULL in it."""
    missing = "coalesce(province, 'null')" if compat else "province"
    return f"""{STATION_SQL},
with_province AS (
  SELECT list_concat([f[1]], [province], f[2:]) AS f, province, f[2] AS city, f[3] AS site
  FROM filled LEFT JOIN provinces ON f[2] = city WHERE len(f) > 1),
full_rows AS (
  SELECT list_concat(f[:4], [coalesce(lng, ''), coalesce(lat, '')], f[5:]) AS f
  FROM with_province LEFT JOIN locations ON address = {missing} || city || site WHERE len(f) > 5)"""


def scratch(spark, label: str) -> str:
    return shared_folder(spark, label)
