"""Cutting, numbering, reassembling, importing and searching rasters."""

from pyspark.sql import functions as F

from airlattice.functions.hilbert import curve_size, hilbert_code, hilbert_xy
from airlattice.functions.keys import key_code, key_region
from airlattice.operators import boxes, mosaic, tiling
from airlattice.plans import tile_query
from airlattice.plans.raster_import import import_rasters
from airlattice.registry import standins as st
from airlattice.sources import rasters as files
from airlattice.sources import tile_store as store

# Fixed values of the questions asked.
CURVE = 64
BOX = boxes.Box(72.0, 19.0, 83.3, 25.1)
COURSE_BOX = boxes.Box(72.0, 18.5, 121.0, 21.0)
PRECISION = 3
FIRST_HOUR = "2016-05-01 00:00:00"
IMPORT_START, IMPORT_END = "2016-05-01", "2999-12-31"
ASKED = ("P1", "C1", "pm25")
# Cities of the files: few, so that each has several hours even in small tables.
CITIES = 4
# Names outside these bounds are not opened.
# One raster in this many comes again.
AGAIN = 3
SOME_START, SOME_END = "2016-05-01 00:00:00", "2016-05-01 01:30:00"


def _big(*names):
    return [F.col(n).cast("bigint").alias(n) for n in names]


def cut(spark, sf_dir):
    tiles = tiling.split_cells(st.raster_cells(spark, sf_dir), st.raster_meta(spark, sf_dir))
    return tiling.with_tile_key(tiles)


def _cells_of(tiles, *names):
    """Every cell of tiles as a row, with some of their columns."""
    cells = tiles.select(*names, F.posexplode("data").alias("pos", "v"))
    return cells.withColumns({"pos": F.col("pos").cast("bigint"), "v": F.round(F.col("v").cast("double"), 2)}).withColumnRenamed("v", "value")


def _total():
    return F.round(F.aggregate("data", F.lit(0.0), lambda a, v: a + v), 2).alias("total")


def split_tiles(spark, sf_dir):
    tiles = cut(spark, sf_dir)
    return tiles.select(
        "region_no", *_big("x", "y"), *_big("tile_code"),
        F.col("props.height").cast("bigint").alias("height"), F.col("props.width").cast("bigint").alias("width"),
        F.col("props.x_tiles").cast("bigint").alias("x_tiles"), F.col("props.y_tiles").cast("bigint").alias("y_tiles"),
        F.size("data").cast("bigint").alias("n"), _total(),
    )


def tile_cells(spark, sf_dir):
    """Where every cell sits in its tile, and its value there."""
    cells = cut(spark, sf_dir).select("tile_key", F.posexplode("data").alias("pos", "v"))
    return cells.select("tile_key", *_big("pos"), F.round(F.col("v").cast("double"), 2).alias("value"))


def tile_keys(spark, sf_dir):
    tiles = cut(spark, sf_dir)
    key = F.col("tile_key")
    return tiles.select(
        "tile_key",
        key_region(key).alias("region_no"),
        key_code(key).cast("bigint").alias("tile_code"),
        curve_size(F.col("props.y_tiles"), F.col("props.x_tiles")).alias("n"),
    )


def hilbert_encode(spark, sf_dir):
    size = F.lit(CURVE).cast("bigint")
    cells = st.raster_cells(spark, sf_dir)
    return cells.select("region_no", *_big("row", "col"), hilbert_code(F.col("col"), F.col("row"), size).alias("code"))


def hilbert_decode(spark, sf_dir):
    orders = st.table(spark, sf_dir, "orders")
    code = F.col("o_orderkey") % (CURVE * CURVE)
    xy = hilbert_xy(code, F.lit(CURVE).cast("bigint"))
    return orders.select("o_orderkey", xy.alias("xy")).select("o_orderkey", F.col("xy.x").alias("x"), F.col("xy.y").alias("y"))


# The curve bit by bit, from the highest; the given columns are x, y.
def _encode_sql(source: str) -> str:
    return f"""walk(x0, y0, x, y, s, d) AS (
  SELECT DISTINCT x::BIGINT, y::BIGINT, x::BIGINT, y::BIGINT, {CURVE // 2}::BIGINT, 0::BIGINT FROM ({source})
  UNION ALL
  SELECT x0, y0,
         CASE WHEN y & s > 0 THEN x WHEN x & s > 0 THEN s - 1 - y ELSE y END,
         CASE WHEN y & s > 0 THEN y WHEN x & s > 0 THEN s - 1 - x ELSE x END,
         s // 2, d + s * s * xor(3 * (x & s > 0)::BIGINT, (y & s > 0)::BIGINT)
  FROM walk WHERE s > 0),
codes AS (SELECT x0, y0, d AS code FROM walk WHERE s = 0)"""


_DECODE_SQL = f"""WITH RECURSIVE walk(code, t, x, y, s) AS (
  SELECT DISTINCT o_orderkey % {CURVE * CURVE}, o_orderkey % {CURVE * CURVE}, 0::BIGINT, 0::BIGINT, 1::BIGINT FROM orders
  UNION ALL
  SELECT code, t // 4,
         CASE WHEN ry = 1 THEN x WHEN rx = 1 THEN s - 1 - y ELSE y END + s * rx,
         CASE WHEN ry = 1 THEN y WHEN rx = 1 THEN s - 1 - x ELSE x END + s * ry, s * 2
  FROM (SELECT *, (t // 2) & 1 AS rx, xor(t, (t // 2) & 1) & 1 AS ry FROM walk) WHERE s < {CURVE})
SELECT o_orderkey, x, y FROM orders JOIN walk ON code = o_orderkey % {CURVE * CURVE} AND s = {CURVE}"""


def raster_roundtrip(spark, sf_dir):
    grid = mosaic.tiles_to_grid(cut(spark, sf_dir), st.raster_meta(spark, sf_dir))
    return grid.select("region_no", *_big("row", "col"), F.round(F.col("value").cast("double"), 2).alias("value"))


def _text(spark, sf_dir):
    return mosaic.tiles_to_asc(cut(spark, sf_dir), st.raster_meta(spark, sf_dir), rasters=st.raster_meta(spark, sf_dir))


def asc_lines(spark, sf_dir):
    """Header lines as text; body lines value by value, in their order."""
    text = _text(spark, sf_dir)
    is_body = F.col("line") >= len(mosaic.HEADER_WORDS)
    head = text.where(~is_body).select(
        "region_no", *_big("line"), F.col("value").alias("header"), F.lit(None).cast("bigint").alias("col"), F.lit(None).cast("double").alias("value")
    )
    body = text.where(is_body).select("region_no", "line", F.posexplode(F.split(F.trim("value"), " ")).alias("col", "v"))
    value = F.round(F.col("v").cast("float").cast("double"), 2).alias("value")
    return head.unionByName(body.select("region_no", *_big("line"), F.lit(None).cast("string").alias("header"), *_big("col"), value))


_ASC_SQL = f"""WITH {st.CELLS_SQL}
SELECT region_no, "row" + 7 AS line, NULL::VARCHAR AS header, col, round(value::DOUBLE, 2) AS value FROM cells
UNION ALL
SELECT region_no, unnest(range(7)) AS line,
       unnest(['NCOLS 50', 'NROWS 30', concat('XLLCENTER ', xll), concat('YLLCENTER ', yll), 'DX 0.125', 'DY 0.125',
               'NODATA_VALUE -9999.0']) AS header, NULL, NULL FROM meta"""


def _raster_name():
    number = F.col("region_no") - 101
    hours = F.make_interval(hours=F.floor(number / CITIES).cast("int"))
    time = F.date_format(F.lit(FIRST_HOUR).cast("timestamp") + hours, "yyyy-MM-dd'H'HH")
    return F.format_string("P%d%%C%d#%s#pm25", number % 2 + 1, number % CITIES + 1, time)


@st.once
def raster_files(spark, sf_dir) -> str:
    """All rasters as text files, a few cities at successive hours; written once per application."""
    path = st.scratch(spark, "asc")
    files.write_asc_files(_text(spark, sf_dir).withColumn("raster", _raster_name()), path)
    return path


def _file_regions(spark, sf_dir):
    """Region table for the file names: cities of even number are listed with their suffix."""
    number = F.col("region_no") - 101
    city = number % CITIES + 1
    return st.raster_meta(spark, sf_dir).select(
        F.concat(F.lpad((number % 2 + 1).cast("string"), 2, "0"), F.lpad(city.cast("string"), 2, "0")).alias("code"),
        F.concat(F.lit("P"), (number % 2 + 1).cast("string")).alias("province"),
        F.concat(F.lit("C"), city.cast("string"), F.when(city % 2 == 0, "市").otherwise("")).alias("city"),
    ).distinct()


_NAMES_SQL = f"""named AS (
  SELECT *, region_no - 101 AS k, concat('P', (region_no - 101) % 2 + 1) AS province, concat('C', (region_no - 101) % {CITIES} + 1) AS city,
         TIMESTAMP '2016-05-01 00:00:00' + to_hours(((region_no - 101) // {CITIES})::INT) AS time
  FROM meta)"""


def read_asc_files(spark, sf_dir):
    """Headers, names and rows of the written files."""
    rasters = files.with_name_parts(files.read_asc(spark, raster_files(spark, sf_dir)))
    rows = files.raster_rows(rasters)
    return rows.select(
        "province", "city", "time", "pollutant", *_big("ncols", "nrows"), "xll", "yll", "cellsize", "nodata", *_big("row"),
        F.size("values").cast("bigint").alias("n"),
        F.round(F.aggregate("values", F.lit(0.0), lambda a, v: a + v), 2).alias("total"),
    )


def read_asc_splits(spark, sf_dir):
    """The same rows, read line by line in splits."""
    rows = files.with_name_parts(files.read_asc_rows(spark, raster_files(spark, sf_dir)))
    return rows.select(
        "province", "city", "time", "pollutant", *_big("ncols", "nrows"), "xll", "yll", "cellsize", "nodata", *_big("row"),
        F.size("values").cast("bigint").alias("n"),
        F.round(F.aggregate("values", F.lit(0.0), lambda a, v: a + v), 2).alias("total"),
    )


def _file_tiles(tiles):
    named = files.with_name_parts(tiles).withColumn("tile_code", F.col("tile_code").cast("bigint"))
    return _cells_of(named, "province", "city", "time", "tile_code")


def split_files(spark, sf_dir):
    """Tiles cut from whole files, without a shuffle."""
    return _file_tiles(tiling.split_rasters(files.read_asc(spark, raster_files(spark, sf_dir)), st.RASTER_LENGTH))


def split_file_rows(spark, sf_dir):
    """The same tiles from files read in splits."""
    return _file_tiles(tiling.split_raster_rows(files.read_asc_rows(spark, raster_files(spark, sf_dir)), st.RASTER_LENGTH))


_READ_SQL = f"""WITH {st.CELLS_SQL}, {_NAMES_SQL}
SELECT province, city, strftime(time, '%Y-%m-%d %H:%M:%S') AS time, 'pm25' AS pollutant, 50 AS ncols, 30 AS nrows, xll, yll,
       0.125::DOUBLE AS cellsize, -9999.0::DOUBLE AS nodata, "row", count(*) AS n, round(sum(value::DOUBLE), 2) AS total
FROM cells JOIN named USING (region_no) GROUP BY ALL"""


def import_files(spark, sf_dir) -> str:
    """All files imported, twice, into new tile and metadata tables."""
    folder = st.scratch(spark, "import")
    for _ in range(2):
        import_rasters(
            spark, raster_files(spark, sf_dir), _file_regions(spark, sf_dir),
            f"{folder}/tiles", f"{folder}/meta", IMPORT_START, IMPORT_END,
        )
    return folder


# The imported tables the questions below share, once per application.
import_folder = st.once(import_files)


def raster_import(spark, sf_dir):
    folder = import_files(spark, sf_dir)
    tiles = store.read_tiles(spark, f"{folder}/tiles").join(
        store.read_meta(spark, f"{folder}/meta").select("region_no", "ncols", "tile_length"), "region_no"
    )
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts")
    return _cells_of(tiles, "tile_key", text, "pollutant", *_big("ncols", "tile_length"))


def import_between(spark, sf_dir):
    """Bounds that leave out files of later hours: tiles by region and hour."""
    folder = st.scratch(spark, "import")
    import_rasters(
        spark, raster_files(spark, sf_dir), _file_regions(spark, sf_dir), f"{folder}/tiles", f"{folder}/meta", SOME_START, SOME_END
    )
    tiles = store.read_tiles(spark, f"{folder}/tiles")
    return tiles.groupBy("region_no", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts")).agg(F.count(F.lit(1)).alias("n"))


def import_again(spark, sf_dir):
    """All files imported with a ledger; then every third raster written anew with doubled cells, and two
    more imports: the first opens the new files only, the second none."""
    folder = st.scratch(spark, "again")
    meta = st.raster_meta(spark, sf_dir)
    again = meta.where(f"region_no % {AGAIN} = 0")
    cells = st.raster_cells(spark, sf_dir).join(F.broadcast(again.select("region_no")), "region_no")
    doubled = cells.withColumn("value", F.when(F.col("value") == st.RASTER_NODATA, F.col("value")).otherwise(F.col("value") * 2).cast("float"))
    text = mosaic.tiles_to_asc(tiling.with_tile_key(tiling.split_cells(doubled, meta)), meta, rasters=again)

    def run():
        import_rasters(
            spark, f"{folder}/asc", _file_regions(spark, sf_dir), f"{folder}/tiles", f"{folder}/meta", IMPORT_START, IMPORT_END,
            ledger_path=f"{folder}/ledger", states_path=f"{folder}/states",
        )

    files.write_asc_files(_text(spark, sf_dir).withColumn("raster", _raster_name()), f"{folder}/asc/a")
    run()
    files.write_asc_files(text.withColumn("raster", _raster_name()), f"{folder}/asc/b")
    for _ in range(2):
        run()
    tiles = store.read_tiles(spark, f"{folder}/tiles")
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts")
    return _cells_of(tiles, "tile_key", text)


def import_parts(spark, sf_dir):
    """All orders as one raster, written in ordered parts, imported, and every cell of it. Its tiles are as large as
    its rows make them: their codes must fit a key."""
    orders = st.table(spark, sf_dir, "orders")
    last = orders.agg(F.max("o_orderkey").alias("last")).select(
        F.lit(101).cast("bigint").alias("region_no"), F.lit(st.RASTER_COLS).alias("ncols"),
        (F.floor(F.col("last") / st.RASTER_COLS) + 1).cast("int").alias("nrows"), F.lit(70.0).alias("xll"), F.lit(18.0).alias("yll"),
        F.lit(0.125).alias("cellsize"), F.lit(st.RASTER_NODATA).alias("nodata"),
    )
    length = tiling.fitting_length(max(last.first()["nrows"] or 0, st.RASTER_COLS), st.RASTER_LENGTH)
    last = last.withColumn("tile_length", F.lit(length))
    cells = orders.select(
        F.lit(101).cast("bigint").alias("region_no"), F.floor(F.col("o_orderkey") / st.RASTER_COLS).cast("int").alias("row"),
        (F.col("o_orderkey") % st.RASTER_COLS).cast("int").alias("col"), F.col("o_totalprice").cast("float").alias("value"),
    )
    folder = st.scratch(spark, "parts")
    tiles = tiling.with_tile_key(tiling.split_cells(cells, last))
    files.write_asc(mosaic.tiles_to_asc(tiles, last, rasters=last), f"{folder}/asc/P1%C1#2016-05-01H00#pm25")
    import_rasters(
        spark, f"{folder}/asc", _file_regions(spark, sf_dir), f"{folder}/tiles", f"{folder}/meta", IMPORT_START, IMPORT_END, length
    )
    grid = mosaic.tiles_to_grid(store.read_tiles(spark, f"{folder}/tiles"), store.read_meta(spark, f"{folder}/meta"))
    return grid.select(*_big("row", "col"), F.round(F.col("value").cast("double"), 2).alias("value"))


_PARTS_SQL = """WITH places AS (SELECT unnest(range((max(o_orderkey) // 50 + 1) * 50)) AS k FROM orders)
SELECT k // 50 AS "row", k % 50 AS col, round(coalesce(o_totalprice::FLOAT, -9999)::DOUBLE, 2) AS value
FROM places LEFT JOIN orders ON o_orderkey = k"""


# Rasters with more bytes of text than this are written in parts.
PART_BYTES = 8_000


def import_mixed(spark, sf_dir):
    """All rasters in one write, those above PART_BYTES in parts, imported, and every cell."""
    folder = st.scratch(spark, "mixed")
    files.write_asc_files(_text(spark, sf_dir).withColumn("raster", _raster_name()), f"{folder}/asc", PART_BYTES)
    import_rasters(
        spark, f"{folder}/asc", _file_regions(spark, sf_dir), f"{folder}/tiles", f"{folder}/meta", IMPORT_START, IMPORT_END
    )
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts")
    return _cells_of(store.read_tiles(spark, f"{folder}/tiles"), "tile_key", text)


def _asked_tiles(spark, sf_dir):
    """Tiles of one region by name, as the two questions below want them."""
    return tile_query.region_tiles(
        spark, f"{import_folder(spark, sf_dir)}/tiles", _file_regions(spark, sf_dir), *ASKED,
        f"{IMPORT_START} 00:00:00", f"{IMPORT_END} 00:00:00",
    )


def named_time_query(spark, sf_dir):
    """Hourly course of the named region, written to one file and read back."""
    path = st.scratch(spark, "course")
    files.write_single_csv(tile_query.time_query(_asked_tiles(spark, sf_dir), "hours"), path)
    course = spark.read.schema("bucket string, mean double").csv(path)
    return course.select("bucket", F.round("mean", 4).alias("mean"))


def named_heat_map(spark, sf_dir):
    """Heat map of the named region as raster text, written in order and read back."""
    path = st.scratch(spark, "heat")
    meta = store.read_meta(spark, f"{import_folder(spark, sf_dir)}/meta")
    region = tile_query.region_number(_file_regions(spark, sf_dir), *ASKED[:2])
    files.write_asc(tile_query.heat_map_raster(_asked_tiles(spark, sf_dir), meta, [region]), path)
    rows = files.read_asc_rows(spark, path)
    values = rows.select(*_big("row"), F.posexplode("values").alias("col", "v"))
    return values.select("row", *_big("col"), F.round(F.col("v").cast("double"), 1).alias("value"))


_FILE_TILES_SQL = f"""WITH {st.CELLS_SQL}, {_NAMES_SQL}
SELECT province, city, strftime(time, '%Y-%m-%d %H:%M:%S') AS time, tile_code, pos, round(value::DOUBLE, 2) AS value
FROM located JOIN named USING (region_no)"""

_IMPORT_SQL = f"""WITH {st.CELLS_SQL}, {_NAMES_SQL}
SELECT ((k % 2 + 1) * 100 + k % {CITIES} + 1) * 100000 + tile_code AS tile_key, strftime(time, '%Y-%m-%d %H:%M:%S') AS ts,
       'pm25' AS pollutant, 50 AS ncols, 16 AS tile_length, pos, round(value::DOUBLE, 2) AS value
FROM located JOIN named USING (region_no)
WHERE strftime(time, '%Y-%m-%d %H:%M:%S') BETWEEN '{IMPORT_START}' AND '{IMPORT_END}'"""

_AGAIN_SQL = f"""WITH {st.CELLS_SQL}, {_NAMES_SQL}
SELECT ((k % 2 + 1) * 100 + k % {CITIES} + 1) * 100000 + tile_code AS tile_key, strftime(time, '%Y-%m-%d %H:%M:%S') AS ts, pos,
       round((CASE WHEN region_no % {AGAIN} = 0 AND value <> -9999 THEN value * 2::FLOAT ELSE value END)::DOUBLE, 2) AS value
FROM located JOIN named USING (region_no)"""

_MIXED_SQL = f"SELECT tile_key, ts, pos, value FROM ({_IMPORT_SQL})"

_BETWEEN_SQL = f"""WITH {st.CELLS_SQL}, {_NAMES_SQL}
SELECT (k % 2 + 1) * 100 + k % {CITIES} + 1 AS region_no, strftime(time, '%Y-%m-%d %H:%M:%S') AS ts, count(DISTINCT tile_code) AS n
FROM located JOIN named USING (region_no)
WHERE strftime(time, '%Y-%m-%d %H:%M:%S') BETWEEN '{SOME_START}' AND '{SOME_END}' GROUP BY ALL"""


def box_query(spark, sf_dir):
    found = boxes.tiles_in_box(cut(spark, sf_dir), BOX, st.RASTER_LENGTH, st.raster_meta(spark, sf_dir))
    return _cells_of(found, "tile_key")


def box_question(spark, sf_dir):
    """Hourly course of the imported tiles under a box."""
    folder = import_folder(spark, sf_dir)
    meta = store.read_meta(spark, f"{folder}/meta")
    tiles = tile_query.box_tiles(spark, f"{folder}/tiles", meta, COURSE_BOX, "pm25", f"{IMPORT_START} 00:00:00", f"{IMPORT_END} 00:00:00")
    return tile_query.time_query(tiles, "hours").select("bucket", F.round("mean", 4).alias("mean"))


def box_intervals(spark, sf_dir):
    """The intervals of keys that a box comes to, region by region."""
    found = boxes.box_key_intervals(st.raster_meta(spark, sf_dir), BOX)
    return found.select("region_no", F.inline("intervals"))


def box_ranges(spark, sf_dir):
    """Every cell of the imported tiles under the box, by intervals of keys."""
    folder = import_folder(spark, sf_dir)
    found = boxes.tiles_in_box_ranges(store.read_tiles(spark, f"{folder}/tiles"), COURSE_BOX, store.read_meta(spark, f"{folder}/meta"))
    return _cells_of(found, "tile_key", F.date_format("ts", "yyyy-MM-dd HH").alias("bucket"))


def geo_index(spark, sf_dir):
    index = boxes.build_geo_index(st.raster_meta(spark, sf_dir), PRECISION)
    return index.select("region_no", "geohash", *_big("tile_code"))


def _customer_boxes(spark, sf_dir):
    """A box of 0.5 x 0.25 degrees per customer."""
    key = F.col("c_custkey")
    west, south = 70.0 + (key * 37 % 480) * 0.1, 18.0 + (key * 17 % 330) * 0.1
    regions = st.raster_meta(spark, sf_dir).agg(F.count(F.lit(1)).alias("regions"))
    customers = st.table(spark, sf_dir, "customer").crossJoin(F.broadcast(regions))
    return customers.select(
        key.alias("box_id"), (key % F.col("regions") + 101).alias("region_no"), west.alias("lng_min"), south.alias("lat_min"),
        (west + 0.5).alias("lng_max"), (south + 0.25).alias("lat_max"),
    )


def geohash_query(spark, sf_dir):
    """Tiles of each customer's region under the customer's box, through a stored index: rasters lie on
    top of each other, and a box asks for one of them."""
    path = st.scratch(spark, "index")
    index = boxes.build_geo_index(st.raster_meta(spark, sf_dir), PRECISION)
    store.refresh_geo_index(index, path)
    store.refresh_geo_index(index.where("region_no % 2 = 0"), path)
    return boxes.box_tile_keys(spark.read.parquet(path), _customer_boxes(spark, sf_dir), PRECISION, by=("region_no",))


def geohash_box(spark, sf_dir):
    """The same tiles as in box_query, through the index."""
    index = boxes.build_geo_index(st.raster_meta(spark, sf_dir), PRECISION)
    return boxes.tiles_in_box_indexed(cut(spark, sf_dir), index, BOX, PRECISION).transform(_cells_of, "tile_key")


_BOX_SQL = f"""WITH {st.CELLS_SQL}
SELECT tile_key, pos, round(value::DOUBLE, 2) AS value FROM located JOIN extents USING (region_no, tile_code)
WHERE lng_min < {BOX.lng_max} AND lng_max > {BOX.lng_min} AND lat_min < {BOX.lat_max} AND lat_max > {BOX.lat_min}"""

_STORED_SQL = f"""{st.CELLS_SQL}, {_NAMES_SQL},
stored AS (
  SELECT *, (k % 2 + 1) * 100 + k % {CITIES} + 1 AS city_no,
         row_number() OVER (PARTITION BY k % {CITIES} ORDER BY time DESC) AS newest FROM named),
spots AS (SELECT city_no, xll, yll FROM stored WHERE newest = 1)"""

_UNDER_COURSE_BOX = f"""s.xll + x * 2.0 < {COURSE_BOX.lng_max} AND s.xll + x * 2.0 + width * 0.125 > {COURSE_BOX.lng_min}
  AND s.yll + y * 2.0 < {COURSE_BOX.lat_max} AND s.yll + y * 2.0 + height * 0.125 > {COURSE_BOX.lat_min}"""

_BOX_RANGES_SQL = f"""WITH {_STORED_SQL}
SELECT stored.city_no * 100000 + tile_code AS tile_key, strftime(time, '%Y-%m-%d %H') AS bucket, pos, round(value::DOUBLE, 2) AS value
FROM located JOIN stored USING (region_no) JOIN spots s ON stored.city_no = s.city_no WHERE {_UNDER_COURSE_BOX}"""

_BOX_COURSE_SQL = f"""WITH {_STORED_SQL},
placed_tiles AS (
  SELECT time, tile_code, city_no, avg(value::DOUBLE) FILTER (value <> -9999) AS tile_mean, any_value(x) AS x, any_value(y) AS y,
         any_value(height) AS height, any_value(width) AS width
  FROM located JOIN stored USING (region_no) WHERE time < '{IMPORT_END}' GROUP BY region_no, time, tile_code, city_no)
SELECT strftime(time, '%Y-%m-%d %H') AS bucket, round(avg(tile_mean), 4) AS mean
FROM placed_tiles t JOIN spots s ON t.city_no = s.city_no
WHERE {_UNDER_COURSE_BOX} GROUP BY 1"""

# Cells of precision 3 are 360/256 degrees wide and 180/128 high; 15 bits, longitude first.
_HASH_SQL = """concat(
  substr('0123456789bcdefghjkmnpqrstuvwxyz', (1 + 16 * ((gx >> 7) & 1) + 8 * ((gy >> 6) & 1) + 4 * ((gx >> 6) & 1) + 2 * ((gy >> 5) & 1) + ((gx >> 5) & 1))::INT, 1),
  substr('0123456789bcdefghjkmnpqrstuvwxyz', (1 + 16 * ((gy >> 4) & 1) + 8 * ((gx >> 4) & 1) + 4 * ((gy >> 3) & 1) + 2 * ((gx >> 3) & 1) + ((gy >> 2) & 1))::INT, 1),
  substr('0123456789bcdefghjkmnpqrstuvwxyz', (1 + 16 * ((gx >> 2) & 1) + 8 * ((gy >> 1) & 1) + 4 * ((gx >> 1) & 1) + 2 * (gy & 1) + (gx & 1))::INT, 1))"""

_INDEX_SQL = f"""WITH {st.CELLS_SQL},
columns_of AS (
  SELECT *, unnest(range(floor((lng_min + 180) / 1.40625)::BIGINT, ceil((lng_max + 180) / 1.40625)::BIGINT)) AS gx FROM extents),
both_of AS (
  SELECT *, unnest(range(floor((lat_min + 90) / 1.40625)::BIGINT, ceil((lat_max + 90) / 1.40625)::BIGINT)) AS gy FROM columns_of)
SELECT region_no, {_HASH_SQL} AS geohash, tile_code FROM both_of"""

_CUSTOMER_BOX_SQL = f"""WITH {st.CELLS_SQL},
corners AS (
  SELECT c_custkey AS box_id, c_custkey % (SELECT count(*) FROM meta) + 101 AS region_no, 70.0::DOUBLE + (c_custkey * 37 % 480) * 0.1::DOUBLE AS west,
         18.0::DOUBLE + (c_custkey * 17 % 330) * 0.1::DOUBLE AS south FROM customer)
SELECT box_id, tile_key FROM corners JOIN extents
ON corners.region_no = extents.region_no AND lng_min < west + 0.5 AND lng_max > west AND lat_min < south + 0.25 AND lat_max > south"""

QUERIES = {
    "split_tiles": (
        split_tiles,
        f"""WITH {st.CELLS_SQL}
SELECT region_no, x, y, tile_code, height, width, 4 AS x_tiles, 2 AS y_tiles, count(*) AS n,
       round(sum(value::DOUBLE), 2) AS total FROM located GROUP BY ALL""",
    ),
    "tile_cells": (
        tile_cells,
        f"WITH {st.CELLS_SQL} SELECT region_no * 100000 + tile_code AS tile_key, pos, round(value::DOUBLE, 2) AS value FROM located",
    ),
    "tile_keys": (
        tile_keys,
        f"WITH {st.CELLS_SQL} SELECT DISTINCT region_no * 100000 + tile_code AS tile_key, region_no, tile_code, 4 AS n FROM located",
    ),
    "hilbert_encode": (
        hilbert_encode,
        f"""WITH RECURSIVE {st.CELLS_SQL}, {_encode_sql('SELECT col AS x, "row" AS y FROM cells')}
SELECT region_no, "row", col, code FROM cells JOIN codes ON col = x0 AND "row" = y0""",
    ),
    "hilbert_decode": (hilbert_decode, _DECODE_SQL),
    "raster_roundtrip": (
        raster_roundtrip,
        f'WITH {st.CELLS_SQL} SELECT region_no, "row", col, round(value::DOUBLE, 2) AS value FROM cells',
    ),
    "asc_lines": (asc_lines, _ASC_SQL),
    "read_asc_files": (read_asc_files, _READ_SQL),
    "read_asc_splits": (read_asc_splits, _READ_SQL),
    "split_files": (split_files, _FILE_TILES_SQL),
    "split_file_rows": (split_file_rows, _FILE_TILES_SQL),
    "raster_import": (raster_import, _IMPORT_SQL),
    "import_between": (import_between, _BETWEEN_SQL),
    "import_again": (import_again, _AGAIN_SQL),
    "import_parts": (import_parts, _PARTS_SQL),
    "import_mixed": (import_mixed, _MIXED_SQL),
    "named_time_query": (
        named_time_query,
        f"""WITH {st.CELLS_SQL}, {_NAMES_SQL},
means AS (
  SELECT time, avg(value::DOUBLE) FILTER (value <> -9999) AS tile_mean FROM located JOIN named USING (region_no)
  WHERE province = '{ASKED[0]}' AND city = '{ASKED[1]}' AND time < '{IMPORT_END}' GROUP BY region_no, time, tile_code)
SELECT strftime(time, '%Y-%m-%d %H') AS bucket, round(avg(tile_mean), 4) AS mean FROM means GROUP BY 1""",
    ),
    "named_heat_map": (
        named_heat_map,
        f"""WITH {st.CELLS_SQL}, {_NAMES_SQL},
heat AS (
  SELECT "row", col, coalesce(avg(value::DOUBLE) FILTER (value <> -9999)::FLOAT, -9999) AS v
  FROM cells JOIN named USING (region_no)
  WHERE province = '{ASKED[0]}' AND city = '{ASKED[1]}' AND time < '{IMPORT_END}' GROUP BY "row", col)
SELECT "row", col, round(v::DOUBLE, 1) AS value FROM heat""",
    ),
    "box_query": (box_query, _BOX_SQL),
    "box_question": (box_question, _BOX_COURSE_SQL),
    "box_intervals": (
        box_intervals,
        f"""WITH {st.CELLS_SQL},
under AS (
  SELECT region_no, tile_key, tile_key - row_number() OVER (PARTITION BY region_no ORDER BY tile_key) AS island FROM extents
  WHERE lng_min < {BOX.lng_max} AND lng_max > {BOX.lng_min} AND lat_min < {BOX.lat_max} AND lat_max > {BOX.lat_min})
SELECT region_no, min(tile_key) AS low, max(tile_key) AS high FROM under GROUP BY region_no, island""",
    ),
    "box_ranges": (box_ranges, _BOX_RANGES_SQL),
    "geo_index": (geo_index, _INDEX_SQL),
    "geohash_query": (geohash_query, _CUSTOMER_BOX_SQL),
    "geohash_box": (geohash_box, _BOX_SQL),
}
