"""Table schemas and the two OLAP hierarchies."""

from pyspark.sql import types as T

# Hierarchy levels from fine to coarse, pollutant names, tile side of the import job.
TIME_LEVELS = ("hour", "day", "month", "year")
SPACE_LEVELS = ("city", "province", "country")
POLLUTANTS = ("aqi", "pm25", "pm10", "co", "no2", "so2")
TILE_LENGTH = 16

HIERARCHIES = {"time": TIME_LEVELS, "space": SPACE_LEVELS}


def _struct(*fields):
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields])


AIR_DATA = _struct(
    ("time", T.StringType()),
    ("ts", T.TimestampType()),
    ("province", T.StringType()),
    ("city", T.StringType()),
    ("site", T.StringType()),
    ("lng", T.DoubleType()),
    ("lat", T.DoubleType()),
    ("aqi", T.DoubleType()),
    ("pm25", T.DoubleType()),
    ("pm10", T.DoubleType()),
    ("co", T.DoubleType()),
    ("no2", T.DoubleType()),
    ("ozone1hour", T.DoubleType()),
    ("ozone8hour", T.DoubleType()),
    ("so2", T.DoubleType()),
)

REGION_DIM = _struct(
    ("code", T.StringType()),
    ("province", T.StringType()),
    ("city", T.StringType()),
    ("lnglat", T.StringType()),
    ("level", T.StringType()),
)

REGION_LIST = _struct(
    ("province", T.StringType()),
    ("code", T.StringType()),
    ("cities", T.ArrayType(_struct(("name", T.StringType()), ("code", T.StringType())))),
)

RASTER_META = _struct(
    ("region_no", T.LongType()),
    ("ncols", T.IntegerType()),
    ("nrows", T.IntegerType()),
    ("xll", T.DoubleType()),
    ("yll", T.DoubleType()),
    ("cellsize", T.DoubleType()),
    ("nodata", T.DoubleType()),
    ("tile_length", T.IntegerType()),
)

# A raster that was imported: what it stands for, and the file by which a change is told.
IMPORTED = _struct(
    ("region_no", T.LongType()),
    ("pollutant", T.StringType()),
    ("ts", T.TimestampType()),
    ("path", T.StringType()),
    ("size", T.LongType()),
    ("modified", T.TimestampType()),
    ("imported", T.TimestampType()),
)

PROPS = _struct(
    ("x_tiles", T.IntegerType()),
    ("y_tiles", T.IntegerType()),
    ("lng", T.DoubleType()),
    ("lat", T.DoubleType()),
    ("cell_size", T.DoubleType()),
    ("height", T.IntegerType()),
    ("width", T.IntegerType()),
    ("nodata", T.DoubleType()),
)

# ``data`` holds no nulls: a missing cell carries ``props.nodata``.
TILES = _struct(
    ("region_no", T.LongType()),
    ("tile_code", T.IntegerType()),
    ("tile_key", T.LongType()),
    ("ts", T.TimestampType()),
    ("pollutant", T.StringType()),
    ("props", PROPS),
    ("data", T.ArrayType(T.FloatType())),
)
