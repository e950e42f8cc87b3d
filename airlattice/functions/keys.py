"""Region numbers and tile keys."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# A tile key is province * 10^7 + city * 10^5 + curve code.
REGION_STEP = 100_000
CITY_STEP = 100
MAX_CODE = 99_999
# Keys of one folder of the tile table: those of ten provinces. Of 100 TB over five years and six pollutants
# a folder then holds about 1 GB, a few files; a span ten times smaller would make files of a tenth of that.
KEY_SPAN = 100_000_000


def region_number(province_no: Column, city_no: Column) -> Column:
    return province_no.cast("bigint") * CITY_STEP + city_no.cast("bigint")


def region_of_code(code: Column) -> Column:
    """Region number of a four-digit ``ppcc`` code."""
    return region_number(F.substring(code, 1, 2), F.substring(code, 3, 2))


def code_of_region(region_no: Column) -> Column:
    return F.lpad(region_no.cast("string"), 4, "0")


def tile_key(region_no: Column, code: Column) -> Column:
    """Key of a tile; a code of more than five digits would run into the next region."""
    too_big = F.raise_error(
        F.concat(F.lit("tile code over 99999, use larger tiles: "), code.cast("string"))
    ).cast("bigint")
    key = region_no.cast("bigint") * REGION_STEP + code.cast("bigint")
    return F.when(code > MAX_CODE, too_big).otherwise(key)


def key_region(key: Column) -> Column:
    return F.floor(key / REGION_STEP).cast("bigint")


def key_code(key: Column) -> Column:
    return (key % REGION_STEP).cast("int")


def region_key_range(region_no: int) -> tuple[int, int]:
    """Keys of one region: start inclusive, end exclusive."""
    return region_no * REGION_STEP, (region_no + 1) * REGION_STEP


def key_span(key: Column) -> Column:
    """Number of the key range that a tile key falls into; a region lies in one."""
    return F.floor(key / KEY_SPAN).cast("int")
