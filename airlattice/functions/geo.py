"""Coordinate shift and GeoHash text as column expressions."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the public GCJ-02 datum: ellipsoid, origin, polynomial coefficients
# (1, x, y, square, x*y, sqrt|x|) and harmonics as (amplitude, multiple of pi, divisor).
GCJ_AXIS = 6378245.0
GCJ_ECCENTRICITY_SQ = 0.00669342162296594323
GCJ_ORIGIN = (105.0, 35.0)
GCJ_LAT_POLY = (-100.0, 2.0, 3.0, 0.2, 0.1, 0.2)
GCJ_LNG_POLY = (300.0, 1.0, 2.0, 0.1, 0.1, 0.1)
GCJ_COMMON_HARMONICS = ((20.0, 6, 1), (20.0, 2, 1))
GCJ_LAT_HARMONICS = ((20.0, 1, 1), (40.0, 1, 3), (160.0, 1, 12), (320.0, 1, 30))
GCJ_LNG_HARMONICS = ((20.0, 1, 1), (40.0, 1, 3), (150.0, 1, 12), (300.0, 1, 30))

# Fixed value: the GeoHash alphabet.
GEOHASH_ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"


def _harmonics(terms, angle: Column) -> Column:
    total = F.lit(0.0)
    for amplitude, multiple, divisor in terms:
        total = total + F.sin(angle * (multiple * math.pi / divisor)) * amplitude
    return total * (2.0 / 3.0)


def _polynomial(coefficients, x: Column, y: Column, squared: Column) -> Column:
    c0, cx, cy, cs, cxy, cr = coefficients
    return c0 + x * cx + y * cy + squared * squared * cs + x * y * cxy + F.sqrt(F.abs(x)) * cr


def gcj02_to_wgs84(lng: Column, lat: Column) -> tuple[Column, Column]:
    """Shift a GCJ-02 point back to WGS-84 (first-order inverse), giving (lng, lat)."""
    x = lng - GCJ_ORIGIN[0]
    y = lat - GCJ_ORIGIN[1]
    common = _harmonics(GCJ_COMMON_HARMONICS, x)
    north = _polynomial(GCJ_LAT_POLY, x, y, y) + common + _harmonics(GCJ_LAT_HARMONICS, y)
    east = _polynomial(GCJ_LNG_POLY, x, y, x) + common + _harmonics(GCJ_LNG_HARMONICS, x)

    phi = F.radians(lat)
    curvature = 1 - GCJ_ECCENTRICITY_SQ * F.pow(F.sin(phi), 2)
    meridian = GCJ_AXIS * (1 - GCJ_ECCENTRICITY_SQ) / (curvature * F.sqrt(curvature))
    parallel = GCJ_AXIS / F.sqrt(curvature) * F.cos(phi)
    return lng - F.degrees(east / parallel), lat - F.degrees(north / meridian)


def geohash_bits(precision: int) -> tuple[int, int]:
    """Bits of longitude and latitude in a hash of so many characters (longitude goes first)."""
    bits = 5 * precision
    return (bits + 1) // 2, bits // 2


def geohash_cell_size(precision: int) -> tuple[float, float]:
    """Width and height in degrees, both exact in binary."""
    lng_bits, lat_bits = geohash_bits(precision)
    return 360.0 / 2**lng_bits, 180.0 / 2**lat_bits


def geohash_column(lng: Column, precision: int) -> Column:
    """Column number of the GeoHash cell; the east edge of the world falls in the last one."""
    last = 2 ** geohash_bits(precision)[0] - 1
    return F.least(F.floor((lng + 180.0) / geohash_cell_size(precision)[0]), F.lit(last).cast("bigint"))


def geohash_row(lat: Column, precision: int) -> Column:
    last = 2 ** geohash_bits(precision)[1] - 1
    return F.least(F.floor((lat + 90.0) / geohash_cell_size(precision)[1]), F.lit(last).cast("bigint"))


def geohash_of_cell(column: Column, row: Column, precision: int) -> Column:
    """Text of a cell: bits of column and row taken in turn, five to a character."""
    left = dict(zip(("lng", "lat"), geohash_bits(precision)))
    sources = {"lng": column.cast("bigint"), "lat": row.cast("bigint")}
    chars = []
    for char in range(precision):
        index = F.lit(0).cast("bigint")
        for bit in range(5):
            axis = "lng" if (5 * char + bit) % 2 == 0 else "lat"
            left[axis] -= 1
            value = F.shiftright(sources[axis], left[axis]).bitwiseAND(F.expr("1L"))
            index = index * 2 + value
        chars.append(F.substring(F.lit(GEOHASH_ALPHABET), (index + 1).cast("int"), F.lit(1)))
    return F.concat(*chars)


def geohash(lng: Column, lat: Column, precision: int) -> Column:
    return geohash_of_cell(geohash_column(lng, precision), geohash_row(lat, precision), precision)
