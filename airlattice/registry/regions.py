"""Region dimension, name lookup, raster metadata, coordinates."""

import uuid

from pyspark.sql import functions as F

from airlattice.functions.geo import gcj02_to_wgs84, geohash
from airlattice.operators import regions as ops
from airlattice.plans.region_load import load_region_dim
from airlattice.registry import standins as st
from airlattice.sources import tile_store as store
from airlattice.sources.regions import read_centres


def _code(province, city):
    return F.concat(F.lpad(province.cast("string"), 2, "0"), F.lpad(city.cast("string"), 2, "0"))


def region_list(spark, sf_dir):
    """Nested list: regions as provinces, nations that have customers as cities; cities of even
    number carry the suffix."""
    nation, region = st.table(spark, sf_dir, "nation"), st.table(spark, sf_dir, "region")
    served = st.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey")).distinct()
    cities = nation.join(served, "n_nationkey").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    name = F.concat("n_name", F.when(F.col("n_nationkey") % 2 == 0, ops.CITY_SUFFIX).otherwise(""))
    code = _code(F.col("r_regionkey") + 1, F.col("n_nationkey") + 1)
    return cities.groupBy(
        F.col("r_name").alias("province"), _code(F.col("r_regionkey") + 1, F.lit(0)).alias("code")
    ).agg(F.collect_list(F.struct(name.alias("name"), code.alias("code"))).alias("cities"))


def centres(spark, sf_dir):
    """Province centres from the regions; city centres from the nation's suppliers, if any."""
    region, nation, supplier = (st.table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    provinces = region.select(F.col("r_name").alias("name"), F.format_string("[%d.5,30.5]", F.col("r_regionkey") + 100).alias("cp"))
    first = supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.min("s_suppkey").alias("key"))
    cities = nation.join(first, "n_nationkey").select(
        F.concat("n_name", F.when(F.col("n_nationkey") % 2 == 0, ops.CITY_SUFFIX).otherwise("")).alias("name"),
        F.format_string("[%d.25,%d.75]", F.col("n_nationkey") + 90, F.col("key") % 90).alias("cp"),
    )
    return provinces, cities


def centres_catalog(spark, sf_dir):
    """City centres from a catalog table."""
    name = f"centres_{uuid.uuid4().hex}"
    extra = centres(spark, sf_dir)[1].withColumn("more", F.lit(1))
    extra.write.option("path", st.scratch(spark, "centres")).saveAsTable(name)
    return read_centres(spark, table=name)


def region_dim(spark, sf_dir):
    return ops.build_region_dim(region_list(spark, sf_dir), *centres(spark, sf_dir))


def region_load(spark, sf_dir):
    """The list written as JSON lines, loaded into the region table and read back."""
    folder = st.scratch(spark, "regions")
    region_list(spark, sf_dir).write.json(f"{folder}/list")
    return load_region_dim(spark, f"{folder}/list", *centres(spark, sf_dir), f"{folder}/dim", multi_line=False)


def region_codes(spark, sf_dir):
    return ops.region_codes(region_dim(spark, sf_dir))


def resolve_region(spark, sf_dir):
    """Code of every customer's city, named without suffix."""
    customer, nation, region = (st.table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    named = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
        region, F.col("n_regionkey") == F.col("r_regionkey")
    )
    asked = named.select("c_custkey", F.col("r_name").alias("province"), F.col("n_name").alias("city"))
    return ops.resolve_region(asked, region_dim(spark, sf_dir))


def upsert_meta(spark, sf_dir):
    """Raster metadata stored, then the regions of the largest orders stored again, finer."""
    path = st.scratch(spark, "meta")
    meta = st.raster_meta(spark, sf_dir)
    store.upsert_meta(meta, path)
    large = st.table(spark, sf_dir, "orders").where("o_totalprice > 499000")
    touched = large.select((F.floor(F.col("o_orderkey") / 1500) + 101).cast("bigint").alias("region_no")).distinct()
    finer = meta.join(touched, "region_no", "left_semi").withColumn("tile_length", F.lit(8))
    store.upsert_meta(finer, path)
    return store.read_meta(spark, path).select(
        "region_no", "xll", "yll", F.col("ncols").cast("bigint").alias("ncols"), F.col("tile_length").cast("bigint").alias("tile_length")
    )


def _points(spark, sf_dir):
    key = F.col("c_custkey")
    return st.table(spark, sf_dir, "customer").select(
        "c_custkey", (73.0 + (key * 37 % 6200) * 0.01).alias("lng"), (18.0 + (key * 17 % 3500) * 0.01).alias("lat")
    )


_POINTS_SQL = """points AS (
  SELECT c_custkey, 73.0::DOUBLE + (c_custkey * 37 % 6200) * 0.01::DOUBLE AS lng,
         18.0::DOUBLE + (c_custkey * 17 % 3500) * 0.01::DOUBLE AS lat FROM customer)"""


def gcj02(spark, sf_dir):
    lng, lat = gcj02_to_wgs84(F.col("lng"), F.col("lat"))
    return _points(spark, sf_dir).select("c_custkey", F.round(lng, 6).alias("lng"), F.round(lat, 6).alias("lat"))


def geohash_points(spark, sf_dir):
    return _points(spark, sf_dir).select("c_custkey", geohash(F.col("lng"), F.col("lat"), 6).alias("geohash"))


_DIM_SQL = f"""cities AS (
  SELECT r_name AS province, concat(n_name, CASE WHEN n_nationkey % 2 = 0 THEN '市' ELSE '' END) AS city, n_name,
         concat(lpad((r_regionkey + 1)::VARCHAR, 2, '0'), lpad((n_nationkey + 1)::VARCHAR, 2, '0')) AS code,
         concat('[', n_nationkey + 90, '.25,', key % 90, '.75]') AS lnglat
  FROM nation JOIN region ON n_regionkey = r_regionkey
  JOIN (SELECT s_nationkey, min(s_suppkey) AS key FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey
  WHERE n_nationkey IN (SELECT c_nationkey FROM customer)),
dim AS (
  SELECT '{ops.COUNTRY_CODE}' AS code, '{ops.COUNTRY_NAME}' AS province, '{ops.COUNTRY_NAME}' AS city,
         '{ops.COUNTRY_CENTRE}' AS lnglat, 'country' AS level
  UNION ALL
  SELECT DISTINCT concat(lpad((r_regionkey + 1)::VARCHAR, 2, '0'), '00'), r_name, r_name,
         concat('[', r_regionkey + 100, '.5,30.5]'), 'province'
  FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey
  UNION ALL
  SELECT code, province, city, lnglat, 'city' FROM cities)"""

_PI = "3.141592653589793::DOUBLE"
_GCJ_SQL = f"""WITH {_POINTS_SQL},
shifted AS (SELECT *, lng - 105 AS x, lat - 35 AS y, lat / 180 * {_PI} AS phi FROM points),
terms AS (
  SELECT *, 1 - 0.006693421622965943::DOUBLE * sin(phi) * sin(phi) AS m,
    (20 * sin(6 * x * {_PI}) + 20 * sin(2 * x * {_PI})) * 2 / 3 AS common FROM shifted),
deltas AS (
  SELECT *,
    -100 + 2 * x + 3 * y + 0.2::DOUBLE * y * y + 0.1::DOUBLE * x * y + 0.2::DOUBLE * sqrt(abs(x)) + common
      + (20 * sin(y * {_PI}) + 40 * sin(y / 3 * {_PI})) * 2 / 3
      + (160 * sin(y / 12 * {_PI}) + 320 * sin(y * {_PI} / 30)) * 2 / 3 AS north,
    300 + x + 2 * y + 0.1::DOUBLE * x * x + 0.1::DOUBLE * x * y + 0.1::DOUBLE * sqrt(abs(x)) + common
      + (20 * sin(x * {_PI}) + 40 * sin(x / 3 * {_PI})) * 2 / 3
      + (150 * sin(x / 12 * {_PI}) + 300 * sin(x / 30 * {_PI})) * 2 / 3 AS east
  FROM terms)
SELECT c_custkey, round(lng - east * 180 / (6378245::DOUBLE / sqrt(m) * cos(phi) * {_PI}), 6) AS lng,
       round(lat - north * 180 / (6378245::DOUBLE * (1 - 0.006693421622965943::DOUBLE) / (m * sqrt(m)) * {_PI}), 6) AS lat
FROM deltas"""

_HASH_BITS = [("gx", 14 - i // 2) if i % 2 == 0 else ("gy", 14 - i // 2) for i in range(30)]
_HASH_SQL = "concat(" + ", ".join(
    "substr('0123456789bcdefghjkmnpqrstuvwxyz', (1 + "
    + " + ".join(f"{16 >> b} * (({_HASH_BITS[5 * c + b][0]} >> {_HASH_BITS[5 * c + b][1]}) & 1)" for b in range(5))
    + ")::INT, 1)"
    for c in range(6)
) + ")"

QUERIES = {
    "region_dim": (region_dim, f"WITH {_DIM_SQL} SELECT * FROM dim"),
    "region_load": (region_load, f"WITH {_DIM_SQL} SELECT * FROM dim"),
    "region_codes": (region_codes, f"WITH {_DIM_SQL} SELECT concat(province, ':', city) AS name, code FROM dim"),
    "resolve_region": (
        resolve_region,
        f"""WITH {_DIM_SQL}
SELECT c_custkey, r_name AS province, nation.n_name AS city, cities.code, substr(cities.code, 1, 2)::BIGINT AS province_no,
       substr(cities.code, 3, 2)::BIGINT AS city_no, cities.code::BIGINT AS region_no
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
LEFT JOIN cities ON cities.province = r_name AND cities.n_name = nation.n_name""",
    ),
    "centres_catalog": (
        centres_catalog,
        """SELECT concat(n_name, CASE WHEN n_nationkey % 2 = 0 THEN '市' ELSE '' END) AS name,
       concat('[', n_nationkey + 90, '.25,', min(s_suppkey) % 90, '.75]') AS cp
FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name, n_nationkey""",
    ),
    "upsert_meta": (
        upsert_meta,
        f"""WITH {st.CELLS_SQL}
SELECT region_no, xll, yll, 50 AS ncols, CASE WHEN region_no IN (
  SELECT o_orderkey // 1500 + 101 FROM orders WHERE o_totalprice > 499000) THEN 8 ELSE 16 END AS tile_length FROM meta""",
    ),
    "gcj02_to_wgs84": (gcj02, _GCJ_SQL),
    "geohash_points": (
        geohash_points,
        f"""WITH {_POINTS_SQL}, bits AS (
  SELECT c_custkey, floor((lng + 180) / (360.0::DOUBLE / 32768))::BIGINT AS gx,
         floor((lat + 90) / (180.0::DOUBLE / 32768))::BIGINT AS gy FROM points)
SELECT c_custkey, {_HASH_SQL} AS geohash FROM bits""",
    ),
}
