"""Region dimension: country, provinces and cities with four-digit codes."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlattice.functions.keys import region_of_code
from airlattice.joins import lookup_once

# The country row and the suffix that city names may lack.
COUNTRY_CODE = "0000"
COUNTRY_NAME = "中国"
COUNTRY_CENTRE = "[108.5525,34.3227]"
CITY_SUFFIX = "市"

# Codes have four digits, so a sound lookup has no more names than this (each code may be known
# under two).
MAX_REGION_NAMES = 20_000


def build_region_dim(region_list: DataFrame, province_centres: DataFrame, city_centres: DataFrame) -> DataFrame:
    """Region dimension from the nested list and two centre tables of (name, cp).

    Cities without a centre are left out; a province without one is an error.
    """
    columns = ["code", "province", "city", "lnglat", "level"]
    country = region_list.sparkSession.createDataFrame(
        [(COUNTRY_CODE, COUNTRY_NAME, COUNTRY_NAME, COUNTRY_CENTRE, "country")], ", ".join(f"{c} string" for c in columns)
    )

    centre = F.coalesce(
        F.col("cp"), F.raise_error(F.concat(F.lit("province without a centre: "), F.col("province"))).cast("string")
    )
    provinces = (
        region_list.select("code", "province")
        .join(_one_per_name(province_centres).withColumnRenamed("name", "province"), "province", "left")
        .select("code", "province", F.col("province").alias("city"), centre.alias("lnglat"), F.lit("province").alias("level"))
    )
    cities = (
        region_list.select("province", F.inline("cities"))
        .join(_one_per_name(city_centres), "name")
        .select("code", "province", F.col("name").alias("city"), F.col("cp").alias("lnglat"), F.lit("city").alias("level"))
    )
    return country.unionByName(provinces).unionByName(cities)


def _one_per_name(centres: DataFrame) -> DataFrame:
    return centres.groupBy("name").agg(F.min("cp").alias("cp"))


def region_codes(region_dim: DataFrame) -> DataFrame:
    """Lookup (name, code) with names ``province:city``."""
    return region_dim.select(F.concat_ws(":", "province", "city").alias("name"), "code")


def resolve_region(df: DataFrame, region_dim: DataFrame, province="province", city="city") -> DataFrame:
    """Add code, province_no, city_no and region_no by names; a city may lack its suffix.

    Both spellings go into one lookup, in which the exact one wins, so ``df`` is joined once. The
    lookup is computed once and its size checked before it is broadcast: rows of ``df`` may carry
    whole rasters, which a shuffle should not move. Unknown names give NULL.
    """
    exact = region_dim.select("province", "city", "code", F.lit(0).alias("rank"))
    bare = region_dim.where(F.endswith("city", F.lit(CITY_SUFFIX))).select(
        "province", F.regexp_replace("city", CITY_SUFFIX + "$", "").alias("city"), "code", F.lit(1).alias("rank")
    )
    lookup = (
        exact.unionByName(bare)
        .groupBy(F.col("province").alias("_province"), F.col("city").alias("_city"))
        .agg(F.min_by("code", F.struct("rank", "code")).alias("code"))
    )
    joined = df.join(
        lookup_once(lookup, MAX_REGION_NAMES),
        (F.col(province) == F.col("_province")) & (F.col(city) == F.col("_city")),
        "left",
    ).drop("_province", "_city")
    return joined.withColumns(
        {
            "province_no": F.substring("code", 1, 2).cast("bigint"),
            "city_no": F.substring("code", 3, 2).cast("bigint"),
            "region_no": region_of_code(F.col("code")),
        }
    )


def region_names(region_dim: DataFrame) -> DataFrame:
    """(region_no, country, province, city) for roll-ups in space."""
    return region_dim.select(
        region_of_code(F.col("code")).alias("region_no"), F.lit(COUNTRY_NAME).alias("country"), "province", "city"
    )
