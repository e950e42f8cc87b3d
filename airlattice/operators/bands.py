"""Pollutant bands and versions of tiles."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlattice.schemas import POLLUTANTS, PROPS


def to_wide(tiles: DataFrame, pollutants=POLLUTANTS, by=("tile_key", "ts")) -> DataFrame:
    """One row per tile and time with one array column per pollutant (NULL where absent).

    Tiles of other pollutants are an error: name all that are wanted, and filter the rest before. Of
    several tiles for one place the one with the greatest cells is taken.
    """
    other = F.raise_error(F.concat(F.lit("not among the bands: "), F.coalesce("pollutant", F.lit("NULL")))).cast("string")
    known = tiles.withColumn("pollutant", F.when(F.col("pollutant").isin(list(pollutants)), F.col("pollutant")).otherwise(other))
    return known.groupBy(*by).agg(*[F.max(F.when(F.col("pollutant") == name, F.col("data"))).alias(name) for name in pollutants])


def select_pollutant(tiles: DataFrame, pollutant: str, slim: bool = False) -> DataFrame:
    """One record per version of one pollutant, with all properties or (``slim``) height and width."""
    shape = [F.col("props.height"), F.col("props.width")] if slim else [F.col("props")]
    return tiles.where(F.col("pollutant") == pollutant).select("tile_key", "ts", *shape, "data")


def explode_versions(rows: DataFrame, versions: str = "versions") -> DataFrame:
    """One record per version from rows that hold an array of STRUCT<ts, data>."""
    kept = [c for c in rows.columns if c != versions]
    return rows.select(*kept, F.inline(versions))


def result_map(wide: DataFrame, pollutants=POLLUTANTS, by=("tile_key", "ts")) -> DataFrame:
    """Flatten the bands of ``to_wide`` into one map ``family:column`` to value."""
    entries = [part for name in pollutants for part in (F.lit(f"{name}:data"), F.col(name))]
    return wide.select(*by, F.create_map(*entries).alias("cells"))


def property_map(tiles: DataFrame, by=("tile_key", "ts")) -> DataFrame:
    """The properties of each tile as a map ``properties:name`` to value."""
    entries = [
        part
        for name in PROPS.fieldNames()
        for part in (F.lit(f"properties:{name}"), F.col(f"props.{name}").cast("double"))
    ]
    return tiles.select(*by, F.create_map(*entries).alias("cells"))
