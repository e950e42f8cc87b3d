"""Region dimension from its JSON list and the centre tables."""

from pyspark.sql import DataFrame, SparkSession

from airlattice.operators.regions import build_region_dim
from airlattice.sources.regions import read_region_list


def load_region_dim(
    spark: SparkSession,
    list_path: str,
    province_centres: DataFrame,
    city_centres: DataFrame,
    out_path: str,
    multi_line: bool = True,
) -> DataFrame:
    """Build, write and read back the region dimension."""
    dim = build_region_dim(read_region_list(spark, list_path, multi_line), province_centres, city_centres)
    dim.write.mode("overwrite").parquet(out_path)
    return spark.read.schema(dim.schema).parquet(out_path)
