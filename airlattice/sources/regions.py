"""Sources of the region dimension."""

from pyspark.sql import DataFrame, SparkSession

from airlattice.schemas import REGION_LIST


def read_region_list(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Nested list of provinces and their cities, from files that hold one JSON array each or (not
    ``multi_line``) one JSON object per line."""
    return spark.read.schema(REGION_LIST).json(path, multiLine=multi_line)


def read_centres(spark: SparkSession, table: str = None, **jdbc_options) -> DataFrame:
    """Centre points (name, cp) in one read, from a catalog table or over JDBC."""
    if table is not None:
        source = spark.read.table(table)
    else:
        source = spark.read.format("jdbc").options(**jdbc_options).load()
    return source.select("name", "cp")
