"""Station text to the typed station table."""

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from airlattice.operators.stations import clean_station, judged_rows, reason_counts, to_csv_lines
from airlattice.sources.text import read_city_provinces, read_lines, read_locations

VIEW = "air_data"


def station_table(spark: SparkSession, paths, provinces_path: str, locations_path: str, compat: bool = False) -> DataFrame:
    return clean_station(
        read_lines(spark, paths),
        read_city_provinces(spark, provinces_path),
        read_locations(spark, locations_path),
        compat,
    )


def run_station_etl(
    spark: SparkSession, paths, provinces_path: str, locations_path: str, table: str, compat: bool = False
) -> None:
    """Clean the station files into a managed table, replacing it."""
    station_table(spark, paths, provinces_path, locations_path, compat).write.mode("overwrite").saveAsTable(table)


def sort_out(
    spark: SparkSession, paths, provinces_path: str, locations_path: str, folder: str, compat: bool = False
) -> dict[str, int]:
    """Write every data line to ``folder`` in one pass, full rows that are valid apart from rejected lines with
    their reasons (see ``read_valid`` and ``read_rejects``), and count them on the way: rows, valid, and
    one count per reason."""
    judged = judged_rows(
        read_lines(spark, paths), read_city_provinces(spark, provinces_path), read_locations(spark, locations_path), compat
    )
    counts = Observation("station rows")
    observed = judged.observe(counts, *reason_counts())
    observed.withColumn("valid", F.size("reasons") == 0).write.mode("overwrite").partitionBy("valid").parquet(folder)
    return counts.get


_JUDGED = "value string, fields array<string>, reasons array<string>, valid boolean"


def read_valid(spark: SparkSession, folder: str) -> DataFrame:
    """The valid rows as comma-separated text, province and location inserted."""
    return to_csv_lines(spark.read.schema(_JUDGED).parquet(folder).where("valid"))


def read_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """value and reasons of the rejected lines, as they came."""
    return spark.read.schema(_JUDGED).parquet(folder).where("not valid").select("value", "reasons")


def preview(df: DataFrame, view: str = VIEW, n: int = 100, order_by=()) -> DataFrame:
    """Register the table as a temporary view and give its first rows, through SQL: any rows, or the
    first in the order of some columns."""
    df.createOrReplaceTempView(view)
    order = f" ORDER BY {', '.join(f'`{c}`' for c in order_by)}" if order_by else ""
    return df.sparkSession.sql(f"SELECT * FROM {view}{order} LIMIT {int(n)}")
