"""Station text and the two station lookups."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, paths) -> DataFrame:
    """Station text, one line per row in ``value``; directories are read with all below them."""
    return spark.read.option("recursiveFileLookup", True).text(paths)


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("value").write.mode("overwrite").text(path)


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of small lookup files with their place (file path, number), so that "the last line wins" has
    a meaning over several files too."""
    files = spark.read.text(path, wholetext=True)
    files = files.select(F.col("_metadata.file_path").alias("file"), F.split("value", r"\r?\n").alias("lines"))
    lines = files.select("file", F.posexplode("lines").alias("line_no", "line"))
    return lines.where((F.col("line_no") > 0) & (F.trim("line") != "")).withColumn("place", F.struct("file", "line_no"))


def _last_per_key(lines: DataFrame, key: str, names) -> DataFrame:
    parts = F.split("line", " ")
    table = lines.select("place", *[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)])
    values = [n for n in names if n != key]
    return table.groupBy(key).agg(*[F.max_by(v, "place").alias(v) for v in values])


def read_city_provinces(spark: SparkSession, path: str) -> DataFrame:
    """(city, province) from lines ``province city`` below a header line; last line wins."""
    return _last_per_key(_numbered_lines(spark, path), "city", ("province", "city"))


def read_locations(spark: SparkSession, path: str) -> DataFrame:
    """(address, lng, lat) from lines ``address lng lat`` below a header line; last line wins."""
    return _last_per_key(_numbered_lines(spark, path), "address", ("address", "lng", "lat"))
