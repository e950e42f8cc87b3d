"""Joins of many rows with a table of one row per key, where a few keys may hold most of the rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key with this share of all rows, and at least this many, is hot: there are at most 1 / share of them.
HOT_SHARE = 1e-3
HOT_ROWS = 20_000


def join_hot(rows: DataFrame, table: DataFrame, key: str, share: float = HOT_SHARE, least: int = HOT_ROWS) -> DataFrame:
    """Inner join of ``rows`` with ``table`` (one row per ``key``). Rows of hot keys stay where they are and
    meet their few rows of ``table`` by broadcast; all others are shuffled. Both sides should be stored data:
    they are read for either way, and ``rows`` once to count keys."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    listed = counts.orderBy(F.desc("n")).limit(int(1 / share)).select(key).collect()
    if not listed:
        return rows.join(table, key)
    hot = [row[0] for row in listed]
    keys = F.broadcast(rows.sparkSession.createDataFrame([(k,) for k in hot], rows.select(key).schema))
    few = F.broadcast(table.join(keys, key, "left_semi"))
    return rows.join(few, key).unionByName(rows.join(keys, key, "left_anti").join(table, key))
