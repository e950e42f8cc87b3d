"""Joins that look at the size of one side before they choose how to move it."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlattice.session import stage

# Keys named as constants in the plan (they reach the file statistics); rows broadcast.
MAX_LISTED_KEYS = 500
MAX_BROADCAST_KEYS = 1_000_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024


def broadcast_if_small(df: DataFrame, max_rows: int, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``max_rows`` rows and (as JSON text) ``max_bytes``
    bytes, else as it is. Rows are measured now, and that stops at the limit."""
    size = F.octet_length(F.to_json(F.struct(*df.columns)))
    found = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if found["rows"] <= max_rows and found["bytes"] <= max_bytes else df


def lookup_once(df: DataFrame, max_rows: int) -> DataFrame:
    """A lookup that should have at most ``max_rows`` short rows, computed once: as local rows to
    broadcast, or written to the shared folder if it is larger after all."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) <= max_rows:
        return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
    return stage(df, "lookup")


def keep_matching(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is among ``keys``.

    Few keys become a filter on the scan, more a broadcast; only beyond that are both sides
    shuffled. Without the look at the keys Spark would shuffle wide rows for a handful of them,
    as it cannot tell from a plan how few they are.
    """
    keys = keys.select(key).distinct()
    listed = keys.limit(MAX_LISTED_KEYS + 1).collect()
    if len(listed) <= MAX_LISTED_KEYS:
        return df.where(F.col(key).isin([row[0] for row in listed]))
    keys = stage(keys, "keys")
    return df.join(broadcast_if_small(keys, MAX_BROADCAST_KEYS), key, "left_semi")


def spread_key(key: Column, row: Column) -> Column:
    """A text key for a left join in which rows without a key match nothing, yet do not all go to one
    task: each gets a key of its own, from the hash of ``row``, which no lookup holds."""
    return F.coalesce(key, F.concat(F.lit("\x00"), F.xxhash64(row).cast("string")))
