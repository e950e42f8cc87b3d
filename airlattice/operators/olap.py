"""Aggregates over tiles and measures, in time and in space."""

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlattice.functions.cells import nodata_of, valid_count, valid_max, valid_mean, valid_min, valid_sum
from airlattice.functions.keys import CITY_STEP, key_region
from airlattice.functions.timebuckets import bucket_start, bucket_text, time_level
from airlattice.schemas import HIERARCHIES, PROPS

# Cells of a tile aggregated side by side in one group. 32 means in one aggregation row keep
# the plan below the code generation field limit and cut groups and shuffled rows 32-fold
# against one row per cell.
BLOCK = 32


def tile_means(tiles: DataFrame, nodata=None) -> DataFrame:
    """Add ``tile_mean``, the mean of the tile's valid cells (NULL if there is none)."""
    return tiles.withColumn("tile_mean", valid_mean(F.col("data"), nodata_of(nodata)))


def time_pattern(tiles: DataFrame, level: str, nodata=None, compat: bool = False, weighted: bool = False) -> DataFrame:
    """Mean of tile means per time bucket, sorted by bucket; ``weighted`` by the tiles' valid cells, it is
    the mean of all valid cells.

    ``level`` is hour, day, month, season, year or all. Tiles without valid cells are left out;
    a bucket of nothing else has a NULL mean (NaN with ``compat``). Grouping is on the truncated
    timestamp; text is made once per bucket.
    """
    start, marker = bucket_start(F.col("ts"), level).alias("start"), nodata_of(nodata)
    if weighted:
        sums = tiles.select(start, valid_sum(F.col("data"), marker).alias("total"), valid_count(F.col("data"), marker).alias("n"))
        buckets = sums.groupBy("start").agg(F.try_divide(F.sum("total"), F.sum("n")).alias("mean"))
    else:
        means = tiles.select(start, valid_mean(F.col("data"), marker).alias("tile_mean"))
        buckets = means.groupBy("start").agg(F.avg("tile_mean").alias("mean"))
    mean = F.coalesce("mean", F.lit(float("nan"))) if compat else F.col("mean")
    return buckets.select(bucket_text(F.col("start"), level).alias("bucket"), mean.alias("mean")).orderBy("bucket")


def spatial_mean(tiles: DataFrame, by=("tile_key",), nodata=None) -> DataFrame:
    """Cell-by-cell mean over time per tile: ``by``, data, props (of the newest version).

    A cell that was never valid becomes NODATA. Sums run in DOUBLE. Versions of one tile meet in
    a map-side partial aggregate, so a tile with a third of all versions costs no more shuffle
    than any other.
    """
    cells = F.transform(
        F.sequence(F.lit(0), F.expr(f"cast((size(data) - 1) div {BLOCK} as int)")),
        lambda i: F.slice("data", i * BLOCK + 1, BLOCK),
    )
    blocks = tiles.select(
        *by, nodata_of(nodata).alias("marker"), "props", "ts", F.posexplode(cells).alias("block", "cells")
    )
    # The first block of a tile carries its properties too, so tiles are read once.
    time = F.when(F.col("block") == 0, F.col("ts"))
    means = blocks.groupBy(*by, "block").agg(
        F.max(F.size("cells")).alias("n"),
        *[F.avg(F.nullif(F.get("cells", F.lit(i)), F.col("marker"))).alias(f"mean_{i}") for i in range(BLOCK)],
        *[F.max_by(f"props.{name}", time).alias(name) for name in PROPS.fieldNames()],
    )
    part = F.slice(F.array(*[F.col(f"mean_{i}").cast("float") for i in range(BLOCK)]), F.lit(1), F.col("n"))
    joined = means.groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct("block", part.alias("part")))).alias("parts"),
        *[F.max(name).alias(name) for name in PROPS.fieldNames()],
    )
    whole = joined.select(*by, "parts", F.struct(*PROPS.fieldNames()).alias("props"))
    marker = nodata_of(nodata)
    filled = F.transform(F.flatten("parts.part"), lambda v: F.coalesce(v, marker))
    return whole.select(*by, filled.alias("data"), "props")


def tile_stats(tiles: DataFrame, nodata=None) -> DataFrame:
    """One row over all tiles: mean of tile means, largest and smallest valid cell."""
    marker = nodata_of(nodata)
    return tiles.agg(
        F.avg(valid_mean(F.col("data"), marker)).alias("tile_avg"),
        F.max(valid_max(F.col("data"), marker)).alias("tile_max"),
        F.min(valid_min(F.col("data"), marker)).alias("tile_min"),
    )


def tile_avg(tiles: DataFrame, nodata=None) -> DataFrame:
    return tile_stats(tiles, nodata).select("tile_avg")


def tile_max(tiles: DataFrame, nodata=None) -> DataFrame:
    return tile_stats(tiles, nodata).select("tile_max")


def tile_min(tiles: DataFrame, nodata=None) -> DataFrame:
    return tile_stats(tiles, nodata).select("tile_min")


def key_stats(df: DataFrame, keys, value: str) -> DataFrame:
    """Sum, count and mean of ``value`` by key."""
    return df.groupBy(*keys).agg(
        F.sum(value).alias("total"), F.count(value).alias("n"), F.avg(value).alias("mean")
    )


def count_tiles(tiles: DataFrame) -> DataFrame:
    """Number of tiles (a tile has many versions)."""
    return tiles.agg(F.count_distinct("tile_key").alias("n_tiles"))


def first_properties(tiles: DataFrame) -> DataFrame:
    """Properties of the first tile, by key, time and pollutant, as (name, value) rows."""
    first = tiles.select("tile_key", "ts", "pollutant", "props").orderBy("tile_key", "ts", "pollutant").limit(1)
    names = F.array(
        *[
            F.struct(F.lit(name).alias("name"), F.col(f"props.{name}").cast("double").alias("value"))
            for name in PROPS.fieldNames()
        ]
    )
    return first.select(F.inline(names))


# --- hierarchies ----------------------------------------------------------------------------


def _levels(dimension: str) -> tuple:
    if dimension not in HIERARCHIES:
        raise ValueError(f"unknown dimension {dimension!r}; use one of {sorted(HIERARCHIES)}")
    return HIERARCHIES[dimension]


def _level_position(dimension: str, level: str) -> int:
    levels = _levels(dimension)
    if level not in levels:
        raise ValueError(f"{level!r} is not a level of {dimension}; use one of {levels}")
    return levels.index(level)


def with_time_levels(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Add the columns hour, day, month and year as bucket text."""
    return df.withColumns({level: bucket_text(F.col(ts), level) for level in _levels("time")})


def _measures(value: str):
    return [
        F.sum(value).alias("total"),
        F.count(value).alias("n"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
    ]


_MERGED = ("total", "n", "low", "high")


def _merge():
    return [
        F.sum("total").alias("total"),
        F.sum("n").alias("n"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
    ]


def _with_mean(df: DataFrame) -> DataFrame:
    return df.withColumn("mean", F.when(F.col("n") > 0, F.col("total") / F.col("n")))


def _partials(df: DataFrame, keys, value: str, places: DataFrame = None, on: str = None) -> DataFrame:
    """total, n, low, high by key. Where some keys are columns of ``places``, facts are summed by
    the join column first and joined after: what is shuffled is one row per key and task, however
    many facts one place has."""
    if places is None:
        return df.groupBy(*keys).agg(*_measures(value))
    own = [k for k in keys if k not in places.columns]
    summed = df.groupBy(*own, on).agg(*_measures(value))
    return summed.join(places, on).groupBy(*keys).agg(*_merge())


def summarize(df: DataFrame, keys, value: str, places: DataFrame = None, on: str = None) -> DataFrame:
    """total, n, low, high and mean of ``value`` by key."""
    return _with_mean(_partials(df, keys, value, places, on))


def coarser_levels(dimension: str, level: str) -> list:
    """The level above ``level`` and all above it, coarse to fine."""
    above = _levels(dimension)[_level_position(dimension, level) + 1 :]
    if not above:
        raise ValueError(f"{level!r} is already the top level of {dimension}")
    return list(reversed(above))


def roll_up(
    df: DataFrame, dimension: str, level: str, value: str, places: DataFrame = None, on: str = None
) -> DataFrame:
    """From data at ``level`` one step up: grouped by the next coarser level and its ancestors.

    The levels are columns of ``df``, or of ``places``, a table with one row per ``on``.
    """
    return summarize(df, coarser_levels(dimension, level), value, places, on)


def drill_down(
    df: DataFrame, dimension: str, level: str, member, value: str, places: DataFrame = None, on: str = None
) -> DataFrame:
    """One step down from one member of ``level``: grouped by the next finer level."""
    position = _level_position(dimension, level)
    if position == 0:
        raise ValueError(f"{level!r} is already the finest level of {dimension}")
    finer = _levels(dimension)[position - 1]
    chosen = F.col(level) == member
    if places is None:
        return summarize(df.where(chosen), [level, finer], value)
    return summarize(df, [level, finer], value, places.where(chosen), on)


def roll_up_all(df: DataFrame, hierarchies, value: str, places: DataFrame = None, on: str = None) -> DataFrame:
    """All levels at once. ``hierarchies`` is a list of column lists, each coarse to fine; with
    several, every level of one meets every level of the others.

    Facts are summed at the finest level first, so the row multiplication of grouping sets acts
    on that much smaller result, never on facts. ``grouping_id`` tells the level of a row.
    """
    return _all_levels(_partials(df, _leaves(hierarchies), value, places, on), hierarchies)


def _leaves(hierarchies) -> list:
    return [c for h in hierarchies for c in h]


def _all_levels(partial: DataFrame, hierarchies) -> DataFrame:
    """Every level of each hierarchy with every level of the others, from sums at the finest."""
    sets = [
        [F.col(c) for part in choice for c in part]
        for choice in product(*[[h[:i] for i in range(len(h), -1, -1)] for h in hierarchies])
    ]
    levels = partial.groupingSets(sets, *[F.col(c) for c in _leaves(hierarchies)]).agg(
        F.grouping_id().cast("bigint").alias("grouping_id"), *_merge()
    )
    return _with_mean(levels)


# --- stored partial states --------------------------------------------------------------------

# What is asked of states is merged from a row per tile, pollutant and (UTC) day; no cells are read.


def state_pattern(states: DataFrame, level: str, weighted: bool = False) -> DataFrame:
    """``time_pattern`` by day, month, season, year or all, from partial states."""
    if time_level(level) == "hour":
        raise ValueError("states are kept by day; ask the tiles for hours")
    total, n = ("cell_total", "cell_count") if weighted else ("mean_total", "n_valid")
    buckets = states.groupBy(bucket_start(F.col("day").cast("timestamp"), level).alias("start")).agg(
        F.try_divide(F.sum(total), F.sum(n)).alias("mean")
    )
    return buckets.select(bucket_text(F.col("start"), level).alias("bucket"), "mean").orderBy("bucket")


def state_stats(states: DataFrame, by=()) -> DataFrame:
    """``tile_stats`` from partial states, over all of them or by some of their columns."""
    return states.groupBy(*by).agg(
        F.try_divide(F.sum("mean_total"), F.sum("n_valid")).alias("tile_avg"),
        F.max("high").alias("tile_max"),
        F.min("low").alias("tile_min"),
        F.sum("n_versions").alias("n_versions"),
    )


def roll_up_states(states: DataFrame, hierarchies, places: DataFrame = None, on: str = "region_no") -> DataFrame:
    """``roll_up_all`` over all valid cells, from partial states.

    Levels may be year, month and day, region_no and province_no, pollutant, and columns of ``places``,
    a table with one row per region. States are merged by region before they are joined with it.
    """
    day = F.col("day").cast("timestamp")
    leveled = states.withColumns({level: bucket_text(day, level) for level in ("year", "month", "day")}).withColumns(
        {"region_no": key_region(F.col("tile_key")), "province_no": F.floor(key_region(F.col("tile_key")) / CITY_STEP)}
    )
    facts = leveled.withColumns({"total": F.col("cell_total"), "n": F.col("cell_count")})
    leaves = _leaves(hierarchies)
    if places is not None:
        own = [c for c in leaves if c not in places.columns or c == on]
        facts = facts.groupBy(*dict.fromkeys([*own, on])).agg(*_merge()).join(places, on)
    return _all_levels(facts.groupBy(*leaves).agg(*_merge()), hierarchies)
