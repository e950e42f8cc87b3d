"""Roll-up and drill-down along time and space."""

from pyspark.sql import functions as F

from airlattice.operators import olap
from airlattice.registry import standins as st

# Fixed values of the questions asked.
MONTH = "1998-03"

# Amounts have two decimals, so means often lie just between two rounded values; this decides
# such ties upward, whatever the order of summation.
TIE = 0.00000037

TIME = ["year", "month", "day"]
SPACE = ["country", "province", "city"]


def _rounded(df, *keys):
    return df.select(
        *keys, F.round("total", 2).alias("total"), "n", F.round("low", 2).alias("low"),
        F.round("high", 2).alias("high"), F.round(F.col("mean") + TIE, 4).alias("mean"),
    )


def order_facts(spark, sf_dir):
    orders = st.table(spark, sf_dir, "orders").withColumn("ts", F.col("o_orderdate").cast("timestamp"))
    return olap.with_time_levels(orders)


def places(spark, sf_dir):
    """Country, province and city of every customer."""
    customer, nation, region = (st.table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
        region, F.col("n_regionkey") == F.col("r_regionkey")
    ).select(
        F.col("c_custkey").alias("o_custkey"), F.lit("world").alias("country"),
        F.col("r_name").alias("province"), F.col("n_name").alias("city"),
    )


def _by_place(operator, *question):
    """An operator over orders whose levels are those of their customer."""

    def ask(spark, sf_dir):
        return operator(order_facts(spark, sf_dir), *question, "o_totalprice", places(spark, sf_dir), "o_custkey")

    return ask


def rollup_time(spark, sf_dir):
    return _rounded(olap.roll_up_all(order_facts(spark, sf_dir), [TIME], "o_totalprice"), *TIME, "grouping_id")


def rollup_space(spark, sf_dir):
    return _rounded(_by_place(olap.roll_up_all, [SPACE])(spark, sf_dir), *SPACE, "grouping_id")


def cube_time_space(spark, sf_dir):
    both = _by_place(olap.roll_up_all, [["year", "month"], ["province", "city"]])(spark, sf_dir)
    return _rounded(both, "year", "month", "province", "city", "grouping_id")


def rollup_tiles(spark, sf_dir):
    """Tile means by hour, day, month and year at once."""
    facts = olap.with_time_levels(olap.tile_means(st.hour_tiles(spark, sf_dir)))
    levels = olap.roll_up_all(facts, [["year", "month", "day", "hour"]], "tile_mean")
    return levels.select(
        "year", "month", "day", "hour", "grouping_id", "n", F.round("total", 5).alias("total"), F.round("mean", 6).alias("mean")
    )


def roll_up_step(spark, sf_dir):
    """From days one step up to months."""
    return _rounded(olap.roll_up(order_facts(spark, sf_dir), "time", "day", "o_totalprice"), "year", "month")


def roll_up_cities(spark, sf_dir):
    """From cities one step up to provinces."""
    return _rounded(_by_place(olap.roll_up, "space", "city")(spark, sf_dir), "country", "province")


def drill_down_time(spark, sf_dir):
    """The days of one month."""
    return _rounded(olap.drill_down(order_facts(spark, sf_dir), "time", "month", MONTH, "o_totalprice"), "month", "day")


def drill_down_space(spark, sf_dir):
    """The cities of one province."""
    return _rounded(_by_place(olap.drill_down, "space", "province", "ASIA")(spark, sf_dir), "province", "city")


_FACTS_SQL = """facts AS (
  SELECT o_totalprice AS v, strftime(o_orderdate, '%Y') AS year, strftime(o_orderdate, '%Y-%m') AS month,
         strftime(o_orderdate, '%Y-%m-%d') AS day, 'world' AS country, r_name AS province, n_name AS city
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""
_MEASURES_SQL = (
    "round(sum(v), 2) AS total, count(v) AS n, round(min(v), 2) AS low, round(max(v), 2) AS high, round(avg(v) + 0.00000037::DOUBLE, 4) AS mean"
)
_ALL_ORDERS_SQL = """facts AS (
  SELECT o_totalprice AS v, strftime(o_orderdate, '%Y') AS year, strftime(o_orderdate, '%Y-%m') AS month,
         strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders)"""


def _levels_sql(facts, columns, group):
    names = ", ".join(columns)
    return f"WITH {facts} SELECT {names}, GROUPING({names})::BIGINT AS grouping_id, {_MEASURES_SQL} FROM facts GROUP BY {group}"


QUERIES = {
    "rollup_time": (rollup_time, _levels_sql(_ALL_ORDERS_SQL, TIME, "ROLLUP (year, month, day)")),
    "rollup_space": (rollup_space, _levels_sql(_FACTS_SQL, SPACE, "ROLLUP (country, province, city)")),
    "cube_time_space": (
        cube_time_space,
        _levels_sql(_FACTS_SQL, ["year", "month", "province", "city"], "ROLLUP (year, month), ROLLUP (province, city)"),
    ),
    "rollup_tiles": (
        rollup_tiles,
        f"""WITH {st.hour_tiles_sql()}, {st.TILE_MEAN_SQL}, facts AS (
  SELECT tile_mean, strftime(ts, '%Y') AS year, strftime(ts, '%Y-%m') AS month, strftime(ts, '%Y-%m-%d') AS day,
         strftime(ts, '%Y-%m-%d %H') AS hour FROM means)
SELECT year, month, day, hour, GROUPING(year, month, day, hour)::BIGINT AS grouping_id, count(tile_mean) AS n,
       round(sum(tile_mean), 5) AS total, round(avg(tile_mean), 6) AS mean
FROM facts GROUP BY ROLLUP (year, month, day, hour)""",
    ),
    "roll_up_step": (
        roll_up_step,
        f"WITH {_ALL_ORDERS_SQL} SELECT year, month, {_MEASURES_SQL} FROM facts GROUP BY year, month",
    ),
    "roll_up_cities": (
        roll_up_cities,
        f"WITH {_FACTS_SQL} SELECT country, province, {_MEASURES_SQL} FROM facts GROUP BY country, province",
    ),
    "drill_down_time": (
        drill_down_time,
        f"WITH {_ALL_ORDERS_SQL} SELECT month, day, {_MEASURES_SQL} FROM facts WHERE month = '{MONTH}' GROUP BY month, day",
    ),
    "drill_down_space": (
        drill_down_space,
        f"WITH {_FACTS_SQL} SELECT province, city, {_MEASURES_SQL} FROM facts WHERE province = 'ASIA' GROUP BY province, city",
    ),
}
