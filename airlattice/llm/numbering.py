"""Running totals over a table in a given order, without bringing it into one task."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from airlattice.llm.common import stage


def running_total(df: DataFrame, order: list[Column], weight: Column, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``weight`` over all rows before it in ``order``.

    The bounds of the ranges are sampled from the rows, so these are written first, not computed
    twice. Rows are dealt by range and written, so that their parts stay what they are; the parts'
    totals (one row each) are summed, and within a part a window does the rest.
    """
    df = stage(df, "rows")
    parts = stage(df.withColumn("__w", weight).repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    totals = parts.groupBy("__part").agg(F.sum("__w").alias("__sum"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    inside = W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    counted = parts.withColumn("__in", F.coalesce(F.sum("__w").over(inside), F.lit(0)))
    joined = counted.join(totals, "__part").withColumn(name, F.col("__base") + F.col("__in"))
    return joined.drop("__part", "__w", "__in", "__base")
