"""Functions over the cell array of one tile."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def nodata_of(nodata=None, props: str = "props") -> Column:
    """The missing-cell marker as FLOAT, the type of the cells it is compared with."""
    marker = F.col(f"{props}.nodata") if nodata is None else F.lit(nodata)
    return marker.cast("float")


def valid_cells(data: Column, nodata: Column) -> Column:
    """Cells other than the marker; every cell is valid when there is no marker."""
    return F.when(nodata.isNull(), data).otherwise(F.array_remove(data, nodata))


def valid_count(data: Column, nodata: Column) -> Column:
    return F.size(valid_cells(data, nodata))


def valid_sum(data: Column, nodata: Column) -> Column:
    return F.aggregate(valid_cells(data, nodata), F.lit(0.0), lambda total, v: total + v)


def valid_max(data: Column, nodata: Column) -> Column:
    return F.array_max(valid_cells(data, nodata)).cast("double")


def valid_min(data: Column, nodata: Column) -> Column:
    return F.array_min(valid_cells(data, nodata)).cast("double")


def valid_mean(data: Column, nodata: Column) -> Column:
    """Mean of the valid cells in DOUBLE; NULL for a tile without any.

    Count and sum are both always needed, so the filtered array is made once for the two.
    """
    return F.try_divide(valid_sum(data, nodata), valid_count(data, nodata))
