"""Hilbert curve numbering of grid positions as column expressions.

The curve is walked one bit level at a time by folding over the powers of two below the curve
size; a level costs one lambda call, and a curve of 256 x 256 positions has eight.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def curve_size(rows: Column, cols: Column) -> Column:
    """Least power of two, at least 2, that covers both counts (from the bit length, in integers)."""
    bits = F.length(F.bin(F.greatest(rows, cols).cast("bigint") - 1))
    return F.expr("1L") * F.pow(F.lit(2), bits).cast("bigint")


def _levels(n: Column) -> Column:
    """[1, 2, 4, ... n/2]"""
    bits = F.length(F.bin(n)) - 1
    return F.transform(F.sequence(F.lit(0), bits - 1), lambda i: F.pow(F.lit(2), i).cast("bigint"))


def _turn(x: Column, y: Column, side: Column, right: Column, upper: Column):
    """Orientation of the curve in one quadrant: upper ones keep the axes, lower ones swap
    them, and the lower right one is mirrored as well."""
    keep = upper == 1
    mirror = right == 1
    new_x = F.when(keep, x).when(mirror, side - 1 - y).otherwise(y)
    new_y = F.when(keep, y).when(mirror, side - 1 - x).otherwise(x)
    return new_x, new_y


def hilbert_code(x: Column, y: Column, n: Column) -> Column:
    """Position (x, y), both from 0, to its number along the curve of size n."""

    def step(acc, side):
        right = (acc["x"].bitwiseAND(side) > 0).cast("bigint")
        upper = (acc["y"].bitwiseAND(side) > 0).cast("bigint")
        quadrant = (right * 3).bitwiseXOR(upper)
        new_x, new_y = _turn(acc["x"], acc["y"], side, right, upper)
        return F.struct(
            (acc["d"] + side * side * quadrant).alias("d"), new_x.alias("x"), new_y.alias("y")
        )

    start = F.struct(
        F.lit(0).cast("bigint").alias("d"),
        x.cast("bigint").alias("x"),
        y.cast("bigint").alias("y"),
    )
    return F.aggregate(F.reverse(_levels(n)), start, step, lambda acc: acc["d"])


def hilbert_xy(code: Column, n: Column) -> Column:
    """Number along the curve to STRUCT<x, y>."""

    def step(acc, side):
        half = F.shiftright(acc["t"], 1)
        right = half.bitwiseAND(F.expr("1L"))
        upper = acc["t"].bitwiseXOR(right).bitwiseAND(F.expr("1L"))
        new_x, new_y = _turn(acc["x"], acc["y"], side, right, upper)
        return F.struct(
            F.shiftright(acc["t"], 2).alias("t"),
            (new_x + side * right).alias("x"),
            (new_y + side * upper).alias("y"),
        )

    zero = F.lit(0).cast("bigint")
    start = F.struct(code.cast("bigint").alias("t"), zero.alias("x"), zero.alias("y"))
    return F.aggregate(
        _levels(n), start, step, lambda acc: F.struct(acc["x"].alias("x"), acc["y"].alias("y"))
    )


def curve_intervals(n: Column, x_first: Column, x_last: Column, y_first: Column, y_last: Column) -> Column:
    """ARRAY<STRUCT<low, high>>: the curve codes of the positions with x and y within the bounds (all
    included), as maximal intervals in ascending order.

    Quadrant descent: squares of the curve are looked at from the whole grid down. A square within the
    bounds is one interval, one outside goes, and only those across an edge are quartered, in the
    order of the curve; so the work grows with the edges of the rectangle, not with its area.
    """
    # A square: its first code, its corner, and how the curve runs in it: whether x and y are swapped
    # and whether they are mirrored.
    number = lambda v: F.lit(v).cast("bigint")

    def square(code, x, y, swap, mirror):
        return F.struct(code.alias("code"), x.alias("x"), y.alias("y"), swap.alias("swap"), mirror.alias("mirror"))

    def quarters(one: Column, half: Column) -> Column:
        """The four quadrants, in the curve's order. In a square as the whole grid is, it runs lower left
        (turned), upper left, upper right, lower right (turned the other way)."""
        parts = []
        for place, (right, upper) in enumerate(((0, 0), (0, 1), (1, 1), (1, 0))):
            # undo the square's own turn: first the swap, then the mirror
            a = F.when(one["swap"], number(upper)).otherwise(number(right))
            b = F.when(one["swap"], number(right)).otherwise(number(upper))
            a = F.when(one["mirror"], 1 - a).otherwise(a)
            b = F.when(one["mirror"], 1 - b).otherwise(b)
            swap = ~one["swap"] if upper == 0 else one["swap"]
            mirror = ~one["mirror"] if (right, upper) == (1, 0) else one["mirror"]
            parts.append(square(one["code"] + place * half * half, one["x"] + a * half, one["y"] + b * half, swap, mirror))
        return F.array(*parts)

    def step(acc: Column, half: Column) -> Column:
        """Quarter all open squares, of side 2 * half, and tell their quarters apart."""
        parts = F.flatten(F.transform(acc["open"], lambda one: quarters(one, half)))
        touched = F.filter(parts, lambda p: (p["x"] <= x_last) & (p["x"] + half > x_first) & (p["y"] <= y_last) & (p["y"] + half > y_first))
        inside = lambda p: (p["x"] >= x_first) & (p["x"] + half - 1 <= x_last) & (p["y"] >= y_first) & (p["y"] + half - 1 <= y_last)
        whole = F.transform(F.filter(touched, inside), lambda p: F.struct(p["code"].alias("low"), (p["code"] + half * half - 1).alias("high")))
        return F.struct(F.filter(touched, lambda p: ~inside(p)).alias("open"), F.concat(acc["done"], whole).alias("done"))

    start = F.struct(
        F.array(square(number(0), number(0), number(0), F.lit(False), F.lit(False))).alias("open"),
        F.array().cast("array<struct<low:bigint,high:bigint>>").alias("done"),
    )
    found = F.aggregate(F.reverse(_levels(n)), start, step, lambda acc: F.array_sort(acc["done"]))
    return joined_intervals(found)


def joined_intervals(intervals: Column) -> Column:
    """Ascending intervals with neighbours joined that leave no code between them."""

    def step(acc: Column, one: Column) -> Column:
        last = F.element_at(acc, -1)
        longer = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["low"].alias("low"), one["high"].alias("high"))))
        near = F.try_element_at(acc, F.lit(-1))["high"] + 1 >= one["low"]
        return F.when(F.size(acc) == 0, F.array(one)).when(near, longer).otherwise(F.concat(acc, F.array(one)))

    return F.aggregate(intervals, F.array().cast("array<struct<low:bigint,high:bigint>>"), step)
