"""Small numeric column helpers shared by every operator."""

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def rnd(value: Column, digits: int) -> Column:
    """Round half to even on the scaled value; the trailing ``+ 0.0`` removes negative zero."""
    scale = F.lit(float(10**digits))
    return F.rint(value * scale) / scale + F.lit(0.0)


def flag(condition: Column) -> Column:
    """0/1 integer where an unknown condition counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def at_least(value: Column, floor: float | int) -> Column:
    """Lower clip that keeps null (``greatest`` alone would turn null into the floor)."""
    return F.when(value.isNotNull(), F.greatest(value, F.lit(floor)))


def total(columns) -> Column:
    return reduce(add, columns)


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def to_double(text: Column) -> Column:
    """Number from text; anything unreadable, and NaN, becomes null."""
    return nan_to_null(text.try_cast("double"))


def to_int(text: Column) -> Column:
    return to_double(text).try_cast("int")
