"""Pipe sizes and slopes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Standard pipe diameters in millimetres.
DIAMETERS = (100, 150, 200, 250, 300, 375, 450, 525, 600, 675, 750, 900, 1050, 1200, 1350, 1500, 1650, 1800)


def standard_diameter(value: Column) -> Column:
    """The nearest standard size, the smaller one of two that are as near; 0 for nothing or less, the smallest for no number."""
    nearest = F.when(value.isNull() | F.isnan(value), float(DIAMETERS[0])).when(value <= 0, 0.0)
    for size, larger in zip(DIAMETERS, DIAMETERS[1:]):
        # Numbers so large that all sizes are as near count as near to the smallest one.
        nearest = nearest.when((value <= (size + larger) / 2) | (value - size == value - DIAMETERS[-1]), float(size))
    return nearest.otherwise(float(DIAMETERS[-1]))


def percent_slope(value: Column) -> Column:
    """A slope in percent: more than 10 is taken as per mille, once."""
    return F.when(value > 10, value / 10).otherwise(value)
