"""Drawing units as factors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .text import lookup


def metres_per_unit(code: Column) -> Column:
    return F.coalesce(lookup(code, K.UNIT_METRES), F.lit(1.0))


def sqft_per_unit(code: Column) -> Column:
    return F.coalesce(lookup(code, K.UNIT_SQFT), F.lit(K.DEFAULT_SQFT))


def feet_per_unit(code: Column) -> Column:
    """Feet by the square root of the area factor."""
    return F.sqrt(sqft_per_unit(code))


def feet_per_unit_v1(code: Column) -> Column:
    return F.coalesce(lookup(code, K.UNIT_FEET), F.lit(1.0))


def sqft_per_unit_v1(code: Column) -> Column:
    feet = feet_per_unit_v1(code)
    return feet * feet
