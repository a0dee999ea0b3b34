"""Casts that give NULL instead of raising, whatever the ANSI setting."""

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, DoubleType, FloatType, StringType

WHOLE_NUMBERS = ("int", "bigint")


def parse(c: Column, have: DataType, want: str) -> Column:
    """Cast ``c``, which has type ``have``, to ``want``; a value that does not fit becomes NULL.

    Text holding a fraction is cut to its whole part, and text flags follow their number.
    """
    fractional = isinstance(have, (DoubleType, FloatType, DecimalType))
    if have.simpleString() == want:
        return c
    if isinstance(have, StringType):
        if want in WHOLE_NUMBERS:
            return F.coalesce(c.try_cast(want), c.try_cast("double").try_cast(want))
        if want == "boolean":
            return F.coalesce(c.try_cast("boolean"), c.try_cast("double") != 0)
    if want in WHOLE_NUMBERS and fractional:
        return c.try_cast("double").try_cast(want)
    return c.try_cast(want)
