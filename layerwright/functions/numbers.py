from pyspark.sql import Column
from pyspark.sql import functions as F


def fill_number(c: Column, value: float, floating: bool = True) -> Column:
    """Replace NULL, and NaN in a floating column, by ``value``."""
    known = F.nanvl(c, F.lit(None).cast("double")) if floating else c
    return F.coalesce(known, F.lit(float(value) if floating else int(value)))


def half_up(c: Column, digits: int = 2) -> Column:
    """Round half away from zero on the printed decimal value."""
    return F.round(c, digits)
