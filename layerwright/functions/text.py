from pyspark.sql import Column
from pyspark.sql import functions as F

STYLES = {
    "trim": lambda c: F.trim(c),
    "upper": lambda c: F.upper(F.trim(c)),
    "title": lambda c: F.initcap(F.trim(c)),
}


def clean_text(c: Column, style: str) -> Column:
    """Strip outer spaces (not tabs), then upper-case or capitalise each word if asked."""
    return STYLES[style](c)


def fill_text(c: Column, value: str) -> Column:
    return F.coalesce(c, F.lit(value))
