"""Column expressions: built-in Spark functions only, so they stay in generated code."""

from layerwright.functions.aggregates import (
    count_where,
    mean_where,
    percent,
    percent_or_zero,
    rounded_mean,
    stddev_where,
)
from layerwright.functions.casting import parse
from layerwright.functions.choice import band, label, value_for_year
from layerwright.functions.hashing import record_hash
from layerwright.functions.numbers import fill_number, half_up
from layerwright.functions.text import clean_text, fill_text

__all__ = [
    "band",
    "clean_text",
    "count_where",
    "fill_number",
    "fill_text",
    "half_up",
    "label",
    "mean_where",
    "parse",
    "percent",
    "percent_or_zero",
    "record_hash",
    "rounded_mean",
    "stddev_where",
    "value_for_year",
]
