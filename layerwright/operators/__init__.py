"""Operators: functions from DataFrames to DataFrames that know nothing of a domain."""

from layerwright.operators.changes import changes
from layerwright.operators.conform import conform, select_by_prefix
from layerwright.operators.dedup import dedup_by_key, find_repeats, first_per_key
from layerwright.operators.groups import group_means, share_of_total, with_group_mean, with_target_gap
from layerwright.operators.lineage import RunStamp, add_lineage
from layerwright.operators.lookup import lookup_all, lookup_join, measure
from layerwright.operators.quality import QualityError, evaluate, gate, quality_report

__all__ = [
    "changes",
    "QualityError",
    "RunStamp",
    "add_lineage",
    "conform",
    "dedup_by_key",
    "evaluate",
    "find_repeats",
    "first_per_key",
    "gate",
    "group_means",
    "lookup_all",
    "lookup_join",
    "measure",
    "quality_report",
    "select_by_prefix",
    "share_of_total",
    "with_group_mean",
    "with_target_gap",
]
