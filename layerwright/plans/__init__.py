from layerwright.plans.facts import (
    area_dimension,
    area_target_fact,
    area_target_rows,
    state_target_fact,
    state_target_rows,
    student_fact,
)
from layerwright.plans.marts import (
    area_targets,
    level_distribution,
    level_sums,
    levels_of,
    school_statistics,
    school_sums,
    schools_of,
    state_targets,
    student_features,
)
from layerwright.plans.months import add_month
from layerwright.plans.runs import Layout, RunFailed, TableRun, read_conformed, report_frame, run_bronze, run_gold, run_silver

__all__ = [
    "Layout",
    "RunFailed",
    "TableRun",
    "add_month",
    "area_dimension",
    "area_target_fact",
    "area_target_rows",
    "area_targets",
    "level_distribution",
    "level_sums",
    "levels_of",
    "read_conformed",
    "report_frame",
    "run_bronze",
    "run_gold",
    "run_silver",
    "school_statistics",
    "school_sums",
    "schools_of",
    "state_target_fact",
    "state_target_rows",
    "state_targets",
    "student_fact",
    "student_features",
]
