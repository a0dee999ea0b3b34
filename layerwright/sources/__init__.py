from layerwright.sources.landing import RAGGED, UNPARSED, landing_schema, ragged_per_file, read_landing, read_text, typed
from layerwright.sources.layers import MissingPartition, read_partition, write_partitioned
from layerwright.sources.versions import publish, read_table, run_folder
from layerwright.sources.workspace import Staged, shared_folder, stage, staging

__all__ = [
    "RAGGED",
    "UNPARSED",
    "MissingPartition",
    "Staged",
    "landing_schema",
    "publish",
    "ragged_per_file",
    "read_landing",
    "read_partition",
    "read_table",
    "read_text",
    "run_folder",
    "shared_folder",
    "stage",
    "staging",
    "typed",
    "write_partitioned",
]
