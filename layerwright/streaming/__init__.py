from layerwright.streaming.increment import compact_month, ingest_new_files, land_increment
from layerwright.streaming.ledger import read_ledger

__all__ = ["compact_month", "ingest_new_files", "land_increment", "read_ledger"]
